"""Map layers: contracts, duplicate lines across sheets, touching polygons, ids, sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rillwise.functions import shapes
from rillwise.functions.geo import segment_distance
from rillwise.operators.graph import connected_components, group_links
from rillwise.operators.spatial import reached_cells, segment_cells
from rillwise.store import saved

DUPLICATE_M = 3.0


def load_layer(df: DataFrame, types: list[str], crs: str = "EPSG:4326") -> tuple[DataFrame, DataFrame]:
    """(rows with a usable geometry, one status row): ERROR for another crs or an unexpected geometry type, MISSING without rows. Never raises."""
    usable = df.filter("geom_type is not null and coords is not null and size(coords) > 0")
    n = df.agg(F.count("*").alias("rows"), F.count_if(F.col("geom_type").isNull() | F.col("coords").isNull() | (F.size("coords") <= 0)).alias("dropped"), F.count_if(~F.col("geom_type").isin(*types)).alias("unexpected"), F.count_if(F.col("crs") != crs).alias("wrong_crs"))
    status = F.when(F.col("rows") == 0, "MISSING").when((F.col("unexpected") > 0) | (F.col("wrong_crs") > 0), "ERROR").otherwise("LOADED")
    return usable, n.withColumn("status", status)


def rule_counts(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(check, severity, n): rows that break each rule, found in one pass; a rule is its severity and what a bad row fulfils."""
    n = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, (_, bad) in rules.items()])
    told = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.when(F.col(name) > 0, level).otherwise("OK").alias("severity"), F.col(name).alias("n")) for name, (level, _) in rules.items()])).alias("r")
    return n.select(told).select("r.*")


def drainage_rules() -> dict[str, tuple[str, Column]]:
    d, kind, ward = F.col("pipe_diameter_mm"), F.col("conduit_type"), F.col("ward")
    return {
        "diameter_range": ("ERROR", ~d.between(100, 3000)),
        "conduit_type": ("ERROR", kind.isNull() | ~kind.isin("pipe", "box_sewer", "drain")),
        "diameter_without_source": ("ERROR", d.isNotNull() & F.col("diameter_source").isNull()),
        "source_without_diameter": ("ERROR", d.isNull() & F.col("diameter_source").isNotNull()),
        "ward_range": ("ERROR", ward.isNull() | ~ward.between(1, 144)),
        "unknown_diameter": ("WARN", d.isNull()),
    }


def unknown_share(df: DataFrame, length: Column, value: str, warn: float = 0.25) -> DataFrame:
    """Share of the length whose value is unknown, and whether that is a warning."""
    share = F.sum(F.when(F.col(value).isNull(), length).otherwise(0.0)) / F.sum(length)
    return df.agg(F.round(share, 4).alias("unknown"), (share > warn).alias("warning"))


def sheet_rank(df: DataFrame, sheet: str, order: str) -> DataFrame:
    """(sheet, rank): sheets by their first row."""
    first = df.groupBy(sheet).agg(F.min(order).alias("_first"))
    return first.withColumn("rank", F.dense_rank().over(W.orderBy("_first"))).drop("_first")  # one row for each sheet


def _covered_vertices(vertices: DataFrame, sides: DataFrame, asked: DataFrame, tol: float) -> DataFrame:
    """(a, b) of the asked ones where every vertex of line a lies closer than tol to a side of line b. Vertices meet only sides in their grid cell."""
    cell = 16.0 * tol
    low, high = [F.least(f"{c}0", f"{c}1") - tol for c in "xy"], [F.greatest(f"{c}0", f"{c}1") + tol for c in "xy"]
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    dealt = sides.withColumnRenamed("segment_id", "b").withColumn("_cx", cells(low[0], high[0])).withColumn("_cy", cells(low[1], high[1]))
    placed = asked.join(vertices.withColumnRenamed("segment_id", "a"), "a").withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    near = segment_distance(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])[0] < tol
    met = placed.join(dealt, ["b", "_cx", "_cy"]).filter(near).select("a", "b", "i", "n").distinct()
    return met.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("n").alias("n")).filter("met = n").select("a", "b")


def duplicate_pairs(lines: DataFrame, tol: float = DUPLICATE_M) -> DataFrame:
    """(later, earlier): lines whose discrete Hausdorff distance to a line of a sheet with a lower rank is less than tol.

    lines: segment_id, rank and line (array of x, y). Such lines have bounding boxes whose corners differ by less than tol, so
    they meet by the cell of the least corner; then every vertex of either must be closer than tol to some side of the other.
    """
    cell, corner = 4.0 * tol, lambda f, c: f(F.transform("line", lambda v: v[c]))
    boxed = lines.filter("size(line) > 1").select("segment_id", "rank", *[corner(f, c).alias(f"{n}{c}") for n, f in (("low", F.array_min), ("high", F.array_max)) for c in "xy"])
    later = boxed.select(*[F.col(c).alias(f"_{c}") for c in boxed.columns], F.floor(F.col("lowx") / cell).alias("_cx"), F.floor(F.col("lowy") / cell).alias("_cy"))
    earlier = reached_cells(boxed, F.col("lowx"), F.col("lowy"), F.col("lowx"), F.col("lowy"), tol, cell)
    close = F.col("_rank") > F.col("rank")
    for c in ("lowx", "lowy", "highx", "highy"):
        close &= F.abs(F.col(c) - F.col(f"_{c}")) < tol
    pairs = saved(later.join(earlier, ["_cx", "_cy"]).filter(close).select(F.col("_segment_id").alias("a"), F.col("segment_id").alias("b")), "line-pairs")
    asked = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = lines.join(asked.select(F.col("a").alias("segment_id")).distinct(), "segment_id")
    vertices = own.select("segment_id", F.size("line").alias("n"), F.posexplode("line").alias("i", "v")).select("segment_id", "n", "i", "v.x", "v.y")
    sides = own.select("segment_id", F.explode(shapes.sides(F.col("line"))).alias("e")).select("segment_id", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))
    covered = saved(_covered_vertices(vertices, sides, asked, tol), "covered-lines")
    both = pairs.join(covered, ["a", "b"]).join(covered.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    return both.select(F.col("a").alias("later"), F.col("b").alias("earlier"))


def dedupe_lines(lines: DataFrame, tol: float = DUPLICATE_M) -> DataFrame:
    """Lines but for those that duplicate an accepted line of an earlier sheet; parallels within a sheet stay.

    lines: segment_id (two sheets may give the same one), rank and line (array of x, y), or x0, y0, x1, y1 of lines of two vertices. A line is settled once all its earlier duplicates are: dropped if one of them was accepted. Rounds are as many as the longest chain.
    """
    known = F.struct("rank", "segment_id").alias("segment_id")
    if "line" in lines.columns:
        shaped = lines.select(known, "rank", "line")
    else:
        shaped = lines.select(known, "rank", F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in "01"]).alias("line"))
    pairs = saved(duplicate_pairs(shaped, tol), "duplicate-lines")
    dropped = None
    while not pairs.isEmpty():
        open_ = pairs.select("later").distinct()
        sure = pairs.join(open_.withColumnRenamed("later", "earlier"), "earlier", "left_anti").select("later").distinct()  # an earlier one is accepted
        sure = saved(sure, "dropped-lines")
        dropped = sure if dropped is None else dropped.unionByName(sure)
        rest = pairs.join(sure, "later", "left_anti").join(sure.withColumnRenamed("later", "earlier"), "earlier", "left_anti")
        pairs = saved(rest, "duplicate-lines")
    return lines if dropped is None else lines.join(dropped.select("later.*"), ["rank", "segment_id"], "left_anti")


def _meet(a: list, b: list, sign, least, greatest):
    """Whether edges (x0, y0, x1, y1) share a place: columns or arrays, with the functions for them."""
    side = lambda px, py, qx, qy, rx, ry: sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    A, B, C, D = a[:2], a[2:], b[:2], b[2:]
    boxes = (greatest(A[0], B[0]) >= least(C[0], D[0])) & (greatest(C[0], D[0]) >= least(A[0], B[0])) & (greatest(A[1], B[1]) >= least(C[1], D[1])) & (greatest(C[1], D[1]) >= least(A[1], B[1]))
    return boxes & (side(*A, *B, *C) * side(*A, *B, *D) <= 0) & (side(*C, *D, *A) * side(*C, *D, *B) <= 0)


def group_touching(edges: DataFrame, polygon: str, reach: float = 500.0) -> DataFrame:
    """(polygon, component): polygons whose edges meet, directly or through others. edges: polygon, x0, y0, x1, y1.

    Equal edges meet, so one stands for all of them, under the least polygon. Edges that meet share a place and so the cell (as wide as reach) that it lies in;
    links within a cell join what meets there, without all of its pairs.
    """
    ends = ["x0", "y0", "x1", "y1"]
    placed = " and ".join(f"coalesce(abs({c}) < double('inf'), false)" for c in ends)  # others meet nothing
    own = saved(edges.select(F.col(polygon).alias("u"), *ends, F.expr(placed).alias("_placed"), F.min(polygon).over(W.partitionBy(*ends)).alias("v")), "edges-of-polygons")
    dealt = segment_cells(own.filter("_placed and u = v").dropDuplicates(["u", *ends]), 1e-3, reach)
    met = group_links(dealt, ["_cx", "_cy"], "u", ends, lambda a, b: _meet(a, b, F.signum, F.least, F.greatest), lambda a, b: _meet(a, b, np.sign, np.minimum, np.maximum))
    return connected_components(met.unionByName(own.select("u", F.when(F.col("_placed"), F.col("v")).otherwise(F.col("u")).alias("v")))).select(F.col("node").alias(polygon), "component")


def bodies(polygons: DataFrame, components: DataFrame, polygon: str, sheet: str, ward: str) -> DataFrame:
    """(component, parts, sheets, wards): how many polygons each body has, and the distinct sheets and wards they come from, sorted."""
    some = lambda c: F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ",")  # noqa: E731  # as many as there are sheets or wards
    return polygons.join(components, polygon).groupBy("component").agg(F.count("*").alias("parts"), some(sheet).alias("sheets"), some(ward).alias("wards"))


def label_agreement(layer: DataFrame, labels: DataFrame, key: str, sheet: str, value: str) -> DataFrame:
    """(sheet, agree, disagree): rows whose value is that of their label, or another, where both are known."""
    met = layer.join(labels.select(key, F.col(value).alias("_label")), key).filter(F.col(value).isNotNull() & F.col("_label").isNotNull())
    return met.groupBy(sheet).agg(F.count_if(F.col(value) == F.col("_label")).alias("agree"), F.count_if(F.col(value) != F.col("_label")).alias("disagree"))


def assign_ids(df: DataFrame, prefix: Column, key: str, order: list[str]) -> DataFrame:
    """df with id: the prefix and a running number of five digits within the key.

    Rows are dealt by ranges of key and order and numbered within their range; each range starts where those before it
    have come to, so no task holds a whole key.
    """
    ranged = saved(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_key", "_r", before.alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(W.partitionBy(key, "_range").orderBy(*order)))
    n = (F.col("_own") + F.col("_before")).cast("string")
    numbered = own.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return numbered.select(*df.columns, F.concat(prefix, F.lpad(n, F.greatest(F.length(n), F.lit(5)), "0")).alias("id"))


def to_geojson_features(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One column `feature`: a JSON point feature for each row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def polygon_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One column `feature`: a JSON feature for each row of parts (parts of rings of x, y); a row of several parts is a MultiPolygon."""
    numbers = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda v: F.array(v["x"], v["y"]))))
    geometry = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    shape = F.when(F.size("parts") == 1, geometry("Polygon", numbers[0])).otherwise(geometry("MultiPolygon", numbers))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("feature"))


def report_json(checks: DataFrame) -> DataFrame:
    """One JSON report of (check, severity, n) rows: ok, and the checks by severity."""
    named = lambda level: F.array_sort(F.collect_list(F.when(F.col("severity") == level, F.col("check"))))
    return checks.agg((F.count_if(F.col("severity") == "ERROR") == 0).alias("ok"), named("ERROR").alias("errors"), named("WARN").alias("warnings")).select(F.to_json(F.struct("ok", "errors", "warnings")).alias("report"))


def invalid_polygons(edges: DataFrame, polygon: str, cell: float = 500.0) -> DataFrame:
    """(polygon, problem): "unclosed" if an end is left over, "short" with fewer than three edges, "self_intersection" where two edges cross.

    edges: polygon, x0, y0, x1, y1. Edges lie in all grid cells that they reach, so only those of one polygon and cell meet.
    Edges that only touch, as neighbours do, don't cross.
    """
    ends = edges.select(polygon, F.explode(F.array(*[F.struct(F.round(f"x{k}", 3).alias("x"), F.round(f"y{k}", 3).alias("y"), F.lit(d).alias("d")) for k, d in ((0, 1), (1, -1))])).alias("e"))
    unclosed = ends.groupBy(polygon, "e.x", "e.y").agg(F.sum("e.d").alias("d")).filter("d <> 0").select(polygon).distinct()
    short = edges.groupBy(polygon).agg(F.count("*").alias("n")).filter("n < 3").select(polygon)
    cells = lambda c: F.sequence(F.floor(F.least(f"{c}0", f"{c}1") / cell), F.floor(F.greatest(f"{c}0", f"{c}1") / cell))
    placed = edges.withColumn("_cx", F.explode(cells("x"))).withColumn("_cy", F.explode(cells("y")))
    other = placed.select(polygon, "_cx", "_cy", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    side = lambda px, py, qx, qy, rx, ry: F.signum((F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px)))
    a, b = ("x0", "y0", "x1", "y1"), ("bx0", "by0", "bx1", "by1")
    crossing = (side(*a, *b[:2]) * side(*a, *b[2:]) < 0) & (side(*b, *a[:2]) * side(*b, *a[2:]) < 0)
    crossed = placed.join(other, [polygon, "_cx", "_cy"]).filter(crossing).select(polygon).distinct()
    named = [df.select(polygon, F.lit(name).alias("problem")) for df, name in ((unclosed, "unclosed"), (short, "short"), (crossed, "self_intersection"))]
    return named[0].unionByName(named[1]).unionByName(named[2])
