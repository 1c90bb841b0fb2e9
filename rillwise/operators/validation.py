"""Validation of whole layers and training tables: rows that break each rule, with the first of them by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rillwise.functions import shapes
from rillwise.functions.geo import CITY_BOX, in_bbox
from rillwise.operators.checks import schema_diff

#: Ids listed for each rule; unique positives below which a model is a prototype; usual share of positives; share of rows with terrain.
LISTED = 25
FEW_POSITIVES = 30
POSITIVE_RATE = (0.005, 0.60)
TERRAIN_SHARE = 0.95


@dataclass(frozen=True)
class LayerSpec:
    """What a layer must hold. Coordinates are longitude (x) and latitude (y)."""

    id_column: str
    types: tuple[str, ...]
    required: tuple[str, ...] = ()
    non_null: tuple[str, ...] = ()
    box: tuple[float, float, float, float] = CITY_BOX
    min_length_m: float | None = None
    min_area_m2: float | None = None


def _row_rules(df: DataFrame, spec: LayerSpec) -> dict[str, Column]:
    kind, coords, parts = F.col("geom_type"), F.col("_vertices"), F.col("_parts")
    present = kind.isNotNull() & coords.isNotNull()
    usable = present & (F.size(coords) > 0)
    number = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    finite = F.forall(coords, lambda p: F.coalesce(number(p["x"]) & number(p["y"]), F.lit(False)))
    within = F.forall(coords, lambda p: in_bbox(p["y"], p["x"], spec.box))
    fine = usable & finite & within & kind.isin(*spec.types)
    rules = {f"null:{c}": F.col(c).isNull() for c in spec.non_null if c in df.columns}
    rules |= {"null_geometry": ~present, "empty_geometry": present & (F.size(coords) == 0), "geometry_type": usable & ~kind.isin(*spec.types), "not_finite": usable & ~finite, "outside": usable & finite & ~within}
    if spec.min_length_m is not None:
        rules["short"] = fine & (shapes.length_m(parts) < spec.min_length_m)
    if spec.min_area_m2 is not None:
        rules["tiny"] = fine & (shapes.area_m2(parts) < spec.min_area_m2)
    return rules


def validate_layer(df: DataFrame, spec: LayerSpec) -> DataFrame:
    """(check, n, items): rows that break each rule, and their first 25 ids. A rule that no row breaks has no line.

    df: the layer's columns with geom_type and parts (parts of rings of x, y) or, for shapes of one ring, coords (array of
    x, y). "missing:COLUMN" and "empty_layer" have no items. A row may break several rules. Of equal geometries, wherever
    their rings start and whichever way they go, all but the least id count; of equal ids all rows do. Length and area (less
    holes) are judged on rows that are otherwise fine. Nulls as ids are no duplicates.
    """
    spark, key = df.sparkSession, F.col(spec.id_column)
    df = df.withColumn("_parts", F.col("parts") if "parts" in df.columns else F.when(F.col("coords").isNotNull(), F.array(F.array("coords"))))
    df = df.withColumn("_vertices", shapes.vertices(F.col("_parts")))
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in _row_rules(df, spec).items()]), lambda c: c.isNotNull())
    rows = df.select(key.alias("id"), F.explode(broken).alias("check")).groupBy("check", "id").agg(F.count("*").alias("n"))
    again = df.filter(key.isNotNull()).groupBy(key.alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("check"), "id", "n")
    formed = df.filter("geom_type is not null and size(_vertices) > 0").groupBy(shapes.shape_key(F.col("_parts")).alias("shape"), key.alias("id")).agg(F.count("*").alias("n"))
    several = formed.groupBy("shape").agg(F.min("id").alias("first"), F.sum("n").alias("all")).filter("all > 1").drop("all")
    copies = formed.join(several, "shape").withColumn("n", F.col("n") - F.col("id").eqNullSafe(F.col("first")).cast("long")).filter("n > 0")
    faults = rows.unionByName(again).unionByName(copies.select(F.lit("duplicate_geometry").alias("check"), "id", "n"))
    # ids of a rule are counted before they are ranked, and ranks stop at the number listed
    ranked = faults.groupBy("check", "id").agg(F.sum("n").alias("n")).withColumn("_r", F.row_number().over(W.partitionBy("check").orderBy("id"))).filter(F.col("_r") <= LISTED)
    listed = ranked.groupBy("check").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("items"))
    told = faults.groupBy("check").agg(F.sum("n").alias("n")).join(listed, "check")
    gone = spark.createDataFrame([(f"missing:{c}", 1, None) for c in spec.required if c not in df.columns], "check string, n long, items string")
    empty = df.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("empty_layer").alias("check"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("items"))
    return told.unionByName(gone).unionByName(empty)


def validate_training(df: DataFrame, expected: list[str], positive_source: str, terrain: list[str]) -> DataFrame:
    """(check, severity, n) of the training rules that look at places: one shuffle by point_id, then counts.

    df: point_id, lat, lon, label, label_source and the terrain columns, a row for each scenario.
    """
    known = F.lit(True)
    for c in terrain:
        known &= F.col(c).isNotNull()
    wrong = (F.col("label") == 1) & ~F.col("label_source").eqNullSafe(F.lit(positive_source))
    places = df.groupBy("point_id").agg(
        F.count("*").alias("rows"), F.min("label").alias("label"), F.max("label").alias("label2"), F.count_if(wrong).alias("wrong"), F.count_if(~known).alias("gone"),
        F.count_if(~F.coalesce(in_bbox(F.col("lat"), F.col("lon")), F.lit(False))).alias("outside"), F.count_distinct("lat", "lon").alias("at"),
    )
    n = places.agg(
        F.count("*").alias("places"), F.sum("rows").alias("rows"), F.sum("wrong").alias("wrong"), F.sum("gone").alias("gone"), F.sum("outside").alias("outside"),
        F.count_if(F.col("label") != F.col("label2")).alias("two"), F.count_if(F.col("at") > 1).alias("moved"), F.count_if(F.col("label") == 1).alias("positives"),
    )
    rate = F.col("positives") / F.col("places")
    odd = schema_diff(df.limit(0), expected).count()  # names of columns, no rows
    rules = [
        ("columns", "ERROR", F.lit(odd) > 0, F.lit(odd)),
        ("label_source", "ERROR", F.col("wrong") > 0, F.col("wrong")),
        ("inconsistent_labels", "ERROR", F.col("two") > 0, F.col("two")),
        ("moved_points", "ERROR", F.col("moved") > 0, F.col("moved")),
        ("few_positives", "WARN", F.col("positives") < FEW_POSITIVES, F.col("positives")),
        ("positive_rate", "WARN", ~rate.between(*POSITIVE_RATE), F.col("positives")),
        ("outside", "ERROR", F.col("outside") > 0, F.col("outside")),
        ("terrain", "ERROR", 1 - F.col("gone") / F.col("rows") < TERRAIN_SHARE, F.col("gone")),
    ]
    told = F.array(*[F.struct(F.lit(name).alias("check"), F.when(bad, level).otherwise("OK").alias("severity"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for name, level, bad, c in rules])
    return n.select(F.explode(told).alias("r")).select("r.*")
