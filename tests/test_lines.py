"""Duplicate lines and ids against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwise.operators import drawings, layers, spatial
from rillwise.sources import readers

SCHEMA = "segment_id int, rank int, line array<struct<x:double,y:double>>"


def gap(p, a, b):
    p, a, d = np.array(p), np.array(a), np.array(b) - np.array(a)
    t = 0.0 if not d.any() else np.clip((p - a) @ d / (d @ d), 0, 1)
    return float(np.hypot(*(p - a - t * d)))


def hausdorff(a, b):
    far = lambda p, q: max(min(gap(v, s, e) for s, e in zip(q, q[1:])) for v in p)
    return max(far(a, b), far(b, a))


def by_hand(rows, tol):
    kept = []
    for i, rank, line in sorted(rows, key=lambda r: (r[1], r[0])):
        if len(line) < 2 or not any(r < rank and len(other) > 1 and hausdorff(line, other) < tol for _, r, other in kept):
            kept.append((i, rank, line))
    return {i for i, _, _ in kept}


def test_duplicates_of_polylines(spark):
    rng, rows, tol = np.random.default_rng(6), [], 3.0
    for family in range(14):
        base = np.cumsum(rng.uniform(-40, 40, (int(rng.integers(2, 9)), 2)), axis=0) + rng.uniform(-200, 200, 2)
        for rank in rng.integers(1, 6, 6):
            line = base + rng.uniform(-1, 1, 2) * rng.choice([0.5, 2.0, 3.5])
            if rng.random() < 0.4:  # more vertices on the same line
                k = int(rng.integers(1, len(line)))
                line = np.insert(line, k, (line[k - 1] + line[k]) / 2, axis=0)
            rows.append((len(rows), int(rank), [tuple(map(float, v)) for v in (line[::-1] if rng.random() < 0.5 else line)]))
    rows += [(900, 1, [(0.0, 0.0), (90.0, 0.0)]), (901, 2, [(0.0, 2.0), (90.0, 2.0)]), (902, 3, [(0.0, 4.0), (90.0, 4.0)]), (903, 2, [(0.0, 0.0), (45.0, 40.0), (90.0, 0.0)]), (904, 3, [(5.0, 5.0)]), (905, 4, [(5.0, 5.0)]), (906, 3, [(1.0, 0.0), (1.0, 0.0), (90.0, 0.0)])]
    got = {r[0] for r in layers.dedupe_lines(spark.createDataFrame(rows, SCHEMA), tol).select("segment_id").collect()}
    want = by_hand(rows, tol)
    assert got == want and len(want) < len(rows) - 20 and 902 in want and 901 not in want and 903 in want


def test_running_numbers_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(rng.choice([1, 2, 3], p=[0.8, 0.15, 0.05]))) for k in rng.permutation(3000)] + [(5000, None), (5001, None)]
    got = layers.assign_ids(spark.createDataFrame(rows, "n int, ward int").repartition(7), F.lit("w_"), "ward", ["n"]).collect()
    for ward in (1, 2, 3, None):
        own = sorted(r.n for r in got if r.ward == ward)
        assert {r.n: r.id for r in got if r.ward == ward} == {n: f"w_{i:05d}" for i, n in enumerate(own, 1)}


@pytest.mark.parametrize("folders", [True, False])
def test_sheets_in_order(spark, tmp_path, folders):
    spark.range(2).selectExpr("id", "1 as extra").coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    glob = str(tmp_path / "*.parquet")
    if not folders:
        (tmp_path / "flat").mkdir()
        for name in "ab":
            next((tmp_path / f"{name}.parquet").glob("part-*.parquet")).rename(tmp_path / "flat" / f"{name}.parquet")
        glob = str(tmp_path / "flat" / "*.parquet")
    read = readers.read_sheets(spark, glob)
    assert {(r.sheet, r.extra): r["count"] for r in read.groupBy("sheet", "extra").count().collect()} == {("a", None): 3, ("b", 1): 2}
    assert [(r.sheet, r["rank"]) for r in layers.sheet_rank(read, "sheet", "sheet").orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_a_frame_holds_a_point_on_its_rounded_side(spark):
    from rillwise.operators import drawings

    frames = spark.createDataFrame([("s", 1, 3.6 * k, 3.6 * k, 180.0) for k in range(0, 9000, 7)], "sheet string, frame int, cx double, cy double, side double")
    frames = frames.selectExpr("*", "cx - 5 * side as xmin", "cx + 5 * side as xmax", "cy - 5 * side as ymin", "cy + 5 * side as ymax").withColumn("frame", (frames.cx / 3.6).cast("int"))
    points = spark.createDataFrame([(k, "s", 3.6 * (k + 250), 3.6 * k) for k in range(0, 9000, 7)], "point_id int, sheet string, x double, y double")
    rule = "abs(x - cx) <= 5 * side and abs(y - cy) <= 5 * side"
    got = {r.point_id: r.frame for r in drawings.in_frames(points, frames, "sheet", holds=rule).collect()}
    want = {r.point_id: r.f for r in points.crossJoin(frames.drop("sheet")).filter(rule).groupBy("point_id").agg({"frame": "min"}).toDF("point_id", "f").collect()}
    assert got == {k: want.get(k) for k in got}
    assert got != {r.point_id: r.frame for r in drawings.in_frames(points, frames, "sheet").collect()}


def test_links_are_worked_out_once(spark):
    """Chains read their links several times; the pairs of ends behind them are formed once."""
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    dashes = spark.createDataFrame([(i, "L", 12.0 * i, 0.0, 12.0 * i + 8, 0.0) for i in range(6)], "dash_id long, layer string, x0 double, y0 double, x1 double, y1 double")
    links = drawings.link_endpoints(dashes, 5.0).withColumn("dash_id", F.udf(told, "long")("dash_id"))
    assert sorted((r.dash_id, r.chain, r.place, r.n) for r in drawings.build_chains(dashes, links).collect()) == [(i, 0, i, 6) for i in range(6)]
    assert seen.value == 10


def test_ends_and_arrows_lie_in_few_cells(spark, monkeypatch):
    """Of 900 places in cells four times as wide as the reach: some two cells each, not nine; the pairs are those of all places with all."""
    seen, real = [], spatial.reached_cells
    monkeypatch.setattr(spatial, "reached_cells", lambda *a: seen.append(real(*a)) or seen[-1])
    lines = spark.range(900).selectExpr("id as segment_id", "(id % 30) * 1.37 as x0", "(id div 30) * 1.21 as y0", "(id % 30) * 1.37 + 0.5 as x1", "(id div 30) * 1.21 + 0.3 as y1")
    arrows = lines.selectExpr("x0 + 0.4 as tx", "y0 - 0.45 as ty")
    got = {r.segment_id: r.flow for r in drawings.flow_direction(lines, arrows).collect()}
    places, tips = [(r.segment_id, r.x0, r.y0, r.x1, r.y1) for r in lines.collect()], [(r.tx, r.ty) for r in arrows.collect()]
    near = lambda x, y: any((x - a) ** 2 + (y - b) ** 2 <= 0.75**2 for a, b in tips)
    assert got == {i: "end" if near(c, d) else "start" if near(a, b) else "none" for i, a, b, c, d in places}
    assert len(seen) == 2 and all(s.count() < 3 * 900 for s in seen)


def test_records_of_a_group_lie_in_few_cells(spark, monkeypatch):
    """Outliers among 600 records of six groups as by all pairs; a record lies in some three cells, not nine."""
    from rillwise.functions.geo import geodesic_m
    from rillwise.operators import places

    seen, real = [], spatial.reached_cells
    monkeypatch.setattr(spatial, "reached_cells", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = spark.range(600).selectExpr("id as rec_id", "id % 6 as ward", "22.4 + (id * 37 % 601) / 601.0D * 0.3 as lat", "88.2 + (id * 101 % 599) / 599.0D * 0.3 as lon").withColumn("lat", F.when(F.col("rec_id") % 50 != 0, F.col("lat")))
    got = {(r.rec_id, r.no_majority) for r in places.consistency_outliers(rows, "ward", 2500.0).collect()}
    own = rows.filter("lat is not null")
    pairs = own.alias("a").join(own.alias("b"), "ward").filter(geodesic_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 2500)
    root = {r.rec_id: r.rec_id for r in own.collect()}
    ward = {r.rec_id: r.ward for r in own.collect()}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in pairs.select("a.rec_id", F.col("b.rec_id").alias("v")).collect():
        a, b = sorted((top(r.rec_id), top(r.v)))
        root[b] = a
    size = {}
    for i in root:
        size[ward[i], top(i)] = size.get((ward[i], top(i)), 0) + 1
    want = set()
    for i in root:
        most = max(n for (w, _), n in size.items() if w == ward[i])
        tie = sum(n == most for (w, _), n in size.items() if w == ward[i]) > 1
        if tie or size[ward[i], top(i)] < most:
            want.add((i, tie))
    assert got == want and len(want) > 10
    assert seen[0].count() < 4 * 588
