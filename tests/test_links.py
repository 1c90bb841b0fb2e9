"""Links within groups: the parts are those of all pairs, but not all pairs are formed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwise import plans
from rillwise.functions.geo import geodesic_m, geodesic_of
from rillwise.operators import graph, layers, places, spatial


def parts(n, meets):
    """The first thing of each thing's part, by all pairs."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if meets(i, j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(n)]


@pytest.fixture
def linked(monkeypatch):
    """Edges that components are asked for."""
    seen = []
    for module in (layers, places):
        monkeypatch.setattr(module, "connected_components", lambda edges, real=graph.connected_components: seen.append(edges.count()) or real(edges))
    return seen


def test_parts_of_a_group(monkeypatch):
    rng = np.random.default_rng(4)
    for tried in (1, 7, 200_000):
        monkeypatch.setattr(graph, "TRIED", tried)
        x = rng.uniform(0, 60, 50)
        met = np.abs(x[:, None] - x[None]) < 1
        assert graph._parted(50, lambda a, b: met[np.ix_(a, b)]).tolist() == parts(50, lambda i, j: met[i, j])
    assert graph._parted(0, None).tolist() == []


def test_crowded_polygons_touch_without_their_pairs(spark, linked):
    """Boxes that overlap, lie in each other, are equal or have no place: components as by all pairs, from some links a box."""
    rng = np.random.default_rng(8)
    boxes = [(float(x), float(y), float(s)) for (x, y), s in zip(rng.uniform(0, 900, (500, 2)), rng.choice([5, 40, 90, 300], 500))] + [(0.0, 0.0, float(s)) for s in range(1000, 1400, 4)] + [(9000.0, 10.0 * k, 4.0) for k in range(30)]
    boxes += boxes[:200]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "body_id long, cx double, cy double, side_m double")
    edges = spatial.box_edges(df, "body_id").unionByName(spark.createDataFrame([(5000, None, 1.0, None, 1.0), (5001, None, 1.0, None, 1.0)], "body_id long, x0 double, y0 double, x1 double, y1 double"))
    got = {r.body_id: r.component for r in layers.group_touching(edges, "body_id").collect()}
    x, y, s = np.array(boxes).T
    dx, dy, far, near = np.abs(x[:, None] - x), np.abs(y[:, None] - y), (s[:, None] + s) / 2, np.abs(s[:, None] - s) / 2
    met = (dx <= far) & (dy <= far) & ~((dx < near) & (dy < near))
    assert got == {**dict(enumerate(parts(len(boxes), lambda i, j: met[i, j]))), 5000: 5000, 5001: 5001}
    assert linked[0] < met.sum() / 4, (linked, met.sum())


def test_bodies_of_crowded_polygons(spark, linked):
    """300 boxes round one place and two apart make three bodies, from few links."""
    df = spark.range(302).selectExpr("id as body_id", "if(id < 300, id % 17 * 1.0D, id * 5000.0D) as cx", "id % 13 * 1.0D as cy", "100.0D as side_m", "concat('s', id % 3) as source_sheet", "cast(id % 4 as int) as ward")
    got = {tuple(r) for r in layers.bodies(df, layers.group_touching(spatial.box_edges(df, "body_id"), "body_id"), "body_id", "source_sheet", "ward").collect()}
    assert got == {(0, 300, "s0,s1,s2", "0,1,2,3"), (300, 1, "s0", "0"), (301, 1, "s1", "1")}
    assert linked[0] < 302 * 8


def test_clusters_of_crowded_records(spark, linked):
    """Records that crowd a ward, some at one place: outliers as by all pairs, from some links a site."""
    rng = np.random.default_rng(2)
    lat, lon = np.concatenate([rng.normal(22.5, 0.02, 500), np.full(40, 22.7), rng.uniform(22.3, 22.9, 60)]), np.concatenate([rng.normal(88.3, 0.02, 500), np.full(40, 88.5), rng.uniform(88.0, 88.7, 60)])
    df = spark.createDataFrame([(i, i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "rec_id int, ward int, lat double, lon double")
    pairs = df.alias("a").crossJoin(df.alias("b")).filter("a.ward = b.ward and a.rec_id < b.rec_id").filter(geodesic_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 2500)
    met = {(r[0], r[1]) for r in pairs.select("a.rec_id", F.col("b.rec_id").alias("v")).collect()}
    part = parts(len(lat), lambda i, j: (j, i) in met)
    most = {w: max(set(part[w::2]), key=part[w::2].count) for w in (0, 1)}
    got = {r.rec_id for r in places.consistency_outliers(df, "ward", 2500.0).collect()}
    assert got == {i for i, c in enumerate(part) if c != most[i % 2]} and len(got) > 60
    assert linked[0] < len(met) / 3, (linked, len(met))


def test_distances_of_arrays_are_those_of_columns(spark):
    rng = np.random.default_rng(1)
    at = [*rng.uniform(22, 23, (2, 50)), *rng.uniform(88, 89, (2, 50))]
    at[1][:5], at[3][:5] = at[0][:5], at[2][:5]
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(*at)], "a double, c double, b double, d double")
    want = [r[0] for r in df.select(geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert geodesic_of(at[0], at[2], at[1], at[3]).tolist() == pytest.approx(want, abs=1e-6) and want[0] == 0


def test_texts_to_ask_choose_no_candidate(spark, monkeypatch):
    """Which texts are still to be asked for needs neither their candidates nor their places."""
    monkeypatch.setattr(places, "choose_candidate", None)
    assert plans.queries()["E10_J13_texts_to_ask"](spark, "/root/testdata/sf0.001").count() > 20
    raw = spark.createDataFrame([("46, Lake Rd (portion)",), ("Lake Road",), ("jn. Canal",), ("Main Road",), (None,)], "location string")
    assert [r[0] for r in places.texts_to_ask(raw, raw.limit(0)).orderBy("query_text").collect()] == ["Canal", "Lake Road"]
    assert [r[0] for r in places.texts_to_ask(raw, raw.filter("location = 'Lake Road'")).collect()] == ["Canal"]


def test_a_location_is_cleaned_once(spark, monkeypatch):
    """Of 300 texts with three locations three are cleaned; repeated candidates change nothing."""
    seen, real = spark.sparkContext.accumulator(0), places.clean_query

    def told(x):
        seen.add(1)
        return x

    monkeypatch.setattr(places, "clean_query", lambda c: real(F.udf(told, "string")(c)))
    raw = spark.range(300).selectExpr("id as query_id", "element_at(array('Lake Rd', 'Canal near X', 'Main Road'), cast(id % 3 + 1 as int)) as location", "id % 2 as ward", "id % 5 as borough")
    c = raw.selectExpr("query_id", "struct(7L as cand_id) as rank", "7L as cand_id", "'Lake Road' as cand_name", "'street' as kind", "22.5D as lat", "88.3D as lon", "cast(null as double) as extent_m")
    got = places.resolve_pockets(raw, c.unionByName(c), raw.limit(0).selectExpr("query_id", "1D as lat", "1D as lon"), F.lit(True))
    n = {r.borough: r for r in places.review_counts(got).collect()}
    assert sum(r.n for r in n.values()) == 300 and all((r.ok, r.name_mismatch, r.too_generic, r.outliers) == (20, 20, 20, 0) for r in n.values())
    assert seen.value == 3
