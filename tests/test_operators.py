"""Operators on small hand-made inputs: missing values, edges, ties."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwise.functions import feeds, geo, hydrology as h, names, shapes
from rillwise.operators import checks, drawings, fuzzy, graph, layers, network, places, quantiles, routes, spatial, weather
from rillwise.sources import readers
from rillwise.store import saved
from rillwise.streaming.weather import decide

SF = "/root/testdata/sf0.001"


def column(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_rainfall_multiplier(spark):
    got = column(spark, h.rainfall_multiplier(F.col("mm")), [(None,), ("0",), ("90",), ("45",), ("-5",), ("x",)], "mm string")
    assert got == pytest.approx([1, 0.3, 1, 0.65, 1, 1])


def test_bands(spark):
    got = column(spark, h.risk_level(F.col("p")), [(0.7,), (0.5,), (0.3,), (0.1,), (None,)], "p double")
    assert got == ["HIGH", "ELEVATED", "MODERATE", "LOW", None]
    assert column(spark, h.drain_alert(F.col("p")), [(1.5,), (1.0,), (0.75,), (0.1,), (None,)], "p double") == ["RED", "ORANGE", "YELLOW", "GREEN", "UNKNOWN"]


def test_manning_limits(spark):
    got = column(spark, h.manning_capacity(F.col("d")), [("99",), ("100",), ("3001",), ("x",), (None,), ("NaN",)], "d string")
    assert got[0] is None and got[1] > 0 and got[2:] == [None] * 4
    with pytest.raises(ValueError):
        h.manning_capacity(F.lit(300), slope=0)


def test_projection_round_trip(spark):
    x, y = geo.utm_xy(F.col("a"), F.col("b"))
    lat, lon = geo.utm_to_latlon(x, y)
    r = spark.createDataFrame([(22.5726, 88.3639)], "a double, b double").select(lat, lon).first()
    assert r[0] == pytest.approx(22.5726, abs=1e-6) and r[1] == pytest.approx(88.3639, abs=1e-6)


def test_valid_latlon(spark):
    rows = [("22.5", "88.3"), ("91", "0"), (None, "1"), ("x", "1"), ("NaN", "1")]
    assert column(spark, geo.valid_latlon(F.col("a"), F.col("b")), rows, "a string, b string") == [True, False, False, False, False]


def test_route_sampling(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 750.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 740.0, 0.0), (3, 0, 5.0, 5.0), (3, 1, 5.0, 5.0)], "route_id int, seq int, x double, y double")
    n = {r["route_id"]: r["n"] for r in routes.sample_routes(v, "route_id", ["seq"], 75.0).groupBy("route_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 11, 2: 11, 3: 1}


def test_recommendation(spark):
    rows = [(1, 1, 0.2), (1, 2, 0.4), (2, 3, 0.6), (2, 4, 0.7), (3, 5, None), (4, 6, 0.3), (5, 7, 0.3), (5, 8, 0.3), (6, 9, None), (6, 10, 0.1)]
    got = {r["trip_id"]: (r["best_route"], r["case"]) for r in routes.recommend(spark.createDataFrame(rows, "trip_id int, route_id int, score double")).collect()}
    assert got == {1: (1, "lower"), 2: (3, "all_risky"), 3: (None, "insufficient"), 4: (6, "single"), 5: (7, "similar"), 6: (10, "single")}


def test_accumulation_with_split_and_loop(spark):
    edges = [(1, 10, 20, 100.0), (2, 20, 30, 50.0), (3, 20, 40, 50.0), (4, 50, 60, 10.0), (5, 60, 50, 10.0), (6, 11, 50, 30.0)]
    got = {r["pipe_id"]: (r["area_m2"], r["path_m"]) for r in network.accumulate(spark.createDataFrame(edges, "pipe_id int, up_node int, down_node int, length_m double")).collect()}
    assert got[1] == (4000.0, 100.0) and got[2] == got[3] == (4000.0, 150.0)
    assert got[4] == (1600.0, 40.0) and got[5] == (400.0, 10.0)  # a loop keeps what reached it


def test_accumulation_of_long_chain(spark, monkeypatch):
    monkeypatch.setattr(network, "FLUSHED", 3)
    edges = [(i, i, i + 1, 10.0) for i in range(8)]
    got = {r["pipe_id"]: (r["area_m2"], r["path_m"]) for r in network.accumulate(spark.createDataFrame(edges, "pipe_id int, up_node int, down_node int, length_m double")).collect()}
    assert got == {i: ((i + 1) * 10.0 * network.STRIP_M, (i + 1) * 10.0) for i in range(8)}


def test_places_in_chains_and_rings(spark):
    both = lambda pairs: [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    links = both([(5, 2), (2, 9), (9, 7), (7, 1)]) + both([(20, 21), (21, 22), (22, 23), (23, 20)]) + both([(30, 31)])
    dashes = spark.createDataFrame([(i,) for i in (1, 2, 5, 7, 9, 20, 21, 22, 23, 30, 31, 40)], "dash_id int")
    got = {r["dash_id"]: (r["chain"], r["place"], r["n"]) for r in drawings.build_chains(dashes, spark.createDataFrame(links, "dash_id int, to_id int")).collect()}
    assert [got[i] for i in (1, 7, 9, 2, 5)] == [(1, p, 5) for p in range(5)]
    assert [got[i] for i in (20, 21, 22, 23)] == [(20, 0, 4), (20, 1, 4), (20, 2, 4), (20, 1, 4)]
    assert got[30] == (30, 0, 2) and got[31] == (30, 1, 2) and got[40] == (40, 0, 1)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 1)]
    got = {tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 8), (8, 8), (5, 5)}
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph.connected_components(chain).filter("component <> 0").count() == 0
    assert graph.connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


@pytest.mark.parametrize("values", [[], [3.0], [2.0] * 50 + [7.0], [1.0, 2.0], list(range(1000)), [1e-300, 1.0, 1e300, -1e308, 1.7e308], [0.1 * i**5 for i in range(300)] * 3])
def test_percentiles_are_exact(spark, values):
    rows = [(float(v),) for v in values] + [(None,), (math.nan,), (math.inf,)]
    got = quantiles.percentiles(spark.createDataFrame(rows, "v double"), F.col("v"), [0.0, 0.5, 0.9, 1.0])
    want = [None] * 4 if not values else np.percentile(np.array(values, float), [0, 50, 90, 100])
    assert got == [None] * 4 if not values else np.allclose(got, want.astype(float), rtol=1e-12, atol=0)


def test_components_read_their_edges_few_times(spark):
    edges = saved(spark.createDataFrame([(2, 1), (3, 2)], "u int, v int"), "edges")
    step = graph._star(graph._star(edges, large=True), large=False)
    assert step._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4


def test_spans_of_a_station_hang_together(spark):
    rng, start = np.random.default_rng(3), 1_700_000_000
    rows, n = [], 0
    for station in (1, 2):
        t = start
        for _ in range(250):
            t += int(rng.choice([0, 5, 70, 900, 4000, 30000, 200000], p=[0.1, 0.3, 0.2, 0.2, 0.1, 0.07, 0.03]))
            rows.append((n, station, t, str(rng.choice(["ok", "rate_limited", "auth", "unavailable"], p=[0.15, 0.55, 0.1, 0.2])), float(n)))
            n += 1
    calls = spark.createDataFrame(rows, "event_id int, station int, s long, outcome string, value double").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for station in (1, 2):
        own, good, streak = [r for r in rows if r[1] == station], None, 0
        for i, (event, _, s, outcome, value) in enumerate(own):
            good = (s, value) if outcome == "ok" else good
            streak = 0 if outcome == "ok" else streak + (outcome == "rate_limited")
            shown = good[1] if good and s - good[0] <= 6 * 3600 else None
            ttl = {"ok": 1800, "auth": 900, "rate_limited": 300}.get(outcome, 120)
            hour = sum(s - 3600 < r[2] <= s for r in own)
            want[event] = (shown, streak, hour, s - own[i - 1][2] if i else None, min(ttl, own[i + 1][2] - s) if i + 1 < len(own) else ttl)
    by = lambda df, c: {r["event_id"]: r[c] for r in df.collect()}
    budget = weather.call_budget(calls)
    got = [by(weather.last_good_asof(calls), "shown"), by(weather.backoff_schedule(calls), "streak"), by(budget, "hour_calls"), by(budget, "gap_s"), by(weather.cache_intervals(calls), "valid_s")]
    assert {e: tuple(g[e] for g in got) for e in want} == want


def test_nearest_line_reasons(spark):
    p = spark.createDataFrame([(1, 0.0, 5.0), (2, None, None), (3, 9e5, 9e5)], "point_id int, x double, y double")
    s = spark.createDataFrame([(7, -10.0, 0.0, 10.0, 0.0), (6, -10.0, 10.0, 10.0, 10.0)], "segment_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r["point_id"]: (r["segment_id"], r["distance"], r["reason"]) for r in spatial.nearest_line(p, s, 500.0).collect()}
    assert got == {1: (6, 5.0, None), 2: (None, None, "no position"), 3: (None, None, "none within radius")}


def test_point_on_edge_is_inside(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 10.0)], "body_id int, cx double, cy double, side_m double")
    p = spark.createDataFrame([(1, 5.0, 0.0), (2, 5.1, 0.0), (3, 0.0, 0.0), (4, 5.0, 5.0)], "point_id int, x double, y double")
    got = {r["point_id"] for r in spatial.covered_by(p, spatial.box_edges(box, "body_id"), polygon="body_id").collect()}
    assert got == {1, 3, 4}


def test_names(spark):
    rows = [("Hassanpur 2nd Lane", "Hasanpur Lane", True), ("Tulip Lane", "Tulip Street", False), ("2nd Lane", "2nd Lane", False), ("Silver Quay", "Silverquay", True), ("Silver Quay", "Quay", False)]
    df = spark.createDataFrame(rows, "q string, n string, want boolean")
    got = {(r.q, r.n): r.named for r in fuzzy.matched_names(df.unionByName(df), "q", "n").collect()}
    assert got == {(q, n): want for q, n, want in rows}
    raw = [("46, Middle Rd (portion) near Park",), ("64 Hill & Other",), ("2A, 2B, 2C Heron Ln",)]
    assert column(spark, names.clean_query(F.col("t")), raw, "t string") == ["Middle Road", "64 Hill", "Heron Lane"]


def test_candidates_are_worked_out_once(spark):
    """Each row of the source is made once, repeats and missing names change nothing."""
    far = [(1, 10, "Silver Quay", "Silverquay", 22.50, 88.30), (1, 10, "Silver Quay", "Silverquay", 22.50, 88.30), (1, 11, "Silver Quay", "Silver Quay", 22.60, 88.30)]
    rows = far + [(2, 20, "Silver Quay", "Silverquay", 22.5, 88.3), (2, 21, "Silver Quay", "Quay", 22.5, 88.4), (3, 30, "2nd Lane", None, 22.5, 88.3), (4, 40, "Silver Quay", None, 22.5, 88.3), (5, 50, "Silver Quay", "Silver Quay", 21.0, 88.3)]
    rows += [(6, 60, "Silver Quay", "Silver Quay", 22.5, 88.3)] * 2
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    names_ = "query_id long, cand_id long, query_text string, cand_name string, lat double, lon double"
    source = spark.createDataFrame(rows, names_).mapInPandas(counted, names_)
    cands = source.withColumn("kind", F.lit("street")).withColumn("extent_m", F.lit(20.0)).withColumn("rank", F.col("cand_id"))
    want = {1: ("ambiguous", None), 2: ("ok", 20), 3: ("too_generic", None), 4: ("name_mismatch", None), 5: ("outside", None), 6: ("ok", 60)}
    got = {r.query_id: (r.status, r.cand_id) for r in places.choose_candidate(cands, F.col("lat") > 22).collect()}
    assert got == want and made.value == len(rows)


def test_ratios_are_those_of_matching_blocks():
    from difflib import SequenceMatcher

    rng = np.random.default_rng(7)
    one, other = (["".join(rng.choice(list("abcé"), rng.integers(0, 12))) for _ in range(3000)] for _ in range(2))
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(one, other)]
    assert fuzzy.ratios(one, other).tolist() == want and fuzzy.ratios([], []).tolist() == []


def test_bounds_lose_no_similar_token(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aabcd1"), rng.integers(1, 8))) for _ in range(120)]
    pairs = [(a, b) for a in words for b in words]
    got = {tuple(r) for r in fuzzy.similar_tokens(spark.createDataFrame(pairs, "w string, h string")).collect()}
    r = fuzzy.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got == {p for p, x in zip(pairs, r) if x >= 0.8} and len(got) > 100


def test_outliers(spark):
    rows = [(1, 1, 22.50, 88.30), (2, 1, 22.501, 88.30), (3, 1, 22.60, 88.40), (4, 2, 22.5, 88.3), (5, 2, 22.6, 88.4), (6, 3, 22.5, 88.3), (7, 1, None, None)]
    got = {(r["rec_id"], r["no_majority"]) for r in places.consistency_outliers(spark.createDataFrame(rows, "rec_id int, ward int, lat double, lon double"), "ward", 2500.0).collect()}
    assert got == {(3, False), (4, True), (5, True)}


def test_duplicate_lines_keep_parallels_of_a_sheet(spark):
    rows = [(1, 1, 0.0, 0.0, 100.0, 0.0), (2, 1, 0.0, 1.0, 100.0, 1.0), (3, 2, 0.0, 2.0, 100.0, 2.0), (4, 3, 0.0, 4.5, 100.0, 4.5)]
    kept = {r[0] for r in layers.dedupe_lines(spark.createDataFrame(rows, "segment_id int, rank int, x0 double, y0 double, x1 double, y1 double")).select("segment_id").collect()}
    assert kept == {1, 2, 4}


def test_similarity_fit(spark):
    p, r = 0.9, 0.2
    pts = [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0), (80.0, 90.0)]
    rows = [(1, x, y, p * x - r * y + 5000, r * x + p * y + 7000) for x, y in pts]
    f = drawings.fit_similarity(spark.createDataFrame(rows, "sheet int, sx double, sy double, mx double, my double"), nominal_rotation_deg=12.5).first()
    assert f["p"] == pytest.approx(p) and f["r"] == pytest.approx(r) and f["rms_m"] < 1e-6 and f["usable"]


def test_metrics_without_positives(spark):
    rows = [(0, 0, 0.2), (0, 0, 0.7), (1, 1, 0.9), (1, 0, 0.1), (1, 1, 0.1)]
    m = {r["fold"]: r for r in checks.classification_metrics(spark.createDataFrame(rows, "fold int, label int, score double"), "fold", "label", "score").collect()}
    assert m[0]["auc"] is None and m[0]["precision"] == 0 and m[1]["auc"] == pytest.approx(0.75)


def test_call_budget_state():
    times, retry, streak, verdict = decide([], 0, 0, 1000, "rate_limited")
    assert (verdict, retry, streak) == ("allowed", 1300, 1)
    assert decide(times, retry, streak, 1200, "ok")[3] == "backing_off"
    times, retry, streak, verdict = decide(times, retry, streak, 1300, "rate_limited")
    assert (retry, streak) == (1900, 2)
    assert decide(list(range(0, 1200, 60)), 0, 0, 1300, "ok")[3] == "hourly_limit"


def test_feeds(spark):
    assert column(spark, feeds.to_rain_mm(F.col("r")), [("NIL",), (" trace ",), ("1.5",), ("x",), (None,), ("NaN",)], "r string") == [0, 0, 1.5, None, None, None]
    assert column(spark, feeds.obs_timestamp(F.col("d"), F.col("t")), [("2024-01-02", "3"), ("2024-01-02", "03:15:00"), (None, "3")], "d string, t string") == ["2024-01-02T03:00:00Z", "2024-01-02T03:15:00Z", None]


def test_sources(spark, tmp_path):
    layer = {"features": [{"geometry": {"type": "LineString", "coordinates": [[88.3, 22.5], [88.31, 22.51]]}, "properties": {"ward": "3"}}, {"geometry": None, "properties": {}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(layer))
    rows = readers.read_geojson(spark, str(tmp_path / "a.geojson"), "drains").collect()
    assert rows[0]["geom_type"] == "LineString" and [tuple(c) for c in rows[0]["coords"]] == [(88.3, 22.5), (88.31, 22.51)] and rows[1]["coords"] is None
    (tmp_path / "p.csv").write_text("location_name,ward,latitude,longitude,source,year,severity,notes\na,1,22.5,x,s,2017,m,\n")
    r = readers.read_pockets(spark, str(tmp_path / "p.csv")).first()
    assert r["latitude"] == 22.5 and r["longitude"] is None
    (tmp_path / "w.json").write_text('[{"Station": "A"}, {"Station": "B"}]\n{"Station": "C"}\n[]\n')
    assert [x["record"]["Station"] for x in readers.read_weather(spark, str(tmp_path / "w.json")).collect()] == ["A", "C"]
    body = {"routes": [{"distance": 10.04, "duration": 3, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "legs": [{"steps": [{"distance": 1, "duration": 1, "name": "x", "maneuver": {"instruction": "go"}}]}]}, {"distance": 1, "duration": 1, "geometry": {"type": "Point", "coordinates": []}, "legs": []}]}
    got = readers.parse_routes(spark.createDataFrame([(1, json.dumps(body))], "id int, body string")).collect()
    assert len(got) == 1 and got[0]["distance_m"] == 10.0 and got[0]["steps"][0]["instruction"] == "go"
    cand = {"features": [{"geometry": {"coordinates": [88.3, 22.5]}, "properties": {"name": "N", "feature_type": "street", "context": {"a": "b", "c": None}}}, {"geometry": {"coordinates": []}, "properties": {}}]}
    c = readers.parse_candidates(spark.createDataFrame([(1, json.dumps(cand))], "id int, body string")).collect()
    assert len(c) == 1 and c[0]["lat"] == 22.5 and c[0]["address"] == "N" and c[0]["context"] == {"a": "b"}
    g = readers.read_gcps(spark.createDataFrame([("#CRS",), ("1,2,3,-4,1",), ("5,6,7,8,0",), ("600000,2490000,1,1",)], "value string")).collect()
    assert [(r["sy"], r["crs"]) for r in g] == [(4.0, "EPSG:4326"), (1.0, "EPSG:32645")]


def test_lambert_distance(spark):
    d = spark.range(1).select(geo.geodesic_m(F.lit(22.5), F.lit(88.3), F.lit(22.5), F.lit(88.4)), geo.geodesic_m(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert d[0] == pytest.approx(10289.5, rel=1e-3) and d[1] == 0.0 and not math.isnan(d[1])


def test_nothing_is_made_up(spark):
    """Least and greatest skip nulls; the formulas must not."""
    n, one = F.lit(None).cast("double"), F.lit(1.0)
    got = spark.range(1).select(
        h.adjusted_probability(n, one, one), h.drain_hazard(n, one), h.drain_hazard(F.lit(2.0), n), h.scenario_risk(n, one, one, one), h.pipe_load(n, one, one, one, one)["load"],
        h.pipe_load(one, one, one, one, n)["overflow"], h.water_depth_cm(one, one, one, one, n, one, one, one), geo.haversine_m(n, one, one, one), h.rainfall_multiplier(n),
    ).first()
    assert list(got) == [None, 0.0, 0.0, None, None, None, None, None, 1.0]


def test_split_parts_are_disjoint_and_whole(spark):
    from rillwise import plans
    from rillwise.plans.training import train

    rows = plans.queries()["M6_O2_split"](spark, SF).collect()
    ids = [r["point_id"] for r in train(spark, SF).select("point_id").collect()]
    assert sorted(r["point_id"] for r in rows) == sorted(ids) and sum(r["sampled"] for r in rows) == min(50, len(ids))
    assert 0.1 < sum(r["part"] == "test" for r in rows) / len(rows) < 0.3


def test_training_rows_against_brute_force(spark):
    """All negatives lie inside the boundary and 300 m off every positive, and no lattice point that does is missing."""
    from rillwise.plans import jobs
    from rillwise.plans.adapters import adapted
    from rillwise.plans.spatial import boundary_edges

    rows = jobs.build_training(spark, SF).collect()
    pos, neg = ([(r["x"], r["y"]) for r in rows if r["label"] == y] for y in (1, 0))
    places = {(round(r["lat"], 6), round(r["lon"], 6)) for r in adapted(spark, SF, "pockets").filter("lat is not null").collect()}
    assert len(pos) == len(places)
    edges = [(e["x0"], e["y0"], e["x1"], e["y1"]) for e in boundary_edges(spark).collect()]
    inside = lambda x, y: sum((a > y) != (b > y) and x < (d - c) * (y - a) / (b - a) + c for c, a, d, b in edges) % 2 == 1
    p = np.array(pos)
    assert neg and all(inside(x, y) and np.hypot(p[:, 0] - x, p[:, 1] - y).min() >= 300 - 1e-6 for x, y in neg)
    cells = {tuple(map(int, r["point_id"].split("_")[1:])) for r in rows if r["label"] == 0}
    assert len(cells) == len(neg)


def test_gates_of_scale_and_rotation(spark):
    from rillwise.operators import drawings

    def usable(scale, degrees, **nominal):
        p, r = scale * np.cos(np.radians(degrees)), scale * np.sin(np.radians(degrees))
        rows = [(1, float(x), float(y), float(p * x - r * y), float(r * x + p * y)) for x, y in ((0, 0), (100, 0), (0, 100), (70, 90), (30, 20))]
        return drawings.fit_similarity(spark.createDataFrame(rows, "sheet int, sx double, sy double, mx double, my double"), **nominal).first()["usable"]

    assert usable(1.0, 3) and not usable(1.0, 25) and usable(1.0, 25, nominal_rotation_deg=20.0) and usable(1.0, 179, nominal_rotation_deg=-178.0)
    assert usable(2.0, 0) and not usable(1.2, 0, nominal_scale=1.0) and usable(1.05, 0, nominal_scale=1.0)


def test_nearest_anywhere_without_a_place(spark):
    from rillwise.operators import spatial

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 0.0), (3, None, 1.0)], "point_id int, x double, y double")
    targets = spark.createDataFrame([(7, 5000.0, 0.0), (8, float("inf"), 0.0)], "t int, tx double, ty double")
    assert [(r["point_id"], r["t"]) for r in spatial.nearest_anywhere(points, targets, "t", 100.0).collect()] == [(1, 7)]


def test_invalid_rings(spark):
    square, bow = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 0), (9, 9), (9, 0), (0, 9), (0, 0)]
    rings = {"square": square, "bow": bow, "open": square[:-1], "short": [(0, 0), (9, 0), (0, 0)], "far": [(x + 4000 * (x > 0), y) for x, y in bow], "spike": [(0, 0), (9, 0), (9, 9), (9, 0), (0, 9), (0, 0)]}
    rows = [(k, float(a), float(b), float(c), float(d)) for k, r in rings.items() for (a, b), (c, d) in zip(r, r[1:])]
    got = {tuple(r) for r in layers.invalid_polygons(spark.createDataFrame(rows, "id string, x0 double, y0 double, x1 double, y1 double"), "id").collect()}
    assert got == {("bow", "self_intersection"), ("far", "self_intersection"), ("open", "unclosed"), ("short", "short")}


def test_layer_rules(spark):
    from rillwise.operators import validation as v

    schema = "id long, geom_type string, coords array<struct<x: double, y: double>>"
    ring = lambda d: [(88.30, 22.50), (88.30 + d, 22.50), (88.30 + d, 22.50 + d), (88.30, 22.50 + d), (88.30, 22.50)]
    rows = [
        (1, "Polygon", ring(0.01)), (2, "Polygon", ring(0.01)[::-1]), (3, "Polygon", ring(1e-6)), (3, "Polygon", ring(0.02)), (4, "Polygon", []), (5, None, None),
        (6, "Point", [(88.30, 22.50)]), (7, "Polygon", [(88.30, 22.50), (None, 22.50)]), (None, "Polygon", ring(1.0)),
    ]
    spec = v.LayerSpec("id", ("Polygon",), ("id", "name"), ("id",), min_area_m2=1.0)
    got = {r["check"]: (r["n"], r["items"]) for r in v.validate_layer(spark.createDataFrame(rows, schema), spec).collect()}
    assert got == {
        "null:id": (1, ""), "null_geometry": (1, "5"), "empty_geometry": (1, "4"), "geometry_type": (1, "6"), "not_finite": (1, "7"), "outside": (1, ""), "tiny": (1, "3"),
        "duplicate_id": (2, "3"), "duplicate_geometry": (1, "2"), "missing:name": (1, None),
    }
    empty = v.validate_layer(spark.createDataFrame([], schema), spec).collect()
    assert {r["check"] for r in empty} == {"empty_layer", "missing:name"}
    area = spark.createDataFrame(rows[:1], schema).select(shapes.area_m2(F.array(F.array("coords")))).first()[0]
    assert abs(area / (1113.2 * 1113.2 * 0.92388) - 1) < 0.01


def test_training_gate(spark):
    from rillwise.plans.jobs import trained

    rows = spark.createDataFrame([(1, 22.5, 88.3, 1, "guess"), (2, 22.6, 88.4, 0, None)], "point_id long, lat double, lon double, label int, label_source string")
    with pytest.raises(ValueError, match="label_source"):
        trained(rows, ["lat"], "record")


def test_route_without_segments(spark):
    from rillwise.operators import routes as r

    routes = spark.createDataFrame([(1, 1000.0, 0.5), (2, 1000.0, None), (3, 900.0, None)], "route_id long, distance_m double, score double")
    segs = spark.createDataFrame([(3, 0.3, "LOW"), (3, None, "HIGH"), (3, 0.1, None)], "route_id long, prob double, level string")
    got = {x["route_id"]: (x["most"], x["exposed_m"]) for x in r.route_metrics(routes, segs).collect()}
    assert got == {1: (0.5, 200), 2: (None, 0), 3: (0.3, 600)}


def test_cleaned_places(spark):
    want = {
        "4,5 Heron Nagar": "Heron Nagar", "4,5": "5", "46, jn. 7, Mill Rd": "7, Mill Road", "St-John Ln.": "Street-John Lane", "Stone St": "Stone Street", "a (b": "a", "a (b) c": "a c", "x and y": "x and y", "x and Y": "x", "x&y": "x",
        "near Park": "near Park", "a near": "a near", "a opp. b": "a", "a opposite b": "a", "apart part": "apart", "22 Bigha": "22 Bigha", "2A, 2B, 2C Heron Ln": "Heron Lane", "é Rd, ": "é Road", "": "", "  ,.- ": "",
    }
    got = column(spark, names.clean_query(F.col("t")), [(t,) for t in want], "t string")
    assert dict(zip(want, got)) == want
    assert column(spark, names.clean_query(F.col("t")), [(None,)], "t string") == [None]
