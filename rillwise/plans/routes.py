"""Route queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwise.operators import routes as r
from rillwise.plans.adapters import adapted, adapters_sql, table
from rillwise.plans.registry import query

SEGS = adapters_sql("route_segs")
SCORES = f"""{SEGS}, sc AS (SELECT trip_id, route_id, round(.30 * max(prob) + .35 * quantile_cont(prob, .9) + .35 * avg(prob) + 1e-9, 4) AS score, round(100.0 * count(prob) / count(*), 1) AS coverage_pct, count(*) AS n,
round(avg(prob) + 1e-9, 4) AS mean, round(max(prob), 4) AS most, round(avg(CASE WHEN prob > .25 THEN 1.0 ELSE 0 END), 4) AS exposed FROM route_segs GROUP BY 1, 2)"""


def scores(spark, sf_dir):
    return r.score_routes(adapted(spark, sf_dir, "route_segs"), ["trip_id", "route_id"])


@query("A1_A2_A6_route_score", f"WITH {SCORES} SELECT * FROM sc")
def route_scores(spark, sf_dir):
    return scores(spark, sf_dir)


@query("A6_route_metrics", f"""WITH {SEGS}, r AS (SELECT o_orderkey AS route_id, 1000.0 + o_orderkey % 5003 AS distance_m, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 10) / 10.0 END AS score FROM orders),
s AS (SELECT route_id, count(*) AS n, avg(prob) AS mean, max(prob) AS most, count(*) FILTER (prob > .25 OR (prob IS NULL AND seq % 2 = 0)) AS risky FROM route_segs WHERE route_id % 4 <> 0 GROUP BY 1)
SELECT route_id, round(coalesce(mean, score) + 1e-9, 4) AS mean, round(coalesce(most, score), 4) AS most, CAST(CASE WHEN n > 0 THEN round(risky * distance_m / n) WHEN coalesce(mean, score) > .3 THEN round(distance_m * .2) ELSE 0 END AS BIGINT) AS exposed_m FROM r LEFT JOIN s USING (route_id)""")
def metrics(spark, sf_dir):
    """All orders as routes; every fourth has no segments, and segments without a probability may still have a level."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"))
    key = F.col("route_id")
    routes = orders.select("route_id", (1000.0 + key % 5003).alias("distance_m"), F.when(key % 3 != 0, (key % 10) / 10.0).alias("score"))
    level = F.when(F.col("prob").isNull(), F.when(F.col("seq") % 2 == 0, "MODERATE")).when(F.col("prob") > 0.25, "MODERATE").otherwise("LOW")
    segs = adapted(spark, sf_dir, "route_segs").filter("route_id % 4 <> 0").select("route_id", "prob", level.alias("level"))
    m = r.route_metrics(routes, segs)
    return m.select("route_id", F.round(F.col("mean") + r.EDGE, 4).alias("mean"), F.round("most", 4).alias("most"), "exposed_m")


@query("E3_W2_safe_routes", f"""WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY score NULLS LAST, route_id) AS rn, count(score) OVER (PARTITION BY trip_id) AS ns, count(*) OVER (PARTITION BY trip_id) AS n_routes, min(score) OVER (PARTITION BY trip_id) AS low FROM sc),
b AS (SELECT trip_id, n_routes, ns, low, max(CASE WHEN rn = 1 AND score IS NOT NULL THEN route_id END) AS best_route, max(CASE WHEN rn = 1 THEN score END) AS best_score, max(CASE WHEN rn = 2 THEN score END) AS next_score FROM k GROUP BY ALL)
SELECT trip_id, best_route, best_score, next_score, round(next_score - best_score + 1e-9, 4) AS gap, CASE WHEN ns > 0 THEN low >= .5 END AS all_risky,
CASE WHEN ns = 0 THEN 'insufficient' WHEN low >= .5 THEN 'all_risky' WHEN next_score > best_score THEN 'lower' WHEN next_score IS NOT NULL THEN 'similar' ELSE 'single' END AS "case",
CASE WHEN best_score >= .7 THEN 'HIGH' WHEN best_score >= .45 THEN 'ELEVATED' WHEN best_score >= .25 THEN 'MODERATE' WHEN best_score IS NOT NULL THEN 'LOW' END AS level, n_routes FROM b""")
def safe_routes(spark, sf_dir):
    return r.recommend(scores(spark, sf_dir)).drop("message")


#: Vertices of a route: the customer's place, then the suppliers' in the order of the items.
VERTICES = f"""{SEGS}, vt AS (SELECT route_id, 0 AS part, 0 AS seq, 0 AS k1, 0 AS k2, 0.0 AS k3, 0.0 AS k4, TIMESTAMP '1900-01-01' AS k5, (trip_id * 7919) % 10007 * 1.0e0 AS x, (trip_id * 5417) % 10007 * 1.0e0 AS y FROM route_segs GROUP BY route_id, trip_id
UNION ALL SELECT route_id, 1, seq, k1, k2, k3, k4, k5, (k2 * 6827 + 29) % 10007 * 1.0e0, (k2 * 3571 + 17) % 10007 * 1.0e0 FROM route_segs),
st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM vt WINDOW w AS (PARTITION BY route_id ORDER BY part, seq, k1, k2, k3, k4, k5)),
ms AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY part, seq, k1, k2, k3, k4, k5 ROWS UNBOUNDED PRECEDING) AS measure, sum(step) OVER (PARTITION BY route_id) AS length FROM st)"""
ORDER = ["part", "seq", "k1", "k2", "k3", "k4", "k5"]


def vertices(spark, sf_dir):
    s = adapted(spark, sf_dir, "route_segs")
    place = lambda c, a, b: ((F.col(c) * a + b) % 10007).cast("double")
    start = s.select("route_id", "trip_id").distinct().select("route_id", F.lit(0).alias("part"), *[F.lit(None).cast(s.schema[c].dataType).alias(c) for c in ORDER[1:]], place("trip_id", 7919, 0).alias("x"), place("trip_id", 5417, 0).alias("y"))
    return start.unionByName(s.select("route_id", F.lit(1).alias("part"), *ORDER[1:], place("k2", 6827, 29).alias("x"), place("k2", 3571, 17).alias("y")))


@query("W1_line_measure", f"WITH {VERTICES} SELECT route_id, part, round(x, 1) AS x, round(y, 1) AS y, round(measure, 2) AS measure, round(length, 2) AS length FROM ms")
def measures(spark, sf_dir):
    m = r.line_measure(vertices(spark, sf_dir), "route_id", ORDER)
    return m.select("route_id", "part", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round("measure", 2).alias("measure"), F.round("length", 2).alias("length"))


@query("G4_G5_sample_routes", f"""WITH {VERTICES}, ed AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(measure) OVER w AS m1 FROM ms WINDOW w AS (PARTITION BY route_id ORDER BY part, seq, k1, k2, k3, k4, k5)),
pl AS (SELECT route_id, i, i * 750.0 AS dist, x + (i * 750.0 - measure) / (m1 - measure) * (x1 - x) AS x, y + (i * 750.0 - measure) / (m1 - measure) * (y1 - y) AS y
  FROM (SELECT *, unnest(range(CAST(ceil(measure / 750.0) AS BIGINT), CAST(ceil(least(m1, length - 1e-6) / 750.0) AS BIGINT))) AS i FROM ed WHERE m1 > measure)),
en AS (SELECT route_id, CASE WHEN length > 1e-6 THEN CAST(ceil((length - 1e-6) / 750) AS BIGINT) ELSE 0 END AS i, length AS dist, x, y FROM ed WHERE m1 IS NULL)
SELECT route_id, i, round(dist, 1) AS dist, round(x, 1) AS x, round(y, 1) AS y FROM (SELECT * FROM pl UNION ALL SELECT * FROM en)""")
def samples(spark, sf_dir):
    s = r.sample_routes(vertices(spark, sf_dir), "route_id", ORDER, 750.0)
    return s.select("route_id", "i", F.round("dist", 1).alias("dist"), F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query("A34_route_bounds", f"WITH {VERTICES} SELECT route_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM vt GROUP BY route_id")
def bounds(spark, sf_dir):
    return r.route_bounds(vertices(spark, sf_dir), "route_id")


@query("J26_P26_colour_edges", f"""WITH {SEGS}, e AS (SELECT route_id, row_number() OVER w - 1 AS edge, count(*) OVER (PARTITION BY route_id) AS n FROM route_segs WINDOW w AS (PARTITION BY route_id ORDER BY seq, k1, k2, k3, k4, k5)),
s AS (SELECT route_id, row_number() OVER w - 1 AS i, prob FROM route_segs WHERE seq <= 2 WINDOW w AS (PARTITION BY route_id ORDER BY seq, k1, k2, k3, k4, k5)), c AS (SELECT route_id, count(*) AS ns FROM s GROUP BY 1)
SELECT e.route_id, edge, i AS sample, round(prob, 4) AS prob FROM e JOIN c USING (route_id) JOIN s ON s.route_id = e.route_id AND s.i = least(ns - 1, CAST(floor(edge / n * ns) AS BIGINT))""")
def colours(spark, sf_dir):
    from pyspark.sql import Window as W

    segs = adapted(spark, sf_dir, "route_segs")
    w = W.partitionBy("route_id").orderBy("seq", "k1", "k2", "k3", "k4", "k5")
    edges = segs.select("route_id", (F.row_number().over(w) - 1).cast("long").alias("edge"), F.count("*").over(W.partitionBy("route_id")).alias("n"))
    s = segs.filter("seq <= 2").select("route_id", (F.row_number().over(w) - 1).cast("long").alias("sample"), "prob", F.count("*").over(W.partitionBy("route_id")).alias("ns"))
    met = edges.join(s, "route_id").filter(F.col("sample") == r.edge_sample_index(F.col("edge"), F.col("n"), F.col("ns")))
    return met.select("route_id", "edge", "sample", F.round("prob", 4).alias("prob"))


@query("J14_T4_attach_rainfall", f"""WITH {adapters_sql('route_segs', 'wx')}, w AS (SELECT station, arg_max(abs(value), event_id) AS rain FROM wx WHERE outcome = 'ok' GROUP BY 1)
SELECT route_id, count(*) AS n, round(max(w.rain), 4) AS rain, round(avg(CASE WHEN prob IS NOT NULL THEN least(prob * (0.3 + 0.7 * least(w.rain / 90, 1)), 1) END) FILTER (w.rain IS NOT NULL) + 1e-9, 5) AS mean FROM route_segs s LEFT JOIN w ON w.station = s.trip_id % 150 GROUP BY route_id""")
def attach_rainfall(spark, sf_dir):
    from rillwise.functions.hydrology import at_most, rainfall_multiplier

    wx = adapted(spark, sf_dir, "wx").filter("outcome = 'ok'").groupBy("station").agg(F.max_by(F.abs("value"), "event_id").alias("rain"))
    s = adapted(spark, sf_dir, "route_segs").join(wx, F.col("trip_id") % 150 == F.col("station"), "left")
    p = F.when(F.col("rain").isNotNull(), at_most(F.col("prob") * rainfall_multiplier(F.col("rain")), 1.0))
    return s.groupBy("route_id").agg(F.count("*").alias("n"), F.round(F.max("rain"), 4).alias("rain"), F.round(F.avg(p) + r.EDGE, 5).alias("mean"))


@query("G5_sample_lines", f"""WITH {VERTICES}, l AS (SELECT DISTINCT route_id, length FROM ms)
SELECT route_id, count(*) AS n, max(i) AS last FROM (SELECT route_id, unnest(range(0, greatest(1, CAST(ceil((length - 1e-6) / 2000.0) AS BIGINT)))) AS i FROM l) GROUP BY 1""")
def line_samples(spark, sf_dir):
    """Places every 2,000 m without the end: how many each route has, and the number of the last."""
    s = r.sample_routes(vertices(spark, sf_dir), "route_id", ORDER, 2000.0, include_endpoint=False)
    return s.groupBy("route_id").agg(F.count("*").alias("n"), F.max("i").alias("last"))
