"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillwise.functions import geo
from rillwise.functions.hydrology import capacity_fields
from rillwise.operators import spatial
from rillwise.plans.adapters import BOUNDARY, adapted, adapters_sql
from rillwise.plans.registry import query

N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
K = 2 * N**0.5 / (1 + N)
R = 0.9996 * 6378137.0 / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)


def utm_sql(name: str, source: str, lat: str = "lat", lon: str = "lon") -> str:
    """A CTE: source with x and y."""
    x = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))
    y = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))
    return f"""{name} AS (SELECT * EXCLUDE (t_, d_, xi, eta), 500000.0 + {R!r} * (eta + {x}) AS x, {R!r} * (xi + {y}) AS y FROM (
        SELECT *, atan2(t_, cos(d_)) AS xi, atanh(sin(d_) / sqrt(1 + t_ * t_)) AS eta FROM (
        SELECT *, sinh(atanh(sin(radians({lat}))) - {K!r} * atanh({K!r} * sin(radians({lat})))) AS t_, radians({lon} - 87) AS d_ FROM {source})))"""


def projected(df: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y") -> DataFrame:
    """df with its place in the plane. Filters on x and y that joins imply stay above: below, each would repeat the whole projection for every row."""
    px, py = geo.utm_xy(F.col(lat), F.col(lon))
    once = 0.0 * F.rand(0)  # adds nothing, but what is not deterministic is computed once, where it stands
    return df.withColumns({x: px + once, y: py + once})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(adapted(spark, sf_dir, "pts"))


def targets(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return projected(adapted(spark, sf_dir, name), x="tx", y="ty")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipes = projected(adapted(spark, sf_dir, "pipes"), "lat0", "lon0", "x0", "y0")
    return pipes.withColumn("x1", F.col("x0") + F.col("dx_m")).withColumn("y1", F.col("y0") + F.col("dy_m"))


POINTS = f"{adapters_sql('pts')}, {utm_sql('p', 'pts')}"
PUMPS = f"{adapters_sql('pumps')}, {utm_sql('t', 'pumps')}"
POCKETS = f"{adapters_sql('pockets')}, {utm_sql('t', 'pockets')}"
SEGMENTS = f"{adapters_sql('pipes')}, {utm_sql('s0', 'pipes', 'lat0', 'lon0')}, s AS (SELECT *, x AS x0, y AS y0, x + dx_m AS x1, y + dy_m AS y1 FROM s0)"
PLACE_T = "greatest(0, least(1, ((p.x - s.x0) * (s.x1 - s.x0) + (p.y - s.y0) * (s.y1 - s.y0)) / ((s.x1 - s.x0) ** 2 + (s.y1 - s.y0) ** 2)))"
LINE_D = f"sqrt((p.x - s.x0 - {PLACE_T} * (s.x1 - s.x0)) ** 2 + (p.y - s.y0 - {PLACE_T} * (s.y1 - s.y0)) ** 2)"
POINT_D = "sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)"


@query("P1_P2_P3_projection", f"""WITH {POINTS} SELECT point_id, abs(lat) <= 90 AND abs(lon) <= 180 AS valid, round(x, 3) AS x, round(y, 3) AS y, true AS round_trip FROM p""")
def projection(spark, sf_dir):
    p = points(spark, sf_dir)
    lat, lon = geo.utm_to_latlon(F.col("x"), F.col("y"))
    return p.select("point_id", geo.valid_latlon(F.col("lat"), F.col("lon")).alias("valid"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), ((F.abs(lat - F.col("lat")) < 2e-6) & (F.abs(lon - F.col("lon")) < 2e-6)).alias("round_trip"))


@query("P4_P5_P6_P32_distances", f"""WITH {adapters_sql('pts', 'pumps')}, j AS (SELECT point_id, p.lat AS a, p.lon AS b, t.lat AS c, t.lon AS d FROM pts p JOIN pumps t ON p.point_id % (SELECT max(pump_id) + 1 FROM pumps) = t.pump_id),
u AS (SELECT *, atan((1 - 1 / 298.257223563) * tan(radians(a))) AS b1, atan((1 - 1 / 298.257223563) * tan(radians(c))) AS b2 FROM j),
v AS (SELECT *, sin((b2 - b1) / 2) ** 2 + cos(b1) * cos(b2) * sin(radians(d - b) / 2) ** 2 AS q FROM u),
w AS (SELECT *, 2 * asin(sqrt(q)) AS s FROM v),
z AS (SELECT *, 6378137.0 * (s - 1 / 298.257223563 / 2 * ((s - sin(s)) * (sin((b1 + b2) / 2) * cos((b2 - b1) / 2) / cos(s / 2)) ** 2 + (s + sin(s)) * (cos((b1 + b2) / 2) * sin((b2 - b1) / 2) / sin(s / 2)) ** 2)) AS g FROM w)
SELECT point_id, round(2 * 6371000 * asin(sqrt(sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2)), 3) AS haversine,
round((d - b) * 111320 * cos(radians(a)), 3) AS east, round((c - a) * 110540, 3) AS north, round(g, 3) AS geodesic, round(g / 2, 3) AS extent FROM z""")
def distances(spark, sf_dir):
    p, t = adapted(spark, sf_dir, "pts"), adapted(spark, sf_dir, "pumps").select("pump_id", F.col("lat").alias("c"), F.col("lon").alias("d"))
    last = t.agg((F.max("pump_id") + 1).alias("n"))
    j = p.crossJoin(F.broadcast(last)).withColumn("own", F.col("point_id") % F.col("n")).join(t, F.col("own") == F.col("pump_id"))
    a, b, c, d = (F.col(x) for x in ("lat", "lon", "c", "d"))
    east, north = geo.local_xy_m(c, d, a, b)
    return j.select("point_id", F.round(geo.haversine_m(a, b, c, d), 3).alias("haversine"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"), F.round(geo.geodesic_m(a, b, c, d), 3).alias("geodesic"), F.round(geo.extent_m(a, b, c, d), 3).alias("extent"))


@query("J1_nearest_line", f"""WITH {POINTS}, {SEGMENTS}, m AS (SELECT point_id, segment_id, s.ward, pipe_diameter_mm, conduit_type, {LINE_D} AS d FROM p JOIN s ON {LINE_D} <= 500),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(d, 4), segment_id) = 1)
SELECT p.point_id, b.segment_id, b.ward, b.pipe_diameter_mm, round(round(b.d, 4), 1) AS distance, b.segment_id IS NOT NULL AS found,
CASE WHEN b.segment_id IS NULL THEN 'none within radius' END AS reason,
round(CASE WHEN conduit_type = 'pipe' AND pipe_diameter_mm BETWEEN 100 AND 3000 THEN 1 / 0.013 * pi() * (pipe_diameter_mm / 1000) ** 2 / 4 * (pipe_diameter_mm / 4000) ** (2 / 3) * sqrt(0.001) END, 4) AS capacity FROM p LEFT JOIN b USING (point_id)""")
def nearest_line(spark, sf_dir):
    found = spatial.nearest_line(points(spark, sf_dir), segments(spark, sf_dir), 500.0, ["ward", "pipe_diameter_mm", "conduit_type"])
    capacity = F.when(F.col("found"), capacity_fields(F.col("pipe_diameter_mm"), F.col("conduit_type"))["capacity"])
    return found.select("point_id", "segment_id", "ward", "pipe_diameter_mm", "distance", "found", "reason", capacity.alias("capacity"))


@query("J2_nearest_point", f"""WITH {POINTS}, {PUMPS}, m AS (SELECT point_id, pump_id, name, {POINT_D} AS d FROM p JOIN t ON {POINT_D} <= 3000),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(d, 4), pump_id) = 1)
SELECT p.point_id, pump_id, name, round(round(d, 4), 1) AS distance, pump_id IS NOT NULL AS found FROM p LEFT JOIN b USING (point_id)""")
def nearest_point(spark, sf_dir):
    found = spatial.nearest_point(points(spark, sf_dir), targets(spark, sf_dir, "pumps"), 3000.0, "pump_id", ["name"])
    return found.select("point_id", "pump_id", "name", "distance", "found")


@query("O1_k_nearest", f"""WITH {POINTS}, {PUMPS} SELECT point_id, pump_id, round({POINT_D}, 4) AS distance, row_number() OVER (PARTITION BY point_id ORDER BY round({POINT_D}, 4), pump_id) AS rank
FROM p JOIN t ON {POINT_D} <= 3000 QUALIFY rank <= 5""")
def k_nearest(spark, sf_dir):
    return spatial.k_nearest(points(spark, sf_dir), targets(spark, sf_dir, "pumps"), 3000.0, "pump_id").select("point_id", "pump_id", "distance", "rank")


BOX_P = "(SELECT point_id, x - 588000 AS x, y - 2477000 AS y FROM p)"
BOX_D = "sqrt(greatest(abs(p.x - cx) - side_m / 2, 0) ** 2 + greatest(abs(p.y - cy) - side_m / 2, 0) ** 2)"
RING_D = f"CASE WHEN abs(p.x - cx) <= side_m / 2 AND abs(p.y - cy) <= side_m / 2 THEN least(side_m / 2 - abs(p.x - cx), side_m / 2 - abs(p.y - cy)) ELSE {BOX_D} END"


def box_points(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", (F.col("x") - 588000).alias("x"), (F.col("y") - 2477000).alias("y"))


@query("J3_F2_nearest_polygon", f"""WITH {POINTS}, {adapters_sql('boxes')}, q AS {BOX_P},
m AS (SELECT point_id, body_id, {RING_D} AS ring, abs(p.x - cx) <= side_m / 2 AND abs(p.y - cy) <= side_m / 2 AS inside FROM q p JOIN boxes ON {BOX_D} <= 1000),
b AS (SELECT point_id, min(body_id) FILTER (inside) AS own, arg_min(body_id, round(ring, 4) * 1e7 + body_id) FILTER (ring <= 1000) AS near, min(ring) AS d FROM m GROUP BY 1)
SELECT point_id, coalesce(own, near) AS body_id, CASE WHEN own IS NOT NULL THEN 0 ELSE round(round(d, 4), 1) END AS distance, own IS NOT NULL AS inside FROM q LEFT JOIN b USING (point_id)""")
def nearest_polygon(spark, sf_dir):
    edges = spatial.box_edges(adapted(spark, sf_dir, "boxes"), "body_id")
    return spatial.nearest_polygon(box_points(spark, sf_dir), edges, 1000.0, "body_id").select("point_id", "body_id", "distance", "inside")


def boundary_edges(spark: SparkSession) -> DataFrame:
    ring = [*BOUNDARY, BOUNDARY[0]]
    edges = spark.createDataFrame([("city", *a, *b) for a, b in zip(ring, ring[1:])], "polygon_id string, a0 double, o0 double, a1 double, o1 double")
    return projected(projected(edges, "a0", "o0", "x0", "y0"), "a1", "o1", "x1", "y1").select("polygon_id", "x0", "y0", "x1", "y1")


EDGES = "e0 AS (SELECT * FROM (VALUES {}) v(a0, o0, a1, o1)), {}, {}, e AS (SELECT e2.x0, e2.y0, e2.x AS x1, e2.y AS y1 FROM e2)".format(
    ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(BOUNDARY, [*BOUNDARY[1:], BOUNDARY[0]])),
    utm_sql("e1", "e0", "a0", "o0"),
    utm_sql("e2", "(SELECT a1, o1, x AS x0, y AS y0 FROM e1)", "a1", "o1"),
)
INSIDE = "(SELECT point_id FROM p JOIN e ON (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) GROUP BY 1 HAVING count(*) % 2 = 1)"


@query("J4_historical_lookup", f"""WITH {POINTS}, {POCKETS}, {EDGES}, i AS {INSIDE},
n AS (SELECT point_id, count(*) AS n FROM p JOIN t ON {POINT_D} <= 250 GROUP BY 1),
m AS (SELECT point_id, min(round({POINT_D}, 4)) AS d FROM p JOIN t ON t.x IS NOT NULL GROUP BY 1)
SELECT p.point_id, i.point_id IS NOT NULL AS inside, CASE WHEN i.point_id IS NOT NULL THEN coalesce(n, 0) END AS n_records, CASE WHEN i.point_id IS NOT NULL THEN round(d, 1) END AS nearest_m
FROM p LEFT JOIN i USING (point_id) LEFT JOIN n USING (point_id) LEFT JOIN m USING (point_id)""")
def historical_lookup(spark, sf_dir):
    p, t = points(spark, sf_dir), targets(spark, sf_dir, "pockets")
    return spatial.historical_lookup(p, t, boundary_edges(spark), 250.0).select("point_id", "inside", "n_records", "nearest_m")


TRAIN = f"{adapters_sql('train')}, {utm_sql('p', 'train')}"


@query("J9_far_from", f"WITH {TRAIN} SELECT point_id FROM p WHERE label = 0 AND NOT EXISTS (FROM p t WHERE t.label = 1 AND {POINT_D} < 300)")
def far_from(spark, sf_dir):
    t = projected(adapted(spark, sf_dir, "train"))
    positives = t.filter("label = 1").select(F.col("x").alias("tx"), F.col("y").alias("ty"))
    return spatial.far_from(t.filter("label = 0"), positives, 300.0).select("point_id")


@query("J10_V6_leakage", f"WITH {TRAIN} SELECT point_id FROM p WHERE label = 0 AND EXISTS (FROM p t WHERE t.label = 1 AND {POINT_D} < 300)")
def leakage(spark, sf_dir):
    t = projected(adapted(spark, sf_dir, "train"))
    positives = t.filter("label = 1").select(F.col("x").alias("tx"), F.col("y").alias("ty"))
    return spatial.within_distance(t.filter("label = 0"), positives, 300.0).select("point_id")


@query("F3_within_mapped", f"WITH {POINTS}, {SEGMENTS} SELECT point_id, source_sheet, count(*) AS n FROM p JOIN s ON {LINE_D} <= 100 GROUP BY ALL")
def within_mapped(spark, sf_dir):
    near = lambda places: spatial.near_segments(places, segments(spark, sf_dir), 100.0).groupBy("point_id", "source_sheet").agg(F.count("*").alias("n"))
    return spatial.at_places(points(spark, sf_dir), near).select("point_id", "source_sheet", "n")


@query("F1_in_bbox", f"WITH {adapters_sql('pockets')} SELECT rec_id, lat BETWEEN 22.45 AND 22.65 AND lon BETWEEN 88.25 AND 88.45 AS inside FROM pockets")
def in_bbox(spark, sf_dir):
    return adapted(spark, sf_dir, "pockets").select("rec_id", geo.in_bbox(F.col("lat"), F.col("lon"), (88.25, 22.45, 88.45, 22.65)).alias("inside"))


@query("F2_covered_by", f"WITH {POINTS}, {EDGES} SELECT point_id FROM {INSIDE}")
def covered(spark, sf_dir):
    return spatial.at_places(points(spark, sf_dir), lambda places: spatial.covered_by(places, boundary_edges(spark))).select("point_id")


@query("A8_V8_polygon_area", f"WITH {adapters_sql('boxes')} SELECT body_id, round(side_m * side_m / 1e6, 4) AS area_km2, side_m * side_m / 1e6 BETWEEN 0.1 AND 0.5 AS plausible, 4 AS n_edges, round(cx - side_m / 2, 2) AS xmin, round(cx + side_m / 2, 2) AS xmax, round(cy - side_m / 2, 2) AS ymin, round(cy + side_m / 2, 2) AS ymax FROM boxes")
def polygon_areas(spark, sf_dir):
    """Area by the shoelace sum, whether it is plausible, and bounds of every polygon of the table."""
    area = F.abs(F.sum(F.expr("x0 * y1 - x1 * y0"))) / 2e6
    bounds = [f(c).alias(n) for f, c, n in ((F.min, "x0", "xmin"), (F.max, "x0", "xmax"), (F.min, "y0", "ymin"), (F.max, "y0", "ymax"))]
    found = spatial.box_edges(adapted(spark, sf_dir, "boxes"), "body_id").groupBy("body_id").agg(area.alias("area"), F.count("*").cast("int").alias("n_edges"), *bounds)
    return found.select("body_id", F.round("area", 4).alias("area_km2"), F.round("area", 9).between(0.1, 0.5).alias("plausible"), "n_edges", *[F.round(c, 2).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])
