"""Drainage network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwise.functions.hydrology import manning_capacity
from rillwise.operators import network as n
from rillwise.plans.adapters import adapted, adapters_sql
from rillwise.plans.registry import query

UP = f"""{adapters_sql('net')}, up AS (SELECT a.pipe_id, b.pipe_id AS src, 40 * b.length_m AS own FROM net a JOIN net b ON a.pipe_id = b.pipe_id),
walk AS (SELECT pipe_id AS src, pipe_id, down_node, length_m AS path, length_m FROM net UNION ALL SELECT w.src, p.pipe_id, p.down_node, w.path + p.length_m, p.length_m FROM walk w JOIN net p ON p.up_node = w.down_node),
acc AS (SELECT w.pipe_id, sum(40.0 * s.length_m) AS area_m2, max(path) AS path_m FROM walk w JOIN net s ON s.pipe_id = w.src GROUP BY 1)"""


@query("A26_accumulate", f"WITH RECURSIVE {UP} SELECT pipe_id, round(area_m2, 2) AS area_m2, round(path_m, 2) AS path_m FROM acc")
def accumulate(spark, sf_dir):
    return n.accumulate(adapted(spark, sf_dir, "net")).select("pipe_id", F.round("area_m2", 2).alias("area_m2"), F.round("path_m", 2).alias("path_m"))


STORMS = ((20.0, 60.0), (50.0, 60.0), (100.0, 120.0))
LOADS = f"""{UP}, {adapters_sql('pipes')}, st AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in STORMS)}) v(intensity, minutes)),
cp AS (SELECT acc.*, CASE WHEN conduit_type = 'pipe' AND pipe_diameter_mm BETWEEN 100 AND 3000 THEN 40 / 0.013 * pi() * (pipe_diameter_mm / 1000) ** 2 / 4 * (pipe_diameter_mm / 4000) ** (2 / 3) * sqrt(0.001) END AS capacity FROM acc JOIN pipes ON segment_id = pipe_id),
q AS (SELECT *, (0.65 + 0.25 * least(minutes / 180, 1)) * intensity * area_m2 * least(minutes / (10 + path_m / 0.9 / 60), 1) / 3.6e6 AS inflow FROM cp CROSS JOIN st),
ld AS (SELECT *, inflow / capacity AS load, CASE WHEN capacity IS NOT NULL THEN greatest(inflow - capacity, 0) * minutes * 60 END AS overflow, CASE WHEN capacity IS NULL THEN 'UNKNOWN' WHEN inflow / capacity >= 1.5 THEN 'RED' WHEN inflow / capacity >= 1 THEN 'ORANGE' WHEN inflow / capacity >= .75 THEN 'YELLOW' ELSE 'GREEN' END AS alert FROM q)"""


def loads(spark, sf_dir):
    """Loads of all pipes under three storms; capacities 40-fold, for the adapted network is one single tree."""
    pipes = adapted(spark, sf_dir, "pipes").select(F.col("segment_id").alias("pipe_id"), F.when(F.col("conduit_type") == "pipe", 40 * manning_capacity(F.col("pipe_diameter_mm"))).alias("capacity"))
    storms = spark.createDataFrame(STORMS, "intensity double, minutes double")
    return n.network_load(n.accumulate(adapted(spark, sf_dir, "net")).join(pipes, "pipe_id"), storms)


@query("E5_P17_J11_network_load", f"WITH RECURSIVE {LOADS} SELECT pipe_id, intensity, round(inflow, 4) AS inflow, round(load, 4) AS load, round(overflow, 2) AS overflow, alert FROM ld")
def network_load(spark, sf_dir):
    return loads(spark, sf_dir).select("pipe_id", "intensity", F.round("inflow", 4).alias("inflow"), F.round("load", 4).alias("load"), F.round("overflow", 2).alias("overflow"), "alert")


@query("A3_A4_F5_alert_summary", f"""WITH RECURSIVE {LOADS}, c AS (SELECT intensity, count(*) FILTER (alert = 'RED') AS red, count(*) FILTER (alert = 'ORANGE') AS orange, count(*) FILTER (alert = 'YELLOW') AS yellow, count(*) FILTER (alert = 'GREEN') AS green, count(*) FILTER (alert = 'UNKNOWN') AS unknown, count(*) AS assessed, round(sum(overflow), 0) AS overflow_m3 FROM ld JOIN pipes ON segment_id = pipe_id WHERE (lon0 - 88.375) ** 2 + (lat0 - 22.575) ** 2 <= 0.0225 GROUP BY 1)
SELECT *, CASE WHEN red + orange + yellow + green = 0 THEN 'UNKNOWN' WHEN red / (red + orange + yellow + green) >= .2 THEN 'RED' WHEN (red + orange) / (red + orange + yellow + green) >= .2 THEN 'ORANGE' WHEN (red + orange + yellow) / (red + orange + yellow + green) >= .2 THEN 'YELLOW' ELSE 'GREEN' END AS overall FROM c""")
def summary(spark, sf_dir):
    """Alerts of the pipes that begin within 0.15 degrees of the city's centre."""
    begin = adapted(spark, sf_dir, "pipes").select(F.col("segment_id").alias("pipe_id"), "lon0", "lat0")
    own = loads(spark, sf_dir).join(begin, "pipe_id").filter(n.in_area(F.col("lon0"), F.col("lat0"), F.lit(88.375), F.lit(22.575), F.lit(0.15)))
    return n.alert_summary(own, ["intensity"])


@query("A5_infer_nodes", f"""WITH {adapters_sql('pipes')}, e AS (SELECT segment_id, ward, pipe_diameter_mm, round(lon0, 2) AS lon, round(lat0, 2) AS lat FROM pipes UNION ALL SELECT segment_id, ward, pipe_diameter_mm, round(lon0 + 0.01, 2), round(lat0, 2) FROM pipes)
SELECT lon, lat, count(*) AS degree, max(pipe_diameter_mm) AS max_diameter, arg_min(ward, segment_id) AS ward, CASE WHEN count(*) >= 3 THEN 'junction' WHEN count(*) = 2 THEN 'joint' ELSE 'terminal' END AS kind FROM e GROUP BY 1, 2""")
def nodes(spark, sf_dir):
    ends = adapted(spark, sf_dir, "pipes").select("segment_id", "ward", F.col("pipe_diameter_mm").alias("diameter"), F.explode(F.array(*[F.struct(F.round(F.col("lon0") + d, 2).alias("lon"), F.round("lat0", 2).alias("lat")) for d in (0.0, 0.01)])).alias("e"))
    return n.infer_nodes(ends.select("segment_id", "ward", "diameter", "e.lon", "e.lat")).select(F.col("klon").alias("lon"), F.col("klat").alias("lat"), "degree", "max_diameter", "ward", "kind")
