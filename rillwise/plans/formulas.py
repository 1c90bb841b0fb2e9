"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwise.functions import feeds, hydrology as h, names
from rillwise.plans.adapters import adapted, adapters_sql, table
from rillwise.plans.registry import query

MANNING = "1 / 0.013 * pi() * (d / 1000) ** 2 / 4 * (d / 4000) ** (2 / 3) * sqrt(0.001)"


@query("P7_P8_manning_capacity", f"""WITH {adapters_sql('pipes')}, q AS (SELECT *, CASE WHEN segment_id % 13 = 0 THEN NULL ELSE conduit_type END AS kind, pipe_diameter_mm * CASE WHEN segment_id % 17 = 0 THEN 10 ELSE 1 END AS d FROM pipes)
SELECT segment_id, round(CASE WHEN d BETWEEN 100 AND 3000 THEN {MANNING} END, 4) AS bore, round(CASE WHEN d BETWEEN 100 AND 3000 AND coalesce(kind, 'pipe') = 'pipe' THEN {MANNING} END, 4) AS capacity,
CASE WHEN d BETWEEN 100 AND 3000 AND coalesce(kind, 'pipe') = 'pipe' THEN 'manning_full_bore' END AS method, round(CASE WHEN d BETWEEN 100 AND 3000 AND kind = 'pipe' THEN {MANNING} END, 4) AS network_capacity FROM q""")
def manning(spark, sf_dir):
    p = adapted(spark, sf_dir, "pipes")
    p = p.withColumn("kind", F.when(F.col("segment_id") % 13 != 0, F.col("conduit_type"))).withColumn("d", F.col("pipe_diameter_mm") * F.when(F.col("segment_id") % 17 == 0, 10).otherwise(1))
    own, net = h.capacity_fields(F.col("d"), F.col("kind")), h.capacity_fields(F.col("d"), F.col("kind"), null_is_pipe=False)
    return p.select("segment_id", F.round(h.manning_capacity(F.col("d")), 4).alias("bore"), own["capacity"].alias("capacity"), own["method"].alias("method"), net["capacity"].alias("network_capacity"))


RAIN = "CASE WHEN try_cast(trim(rain_raw) AS DOUBLE) >= 0 THEN 0.3 + 0.7 * least(try_cast(trim(rain_raw) AS DOUBLE) / 90, 1) ELSE 1 END"


@query("P9_P21_P22_rain", f"""WITH {adapters_sql('wx')} SELECT event_id, round(try_cast(trim(rain_raw) AS DOUBLE), 4) AS number,
round(CASE WHEN upper(trim(rain_raw)) IN ('NIL', 'TRACE', 'TR') THEN 0 ELSE try_cast(trim(rain_raw) AS DOUBLE) END, 4) AS rain_mm, round({RAIN}, 4) AS multiplier FROM wx""")
def rain(spark, sf_dir):
    raw = F.col("rain_raw")
    return adapted(spark, sf_dir, "wx").select("event_id", F.round(feeds.to_float(raw), 4).alias("number"), F.round(feeds.to_rain_mm(raw), 4).alias("rain_mm"), F.round(h.rainfall_multiplier(raw), 4).alias("multiplier"))


@query("P10_P11_P36_risk_bands", f"""WITH {adapters_sql('route_segs')} SELECT route_id, seq, k1, k2, k3, k4, k5, round(prob, 4) AS prob,
CASE WHEN prob IS NULL THEN NULL WHEN prob >= .7 THEN 'HIGH' WHEN prob >= .45 THEN 'ELEVATED' WHEN prob >= .25 THEN 'MODERATE' ELSE 'LOW' END AS level,
CASE WHEN prob IS NULL THEN NULL WHEN prob >= .8 THEN 'CRITICAL' WHEN prob >= .6 THEN 'HIGH' WHEN prob >= .35 THEN 'MODERATE' ELSE 'LOW' END AS synth,
CASE WHEN prob >= .8 THEN '#d62828' WHEN prob >= .6 THEN '#f97316' WHEN prob >= .35 THEN '#eab308' WHEN prob IS NOT NULL THEN '#22c55e' ELSE '#94a3b8' END AS colour,
CASE WHEN prob IS NULL THEN 'no_data' WHEN k3 > 25 THEN 'full' ELSE 'terrain_only' END AS coverage FROM route_segs""")
def bands(spark, sf_dir):
    p = F.col("prob")
    keys = ["route_id", "seq", "k1", "k2", "k3", "k4", "k5"]
    return adapted(spark, sf_dir, "route_segs").select(*keys, F.round(p, 4).alias("prob"), h.risk_level(p).alias("level"), h.risk_level_synth(p).alias("synth"), h.risk_color(h.risk_level_synth(p)).alias("colour"), h.coverage_class(p, F.col("k3") > 25).alias("coverage"))


@query("P12_P13_P42_nowcast", f"""WITH {adapters_sql('wx')}, n AS (SELECT *, abs(value) AS r, (event_id % 1001) / 1000.0e0 AS sus FROM wx)
SELECT event_id, CASE WHEN r < 20 THEN 'LOW' WHEN r < 50 THEN 'MODERATE' WHEN r < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS level, CASE WHEN r < 20 THEN 15 WHEN r < 50 THEN 40 WHEN r < 80 THEN 70 ELSE 90 END AS score,
round(least(sus * (0.3 + 0.7 * least(r / 90, 1)) * 1.1, 1), 4) AS adjusted, CASE WHEN r > 10 THEN 'heavy_rain' WHEN r > 0 THEN 'rain' WHEN event_id % 100 > 80 THEN 'humid' ELSE 'clear' END AS condition FROM n""")
def nowcast(spark, sf_dir):
    n = adapted(spark, sf_dir, "wx").withColumn("r", F.abs("value")).withColumn("sus", (F.col("event_id") % 1001) / 1000.0)
    now = h.nowcast(F.col("r"))
    adjusted = h.adjusted_probability(F.col("sus"), F.col("r"), F.lit(60))
    return n.select("event_id", now["level"].alias("level"), now["score"].alias("score"), adjusted.alias("adjusted"), h.condition(F.col("r"), F.col("event_id") % 100).alias("condition"))


@query("P14_P15_P16_scenario", f"""WITH {adapters_sql('route_segs')}, n AS (SELECT *, CASE WHEN k2 % 5 <> 0 THEN k3 / 20.0e0 END AS load, k1 % 400 * 1.0e0 AS dist, CASE WHEN seq = 1 THEN 0.0e0 ELSE k2 % 120 * 1.0e0 END AS mm, k1 % 15 * 1.0e0 AS depth FROM route_segs),
z AS (SELECT *, CASE WHEN load IS NULL THEN 0 ELSE 0.9 * greatest(0, least(1, (load - .75) / 1.25)) * greatest(0, 1 - dist / 300) END AS hazard, CASE WHEN mm = 0 THEN 0.3 * least(depth / 10, 1) ELSE 0.3 + 0.7 * least(mm / 90, 1) END AS m FROM n)
SELECT route_id, seq, k1, k2, k3, k4, k5, CASE WHEN load IS NULL THEN 'UNKNOWN' WHEN load >= 1.5 THEN 'RED' WHEN load >= 1 THEN 'ORANGE' WHEN load >= .75 THEN 'YELLOW' ELSE 'GREEN' END AS alert, round(hazard, 4) AS hazard, CASE WHEN prob IS NOT NULL THEN round(1 - (1 - least(prob * m, 1)) * (1 - hazard) + 1e-9, 6) END AS risk FROM z""")
def scenario(spark, sf_dir):
    n = adapted(spark, sf_dir, "route_segs").withColumn("load", F.when(F.col("k2") % 5 != 0, F.col("k3") / 20)).withColumn("dist", (F.col("k1") % 400).cast("double"))
    n = n.withColumn("mm", F.when(F.col("seq") == 1, 0.0).otherwise(F.col("k2") % 120)).withColumn("depth", (F.col("k1") % 15).cast("double"))
    n = n.withColumn("hazard", h.drain_hazard(F.col("load"), F.col("dist")))
    risk = h.scenario_risk(F.col("prob"), F.col("mm"), F.col("hazard"), F.col("depth"))
    return n.select("route_id", "seq", "k1", "k2", "k3", "k4", "k5", h.drain_alert(F.col("load")).alias("alert"), F.round("hazard", 4).alias("hazard"), F.round(risk + 1e-9, 6).alias("risk"))


DEPTH = """greatest(0, round(greatest(0, mm / (1 + 0.3 * (minutes / 60 - 1)) * (minutes / 60) * (0.3 + imperviousness / 100 * 0.65) / 1000 * 250000
- drain_capacity * (minutes / 60) * greatest(0.2, 1 - mm / 200) * greatest(0.3, 1 - distance_to_drain / 100)) / 250000 * greatest(0.5, 2 - elevation / 10) * greatest(0.3, 1 - slope / 5) * 100 + historical_floods * 0.5, 1))"""
STORMS = ((15.0, 60.0), (40.0, 60.0), (90.0, 120.0), (150.0, 180.0))
CELLS = f"{adapters_sql('cells')}, g AS (SELECT * FROM cells CROSS JOIN (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in STORMS)}) v(mm, minutes)), d AS (SELECT cell_id, mm, minutes, {DEPTH} AS depth FROM g)"


def depths(spark, sf_dir):
    """Cells under every storm: the storms are a small fixed table."""
    storms = spark.createDataFrame(STORMS, "mm double, minutes double")
    g = adapted(spark, sf_dir, "cells").crossJoin(F.broadcast(storms))
    cols = ["mm", "minutes", "imperviousness", "drain_capacity", "distance_to_drain", "elevation", "slope", "historical_floods"]
    depth = h.water_depth_cm(*[F.col(c) for c in cols])
    return g.select("cell_id", "mm", "minutes", depth.alias("depth"))


@query("P18_P19_G7_G8_E13_depth_dataset", f"WITH {CELLS} SELECT cell_id, mm, minutes, depth, round(1 / (1 + exp(-(depth - 10) / 5)), 3) AS probability FROM d")
def depth_dataset(spark, sf_dir):
    return depths(spark, sf_dir).withColumn("probability", h.depth_probability(F.col("depth")))


@query("A27_depth_stats", f"WITH {CELLS} SELECT mm, count(*) AS n, min(depth) AS least, max(depth) AS most, round(avg(depth), 4) AS mean, round(avg(CASE WHEN depth > 10 THEN 1.0 ELSE 0 END), 4) AS flooded FROM d GROUP BY mm")
def depth_stats(spark, sf_dir):
    return depths(spark, sf_dir).groupBy("mm").agg(F.count("*").alias("n"), F.min("depth").alias("least"), F.max("depth").alias("most"), F.round(F.avg("depth"), 4).alias("mean"), F.round(F.avg(F.when(F.col("depth") > 10, 1.0).otherwise(0.0)), 4).alias("flooded"))


@query("P20_G6_grid_cells", f"WITH {adapters_sql('boxes')} SELECT body_id, i, j, round(cx - side_m / 2 + (i + .5) * 50, 3) AS x, round(cy - side_m / 2 + (j + .5) * 50, 3) AS y FROM boxes, range(0, 100) a(i), range(0, 100) b(j) WHERE i < floor(side_m / 50) AND j < floor(side_m / 50)")
def grid_cells(spark, sf_dir):
    n = F.floor(F.col("side_m") / 50)
    cells = adapted(spark, sf_dir, "boxes").filter("side_m >= 50").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
    at = lambda c, k: F.round(F.col(c) - F.col("side_m") / 2 + (F.col(k) + 0.5) * 50, 3)
    return cells.select("body_id", "i", "j", at("cx", "i").alias("x"), at("cy", "j").alias("y"))


@query("P23_obs_timestamp", f"""WITH {adapters_sql('wx')}, q AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS d, CASE event_id % 3 WHEN 0 THEN CAST(hour(ts) AS VARCHAR) WHEN 1 THEN strftime(ts, '%H:%M:%S') END AS c FROM wx)
SELECT event_id, CASE WHEN d IS NULL THEN NULL WHEN c IS NULL THEN d ELSE d || 'T' || CASE WHEN length(c) <= 2 THEN lpad(c, 2, '0') || ':00:00' ELSE c END || 'Z' END AS observed FROM q""")
def timestamps(spark, sf_dir):
    w = adapted(spark, sf_dir, "wx")
    day = F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "yyyy-MM-dd"))
    clock = F.when(F.col("event_id") % 3 == 0, F.hour("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "HH:mm:ss"))
    return w.select("event_id", feeds.obs_timestamp(day, clock).alias("observed"))


@query("P30_P31_P34_text_fields", r"""SELECT p_partkey, [x for x in [try_cast(trim(y) AS INTEGER) for y in string_split(wards, ',')] if x BETWEEN 1 AND 144][1] AS first_ward,
len([x for x in [try_cast(trim(y) AS INTEGER) for y in string_split(wards, ',')] if x BETWEEN 1 AND 144]) AS n_wards, 'P' || p_partkey AS base,
try_cast(regexp_extract(label, '(?i)\b(\d{3,4})\s*(?:mm|KEIIP)\b', 1) AS INTEGER) AS diameter_mm, try_cast(replace(regexp_extract(label, '(?i)SCALE\s*1\s*:\s*([\d,]+)', 1), ',', '') AS INTEGER) AS scale
FROM (SELECT p_partkey, p_partkey % 200 || ', ' || p_size || ',x' AS wards, CASE p_partkey % 3 WHEN 0 THEN 'pipe ' || (p_size * 25) || 'mm' WHEN 1 THEN (p_size * 30) || ' KEIIP' ELSE 'SCALE 1:2,' || (100 + p_size) END AS label FROM part)""")
def text_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wards = F.concat(F.col("p_partkey") % 200, F.lit(", "), F.col("p_size"), F.lit(",x"))
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("pipe "), F.col("p_size") * 25, F.lit("mm"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size") * 30, F.lit(" KEIIP"))).otherwise(F.concat(F.lit("SCALE 1:2,"), 100 + F.col("p_size")))
    found, parsed = feeds.split_wards(wards), feeds.parse_label(label)
    base = feeds.base_id(F.concat(F.lit("P"), F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, F.lit("__heavy")).otherwise(F.lit(""))))
    return p.select("p_partkey", F.get(found, F.lit(0)).alias("first_ward"), F.size(found).cast("long").alias("n_wards"), base.alias("base"), parsed["diameter_mm"].alias("diameter_mm"), parsed["scale"].alias("scale"))


GENERIC = ", ".join(f"'{w}'" for w in names.GENERIC)


@query("P28_distinctive_tokens", rf"""SELECT p_partkey, array_to_string([t for t in regexp_extract_all(lower(p_name || ' 2nd Lane near ' || p_brand), '[a-z0-9]+') if t NOT IN ({GENERIC}) AND NOT regexp_full_match(t, '\d+(st|nd|rd|th)?') AND length(t) > 2], ' ') AS tokens FROM part""")
def distinctive(spark, sf_dir):
    text = F.concat("p_name", F.lit(" 2nd Lane near "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.distinctive_tokens(text), " ").alias("tokens"))


#: Pieces of location texts, many of them words of the cleaning rules; texts are drawn from them by the part's number.
PIECES = (
    "46,", " ", "4,5", " ", "12/A, ", "7-B ", "St", " St.", "-", "Rd", " Rd. ", "Ln", ". ", " near ", " NEAR", "opp. ", " opp ", "(portion)", " (from x", ")", " part ", "portion", "jn.", " Jn ", "junction of ", " & ", "&", " and ", "and",
    "Middle", "hill", " Pally", "22 Bigha", " in front of ", " infront of", "towards ", ", ", "Stone", "Rdx", "  ", "crossing of ", "apart", "-John",
)
N_PIECES = 9
DRAWS = [(37 + 62 * k, 11 * k * k + 3 * k) for k in range(N_PIECES)]


def _clean_sql() -> str:
    pieces = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in PIECES) + "]"
    text = " || ".join(f"{pieces}[1 + CAST(floor({a} * p_partkey / 7 + {b}) AS BIGINT) % {len(PIECES)}]" for a, b in DRAWS)
    cleaned = "raw"
    for pattern, put in names.CLEANING:
        cleaned = f"regexp_replace({cleaned}, '{pattern}', '{put}', 'g')"
    return f"SELECT p_partkey, raw, trim({cleaned}, ' ,.-') AS cleaned FROM (SELECT p_partkey, {text} AS raw FROM part)"


@query("P27_clean_query", _clean_sql())
def clean(spark, sf_dir):
    """Location texts of many forms, cleaned."""
    pieces = F.array(*[F.lit(x) for x in PIECES])
    piece = lambda a, b: F.get(pieces, (F.floor(a * F.col("p_partkey") / 7 + b) % len(PIECES)).cast("int"))
    raw = F.concat(*[piece(a, b) for a, b in DRAWS])
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), names.clean_query(raw).alias("cleaned"))


@query("P37_source_state", f"""WITH {adapters_sql('wx')} SELECT station, max(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) = 1 AS success, CASE WHEN station % 5 = 0 THEN 'NOT_CONFIGURED' WHEN bool_or(outcome = 'ok') THEN 'LIVE' ELSE 'ERROR' END AS live,
CASE WHEN station % 7 = 0 THEN 'ERROR' WHEN station % 7 = 1 THEN 'MISSING' ELSE 'LOADED' END AS layer FROM wx GROUP BY station""")
def states(spark, sf_dir):
    w = adapted(spark, sf_dir, "wx").groupBy("station").agg(F.max(F.when(F.col("outcome") == "ok", F.col("ts"))).alias("ok"), F.max(F.when(F.col("outcome") != "ok", F.col("outcome"))).alias("error"))
    layer = h.source_state(F.col("station") % 7 != 1, F.when(F.col("station") % 7 == 0, "unreadable"))
    return w.select("station", F.col("ok").isNotNull().alias("success"), h.live_state(F.col("station") % 5 != 0, F.col("ok"), F.col("error")).alias("live"), layer.alias("layer"))


@query("F4_F7_scored_only", f"WITH {adapters_sql('route_segs')} SELECT route_id, count(*) AS n, count(prob) AS scored, count(*) FILTER (prob IS NOT NULL OR seq > 3) AS known FROM route_segs GROUP BY route_id")
def scored(spark, sf_dir):
    s = adapted(spark, sf_dir, "route_segs")
    known = h.has_any(F.col("prob"), F.when(F.col("seq") > 3, F.col("seq")))
    return s.groupBy("route_id").agg(F.count("*").alias("n"), F.count("prob").alias("scored"), F.count_if(known).alias("known"))


@query("G3_cross_pattern", f"WITH {adapters_sql('pts')} SELECT point_id, dx, dy, round(lat + dy * 0.002, 6) AS lat, round(lon + dx * 0.002, 6) AS lon FROM pts, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1),(2,0),(-2,0),(0,2),(0,-2)) v(dx, dy)")
def cross(spark, sf_dir):
    offsets = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (-2, 0), (0, 2), (0, -2)]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets])).alias("o")
    p = adapted(spark, sf_dir, "pts").select("*", o)
    return p.select("point_id", "o.dx", "o.dy", F.round(F.col("lat") + F.col("o.dy") * 0.002, 6).alias("lat"), F.round(F.col("lon") + F.col("o.dx") * 0.002, 6).alias("lon"))


@query("G1_hex_grid", f"""WITH {adapters_sql('boxes')}, g AS (SELECT body_id, i, j, cx + (i + CASE WHEN j % 2 <> 0 THEN .5 ELSE 0 END) * 100 AS x, cy + j * 100 * sqrt(3) / 2 AS y, cx, cy FROM boxes, range(-4, 5) a(i), range(-4, 5) b(j))
SELECT body_id, i, j, round(x, 3) AS x, round(y, 3) AS y FROM g WHERE sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 250 + 1e-9""")
def hexagons(spark, sf_dir):
    return hex_grid(adapted(spark, sf_dir, "boxes"), 250.0, 100.0).select("body_id", "i", "j", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def hex_grid(centres, radius: float, spacing: float):
    """Centres (cx, cy) with the points of a hexagonal grid round each, within radius; odd rows are shifted by half a step."""
    n = int(radius // spacing) + 2
    g = centres.withColumn("i", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn("j", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    g = g.withColumn("x", F.col("cx") + (F.col("i") + F.when(F.col("j") % 2 != 0, 0.5).otherwise(0.0)) * spacing).withColumn("y", F.col("cy") + F.col("j") * (spacing * 3**0.5 / 2))
    return g.filter(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) <= radius + 1e-9)
