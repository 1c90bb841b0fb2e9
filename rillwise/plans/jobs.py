"""Whole jobs, models and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillwise.functions.geo import utm_to_latlon
from rillwise.functions.hydrology import at_most, coverage_class, drain_alert, drain_hazard, live_state, manning_capacity, rainfall_multiplier, risk_level, scenario_risk, source_state
from rillwise.operators import checks, layers, models, network, spatial, validation
from rillwise.plans.adapters import ADAPTERS, adapted, adapters_sql, table
from rillwise.plans.formulas import depths, hex_grid
from rillwise.plans.layers import KEPT, sheets as line_sheets
from rillwise.plans.registry import query
from rillwise.plans.features import FEATURES, LAYERS, OF_POINTS, featured
from rillwise.plans.spatial import boundary_edges, points, projected, segments, targets
from rillwise.plans.training import SCENARIOS, train
from rillwise.sources import readers
from rillwise.store import saved, scratch
from rillwise.streaming import weather as stream

def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points with their features, written once: training reads them again and again."""
    return saved(featured(spark, sf_dir, train(spark, sf_dir)), "features")


def fitted(spark: SparkSession, sf_dir: str):
    return models.train_susceptibility(located(spark, sf_dir), FEATURES)


@query("M1_M3_E1_location_risk")
def location_risk(spark, sf_dir):
    """Risk of every point under 40 mm of rain, with its coverage class."""
    own = featured(spark, sf_dir, points(spark, sf_dir)).withColumn("rain_mm", F.lit(40.0))
    scored = models.score_segments(own, fitted(spark, sf_dir), FEATURES)
    return scored.select("point_id", "susceptibility", "probability", "level", coverage_class(F.col("probability"), F.col("drain_m").isNotNull()).alias("coverage"))


@query("M2_spatial_cv")
def cv(spark, sf_dir):
    return models.spatial_cv(located(spark, sf_dir), FEATURES)


@query("M8_O6_model_metadata")
def metadata(spark, sf_dir):
    rows = located(spark, sf_dir)
    return models.model_metadata(models.train_susceptibility(rows, FEATURES), rows, FEATURES, "real_v1")


@query("M4_M5_M7_predict_batch")
def batch(spark, sf_dir):
    names = ["mm", "minutes", "imperviousness", "drain_capacity", "distance_to_drain", "elevation", "slope", "historical_floods"]
    rows = depths(spark, sf_dir).join(adapted(spark, sf_dir, "cells"), "cell_id").withColumn("label", (F.col("depth") > 10).cast("int"))
    rest, test = checks.split(rows, 0.2, 42, "cell_id")
    deep = models.train_depth(rest, names)
    flood = models.train_susceptibility(rest, names)
    return models.predict_batch(test, deep, flood, names).select("cell_id", "mm", "minutes", "depth_cm", "probability", "level", "colour")


@query("E4_simulate_points")
def simulate(spark, sf_dir):
    """Scenario risk of all points: 60 mm/h for an hour over the points' susceptibility and the load of their drain."""
    own = featured(spark, sf_dir, points(spark, sf_dir))
    scored = models.predict(own, fitted(spark, sf_dir), FEATURES)
    pipes = adapted(spark, sf_dir, "pipes").select(F.col("segment_id").alias("pipe_id"), F.when(F.col("conduit_type") == "pipe", 40 * manning_capacity(F.col("pipe_diameter_mm"))).alias("capacity"))
    storm = spark.createDataFrame([(60.0, 60.0)], "intensity double, minutes double")
    load = network.network_load(network.accumulate(adapted(spark, sf_dir, "net")).join(pipes, "pipe_id"), storm).select(F.col("pipe_id").alias("segment_id"), "load")
    met = scored.join(load, "segment_id", "left").withColumn("hazard", drain_hazard(F.col("load"), F.col("drain_m")))
    risk = F.round(scenario_risk(F.col("susceptibility"), F.lit(60.0), F.col("hazard"), F.lit(60.0)), 4)
    return met.select("point_id", "susceptibility", risk.alias("probability"), risk_level(risk).alias("level"), F.when(F.col("segment_id").isNotNull(), drain_alert(F.col("load"))).alias("alert"))


@query("E6_radius_risk")
def radius(spark, sf_dir):
    """A hexagonal grid round every pump as GeoJSON features with each place's risk under 40 mm of rain."""
    centres = targets(spark, sf_dir, "pumps").select("pump_id", F.col("tx").alias("cx"), F.col("ty").alias("cy"))
    grid = hex_grid(centres, 500.0, 200.0).withColumn("point_id", F.concat_ws(":", "pump_id", "i", "j"))
    lat, lon = utm_to_latlon(F.col("x"), F.col("y"))
    places = grid.select("point_id", "x", "y", lat.alias("lat"), lon.alias("lon"))
    own = featured(spark, sf_dir, places).withColumn("rain_mm", F.lit(40.0))
    scored = models.score_segments(own, fitted(spark, sf_dir), FEATURES)
    return layers.to_geojson_features(scored, "lon", "lat", ["point_id", "drain_m", "pump_m", "susceptibility", "probability", "level"])


JITTER = "(('0x' || md5('{0}:' || i || ':' || j)[1:7])::BIGINT % 1201 - 600) / 10.0"
#: Positives and negatives of the training set as points p, in SQL.
TRAINING_POINTS = f"""pos AS (SELECT CAST(rec_id AS VARCHAR) AS point_id, x, y FROM rk WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY round(lat, 6), round(lon, 6) ORDER BY rec_id) = 1),
box AS (SELECT min(x0) AS a, max(x0) AS b, min(y0) AS c, max(y0) AS d FROM e), gi AS (SELECT *, unnest(range(0, CAST(floor((b - a) / 300) AS BIGINT) + 1)) AS i FROM box), gj AS (SELECT *, unnest(range(0, CAST(floor((d - c) / 300) AS BIGINT) + 1)) AS j FROM gi),
cand AS (SELECT 'neg_' || i || '_' || j AS point_id, a + i * 300 + {JITTER.format('x')} AS x, c + j * 300 + {JITTER.format('y')} AS y FROM gj),
within AS (SELECT cand.point_id FROM cand JOIN e ON (e.y0 > cand.y) <> (e.y1 > cand.y) AND cand.x < e.x0 + (cand.y - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) GROUP BY 1 HAVING count(*) % 2 = 1),
close_ AS (SELECT DISTINCT cand.point_id FROM cand JOIN pos ON abs(cand.x - pos.x) < 300 AND abs(cand.y - pos.y) < 300 AND (cand.x - pos.x) ** 2 + (cand.y - pos.y) ** 2 < 90000),
p AS (SELECT *, 1 AS label FROM pos UNION ALL SELECT *, 0 FROM cand WHERE point_id IN (SELECT point_id FROM within) AND point_id NOT IN (SELECT point_id FROM close_))"""
TRAINED = ["elevation_m", "slope_pct", "drain_m", "pump_m", "water_m", "pipe_diameter_mm"]
SCENARIO_ROWS = ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in SCENARIOS)


@query("E7_build_training", f"""WITH {LAYERS}, {TRAINING_POINTS}, {OF_POINTS}
SELECT point_id || '__' || scenario AS row_id, point_id, label, scenario, mm, round(x, 3) AS x, round(y, 3) AS y, round(elevation_m, 4) AS elevation_m, round(slope_pct + 1e-9, 3) AS slope_pct, drain_m, pump_m, water_m, pipe_diameter_mm FROM ft, (VALUES {SCENARIO_ROWS}) v(scenario, mm)""")
def build(spark, sf_dir):
    """Every training row, written as CSV and read again: positives (records at distinct places), negatives from a lattice, with the features of all layers, under every scenario."""
    rows = training_rows(featured(spark, sf_dir, build_training(spark, sf_dir)), spark.createDataFrame(SCENARIOS, "scenario string, mm double"))
    path = scratch(spark, "training-set")
    readers.write_training(rows, path)
    return readers.read_training(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


@query("E7_A7_training_report", f"""WITH {LAYERS}, {TRAINING_POINTS}, {OF_POINTS} SELECT count(*) AS n_places, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 1 AND drain_m IS NOT NULL) AS positives_with_drain,
{', '.join(f'round(100.0 * count({c}) / count(*) + 1e-9, 2) AS {c}_pct' for c in TRAINED)} FROM ft""")
def training_report(spark, sf_dir):
    """How complete the training set is: one row over its places."""
    f = featured(spark, sf_dir, build_training(spark, sf_dir))
    known = [F.round(100.0 * F.count(c) / F.count("*") + 1e-9, 2).alias(f"{c}_pct") for c in TRAINED]
    return f.agg(F.count("*").alias("n_places"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if((F.col("label") == 1) & F.col("drain_m").isNotNull()).alias("positives_with_drain"), *known)


def build_training(spark: SparkSession, sf_dir: str, step: float = 300.0) -> DataFrame:
    """point_id, x, y, label: deduplicated records and jittered lattice points inside the boundary that are far from all of them."""
    kept = checks.first_by(adapted(spark, sf_dir, "pockets").filter("lat is not null"), [F.round("lat", 6), F.round("lon", 6)], ["rec_id"])
    pos = projected(kept).select(F.col("rec_id").cast("string").alias("point_id"), "x", "y")
    box = boundary_edges(spark).agg(F.min("x0").alias("a"), F.max("x0").alias("b"), F.min("y0").alias("c"), F.max("y0").alias("d"))
    grid = box.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / step)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("d") - F.col("c")) / step))))
    jitter = lambda s: (checks.hash_number(F.lit(s), "i", "j") % 1201 - 600) / 10.0
    cand = grid.select(F.concat_ws("_", F.lit("neg"), "i", "j").alias("point_id"), (F.col("a") + F.col("i") * step + jitter("x")).alias("x"), (F.col("c") + F.col("j") * step + jitter("y")).alias("y"))
    inside = cand.join(spatial.covered_by(cand, boundary_edges(spark)).select("point_id"), "point_id", "left_semi")
    neg = spatial.far_from(inside, pos.select(F.col("x").alias("tx"), F.col("y").alias("ty")), 300.0)
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def training_rows(places: DataFrame, scenarios: DataFrame) -> DataFrame:
    """A row for each place with its features and each scenario (a few)."""
    rounded = {"x": F.round("x", 3), "y": F.round("y", 3), "elevation_m": F.round("elevation_m", 4), "slope_pct": F.round(F.col("slope_pct") + 1e-9, 3)}
    each = places.crossJoin(F.broadcast(scenarios)).withColumn("row_id", F.concat_ws("__", "point_id", "scenario"))
    return each.select("row_id", "point_id", "label", "scenario", "mm", *[rounded.get(c, F.col(c)).alias(c) for c in ("x", "y", *TRAINED)])


@query("E9_merge_layers", f"""WITH {adapters_sql('pipes')}, {KEPT}, k AS (SELECT kept.segment_id, rank, ward FROM kept JOIN pipes p ON p.segment_id = line_no)
SELECT segment_id, 'kmc_w' || ward || '_' || CASE WHEN i < 100000 THEN lpad(CAST(i AS VARCHAR), 5, '0') ELSE CAST(i AS VARCHAR) END AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY segment_id) AS i FROM k)""")
def merge(spark, sf_dir):
    """Three sheets as files, read in the order of their names: what is left of them, with new ids."""
    folder, every = scratch(spark, "sheets"), line_sheets(spark, sf_dir)
    for rank, name in ((3, "c-late"), (1, "a-first"), (2, "b-second")):
        own = every.filter(F.col("rank") == rank).drop("rank")
        (own.drop("pipe_diameter_mm") if rank == 3 else own).write.parquet(f"{folder}/sheet-{name}.parquet")
    read = readers.read_sheets(spark, f"{folder}/sheet-*.parquet")
    known = F.when(F.col("pipe_diameter_mm").isNotNull(), "label")
    return merge_layers(read.withColumn("diameter_source", known)).select("segment_id", "id", "rank")


def merge_layers(lines: DataFrame) -> DataFrame:
    """Lines of all sheets with ids by ward, without those that repeat a line of an earlier sheet. Raises if a rule of layers or of drainage is broken.

    lines: segment_id (of its sheet: the layer's ids are new), sheet (in the order of its name), line (array of x, y in metres of UTM 45 N), ward, conduit_type,
    pipe_diameter_mm, diameter_source.
    """
    ranks = layers.sheet_rank(lines, "sheet", "sheet")
    kept = saved(layers.dedupe_lines(lines.join(F.broadcast(ranks), "sheet")), "merged-lines")  # a row a sheet
    broken = [r["check"] for r in layers.rule_counts(kept, layers.drainage_rules()).filter("severity = 'ERROR'").collect()]  # a row a rule
    lonlat = F.transform("line", lambda p: F.struct(utm_to_latlon(p["x"], p["y"])[1].alias("x"), utm_to_latlon(p["x"], p["y"])[0].alias("y")))
    shaped = kept.select(F.concat_ws("/", "sheet", "segment_id").alias("line_id"), "ward", "conduit_type", F.lit("LineString").alias("geom_type"), lonlat.alias("coords"))
    spec = validation.LayerSpec("line_id", ("LineString", "MultiLineString"), ("ward", "conduit_type"), ("conduit_type",), box=(88.0, 22.0, 90.0, 23.0), min_length_m=1.0)
    broken += [r["check"] for r in validation.validate_layer(shaped, spec).collect()]  # a row a rule
    if broken:
        raise ValueError(f"layer is not valid: {', '.join(sorted(broken))}")
    return layers.assign_ids(kept, F.concat(F.lit("kmc_w"), F.col("ward"), F.lit("_")), "ward", ["segment_id", "rank"])


@query("E11_S13_data_status", f"""WITH {adapters_sql('pipes', 'pumps', 'boxes', 'pockets', 'wx')}, ly AS (
SELECT 'pipes' AS name, count(*) AS n, count(*) FILTER (segment_id % 19 = 0) AS dropped, 0 AS bad FROM pipes UNION ALL SELECT 'pumps', count(*), 0, count(*) FILTER (pump_id % 7 = 3) FROM pumps
UNION ALL SELECT 'water', count(*), 0, 0 FROM boxes WHERE side_m < 0),
st AS (SELECT name, n, dropped, CASE WHEN n = 0 THEN 'MISSING' WHEN bad > 0 THEN 'ERROR' ELSE 'LOADED' END AS state FROM ly
UNION ALL SELECT 'pockets', count(*), count(*) FILTER (lat IS NULL OR source IS NULL), CASE WHEN count(*) FILTER (lat IS NOT NULL AND source IS NOT NULL) > 0 THEN 'LOADED' WHEN count(*) > 0 THEN 'ERROR' ELSE 'MISSING' END FROM pockets
UNION ALL SELECT 'weather', count(*), count(*) FILTER (outcome <> 'ok'), CASE WHEN bool_or(outcome = 'ok') THEN 'LIVE' WHEN count(*) > 0 THEN 'ERROR' ELSE 'UNKNOWN' END FROM wx
UNION ALL SELECT 'model real_v1', count(*), 0, 'LOADED' FROM pumps)
SELECT name, n, dropped, state FROM st UNION ALL SELECT 'all', sum(n), sum(dropped), CASE WHEN bool_or(state = 'ERROR') THEN 'ERROR' WHEN bool_or(state = 'MISSING') THEN 'MISSING' ELSE 'LOADED' END FROM st""")
def status(spark, sf_dir):
    """State of all layers, of the records, of the weather feed and of the model, and of all together."""
    shaped = lambda df, kind: df.select(kind.alias("geom_type"), F.when(kind.isNotNull(), F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))).alias("coords"), F.lit("EPSG:4326").alias("crs"))
    known = {
        "pipes": (shaped(adapted(spark, sf_dir, "pipes"), F.when(F.col("segment_id") % 19 != 0, "LineString")), ["LineString", "MultiLineString"]),
        "pumps": (shaped(adapted(spark, sf_dir, "pumps"), F.when(F.col("pump_id") % 7 == 3, "LineString").otherwise("Point")), ["Point"]),
        "water": (shaped(adapted(spark, sf_dir, "boxes").filter("side_m < 0"), F.lit("Polygon")), ["Polygon", "MultiPolygon"]),
    }
    path = scratch(spark, "models")
    record = adapted(spark, sf_dir, "pumps").agg(F.count("*").alias("rows")).select(F.to_json(F.struct(F.lit("real_v1").alias("version"), F.array(*[F.lit(c) for c in FEATURES]).alias("features"), "rows")).alias("value"))
    record.write.text(path)
    return data_status(known, adapted(spark, sf_dir, "pockets"), adapted(spark, sf_dir, "wx"), readers.model_descriptors(spark, path, "real_v1"))


def data_status(known: dict[str, tuple[DataFrame, list[str]]], pockets: DataFrame, calls: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(name, n, dropped, state) of every source, and of all: the worst state there is (ERROR, MISSING, LOADED).

    known: a layer's rows (see layers.load_layer) and geometry types; pockets: lat, source; calls: outcome; descriptors: see
    readers.model_descriptors. dropped are rows that can't be used.
    """
    rows = None
    for name, (df, types) in known.items():
        _, told = layers.load_layer(df, types)
        one = told.select(F.lit(name).alias("name"), F.col("rows").alias("n"), "dropped", F.col("status").alias("state"))
        rows = one if rows is None else rows.unionByName(one)
    lost = F.count_if(F.col("lat").isNull() | F.col("source").isNull())
    state = source_state(F.count("*") > 0, F.when((F.count("*") > 0) & (lost == F.count("*")), "unusable"))
    rows = rows.unionByName(pockets.agg(F.lit("pockets").alias("name"), F.count("*").alias("n"), lost.alias("dropped"), state.alias("state")))
    ok, bad = F.max(F.when(F.col("outcome") == "ok", "ok")), F.max(F.when(F.col("outcome") != "ok", F.col("outcome")))
    rows = rows.unionByName(calls.agg(F.lit("weather").alias("name"), F.count("*").alias("n"), F.count_if(F.col("outcome") != "ok").alias("dropped"), live_state(F.lit(True), ok, bad).alias("state")))
    rows = rows.unionByName(descriptors.select(F.concat(F.lit("model "), "version").alias("name"), F.col("rows").alias("n"), F.lit(0).cast("long").alias("dropped"), F.lit("LOADED").alias("state")))
    worst = F.when(F.bool_or(F.col("state") == "ERROR"), "ERROR").when(F.bool_or(F.col("state") == "MISSING"), "MISSING").otherwise("LOADED")
    return rows.unionByName(rows.agg(F.lit("all").alias("name"), F.sum("n").alias("n"), F.sum("dropped").alias("dropped"), worst.alias("state")))


@query("S12_report", f"""WITH {adapters_sql('pipes')}, c AS (SELECT count(*) FILTER (conduit_type = 'drain') AS drains, count(*) FILTER (pipe_diameter_mm IS NULL) AS unknown FROM pipes)
SELECT drains = 0 AS ok, CASE WHEN drains > 0 THEN 1 ELSE 0 END AS n_errors, CASE WHEN unknown > 0 THEN 'unknown_diameter' END AS warning FROM c""")
def report(spark, sf_dir):
    """The JSON report of a layer's rules, read again."""
    rules = {"no_drains": ("ERROR", F.col("conduit_type") == "drain"), "unknown_diameter": ("WARN", F.col("pipe_diameter_mm").isNull()), "ward_range": ("ERROR", ~F.col("ward").between(1, 144))}
    told = layers.report_json(layers.rule_counts(adapted(spark, sf_dir, "pipes"), rules))
    read = told.select(F.from_json("report", "ok boolean, errors array<string>, warnings array<string>").alias("r"))
    return read.select("r.ok", F.size("r.errors").alias("n_errors"), F.get("r.warnings", F.lit(0)).alias("warning"))


@query("S4_training_csv", f"WITH {adapters_sql('train')} SELECT point_id, label, CASE WHEN point_id % 3 <> 0 THEN round(score, 4) END AS score FROM train")
def csv(spark, sf_dir):
    """A training table written and read again: blanks are nulls."""
    path = scratch(spark, "training")
    t = train(spark, sf_dir).select("point_id", "label", F.when(F.col("point_id") % 3 != 0, F.round("score", 4)).alias("score"))
    readers.write_training(t, path)
    return readers.read_training(spark, path, "point_id long, label int, score double")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(ADAPTERS["wx"], events=events).withColumn("ts", F.col("ts").cast("timestamp"))


@query("T1_weather_stream", f"WITH {adapters_sql('wx')} SELECT DISTINCT station, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM wx")
def observations(spark, sf_dir):
    calls = event_stream(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))  # a second, in which times are told, has one observation
    out = stream.run_available(stream.weather_stream(calls), "weather")
    return out.select("station", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


#: What the watermark has passed once all is read: whole seconds up to ten minutes before the last call.
PASSED = "passed AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM wx WHERE floor(epoch(ts)) + 1 <= (SELECT floor(epoch_ms(max(ts)) / 1000.0) FROM wx) - 600)"


@query("T2_last_good_stream", f"""WITH {adapters_sql('wx')}, {PASSED}, g AS (SELECT a.event_id, a.station, a.outcome, a.s, b.s AS gs, b.value AS gv FROM passed a ASOF LEFT JOIN (SELECT * FROM passed WHERE outcome = 'ok') b ON a.station = b.station AND a.ts >= b.ts), z AS (SELECT *, s - gs AS age FROM g)
SELECT event_id, station, outcome, round(CASE WHEN age <= 21600 THEN gv END, 4) AS shown, coalesce(age <= 21600 AND outcome <> 'ok', false) AS stale, CASE WHEN age <= 21600 THEN floor(age / 60) END AS age_min FROM z""")
def last_good(spark, sf_dir):
    return stream.run_available(stream.last_good_stream(event_stream(spark, sf_dir)), "last-good").withColumn("shown", F.round("shown", 4))


@query("T3_backoff_stream", f"""WITH RECURSIVE {adapters_sql('wx')}, {PASSED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS k FROM passed),
steps AS (
  SELECT station, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict, []::BIGINT[] AS times, 0::BIGINT AS retry_at, 0::BIGINT AS streak FROM (SELECT DISTINCT station FROM passed)
  UNION ALL
  SELECT station, k, event_id, verdict, CASE WHEN verdict = 'allowed' THEN list_append(recent, s) ELSE recent END,
         CASE WHEN verdict <> 'allowed' THEN retry_at ELSE s + CASE outcome WHEN 'ok' THEN 0 WHEN 'rate_limited' THEN CAST(least(300 * 2 ** (least(run, 10) - 1), 3600) AS BIGINT) WHEN 'auth' THEN 900 ELSE 120 END END,
         CASE WHEN verdict = 'allowed' THEN run ELSE streak END
  FROM (SELECT *, CASE WHEN s < retry_at THEN 'backing_off' WHEN len(recent) >= 20 THEN 'hourly_limit' WHEN len(recent) > 0 AND s - recent[-1] < 60 THEN 'too_soon' ELSE 'allowed' END AS verdict
        FROM (SELECT n.station, n.k, n.event_id, n.s, n.outcome, p.retry_at, p.streak, list_filter(p.times, lambda t: t > n.s - 3600) AS recent,
                     CASE WHEN n.outcome = 'ok' THEN 0 WHEN n.outcome = 'rate_limited' THEN p.streak + 1 ELSE p.streak END AS run
              FROM steps p JOIN numbered n ON n.station = p.station AND n.k = p.k + 1)))
SELECT event_id, station, verdict, retry_at FROM steps WHERE k > 0""")
def backoff(spark, sf_dir):
    return stream.run_available(stream.backoff_stream(event_stream(spark, sf_dir)), "backoff")


@query("T5_hourly_stream", f"WITH {adapters_sql('wx')} SELECT station, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM wx GROUP BY ALL HAVING max(date_trunc('hour', ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM wx) - INTERVAL 10 MINUTE")
def hourly(spark, sf_dir):
    """Hours that the watermark has closed."""
    out = stream.run_available(stream.hourly_stream(event_stream(spark, sf_dir)), "hourly")
    return out.select("station", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


@query("T4_score_stream", f"""WITH {adapters_sql('route_segs', 'wx')}, w AS (SELECT station, abs(value) AS rain FROM wx WHERE outcome = 'ok' QUALIFY row_number() OVER (PARTITION BY station ORDER BY ts DESC, event_id DESC) = 1)
SELECT route_id, seq, k1, k2, round(rain, 4) AS rain, CASE WHEN prob IS NOT NULL THEN round(least(prob * (0.3 + 0.7 * least(rain / 90, 1)), 1) + 1e-9, 4) END AS probability FROM route_segs s JOIN w ON w.station = s.trip_id % 150""")
def score_stream(spark, sf_dir):
    """Route segments under the rain that their station read last."""
    path = scratch(spark, "scored-segments")
    segs = adapted(spark, sf_dir, "route_segs").withColumn("station", F.col("trip_id") % 150)
    seen = event_stream(spark, sf_dir).filter("outcome = 'ok'").select("station", "ts", "event_id", F.abs("value").alias("rain"))
    stream.score_stream(seen, segs, path).awaitTermination()
    now = stream.current_scores(spark, path)
    return now.select("route_id", "seq", "k1", "k2", F.round("rain", 4).alias("rain"), F.round(F.col("probability") + 1e-9, 4).alias("probability"))


@query("E2_route_flood_risk", f"WITH {adapters_sql('route_segs')} SELECT route_id, count(*) AS n, round(100.0 * count(prob) / count(*), 1) AS coverage_pct, CASE WHEN count(prob) > 0 THEN round(least(max(prob) * (0.3 + 0.7 * 40 / 90), 1) + 1e-9, 4) END AS most FROM route_segs GROUP BY 1")
def route_flood_risk(spark, sf_dir):
    """Routes under 40 mm of rain: segment risk, coverage and the largest."""
    segs = adapted(spark, sf_dir, "route_segs").withColumn("prob", at_most(F.col("prob") * rainfall_multiplier(F.lit(40.0)), 1.0))
    return segs.groupBy("route_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("prob").isNotNull().cast("int")) * 100, 1).alias("coverage_pct"), F.round(F.max("prob") + 1e-9, 4).alias("most"))


@query("P35_model_features", f"WITH {adapters_sql('wx')} SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN NULL ELSE try_cast(trim(rain_raw) AS DOUBLE) END, 4) AS slope_pct, round(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, 0.0), 4) AS elevation FROM wx")
def model_features(spark, sf_dir):
    """Segment keys under the model's names: the first key that is there, text that is no number is null."""
    w = adapted(spark, sf_dir, "wx").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("rain_raw")).alias("slope"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("elevation_m"), F.lit("0.0").alias("elevation"))
    named = renamed_features(w, {"slope_pct": ["slope"], "elevation": ["elevation_m", "elevation"]})
    return named.select("event_id", F.round("slope_pct", 4).alias("slope_pct"), F.round("elevation", 4).alias("elevation"))


def renamed_features(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    from rillwise.functions.feeds import to_float

    rest = [c for c in df.columns if c not in {x for own in names.values() for x in own}]
    return df.select(*rest, *[F.coalesce(*[to_float(F.col(c)) for c in own]).alias(name) for name, own in names.items()])


@query("O7_clamped_limit", f"WITH {adapters_sql('cands')} SELECT query_id, cand_id FROM (SELECT DISTINCT query_id, cand_id FROM cands) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cand_id) <= 1")
def clamped(spark, sf_dir):
    return clamped_limit(adapted(spark, sf_dir, "cands").select("query_id", "cand_id").distinct(), ["query_id"], ["cand_id"], 0).select("query_id", "cand_id")


def clamped_limit(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; n is held between 1 and 10."""
    return spatial.top_k(df, keys, order, min(max(n, 1), 10))


@query("E8_train_job")
def train_job(spark, sf_dir):
    """The model's record with its cross-validation, from the labelled points that are first at their place."""
    rows = located(spark, sf_dir).withColumn("label_source", F.when(F.col("label") == 1, "record"))
    return trained(rows, FEATURES, "record")


def trained(rows: DataFrame, features: list[str], source: str) -> DataFrame:
    """Training behind a gate: raises if a training rule is broken; else one row: metadata, folds, auc (mean over folds)."""
    expected = rows.columns
    broken = [r["check"] for r in validation.validate_training(rows, expected, source, ["lat", "lon"]).filter("severity = 'ERROR'").collect()]  # a row a rule
    if broken or rows.filter("label is null or label not in (0, 1)").limit(1).count():
        raise ValueError(f"training rows are not valid: {', '.join(sorted(broken)) or 'labels'}")
    once = saved(checks.first_by(rows, [F.round("lat", 6), F.round("lon", 6)], ["point_id"]), "training-rows")
    folds = models.spatial_cv(once, features).agg(F.count("*").alias("folds"), F.round(F.avg("auc"), 4).alias("auc"))
    return models.model_metadata(models.train_susceptibility(once, features), once, features, "real_v1").crossJoin(F.broadcast(folds))  # one row each
