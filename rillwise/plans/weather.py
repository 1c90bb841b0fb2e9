"""Weather queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwise.operators import weather as w
from rillwise.plans.adapters import adapted, adapters_sql
from rillwise.plans.registry import query

WX = adapters_sql("wx")


def calls(spark, sf_dir):
    return adapted(spark, sf_dir, "wx").withColumn("ts", F.col("ts").cast("timestamp"))


@query("J15_last_good_asof", f"""WITH {WX}, g AS (SELECT a.event_id, a.station, a.ts, a.outcome, b.ts AS gts, b.value AS gv FROM wx a ASOF LEFT JOIN (SELECT * FROM wx WHERE outcome = 'ok') b ON a.station = b.station AND a.ts >= b.ts),
z AS (SELECT *, floor(epoch(ts)) - floor(epoch(gts)) AS age FROM g)
SELECT event_id, outcome, round(CASE WHEN age <= 21600 THEN gv END, 4) AS shown, coalesce(age <= 21600 AND outcome <> 'ok', false) AS stale, CASE WHEN age <= 21600 THEN floor(age / 60) END AS age_min FROM z""")
def asof(spark, sf_dir):
    return w.last_good_asof(calls(spark, sf_dir)).select("event_id", "outcome", F.round("shown", 4).alias("shown"), "stale", "age_min")


@query("W7_backoff_schedule", f"""WITH {WX}, i AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM wx),
s AS (SELECT *, sum(CASE WHEN outcome = 'rate_limited' THEN 1 ELSE 0 END) OVER (PARTITION BY station, k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT event_id, streak, CASE outcome WHEN 'rate_limited' THEN least(300 * 2.0 ** (streak - 1), 3600) WHEN 'auth' THEN 900 WHEN 'ok' THEN 0 ELSE 120 END AS wait FROM s""")
def backoff(spark, sf_dir):
    return w.backoff_schedule(calls(spark, sf_dir)).select("event_id", "streak", "wait")


@query("W8_call_budget", f"""WITH {WX}, c AS (SELECT *, count(*) OVER (PARTITION BY station ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS hour_calls,
CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id))) AS BIGINT) AS gap_s FROM wx)
SELECT event_id, hour_calls, gap_s, CASE WHEN hour_calls > 20 THEN 'hourly_limit' WHEN gap_s < 60 THEN 'too_soon' ELSE 'allowed' END AS verdict FROM c""")
def budget(spark, sf_dir):
    return w.call_budget(calls(spark, sf_dir)).select("event_id", "hour_calls", "gap_s", "verdict")


@query("W9_cache_intervals", f"""WITH {WX}, t AS (SELECT *, CASE outcome WHEN 'ok' THEN 1800 WHEN 'auth' THEN 900 WHEN 'rate_limited' THEN 300 ELSE 120 END AS ttl, floor(epoch(lead(ts) OVER (PARTITION BY station ORDER BY ts, event_id))) - floor(epoch(ts)) AS f FROM wx)
SELECT event_id, ttl, least(ttl, f) AS valid_s FROM t""")
def cache(spark, sf_dir):
    return w.cache_intervals(calls(spark, sf_dir)).select("event_id", "ttl", "valid_s")


@query("J16_combine_rainfall", f"""WITH {WX}, o AS (SELECT station, round(max(value), 3) AS official FROM wx WHERE outcome = 'ok' AND station % 4 <> 0 GROUP BY 1), r AS (SELECT station, round(max(value), 3) AS rolling FROM wx WHERE event_id % 3 = 0 AND station % 5 <> 0 GROUP BY 1), s AS (SELECT DISTINCT station FROM wx)
SELECT station, greatest(official, rolling) AS mm, CASE WHEN official >= coalesce(rolling, official) THEN 'official' WHEN rolling IS NOT NULL THEN 'rolling' END AS source, CASE WHEN coalesce(official, rolling) IS NOT NULL THEN '24h' END AS period FROM s LEFT JOIN o USING (station) LEFT JOIN r USING (station)""")
def rainfall(spark, sf_dir):
    c = calls(spark, sf_dir)
    o = c.filter("outcome = 'ok' and station % 4 <> 0").groupBy("station").agg(F.round(F.max("value"), 3).alias("official"))
    r = c.filter("event_id % 3 = 0 and station % 5 <> 0").groupBy("station").agg(F.round(F.max("value"), 3).alias("rolling"))
    out = c.select("station").distinct().join(o, "station", "left").join(r, "station", "left")
    return out.select("station", w.combine_rainfall(F.col("official"), F.col("rolling")).alias("r")).select("station", "r.*")


@query("T5_calls_per_hour", f"WITH {WX} SELECT station, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM wx GROUP BY ALL")
def per_hour(spark, sf_dir):
    return w.calls_per_hour(calls(spark, sf_dir)).select("station", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


@query("P24_S7_normalize_weather", f"""WITH {WX} SELECT event_id, 'S' || station AS station_id, round(try_cast(CAST(value AS VARCHAR(20)) AS DOUBLE), 4) AS temperature, round(CASE WHEN upper(trim(rain_raw)) IN ('NIL', 'TRACE', 'TR') THEN 0 ELSE try_cast(trim(rain_raw) AS DOUBLE) END, 4) AS rain_24h_mm, CAST(NULL AS DOUBLE) AS rain_1h_mm,
strftime(ts, '%Y-%m-%d') || 'T' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00:00Z' AS observed FROM wx""")
def weather(spark, sf_dir):
    fields = {"Station_Code": F.concat(F.lit("S"), "station"), "Temperature": F.col("value").cast("string"), "Last 24 hrs Rainfall": F.col("rain_raw"), "Date of Observation": F.date_format("ts", "yyyy-MM-dd"), "Time of Observation": F.hour("ts").cast("string")}
    record = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    out = w.normalize_weather(calls(spark, sf_dir).select("event_id", record.alias("record")))
    return out.select("event_id", "station_id", F.round("temperature", 4).alias("temperature"), F.round("rain_24h_mm", 4).alias("rain_24h_mm"), "rain_1h_mm", "observed")


@query("P25_normalize_forecast", f"""WITH {WX} SELECT event_id, d.day AS day, CASE d.day WHEN 1 THEN 'F' || event_id % 7 WHEN 3 THEN 'rain' END AS forecast, CASE d.day WHEN 1 THEN round(value, 3) END AS max_temp FROM wx, range(1, 8) d(day)""")
def forecast(spark, sf_dir):
    fields = {"Station_Code": F.col("station").cast("string"), "Todays_Forecast": F.concat(F.lit("F"), F.col("event_id") % 7), "Day_3_Forecast": F.lit("rain"), "Todays_Forecast_Max_Temp": F.col("value").cast("string")}
    record = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    days = w.normalize_forecast(calls(spark, sf_dir).select("event_id", record.alias("record"))).select("event_id", F.explode("forecast_days").alias("d"))
    return days.select("event_id", "d.day", "d.forecast", F.round("d.max_temp", 3).alias("max_temp"))
