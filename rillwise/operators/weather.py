"""Weather observations: normalised records, last good reading, call budget and back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from rillwise.functions.feeds import obs_timestamp, to_float, to_rain_mm

# Fixed values (seconds, counts): limits of the weather client.
TTL, STALE, BACKOFF, BACKOFF_MOST, AUTH_BACKOFF, FAILURE_TTL, CALLS_AN_HOUR, GAP = 1800, 6 * 3600, 300, 3600, 900, 120, 20, 60
HOUR, DAY = 3600, 86400

CURRENT = {
    "station_id": ("Station Id", "Station_Code"), "station": ("Station", "Station_Name"), "temperature": ("Temperature",), "humidity": ("Humidity",), "pressure": ("M.S.L.P",),
    "wind_speed": ("Wind Speed",), "wind_direction": ("Wind Direction",), "weather_code": ("Weather Code",), "nebulosity": ("Nebulosity",),
}
TEXT = ("station_id", "station", "wind_direction", "weather_code", "nebulosity")


def normalize_weather(records: DataFrame) -> DataFrame:
    """records (a map column `record` of feed keys to texts) as typed fields; sub-daily rain is not measured and stays null."""
    r = F.col("record")
    first = lambda keys: F.coalesce(*[r[k] for k in keys])
    out = [(first(k) if name in TEXT else to_float(first(k))).alias(name) for name, k in CURRENT.items()]
    return records.select(
        *[c for c in records.columns if c != "record"], *out, to_rain_mm(r["Last 24 hrs Rainfall"]).alias("rain_24h_mm"), F.lit(None).cast("double").alias("rain_1h_mm"),
        obs_timestamp(r["Date of Observation"], r["Time of Observation"]).alias("observed"),
    )


def normalize_forecast(records: DataFrame) -> DataFrame:
    """Wide forecast records as an array of seven days; missing days are null."""
    r = F.col("record")
    day = lambda i: F.struct(F.lit(i).alias("day"), r["Todays_Forecast" if i == 1 else f"Day_{i}_Forecast"].alias("forecast"), to_float(r[("Todays" if i == 1 else f"Day_{i}") + "_Forecast_Max_Temp"]).alias("max_temp"), to_float(r[("Todays" if i == 1 else f"Day_{i}") + "_Forecast_Min_temp"]).alias("min_temp"))
    days = F.array(*[day(i) for i in range(1, 8)])
    return records.select(*[c for c in records.columns if c != "record"], r["Station_Code"].alias("station_id"), to_rain_mm(r["Past_24_hrs_Rainfall"]).alias("rain_24h_mm"), days.alias("forecast_days"))


def _spans(calls: DataFrame, seconds: int) -> DataFrame:
    """calls with _s, the whole second, and _b, the span of so many seconds that it lies in: a window holds one span, not a station's history."""
    return calls.withColumn("_s", F.unix_timestamp("ts")).withColumn("_b", F.floor(F.col("_s") / seconds))


def _in_span() -> WindowSpec:
    return W.partitionBy("station", "_b").orderBy("ts", "event_id")


def last_good_asof(calls: DataFrame, max_age: int = STALE) -> DataFrame:
    """calls (station, ts, event_id, outcome, value): what each call shows. A good one shows itself; another the station's last good
    reading before it if that is no older than max_age seconds (stale, with its age in minutes), else nothing.

    Spans are max_age long, so a reading that may be shown lies in the call's own span or is the last good one of the span before.
    """
    timed = _spans(calls, max_age)
    fresh = F.col("outcome") == "ok"
    carried = timed.filter(fresh).groupBy("station", (F.col("_b") + 1).alias("_b")).agg(F.max(F.struct("ts", "event_id", "value")).alias("_c"))
    own = F.last(F.when(fresh, F.struct("ts", "event_id", "value")), ignorenulls=True).over(_in_span().rowsBetween(W.unboundedPreceding, 0))
    out = timed.withColumn("_o", own).join(carried, ["station", "_b"], "left").withColumn("_g", F.coalesce("_o", "_c"))
    age = F.col("_s") - F.unix_timestamp(F.col("_g.ts"))
    usable = F.col("_g").isNotNull() & (age <= max_age)
    return out.select(
        *calls.columns, F.when(usable, F.col("_g.value")).alias("shown"), (usable & ~fresh).alias("stale"), F.when(usable, F.floor(age / 60)).alias("age_min")
    ).withColumn("stale", F.coalesce("stale", F.lit(False)))


def backoff_schedule(calls: DataFrame) -> DataFrame:
    """calls with streak (rate limits in a row since the last success) and wait: seconds to the next try, doubling from 300 to 3600.

    Streaks are counted within days; a day hands on what its last streak has come to, through one row a station and day.
    """
    limited = F.col("outcome") == "rate_limited"
    timed = _spans(calls, DAY).withColumn("_island", F.count_if(F.col("outcome") == "ok").over(_in_span().rowsBetween(W.unboundedPreceding, 0)))
    inner = W.partitionBy("station", "_b", "_island").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    timed = timed.withColumn("_own", F.count_if(limited).over(inner))
    days = timed.groupBy("station", "_b").agg(F.max_by("_own", F.struct("_island", "_own")).alias("_tail"), (F.max("_island") > 0).alias("_ok"))
    by_day = W.partitionBy("station").orderBy("_b")
    days = days.withColumn("_since", F.count_if("_ok").over(by_day.rowsBetween(W.unboundedPreceding, 0)))
    days = days.withColumn("_run", F.sum("_tail").over(W.partitionBy("station", "_since").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
    days = days.select(F.col("station").alias("_st"), F.col("_b").alias("_day"), F.coalesce(F.lag("_run").over(by_day), F.lit(0)).alias("_before"))
    run = timed.join(days, F.col("station").eqNullSafe(F.col("_st")) & F.col("_b").eqNullSafe(F.col("_day")))
    run = run.withColumn("streak", F.col("_own") + F.when(F.col("_island") == 0, F.col("_before")).otherwise(0))
    wait = F.when(limited, F.least(F.lit(float(BACKOFF)) * F.pow(F.lit(2.0), F.col("streak") - 1), F.lit(float(BACKOFF_MOST)))).when(F.col("outcome") == "auth", float(AUTH_BACKOFF)).when(F.col("outcome") == "ok", 0.0).otherwise(float(FAILURE_TTL))
    return run.select(*calls.columns, "streak", wait.alias("wait"))


def call_budget(calls: DataFrame) -> DataFrame:
    """Calls of the station in the hour up to each (itself included), seconds since the one before, and whether it was within budget.

    Spans are hours; each call also counts in the span after its own, and an hour's last second is handed on through one row a station and hour.
    """
    timed = _spans(calls, HOUR).withColumn("_own", F.lit(True))
    both = timed.unionByName(timed.filter("_b is not null").withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
    counted = both.withColumn("hour_calls", F.count("*").over(W.partitionBy("station", "_b").orderBy("_s").rangeBetween(1 - HOUR, 0)))
    counted = counted.filter("_own").withColumn("_last", F.lag("_s").over(_in_span()))
    hours = timed.groupBy("station", "_b").agg(F.max("_s").alias("_most")).withColumn("_before", F.lag("_most").over(W.partitionBy("station").orderBy("_b")))
    out = counted.join(hours.select("station", "_b", "_before"), ["station", "_b"], "left").withColumn("gap_s", F.col("_s") - F.coalesce("_last", "_before"))
    reason = F.when(F.col("hour_calls") > CALLS_AN_HOUR, "hourly_limit").when(F.col("gap_s") < GAP, "too_soon").otherwise("allowed")
    return out.select(*calls.columns, "hour_calls", "gap_s", reason.alias("verdict"))


def cache_intervals(calls: DataFrame) -> DataFrame:
    """Seconds for which each result answers: its time to live by outcome, or until the next call if that comes first.

    Spans are as long as the longest time to live: a next call that matters lies in the call's own span or is the first of the span after.
    """
    ttl = F.when(F.col("outcome") == "ok", TTL).when(F.col("outcome") == "auth", AUTH_BACKOFF).when(F.col("outcome") == "rate_limited", BACKOFF).otherwise(FAILURE_TTL)
    timed = _spans(calls, max(TTL, AUTH_BACKOFF, BACKOFF, FAILURE_TTL)).withColumn("_next", F.lead("_s").over(_in_span()))
    after = timed.groupBy("station", (F.col("_b") - 1).alias("_b")).agg(F.min("_s").alias("_then"))
    out = timed.join(after, ["station", "_b"], "left")
    return out.select(*calls.columns, ttl.alias("ttl"), F.least(ttl, F.coalesce("_next", "_then") - F.col("_s")).alias("valid_s"))


def combine_rainfall(official: Column, rolling: Column) -> Column:
    """The larger of the official daily and the rolling rain; the official one on a tie; null if neither is known."""
    mm = F.greatest(official, rolling)
    source = F.when(mm.isNull(), None).when(official.isNotNull() & (official == mm), "official").otherwise("rolling")
    return F.struct(mm.alias("mm"), source.alias("source"), F.when(mm.isNotNull(), "24h").alias("period"))


def calls_per_hour(calls: DataFrame) -> DataFrame:
    """(station, hour, n); over a stream give calls a watermark first."""
    return calls.groupBy("station", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("station", F.col("w.start").alias("hour"), "n")
