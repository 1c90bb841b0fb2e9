"""Weather as a stream: duplicates, last good readings, back-off and call budget as state of each station."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rillwise.functions.hydrology import at_most, rainfall_multiplier
from rillwise.operators.weather import AUTH_BACKOFF, BACKOFF, BACKOFF_MOST, CALLS_AN_HOUR, FAILURE_TTL, GAP, STALE, calls_per_hour
from rillwise.store import discard, saved, scratch, settings


def weather_stream(observations: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Observations without repeats of a station and time, as far as the watermark remembers."""
    return observations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["station", "ts"])


#: Calls of a station that are put in order at once.
ORDERED = 100_000


class _InOrder(StatefulProcessor):
    """Holds each station's calls until the watermark has passed their second, then takes them by time and event_id.

    A map holds the calls that still wait, a row each, and a timer at the end of the first one's second takes out all that the
    watermark has passed. The state is asked about once a call that comes, and a few times a station and batch for all the rest:
    each question is a message to another process. Of a station no more than ORDERED calls are in memory, however many have passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "n long")
        self.waiting = handle.getMapState("waiting", "i long", "us long, event_id long, outcome string, value double")

    def timer(self, second: int) -> None:
        self.handle.registerTimer(1000 * (second + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, first = (self.number.get() or (0,))[0], None
        for r in rows:
            self.waiting.updateValue((n,), (r.us, r.event_id, r.outcome, r.value))
            n, first = n + 1, r.us if first is None else min(first, r.us)
        if first is not None:
            self.number.update((n,))
            self.timer(first // 1_000_000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000  # calls before this second
        yield from self.run(key[0], self.due(passed))
        self.forget(passed - 1)

    def due(self, passed: int) -> Iterator[tuple]:
        """The calls before a second in order: in parts, each the first of those that are left. What is told of goes from the state."""
        left = True
        while left:
            held, later = 0, []

            def before():
                nonlocal held
                for (i,), (us, event_id, outcome, value) in self.waiting.iterator():
                    held += 1
                    if us // 1_000_000 < passed:
                        yield us, event_id, i, outcome, value
                    else:
                        later[:] = [min(us, *later)] if later else [us]

            part = heapq.nsmallest(ORDERED, before(), key=lambda c: c[:3])
            left = len(part) == ORDERED
            for us, event_id, _, outcome, value in part:
                yield us // 1_000_000, event_id, outcome, value
            if len(part) == held:
                self.waiting.clear()
                self.number.clear()
            else:
                for c in part:
                    self.waiting.removeKey((c[2],))
            if part and later:
                self.timer(later[0] // 1_000_000)

    def run(self, station: int, calls: Iterator[tuple]) -> Iterator[Row]:
        """A row for each call (second, event_id, outcome, value), which come in order."""
        raise NotImplementedError

    def forget(self, now: int) -> None:
        """Drops what no later call can need."""

    def close(self) -> None:
        pass


class LastGood(_InOrder):
    """State beside the waiting calls: a station's last good reading, for six hours."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long, value double")

    def run(self, station, calls):
        last = before = self.last.get()
        for now, event_id, outcome, value in calls:
            last = (now, value) if outcome == "ok" else last
            age = None if last is None else now - last[0]
            if age is None or age > STALE:
                yield Row(event_id=event_id, station=station, outcome=outcome, shown=None, stale=False, age_min=None)
            else:
                yield Row(event_id=event_id, station=station, outcome=outcome, shown=last[1], stale=outcome != "ok", age_min=age // 60)
        if last is not before:
            self.last.update(last)
            self.timer(last[0] + STALE)

    def forget(self, now):
        last = self.last.get()
        if last is not None and last[0] + STALE <= now:
            self.last.clear()


class BackOff(_InOrder):
    """State beside the waiting calls: the allowed calls of the last hour (20 at most), and the next try with the streak of rate limits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "at long")
        self.next = handle.getValueState("next", "retry_at long, streak int")

    def run(self, station, calls):
        (retry_at, streak), times, any_ = self.next.get() or (0, 0), [t[0] for t in self.times.get()], False
        for now, event_id, outcome, _ in calls:
            any_ = True
            times, retry_at, streak, verdict = decide(times, retry_at, streak, now, outcome)
            yield Row(event_id=event_id, station=station, verdict=verdict, retry_at=retry_at)
        if any_:
            self.next.update((retry_at, streak))
            if times:
                self.times.put([(t,) for t in times])
                self.timer(times[-1] + 3600)

    def forget(self, now):
        if self.times.exists():
            left = [t for t in self.times.get() if t[0] > now - 3600]
            self.times.put(left) if left else self.times.clear()


#: State of the processors is in RocksDB, on the executors' disks, with checkpoints in the shared folder.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _by_station(calls: DataFrame, processor: _InOrder, schema: str, delay: str) -> DataFrame:
    rows = calls.withWatermark("ts", delay).select("station", "ts", F.unix_micros("ts").alias("us"), "event_id", "outcome", F.col("value").cast("double").alias("value"))
    return rows.groupBy("station").transformWithState(processor, schema, "append", "eventTime")


def last_good_stream(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each call that the watermark has passed with what it shows: its own value, or the station's last good one no older than six hours, marked stale.

    calls: station, ts, event_id, outcome, value, in any order; those that come later than the delay are dropped, as the watermark does.
    """
    return _by_station(calls, LastGood(), "event_id long, station long, outcome string, shown double, stale boolean, age_min long", delay)


def decide(times: list[int], retry_at: int, streak: int, now: int, outcome: str) -> tuple[list[int], int, int, str]:
    """One step of a station: what is remembered after a call that is asked for at `now`, and the verdict. Refused calls change nothing.

    times: allowed calls of the last hour. A success clears the streak; rate limits double the wait from 300 to 3600 seconds.
    """
    times = [t for t in times if t > now - 3600]
    if now < retry_at:
        return times, retry_at, streak, "backing_off"
    if len(times) >= CALLS_AN_HOUR:
        return times, retry_at, streak, "hourly_limit"
    if times and now - times[-1] < GAP:
        return times, retry_at, streak, "too_soon"
    streak = 0 if outcome == "ok" else streak + (outcome == "rate_limited")
    wait = {"ok": 0, "rate_limited": min(BACKOFF * 2 ** max(0, min(streak, 10) - 1), BACKOFF_MOST), "auth": AUTH_BACKOFF}.get(outcome, FAILURE_TTL)
    return [*times, now], now + wait, streak, "allowed"


def backoff_stream(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each call that the watermark has passed with its verdict and the station's next try; calls as for last_good_stream."""
    return _by_station(calls, BackOff(), "event_id long, station long, verdict string, retry_at long", delay)


def hourly_stream(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return calls_per_hour(calls.withWatermark("ts", delay))


#: Stations up to which their rain goes to the segments; of more, both move.
STATIONS_SENT = 100_000


def score_stream(observations: DataFrame, segments: DataFrame, path: str) -> StreamingQuery:
    """Writes the segments scored under each station's current rain, a folder `batch=N` for each micro-batch, and returns the running query.

    observations: station, ts, event_id, rain; segments: station, prob and keys of their own, a table that does not move. The
    state is one reading a station. A batch rewrites its own folder, so one that is repeated after a failure counts once;
    of several folders that hold a station's segments the largest batch is current.
    """

    def write(changed: DataFrame, batch: int) -> None:
        now = saved(changed.select("station", F.col("now.rain").alias("rain")), "rain")
        met = segments.join(F.broadcast(now) if now.count() <= STATIONS_SENT else now, "station")
        p = at_most(F.col("prob") * rainfall_multiplier(F.col("rain")), 1.0)
        met.withColumn("probability", p).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        discard(now)

    current = observations.filter("rain is not null").groupBy("station").agg(F.max(F.struct("ts", "event_id", "rain")).alias("now"))
    state = scratch(segments.sparkSession, "score-state")
    return current.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def current_scores(spark: SparkSession, path: str) -> DataFrame:
    """Of what score_stream wrote, the rows of each station's latest batch: a batch that has a station has all of its segments."""
    rows = spark.read.parquet(path)
    latest = saved(rows.groupBy("station").agg(F.max("batch").alias("batch")), "latest")
    return rows.join(F.broadcast(latest) if latest.count() <= STATIONS_SENT else latest, ["station", "batch"]).drop("batch")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, exactly once into Parquet, and return it as a table."""
    spark: SparkSession = stream.sparkSession
    out = scratch(spark, name)
    with settings(spark, STATE):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
