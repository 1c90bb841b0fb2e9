"""Streams with state of their own against the same steps over sorted calls."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from rillwise.operators.weather import STALE
from rillwise.store import scratch, settings
from rillwise.streaming import weather as w

SCHEMA = "event_id long, station long, ts timestamp, outcome string, value double"
START = 1_700_000_000


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """Calls of three stations over two days in three files, unordered within each, several in one second, and one last call far later."""
    rng, rows = np.random.default_rng(8), []
    for i in range(600):
        at = START + float(rng.integers(0, 172_800)) + (0.25 if i % 3 else 0.5)
        at = rows[-1][2] if i % 20 == 1 else at
        rows.append((i, int(rng.integers(3)), at, str(rng.choice(["ok", "rate_limited", "auth", "unavailable"], p=[0.2, 0.5, 0.1, 0.2])), None if i % 50 == 0 else float(i)))
    rows.append((600, 9, START + 10 * 86_400.0, "ok", 1.0))
    table = pd.DataFrame(rows, columns=["event_id", "station", "at", "outcome", "value"])
    folder = tmp_path_factory.mktemp("calls")
    part = np.searchsorted([START + 60_000, START + 120_000], table["at"])
    for i in range(3):
        own = spark.createDataFrame(table[part == i]).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
        own.select("event_id", "station", "ts", "outcome", F.nanvl("value", F.lit(None)).alias("value")).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), table[table["event_id"] < 600].sort_values(["at", "event_id"])


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_back_off_is_what_the_steps_say(spark, calls):
    folder, rows = calls
    got = {r.event_id: (r.verdict, r.retry_at) for r in w.run_available(w.backoff_stream(read(spark, folder), "2 days"), "backoff").collect()}
    want = {}
    for _, own in rows.groupby("station"):
        times, retry, streak = [], 0, 0
        for r in own.itertuples():
            times, retry, streak, verdict = w.decide(times, retry, streak, int(r.at), r.outcome)
            want[r.event_id] = (verdict, retry)
    assert got == want and len({v for v, _ in want.values()}) >= 3


def test_last_good_is_what_the_calls_say(spark, calls):
    folder, rows = calls
    got = {r.event_id: (r.shown, r.stale, r.age_min) for r in w.run_available(w.last_good_stream(read(spark, folder), "2 days"), "good").collect()}
    for _, own in rows.groupby("station"):
        last = None
        for r in own.itertuples():
            last = (int(r.at), None if np.isnan(r.value) else r.value) if r.outcome == "ok" else last
            age = None if last is None else int(r.at) - last[0]
            assert got[r.event_id] == ((last[1], r.outcome != "ok", age // 60) if age is not None and age <= STALE else (None, False, None))
    assert len(got) == len(rows)


@pytest.mark.parametrize("stream", [w.last_good_stream, w.backoff_stream])
def test_state_is_bounded(spark, calls, stream):
    """Once the watermark is ten days on, no call waits but the last one, no reading is kept and no hour's calls; a station's next try is."""
    folder, _ = calls
    with settings(spark, w.STATE):
        q = stream(read(spark, folder), "2 days").writeStream.format("noop").option("checkpointLocation", scratch(spark, "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]
    held = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert max(held) > 400 and held[-1] <= 12


class Told:
    """The state of one station in memory; asked counts the messages that Spark would send."""

    def __init__(self):
        self.asked, self.timers = 0, []

    def of(self, *_):
        told, rows = self, {}

        class State:
            def __getattr__(self, name):
                told.asked += 1
                return {
                    "get": lambda: rows.get("own"), "update": lambda v: rows.update(own=v), "clear": rows.clear, "iterator": lambda: iter(list(rows.items())), "exists": lambda: bool(rows),
                    "updateValue": lambda k, v: rows.update({k: v}), "removeKey": rows.pop, "containsKey": lambda k: k in rows, "getValue": rows.get,
                }[name]

        return State()

    getValueState = getMapState = getListState = of

    def registerTimer(self, ms):
        self.asked += 1
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.mark

    def getExpiryTimeInMs(self):
        return self.fires


@pytest.mark.parametrize("at_once", [100_000, 7])
def test_state_is_asked_little_and_gives_calls_in_order(monkeypatch, at_once):
    """1,000 calls of a month, of which 900 are passed at the first mark: two messages a call at most, in order, whatever is put in order at once."""
    monkeypatch.setattr(w, "ORDERED", at_once, raising=False)
    calls = [Row(us=(START + (i * 7919 % 1000) * 2600) * 1_000_000, event_id=i, outcome="ok" if i % 4 else "auth", value=float(i)) for i in range(1000)]
    told, good = Told(), w.LastGood()
    good.init(told)
    list(good.handleInputRows((5,), iter(calls), told))
    out = []
    for told.mark in (1000 * (START + 900 * 2600), 1000 * (START + 1000 * 2600)):
        while due := sorted(t for t in told.timers if t <= told.mark):
            told.timers.remove(due[0])
            told.fires = due[0]
            out += list(good.handleExpiredTimer((5,), told, told))
        assert len(out) in (900, 1000)
    assert [r.event_id for r in out] == [c.event_id for c in sorted(calls, key=lambda c: c.us)]
    assert at_once < 1000 or told.asked <= 2000 + 50


def test_scores_of_each_station_are_those_of_its_latest_batch(spark, tmp_path):
    """Segments do not move, equal ones all stay, and a station that a later batch leaves out keeps its rows."""
    segs = spark.createDataFrame([(1, 10, 0.5), (1, 10, 0.5), (1, 11, None), (2, 12, 0.5), (3, 13, 0.5)], "station long, seg long, prob double")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "station long, ts timestamp, event_id long, rain double"
    when = pd.Timestamp("2024-01-01").to_pydatetime()
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for day, rows in enumerate([[(1, 0, 90.0), (2, 1, 45.0)], [(1, 2, 0.0)]]):
            spark.createDataFrame([(s, when + pd.Timedelta(days=day), e, mm) for s, e, mm in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        w.score_stream(stream, segs, out).awaitTermination()
        now = w.current_scores(spark, out)
        plan = now._jdf.queryExecution().executedPlan().toString()
        got = sorted((x.seg, x.rain, x.probability) for x in now.fillna(-1.0).collect())
    assert got == [(10, 0.0, pytest.approx(0.15)), (10, 0.0, pytest.approx(0.15)), (11, 0.0, -1.0), (12, 45.0, pytest.approx(0.325))]
    assert "Exchange hashpartitioning" not in plan
