"""Periodic runs of words by a dictionary of basic factors.

For each power of two the dictionary names the word sequences of that length: equal sequences have equal names. Where a
sequence's next occurrences lie within twice its length and form an arithmetic progression, their distance is proposed as a
period. In a run of period q and at least 4 q words, the sequences of the least power of two from q on do so from the run's
first word on, with the distance q itself, so no run is missed. A proposal is extended both ways by comparing sequences of
falling powers of two, which gives the whole run; equal runs are one. A sequence that occurs once has no name, and nothing
longer that starts with it is looked at: long texts without repeats cost little more than sorting their words.
Documents don't meet: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillwise.llm import text as tx

#: A run has at least so many words and so many periods (4 at least: shorter ones need not be proposed).
LEAST, POWER = 6, 4


class Factors:
    """names[k][i]: the name of the 2**k numbers from place i on, -1 if they stand nowhere else. One more place than numbers."""

    def __init__(self, ids: np.ndarray):
        self.size, self.names, self.proposed = len(ids), [], []
        at, key = np.arange(len(ids)), ids
        while len(at):
            order = np.argsort(key, kind="stable")
            place, same = at[order], np.diff(key[order]) == 0
            self._propose(place, same, 1 << len(self.names))
            repeated = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if not repeated.any():
                break
            numbers = np.concatenate([[0], np.cumsum(~same)])
            name = np.full(self.size + 1, -1, np.int64)
            name[place[repeated]] = numbers[repeated]
            half = 1 << len(self.names)
            self.names.append(name)
            at = np.sort(place[repeated])
            at = at[at + 2 * half <= self.size]
            at = at[name[at + half] >= 0]
            key = name[at] * (int(numbers[-1]) + 1) + name[at + half]

    def _propose(self, place: np.ndarray, same: np.ndarray, length: int) -> None:
        """Places whose next two occurrences are equally far, within twice the length; of neighbours that propose the same the first."""
        gap = np.diff(place)
        first = np.flatnonzero(same[:-1] & same[1:] & (gap[:-1] == gap[1:]) & (gap[:-1] <= 2 * length))
        at, period = place[first], gap[first]
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        if len(at):
            new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(period) != 0)])
            self.proposed.append((at[new], period[new]))

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many numbers from places a and b on (back: before them) agree."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            size, name = 1 << k, self.names[k]
            x, y = (a - size, b - size) if back else (a, b)
            inside = np.minimum(x, y) >= 0
            equal = inside & (name[np.where(inside, x, self.size)] == name[np.where(inside, y, self.size)]) & (name[np.where(inside, x, self.size)] >= 0)
            step = np.where(equal, -size if back else size, 0)
            a, b, out = a + step, b + step, out + np.abs(step)
        return out

    def runs(self, least: int = LEAST, power: int = POWER) -> np.ndarray:
        """start, length, period of the runs, by start, then period."""
        if not self.proposed:
            return np.zeros((0, 3), np.int64)
        at, period = (np.concatenate(x) for x in zip(*self.proposed))
        before = self.common(at, at + period, back=True)
        length = before + period + self.common(at, at + period)
        long = length >= np.maximum(least, power * period)
        return np.unique(np.stack([at - before, period, length], axis=1)[long], axis=0)[:, [0, 2, 1]]


def word_ids(texts: list[list[bytes]]) -> np.ndarray:
    """Of all words of all texts, equal within a text for equal words; no two texts share one."""
    out, taken = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + taken)
        taken += len(known)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_FOUND = "n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def _find(least: int, power: int):
    @F.pandas_udf(_FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, out = tx.utf8(batch), []
            for part in tx.chunks(raw):
                texts = [t.split() for t in raw[part]]
                first = np.cumsum([0, *map(len, texts)])
                # texts share no word, so no run crosses from one to the next
                runs = Factors(word_ids(texts)).runs(least, power)
                ptr = np.searchsorted(runs[:, 0], first)
                for words, begin, a, b in zip(texts, first, ptr[:-1], ptr[1:]):
                    own = runs[a:b] - [begin, 0, 0]
                    if len(own):
                        covered = np.zeros(len(words) + 1, np.int64)
                        np.add.at(covered, own[:, 0] + own[:, 2], 1)
                        np.add.at(covered, own[:, 0] + own[:, 1], -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0)]
                    else:
                        kept = words
                    out.append((len(words), own[:, 0], own[:, 1], own[:, 2], b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs, collapsed: one row for each row of docs, of which only doc_id and text are read.

    runs are all stretches of words with a smallest period q that hold max(least, power * q) words or more and can't be
    longer, as structs (start, length, period) by start, then period. collapsed is the text without the words that a run
    holds after its first period, joined by one space. Null, empty and white texts have no words. Repeated rows are rows of
    their own; a null doc_id is kept. power must be 4 or more.
    """
    if power < POWER:
        raise ValueError(f"runs of fewer than {POWER} periods are not all proposed")
    found = docs.select("doc_id", _find(least, power)(F.coalesce("text", F.lit(""))).alias("found"))
    run = F.transform(
        F.arrays_zip(F.col("found.starts").alias("start"), F.col("found.lengths").alias("length"), F.col("found.periods").alias("period")),
        lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")),
    )
    return found.select("doc_id", F.col("found.n_words").alias("n_words"), run.alias("runs"), F.col("found.collapsed").alias("collapsed"))


def with_planted_periods(docs: DataFrame, one_of: int = 10) -> DataFrame:
    """docs, in whose texts one of so many documents repeats a stretch of words up to its end; which, from where and how long depends on the doc_id."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / one_of)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_words")

    def word(i: Column) -> Column:
        return F.get("_words", F.when(i < F.col("_from"), i).otherwise((F.col("_from") + (i - F.col("_from")) % F.col("_period")).cast("int")))

    asked = docs.withColumn("_words", F.when(h % one_of == 0, words))
    asked = asked.withColumn("_from", F.when(n > 0, g % n)).withColumn("_period", F.floor((n - F.col("_from")) / (3 + g % 8)) + 1)
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return asked.withColumn("text", F.when(n > 0, planted).otherwise(F.col("text"))).drop("_words", "_from", "_period")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared as whole numbers; the first of equals."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, after repeats have been planted in a tenth. A very long text costs 8 bytes a word for each power of two that repeats."""
    planted = with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic_runs(planted).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
