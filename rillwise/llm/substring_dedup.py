"""Substring deduplication by seed and extend.

Every window of 50 words holds one anchor: the least 18-gram among its 33 (winnowing), chosen by content alone, so equal
windows have equal anchors at equal places. Only anchors that more than one document holds are followed. Occurrences of an
anchor are extended both ways over the words that its windows cover, and compared by BLAKE2b digests of these words as they
stand in the text. Those with the same anchor and the same extension are one class, settled by its least doc_id; where an
anchor has several classes, one occurrence of each is compared window by window, by digests of the windows' words again.
Anchor and digest agree in 128 bits together, which no unequal words can be made to do. No pairs of documents are formed: a
group costs as many rows as it has windows, however many documents hold it.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rillwise.llm import bitmap, text as tx
from rillwise.store import saved

WINDOW = 50
ANCHOR = 18


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (of its upper bits; the leftmost of equals) in each run of width values."""
    place = max(24, len(x).bit_length())
    least = (x >> np.uint64(place) << np.uint64(place)) | np.arange(len(x), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & np.uint64((1 << place) - 1)).astype(np.int64)


class _Plain:
    """The words of some texts joined by one space, for digests of runs of words."""

    def __init__(self, words: tx.Words):
        size = words.end - words.start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.line = b" ".join(words.buf.tobytes().split())

    def digest(self, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Of the words from begin to before end, and of a number beside them."""
        a, b, line = self.start[begin].tolist(), self.end[end - 1].tolist(), self.line
        return np.fromiter((tx.digest64(b"%d " % s + line[x:y]) for x, y, s in zip(a, b, salt.tolist())), np.uint64, len(a))


def anchors(words: tx.Words, window: int, anchor: int) -> dict[str, np.ndarray] | None:
    """Runs of windows that share an anchor: text, first (window), last, anchor's hash, and the digest of its place and of all words that they cover."""
    h = words.hashes()
    if len(h) < window:
        return None
    g = tx.grams(h, anchor)
    at = sliding_argmin(g, window - anchor + 1)
    ok = tx.runs(words.ptr, window)[: len(at)]
    text = words.text[: len(at)]
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(at) - 1]
    first, last = first[ok[first]], last[ok[first]]
    if not len(first):
        return None
    cover = _Plain(words).digest(first, last + window, at[first] - first)
    return {"text": text[first], "first": first - words.ptr[text[first]], "last": last - words.ptr[text[first]], "seed": g[at[first]], "cover": cover}


def _occurrences(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, ids, keys = tx.utf8(batch["text"]), batch["doc_id"].to_numpy(), batch["row_key"].to_numpy()
            for part in tx.chunks(raw):
                found = anchors(tx.Words(raw[part]), window, anchor)
                if found:
                    yield pd.DataFrame({"doc_id": ids[part][found["text"]], "row_key": keys[part][found["text"]], "first": found["first"].astype(np.int32), "span": (found["last"] - found["first"]).astype(np.int16), "seed": tx.signed(found["seed"]), "cover": tx.signed(found["cover"])})

    known = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    return known.mapInPandas(run, f"doc_id {kind}, row_key long, first int, span short, seed long, cover long")


def _windows(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(seed, cover, shift, hash, doc_id) of each window of the asked occurrences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = asked.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "span", "seed", "cover")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = tx.utf8(batch["text"])
            for part in tx.chunks(raw):
                words = tx.Words(raw[part])
                rows = [(doc, ptr, x) for doc, ptr, asked in zip(batch["doc_id"][part], words.ptr, batch["asked"][part]) for x in asked]
                if rows:
                    n = np.array([x["span"] + 1 for _, _, x in rows])
                    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat([ptr + x["first"] for _, ptr, x in rows], n) + shift
                    each = lambda values: np.repeat(np.array(values), n)
                    yield pd.DataFrame({"doc_id": each([d for d, _, _ in rows]), "seed": each([x["seed"] for _, _, x in rows]), "cover": each([x["cover"] for _, _, x in rows]), "shift": shift.astype(np.int16), "hash": tx.signed(_Plain(words).digest(at, at + window, np.zeros_like(at)))})

    texts = bitmap.may_hold(docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text"), F.col("row_key"), wanted, "row_key")
    return texts.join(wanted, ["doc_id", "row_key"]).mapInPandas(run, f"doc_id {kind}, seed long, cover long, shift short, hash long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, row_key, begin, end): word ranges of windows whose word sequence also starts in a document with a smaller doc_id.

    Ranges of one document may overlap; joined, they are the maximal repeats. row_key is the text's hash: of rows that share a
    doc_id each has the ranges of its own text, and none is judged by another row of its doc_id. Rows without a doc_id neither
    give nor get repeats; null texts have no words.
    """
    tx.small_batches(docs.sparkSession)
    found = saved(_occurrences(docs, window, anchor), "anchors")
    # what is joined is written first: both sides of each join are then plain exchanges, whose hot keys Spark can split
    shared = saved(found.groupBy("seed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("seed"), "shared-seeds")
    found = saved(found.join(shared, "seed"), "shared-anchors")
    classes = saved(found.groupBy("seed", "cover").agg(F.min(F.struct("doc_id", "first", "span", "row_key")).alias("one")), "classes")
    several = saved(classes.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "several")
    asked = saved(classes.join(several, "seed").select("seed", "cover", "one.doc_id", "one.row_key", "one.first", "one.span"), "asked")
    seen = saved(_windows(docs, asked, window), "windows")
    before = saved(seen.groupBy("seed", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most"), "before")
    matched = seen.join(before.select("seed", "hash", "least"), ["seed", "hash"]).filter("doc_id > least").groupBy("seed", "cover").agg(F.min("shift").alias("low"), F.max("shift").alias("high"))
    known = saved(classes.select("seed", "cover", F.col("one.doc_id").alias("least")).join(matched, ["seed", "cover"], "left"), "known")
    settled = found.join(known, ["seed", "cover"]).withColumn("all", F.col("doc_id") > F.col("least")).filter("all or low is not null")
    low, high = F.when(F.col("all"), F.lit(0)).otherwise(F.col("low")), F.when(F.col("all"), F.col("span")).otherwise(F.col("high"))
    return settled.select("doc_id", "row_key", (F.col("first") + low).alias("begin"), (F.col("first") + high + window).alias("end"))


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept, spans for each row of docs: kept are the words that stay, joined by one space; spans the maximal repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tx.small_batches(docs.sparkSession)
    ranges = saved(repeated_spans(docs, window, anchor), "repeats")
    ranges = ranges.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    schema = f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<begin:long,end:long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, raw, ranges in zip(batch["doc_id"], tx.utf8(batch["text"]), batch["ranges"]):
                words, spans, kept, at = raw.split(), [], [], 0
                for begin, end in sorted((r["begin"], min(r["end"], len(words))) for r in (ranges if ranges is not None else ())):
                    if spans and begin <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                    else:
                        spans.append((begin, end))
                for begin, end in spans:
                    kept += words[at:begin]
                    at = max(at, end)
                kept += words[at:]
                out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [{"begin": b, "end": e} for b, e in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "spans"]).astype({"doc_id": batch["doc_id"].dtype})

    # texts that no range belongs to stay where they are
    flagged = bitmap.flagged(docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text"), F.col("row_key"), ranges, "row_key", "_may")
    met = flagged.filter("_may").join(ranges, ["doc_id", "row_key"], "left").select("doc_id", "text", "ranges")
    alone = flagged.filter("not _may").select("doc_id", "text", F.lit(None).cast(met.schema["ranges"].dataType).alias("ranges"))
    return met.unionByName(alone).mapInPandas(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows that an earlier document holds; spans are the maximal repeats. A very long text costs one row an anchor."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "spans")
