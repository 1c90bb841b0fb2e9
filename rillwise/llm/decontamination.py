"""Benchmark decontamination: rare n-grams join documents to test items, Smith-Waterman alignment scores edited copies.

A bounded bitmap of the items' 5-grams goes to the documents; those that may hold one send their words and 5-grams. How many
documents hold each n-gram is counted over all of them, and the n-grams that are rare for an item join it to documents.
What is rare depends on the other documents, so pairs that share common n-grams alone are not given up: while it is read, a
document is held against an index of the items' words, in blocks of items, and those whose words could reach the threshold
are pairs as well. Each pair is aligned once, over the whole text; a document moves once for all its items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rillwise.llm import bitmap, text as tx
from rillwise.store import discard, saved

GRAM = 5
#: Words of the items that an index holds at most (some 200 MB with its n-grams); with more, items are taken in blocks.
BLOCK_WORDS = 2_000_000
#: Items that a document is aligned with at once.
TOGETHER = 256
#: An n-gram is rare for an item if at most RARE times as many documents hold it as hold the item's rarest; an item whose rarest
#: is held by more than SEEDED has none, and is found by its words.
RARE, SEEDED = 4, 64
THRESHOLD = 0.4
MATCH, MISMATCH, GAP = 1.0, -1.0, -0.6


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> float:
    """Best local alignment of two word sequences, as a share of the item's perfect score (0 if either is empty)."""
    if not len(item) or not len(passage):
        return 0.0
    slope = GAP * np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1), 0.0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        now = np.r_[0.0, np.maximum(np.maximum(diagonal, row[1:] + GAP), 0)]
        row = np.maximum.accumulate(now - slope) + slope  # gaps along the passage
        best = max(best, round(float(row.max()), 9))
    return best / (MATCH * len(item))


def _keys(words: np.ndarray, n: int) -> np.ndarray:
    """Of each run of n words; runs of different lengths have different ones."""
    return tx.mix(tx.grams(words, n) ^ np.uint64(n))


def _lists(arrays: list[np.ndarray]) -> pd.Series:
    return pd.Series([tx.signed(x) for x in arrays], dtype=object)


def item_table(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id, words (hashes, in order), grams (distinct n-grams, or the whole item if it is shorter) of each item with a word."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = tx.Words(tx.lower(batch["text"]), tx.ALNUM)
            h = words.hashes()
            own = [h[a:b] for a, b in zip(words.ptr[:-1], words.ptr[1:])]
            grams = [np.unique(_keys(w, min(GRAM, len(w)))) if len(w) else w for w in own]
            yield pd.DataFrame({"item": batch["item"], "item_id": batch["item_id"], "words": _lists(own), "grams": _lists(grams)})

    numbered = benchmark.filter("item_id is not null").select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return numbered.mapInPandas(run, f"item long, item_id {kind}, words array<long>, grams array<long>").filter(F.size("words") > 0)


class ItemIndex:
    """Which items of a block hold a word, and how often, and which hold an n-gram."""

    def __init__(self, items: pd.DataFrame):
        self.item = items["item"].to_numpy(np.int64)
        words, grams = ([np.asarray(x, np.int64).view(np.uint64) for x in items[c]] for c in ("words", "grams"))
        self.size = np.array([len(w) for w in words], np.int64)
        self.words, self.grams = self._postings(words), self._postings(grams)

    @staticmethod
    def _postings(lists: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Sorted keys, where each key's postings begin, and the postings: places in the block and how often."""
        each = [np.unique(x, return_counts=True) for x in lists]
        key, n = (np.concatenate([e[i] for e in each] + [np.zeros(0, (np.uint64, np.int64)[i])]) for i in (0, 1))
        at = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
        order = np.argsort(key, kind="stable")
        keys, begin = np.unique(key[order], return_index=True)
        return keys, np.append(begin, len(key)), at[order], n[order]

    @staticmethod
    def _tally(postings: tuple[np.ndarray, ...], held: np.ndarray, width: int) -> np.ndarray:
        """Of each item how many of its places have a key that is held (distinct keys)."""
        keys, begin, at, n = postings
        if not len(keys):
            return np.zeros(width)
        i = np.searchsorted(keys, held)
        i = i[i < len(keys)][keys[i[i < len(keys)]] == held[i < len(keys)]]
        size = begin[i + 1] - begin[i]
        places = np.arange(size.sum()) + np.repeat(begin[i] - np.cumsum(size) + size, size)
        return np.bincount(at[places], weights=n[places], minlength=width)

    def may_reach(self, words: np.ndarray, grams: np.ndarray, threshold: float) -> np.ndarray:
        """Items that share an n-gram and of whose words so many are held that the threshold could be reached (see may_score)."""
        shares = self._tally(self.grams, np.unique(grams), len(self.size)) > 0
        if not shares.any():
            return self.item[:0]
        held = self._tally(self.words, np.unique(words), len(self.size))
        return self.item[shares & (MATCH * held >= threshold * MATCH * self.size - 1e-6)]


def sharing_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row (a number), doc_id, key (of the content), grams, words, may of each row of docs that may share an n-gram with an item.

    may are the items whose words could reach the threshold. items: a block that can be held in each task (BLOCK_WORDS). A
    bounded bitmap of the items' n-grams is asked first: of other documents nothing leaves the scan.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    tx.small_batches(spark)
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(GRAM))).distinct().collect()]  # 5 at most
    bits = spark.sparkContext.broadcast(bitmap.collected(items.select(F.explode("grams").alias("gram")), "gram"))
    index = spark.sparkContext.broadcast(ItemIndex(items.select("item", "words", "grams").toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = tx.lower(batch["text"])
            for part in tx.chunks(raw):
                words = tx.Words(raw[part], tx.ALNUM)
                h, text, met = words.hashes(), words.text, {}
                for n in sizes:
                    g = _keys(h, n)
                    hit = np.flatnonzero(bitmap.holds(bits.value, g) & tx.runs(words.ptr, n)[: len(g)])
                    for t in np.unique(text[hit]):
                        met.setdefault(int(t), []).append(g[hit[text[hit] == t]])
                rows = batch.iloc[part].iloc[list(met)].reset_index(drop=True)
                found, own = [np.unique(np.concatenate(g)) for g in met.values()], [h[words.ptr[t] : words.ptr[t + 1]] for t in met]
                may = [index.value.may_reach(w, g, threshold) for w, g in zip(own, found)]
                yield pd.DataFrame({"row": rows["row"], "doc_id": rows["doc_id"], "key": rows["key"], "grams": _lists(found), "words": _lists(own), "may": pd.Series(may, dtype=object)})

    tagged = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", tx.content_key(F.col("text")).alias("key"), "text")
    return tagged.mapInPandas(run, f"row long, doc_id {kind}, key string, grams array<long>, words array<long>, may array<long>")


def may_score(item: np.ndarray, passage: np.ndarray, threshold: float) -> bool:
    """Whether the item's words that the passage holds would do if all of them matched; no alignment scores more."""
    return MATCH * np.isin(item, passage).sum() >= threshold * MATCH * len(item) - 1e-6


def _aligner(threshold: float):
    """A column function of (words of some items, document's words): the best alignment's score with each, 0 if it can't reach the threshold."""

    @F.pandas_udf("array<double>")
    def align(asked: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for items, text in zip(asked, texts):
            text = np.asarray(text, np.int64)
            own = [np.asarray(i, np.int64) for i in items]
            out.append([smith_waterman(i, text) if may_score(i, text, threshold) else 0.0 for i in own])
        return pd.Series(out, dtype=object)

    return align


def candidate_pairs(met: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item, seeds): documents and items that share an n-gram that is rare for the item, and how many of them; and those that
    share common ones alone (seeds 0) but whose words could reach the threshold.
    """
    each = saved(met.select("row", F.explode("grams").alias("gram")), "shared-grams")
    asked = saved(items.select("item", F.explode("grams").alias("gram")), "asked-grams")
    held = each.groupBy("gram").agg(F.count("*").alias("held"))
    known = saved(asked.join(held, "gram"), "held-grams")
    least = known.groupBy("item").agg(F.min("held").alias("least")).filter(F.col("least") <= SEEDED)
    rare = saved(known.join(least, "item").filter(F.col("held") <= RARE * F.col("least")).select("item", "gram"), "rare-grams")
    seeded = saved(each.join(rare, "gram").groupBy("row", "item").agg(F.count("*").alias("seeds")), "seeded-pairs")
    may = met.select("row", F.explode("may").alias("item"))
    pairs = saved(seeded.unionByName(may.join(seeded, ["row", "item"], "left_anti").withColumn("seeds", F.lit(0).cast("long"))), "pairs")
    discard(each, asked, known, rare, seeded)
    return pairs


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row, key, item_id, seeds, score of the documents and items that share an n-gram and align with threshold or more.

    The score is that of the whole text's best alignment with the item, so nothing depends on where the shared n-grams lie
    or how long the copy is. Words are runs of letters and digits, in lower case. Items without a word match nothing; an
    item shorter than five words is matched by its whole sequence. Null texts are empty. Equal items each give a row, as do
    repeated rows of docs; row tells these apart (within a block of items), key is the content's digest. No pair is left out
    for what is frequent: seeds counts the shared n-grams that are rare for the item, and may be 0. A very long text costs its
    words (8 bytes each) if it shares an n-gram, and one alignment for each item that it may reach.
    """
    items = saved(item_table(benchmark), "items")
    words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks, found = -(-words // BLOCK_WORDS) or 1, []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        met = saved(sharing_documents(docs, own, threshold), "sharing")
        pairs = candidate_pairs(met, own)
        some = F.pmod("item", F.floor(F.count("*").over(W.partitionBy("row")) / TOGETHER) + 1)
        asking = pairs.join(own.select("item", "item_id", F.col("words").alias("asked")), "item").withColumn("_some", some)
        together = asking.groupBy("row", "_some").agg(F.collect_list(F.struct("item_id", "seeds", "asked")).alias("_asked"))  # TOGETHER items or so
        scored = met.select("row", "doc_id", "key", "words").join(together, "row").withColumn("_score", _aligner(threshold)("_asked.asked", "words"))
        each = scored.select("doc_id", "row", "key", F.explode(F.arrays_zip(F.col("_asked.item_id").alias("item_id"), F.col("_asked.seeds").alias("seeds"), F.col("_score").alias("score"))).alias("_p"))
        found.append(each.select("doc_id", "row", "key", "_p.item_id", "_p.seeds", "_p.score").filter(F.col("score") >= threshold))
    return reduce(DataFrame.unionByName, found)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document: doc_id, its best item_id (ties: the least), n_items, seeds and score of that item."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contaminated(docs, benchmark)
    best = found.groupBy("doc_id", "row").agg(F.min(F.struct((-F.col("score")).alias("less"), "item_id", "seeds")).alias("best"), F.countDistinct("item_id").alias("n_items"))
    return best.select("doc_id", F.col("best.item_id").alias("item_id"), "n_items", F.col("best.seeds").alias("seeds"), F.round(-F.col("best.less"), 6).alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that align with no test item, with all their columns; another text of a contaminated one's doc_id stays."""
    gone = saved(contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")).distinct(), "contaminated")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (tx.content_key(F.col("text")) == F.col("_key")), "left_anti")
