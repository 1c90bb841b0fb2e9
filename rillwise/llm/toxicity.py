"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

A bounded sample of labelled documents is the example set. Terms are words and word beginnings, all that the examples
hold; a term weighs its TF-IDF times the square of how many standard errors its frequency differs by between the classes.
Examples lie in blocks; for each term and block the index knows the largest weight, so blocks whose bound can't reach the
k nearest are skipped without changing the result. Votes are weighted by cosine and calibrated by the examples' own
leave-one-out votes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rillwise.llm import text as tx
from rillwise.store import saved

#: Bound of what is fitted on: labelled examples of each class.
EXAMPLES = {1: 512, 0: 1280}
NEAREST = 15
BLOCK = 128
STARTS = (5,)
REJECT = 0.7


def terms(words: tx.Words) -> np.ndarray:
    """Hashes of each word and of its beginnings, one row for each length."""
    whole = words.hashes()
    size = words.end - words.start
    return np.stack([whole, *(np.where(size > n, words.hashes(n) ^ np.uint64(n), whole) for n in STARTS)])


def _document_terms(raw: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its distinct terms)."""
    for part in tx.chunks(raw):
        words = tx.Words(raw[part], tx.ALNUM)
        all_terms = terms(words)
        for i in range(len(words.ptr) - 1):
            yield part.start + i, np.unique(all_terms[:, words.ptr[i] : words.ptr[i + 1]])


def choose_examples(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] = EXAMPLES) -> DataFrame:
    """doc_id, text, toxic of at most bounds[label] labelled documents of each class: those least by a hash of doc_id.

    Of conflicting labels the larger counts; where a doc_id has several texts, the least is the example.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    picked = [known.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(n) for label, n in bounds.items()]
    own = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # no more than the bounds
    return own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def term_counts(examples: DataFrame) -> DataFrame:
    """term, toxic, clean: how many examples of each class hold each term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(t, np.full(len(t), y)) for (_, t), y in zip(_document_terms(tx.lower(batch["text"])), batch["toxic"])]
            if found:
                term, label = (np.concatenate(x) for x in zip(*found))
                own, place = np.unique(term, return_inverse=True)
                toxic = np.bincount(place, weights=label, minlength=len(own)).astype(np.int64)
                yield pd.DataFrame({"term": tx.signed(own), "toxic": toxic, "clean": np.bincount(place, minlength=len(own)) - toxic})

    counted = examples.select("text", F.col("toxic").cast("long")).mapInPandas(run, "term long, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 ... n times, for each pair."""
    end = np.cumsum(n)
    return np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0)


@dataclass
class Index:
    """vocabulary (sorted term hashes) with the terms' weights; cells of a term and a block, each with its largest weight and postings; label of each example; calibration steps."""

    vocabulary: np.ndarray
    value: np.ndarray
    cells: np.ndarray  # of each term: its first cell
    block: np.ndarray  # of each cell
    most: np.ndarray
    postings: np.ndarray  # of each cell: its first posting
    example: np.ndarray
    weight: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    importance: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def vectors(self, raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text, of length 1, or nothing where no term is known."""
        for part in tx.chunks(raw):
            words = tx.Words(raw[part], tx.ALNUM)
            found = terms(words).ravel()
            at = np.minimum(np.searchsorted(self.vocabulary, found), max(0, len(self.vocabulary) - 1))
            hit = np.flatnonzero(self.vocabulary[at] == found) if len(self.vocabulary) else np.zeros(0, np.int64)
            n = len(self.vocabulary) or 1
            text = np.repeat(np.arange(len(words.ptr) - 1), np.diff(words.ptr))[hit % max(1, len(words))]
            keys, tf = np.unique(text * n + at[hit], return_counts=True)
            value = (1 + np.log(tf)) * self.value[keys % n] if len(keys) else np.zeros(0)
            bounds = np.searchsorted(keys, np.arange(len(words.ptr)) * n)
            for a, b in zip(bounds[:-1], bounds[1:]):
                w = value[a:b]
                yield keys[a:b] % n, w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEAREST, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine above 0 (ties: the first), and their cosines."""
        best, who = np.zeros(0), np.zeros(0, np.int64)
        blocks = -(-len(self.label) // BLOCK)
        n = self.cells[term + 1] - self.cells[term]
        cell, own = _spread(self.cells[term], n), np.repeat(weight, n)
        block = self.block[cell]
        bound = np.bincount(block, own * self.most[cell], minlength=blocks)
        order = np.argsort(-bound, kind="stable")
        for todo in (order[: -(-blocks // 4)], order[-(-blocks // 4) :]):
            todo = todo[(bound[todo] > 0) & ((len(best) < k) | (bound[todo] >= (best[-1] if len(best) else 0) - 1e-12))]
            if not len(todo):
                break
            chosen = np.zeros(blocks, bool)
            chosen[todo] = True
            some = np.flatnonzero(chosen[block])
            n = self.postings[cell[some] + 1] - self.postings[cell[some]]
            at = _spread(self.postings[cell[some]], n)
            score = np.bincount(self.example[at], self.weight[at] * np.repeat(own[some], n), minlength=len(self.label))
            if leave >= 0:
                score[leave] = 0
            near = np.flatnonzero(score > (best[-1] - 1e-12 if len(best) == k else 0))
            best, who = np.r_[best, score[near]], np.r_[who, near]
            first = np.lexsort((who, -np.round(best, 12)))[:k]
            best, who = best[first], who[first]
        return who, best

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        """Weighted share of toxic ones; sampled classes count as often as they are in the labels; -1 without a neighbour."""
        if not len(who):
            return -1.0
        w = cosine * cosine * self.importance[who]
        return float((w * self.label[who]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending steps (pool adjacent violators), shrunk a little from 0 and 1."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    at, group = np.unique(x, return_inverse=True)
    total, good = np.bincount(group, w), np.bincount(group, w * y)
    pools: list[list[float]] = []
    for a, n, g in zip(at, total, good):
        pools.append([g, n, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, n, _, b = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + n, pools[-1][2], b]
    xs = np.array([v for p in pools for v in p[2:]])
    ys = np.repeat([(p[0] + 0.02) / (p[1] + 0.1) for p in pools], 2)
    return xs, np.maximum.accumulate(ys)


def term_values(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """A term's weight from how many toxic and clean examples hold it: IDF times the squared standard score of its log ratio."""
    idf = np.log((n1 + n0 + 1) / (toxic + clean + 1)) + 1
    ratio = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    return idf * ratio**2 / (1 / (toxic + 0.5) + 1 / (clean + 0.5))


def fit(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] = EXAMPLES) -> Index:
    """The index of a bounded sample of labels; the driver gets the examples' terms and sparse vectors, no texts."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    tx.small_batches(spark)
    examples = saved(choose_examples(docs, labels, bounds), "examples")
    shares = {r["toxic"]: r["n"] for r in labels.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(size.get(1, 0)), float(size.get(0, 0))
    counted = term_counts(examples).toPandas()
    counted = counted.assign(key=counted["term"].to_numpy(np.int64).view(np.uint64)).sort_values("key", ignore_index=True)
    vocabulary, value = counted["key"].to_numpy(np.uint64), term_values(counted["toxic"].to_numpy(float), counted["clean"].to_numpy(float), n1, n0)
    draft = Index(vocabulary, value, *[np.zeros(0)] * 9, steps=(np.array([-1.0]), np.array([0.5])))
    sent = spark.sparkContext.broadcast(draft)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = list(sent.value.vectors(tx.lower(batch["text"])))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "term": pd.Series([t for t, _ in vectors], dtype=object), "weight": pd.Series([w for _, w in vectors], dtype=object)})

    rows = examples.select("doc_id", "text", F.col("toxic").cast("long")).mapInPandas(run, f"doc_id {kind}, toxic long, term array<long>, weight array<double>").toPandas()
    sent.destroy()
    # alike examples side by side: a block's bound is then close to its examples
    heavy = [t[int(np.argmax(w))] if len(t) else -1 for t, w in zip(rows["term"], rows["weight"])]
    rows = rows.assign(heavy=heavy).sort_values(["heavy", "doc_id"], ignore_index=True)
    example = np.repeat(np.arange(len(rows), dtype=np.int32), rows["term"].map(len).to_numpy(np.int64))
    term = np.concatenate([*rows["term"], np.zeros(0, np.int64)]).astype(np.int64)
    weight = np.concatenate([*rows["weight"], np.zeros(0)]).astype(float)
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order], weight[order]
    place = term * (len(rows) // BLOCK + 1) + example // BLOCK
    first = np.flatnonzero(np.diff(place, prepend=-1))
    label = rows["toxic"].to_numpy(float)
    importance = np.where(label == 1, shares.get(1, 0) / max(n1, 1), shares.get(0, 0) / max(n0, 1))
    index = Index(
        vocabulary, value, np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), example[first] // BLOCK, np.maximum.reduceat(weight, first) if len(first) else weight,
        np.r_[first, len(term)], example, weight, label, rows["doc_id"].to_numpy(), importance, draft.steps,
    )
    full = spark.sparkContext.broadcast((index, {d: i for i, d in enumerate(rows["doc_id"])}))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, place = full.value
        for batch in batches:
            own = [(place[d], x) for d, x in zip(batch["doc_id"], index.vectors(tx.lower(batch["text"])))]
            yield pd.DataFrame({"example": [i for i, _ in own], "vote": [index.vote(*index.nearest(*x, leave=i)) for i, x in own]})

    votes = examples.repartition(8, "doc_id").select("doc_id", "text").mapInPandas(alone, "example long, vote double").toPandas().sort_values("example")
    full.destroy()
    gc.collect()  # sparse vectors and plans that are done with
    if len(votes):
        index.steps = isotonic(votes["vote"].to_numpy(), label, importance)
    return index


def score(docs: DataFrame, index: Index, key: bool = False) -> DataFrame:
    """doc_id, score (0 to 1), evidence (doc_ids of the nearest examples and their cosines) of each row of docs, and on demand the content's key.

    A null or empty text, and one without a known term, gets the share of toxic examples that have no neighbour either.
    Of examples with one cosine the first by their order in the index is nearer. Repeated rows are scored each, alike. A
    very long text is one sparse vector, made in one task. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tx.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            near = [index.nearest(t, w) for t, w in index.vectors(tx.lower(batch["text"]))]
            yield pd.DataFrame({
                **{c: batch[c] for c in batch.columns if c != "text"},
                "score": [index.calibrated(index.vote(*x)) for x in near],
                "evidence": pd.Series([[{"doc_id": index.ids[i], "cosine": c} for i, c in zip(*x)] for x in near], dtype=object),
            })

    extra = [tx.content_key(F.col("text")).alias("key")] if key else []
    return docs.select("doc_id", "text", *extra).mapInPandas(run, f"doc_id {kind}, {'key string, ' if key else ''}score double, evidence array<struct<doc_id:{kind},cosine:double>>")


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and its evidence."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, fit(docs, training_labels(labels)))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of docs whose score is below reject, learned from docs that labels name. All columns stay.

    A clean text whose doc_id a toxic one has too stays.
    """
    found = score(docs, fit(docs, training_labels(labels)), key=True).filter(F.col("score") >= reject)
    gone = saved(found.select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")).distinct(), "toxic")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (tx.content_key(F.col("text")) == F.col("_key")), "left_anti")
