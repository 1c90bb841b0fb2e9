"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every document. Expectation-maximisation estimates each labeller's
accuracy and the share of good documents from the counts of vote patterns over all documents (as many as there are
patterns, whatever the corpus holds), and gives each pattern its posterior. A linear scorer over hashed words, word
shapes and text statistics is then trained on the posteriors of a bounded sample and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rillwise.llm import text as tx
from rillwise.store import saved

#: Documents whose posteriors the scorer is trained on: those least by a hash of doc_id.
SAMPLE = 6000
SLOTS = 1 << 15
EPOCHS = 12
KEEP = 0.5

# Frequent short words of the languages at hand, and bytes that prose seldom has.
STOP = "the of and to in is that it was for on are as with be by de la que el en y los se las un una der die und den von zu das mit sich des auf et le les des du dans qui par pour est".split()
ODD = np.isin(np.arange(256), list(b"#$%&*@!|<>{}[]\\^~_=+"))
UPPER = np.isin(np.arange(256), list(range(65, 91)))
PUNCTUATION = np.array([chr(b).isprintable() and not chr(b).isalnum() and b not in (9, 10, 13, 32) for b in range(128)] + [False] * 128)
LETTER = np.array([chr(b).isalpha() for b in range(128)] + [True] * 128)

#: Labeller: statistic, good from (or up to), bad beyond; between them it abstains.
LABELLERS = (
    ("punctuation", 0.045, 0.07),
    ("odd", 0.004, 0.03),
    ("upper", 0.06, 0.3),
    ("repeats", 0.03, 0.2),
    ("pairs_again", 0.2, 0.4),
    ("open_lines", 0.1, 0.3),
    ("no_stop", 0.95, 0.985),
    ("length_off", 0.9, 1.6),
)
#: Labellers that see the same kind of bad text.
KINDS = (("punctuation", "odd"), ("upper",), ("repeats", "pairs_again"), ("open_lines", "no_stop", "length_off"))


def statistics(raw: list[bytes]) -> np.ndarray:
    """One row for each text, one column for each labeller, and the number of words; all are larger the worse the text."""
    out = []
    stop = np.unique(tx.Words([b" ".join(w.encode() for w in STOP)]).hashes())
    for part in tx.chunks(raw):
        words = tx.Words(raw[part])
        low = tx.Words([t.lower() for t in raw[part]])
        h = low.hashes()
        first = np.r_[words.first[:-1], len(words.buf)]
        n, size = np.diff(words.ptr), np.diff(first) - 1
        # shares and means lean towards what prose usually has (as if so many bytes or words of it stood there): short texts say little
        shares = lambda table, usual, lean=200: (np.diff(np.r_[0, np.cumsum(table[words.buf])][first]) + lean * usual) / (size + lean)
        word_share = lambda x, usual=0.0, lean=20: (np.diff(np.r_[0, np.cumsum(x)][words.ptr]) + lean * usual) / (n + lean)
        inner = np.r_[False, np.diff(words.text) == 0] if len(h) else np.zeros(0, bool)
        again = np.zeros(len(n))
        # the first word of a text has no word before it, whatever text stands there
        pair = tx.mix(np.where(inner, np.r_[h[:1], h[:-1]], 0).astype(np.uint64) * np.uint64(3) + h)
        for i, (a, b) in enumerate(zip(words.ptr[:-1], words.ptr[1:])):
            again[i] = (b - a - len(np.unique(pair[a:b]))) / (b - a + 20)
        lines = [[x for x in (y.strip() for y in t.split(b"\n")) if x] for t in raw[part]]
        letters = (words.end - words.start).astype(float)
        out.append(np.stack([
            shares(PUNCTUATION, 0.025), shares(ODD, 0.0), shares(UPPER, 0.016),
            word_share(np.r_[False, h[1:] == h[:-1]][: len(h)] & inner), again,
            np.array([sum(x[-1:] not in b".!?:;\"')" for x in own) / (len(own) + 2) for own in lines]),
            1 - word_share(np.isin(h, stop), 0.14), np.abs(word_share(letters, 5.2) - 5.2), n,
        ], axis=1))
    return np.concatenate([*out, np.zeros((0, len(LABELLERS) + 1))])


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 abstains. Texts without words get no good vote, and one bad one from each labeller."""
    good, bad = (np.array([x[i] for x in LABELLERS]) for i in (1, 2))
    own = stats[:, : len(LABELLERS)]
    v = np.where(own <= good, 1, np.where(own > bad, 0, -1))
    return np.where(stats[:, -1:] > 0, v, 0)


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and each labeller's accuracy, by expectation-maximisation.

    A labeller sees some kinds of bad text only, so bad is several classes, one for each kind; votes are independent given the class.
    """
    m, classes = len(LABELLERS), 1 + len(KINDS)
    v = patterns[:, None] // 3 ** np.arange(m) % 3 - 1
    prior = np.array([0.8, *[0.2 / len(KINDS)] * len(KINDS)])
    p = np.full((m, classes, 3), 0.0)  # of labeller, class, vote
    p[:, 0] = [0.2, 0.02, 0.78]
    p[:, 1:] = [0.3, 0.1, 0.6]
    for c, kind in enumerate(KINDS, 1):
        p[[i for i, x in enumerate(LABELLERS) if x[0] in kind], c] = [0.2, 0.7, 0.1]
    n = counts.astype(float)
    share = np.zeros((len(n), classes))
    for _ in range(rounds):
        like = np.stack([np.log(p[np.arange(m), c, v + 1]).sum(axis=1) for c in range(classes)], axis=1) + np.log(prior)
        share = np.exp(like - like.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        weight = share * n[:, None]
        prior = weight.sum(axis=0) + 1e-3 * max(1.0, n.sum())
        prior /= prior.sum()
        for c in range(classes):
            for k in range(3):
                p[:, c, k] = ((v == k - 1) * weight[:, c : c + 1]).sum(axis=0) + 1
            p[:, c] /= p[:, c].sum(axis=1, keepdims=True)
    accuracy = prior[0] * p[:, 0, 2] + (prior[None, 1:] * p[:, 1:, 1]).sum(axis=1)
    return share[:, 0], accuracy


def features(raw: list[bytes], stats: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text: shares of hashed words and word shapes, and its binned statistics."""
    m = len(LABELLERS)
    bins = np.clip((stats[:, :m] / np.array([x[2] for x in LABELLERS]) * 8).astype(np.int64), 0, 15)
    salt = tx.mix(np.arange(1, 16 * m + 1, dtype=np.uint64)).astype(np.uint64)
    for part in tx.chunks(raw):
        low = tx.Words([t.lower() for t in raw[part]])
        h = low.hashes()
        size = low.end - low.start
        letters = np.r_[0, np.cumsum(LETTER[low.buf])]
        last = low.buf[low.end - 1].astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
        letters = letters[low.end] - letters[low.start]
        shape = tx.mix(np.minimum(size - letters, 7).astype(np.uint64) * np.uint64(4096) + np.where(LETTER[last.astype(np.int64)], 0, last).astype(np.uint64) + np.uint64(1 << 40))
        for i, (a, b) in enumerate(zip(low.ptr[:-1], low.ptr[1:])):
            own = salt[bins[part.start + i] + 16 * np.arange(m)]
            slot, n = np.unique(np.r_[h[a:b], shape[a:b]] % np.uint64(SLOTS), return_counts=True)
            norm = np.sqrt((n * n).sum()) or 1.0
            yield np.r_[slot, own % np.uint64(SLOTS)].astype(np.int64), np.r_[n / norm, np.full(m, 1.0)]


def train(vectors: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer, by AdaGrad over soft targets."""
    w, g2 = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-6)
    order = np.argsort(tx.mix(np.arange(len(vectors), dtype=np.uint64)), kind="stable")
    for _ in range(EPOCHS):
        for i in order:
            slot, value = vectors[i]
            error = 1 / (1 + np.exp(-np.clip(w[slot] @ value + w[-1], -30, 30))) - target[i]
            slot, g = np.r_[slot, SLOTS], np.r_[error * value, error]
            g2[slot] += g * g
            w[slot] -= 0.2 * g / np.sqrt(g2[slot])
    return w


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vote patterns of all rows, ascending, and how often each comes (3 ** labellers patterns at most)."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, n = np.unique(pattern(votes(statistics(tx.utf8(batch["text"])))), return_counts=True)
            yield pd.DataFrame({"pattern": own, "n": n})

    tx.small_batches(docs.sparkSession)
    counted = docs.select("text").mapInPandas(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    return counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)


def labeller_accuracies(docs: DataFrame) -> dict[str, float]:
    """Of each labeller the estimated share of documents that it votes right on, without any label."""
    _, accuracy = label_model(*vote_counts(docs))
    return {x[0]: float(a) for x, a in zip(LABELLERS, accuracy)}


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, posterior, score (0 to 1: good is likelier), votes of each row of docs, of which doc_id and text are read.

    Null and empty texts get bad votes. Repeated rows are scored alike; where a doc_id has several texts, the least may be
    trained on. Rows without a doc_id are scored, not trained on. An empty table gives an empty result. A very long text is
    read once a pass, in the task that holds it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    patterns, counts = vote_counts(docs)
    posterior, _ = label_model(patterns, counts)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    # ids first, no more than the sample: texts stay where they are, but for those chosen
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    chosen = saved(own.groupBy("doc_id").agg(F.min("text").alias("text")), "quality-sample")

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = tx.utf8(batch["text"])
            stats = statistics(raw)
            slots, values = zip(*features(raw, stats)) if raw else ((), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pattern": pattern(votes(stats)), "slots": list(slots), "vals": list(values)})

    rows = chosen.mapInPandas(sparse, f"doc_id {kind}, pattern long, slots array<int>, vals array<double>").toPandas().sort_values("doc_id", ignore_index=True)
    target = posterior[np.searchsorted(patterns, rows["pattern"].to_numpy(np.int64))] if len(rows) else np.zeros(0)
    weights = docs.sparkSession.sparkContext.broadcast(train([(np.asarray(s, np.int64), np.asarray(v)) for s, v in zip(rows["slots"], rows["vals"])], target))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for batch in batches:
            raw = tx.utf8(batch["text"])
            stats = statistics(raw)
            v = votes(stats)
            linear = np.array([w[s] @ x + w[-1] for s, x in features(raw, stats)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "posterior": posterior[np.searchsorted(patterns, pattern(v))], "score": 1 / (1 + np.exp(-np.clip(linear, -30, 30))), "votes": list(v)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, posterior double, score double, votes array<int>")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the scorer's verdict and the label model's posterior."""
    found = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "score", "posterior", (F.col("score") >= KEEP).alias("keep"))
