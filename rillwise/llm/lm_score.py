"""Language-model scores by deleted interpolation.

Documents lie in blocks of neighbouring doc_ids, of about equal bytes. A block asks the shards of the n-gram space for the counts of its
distinct n-grams and brings its own counts along; a shard adds up what all blocks bring and answers each in the order of
its question. So counts cover all documents, rows grow with the distinct n-grams of a block, and no n-gram, however
frequent, costs more than one entry a block. One fold of the training documents is held out of the counts that
expectation-maximisation learns the mixture weights from; weights belong to buckets of the context's frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillwise.llm import text as tx
from rillwise.store import saved

#: Bytes of text for each block of documents, and from how many times as much a block is parted.
BLOCK_BYTES, LARGE = 6 << 20, 4
#: Bytes of text for each shard of the n-gram space, and for each task of documents.
SHARD_BYTES = 6 << 20
FOLDS = 10
#: Fold that is never trained on, and fold that the mixture weights are learned on.
TEST, TUNE = 0, 1
END = np.uint64(0x5851F42D4C957F2D)
#: log10 probabilities are binned so finely for the learning of the weights alone.
STEP, LOW = 0.1, -12.0
ROUNDS = 60


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words in lower case, then its end), and where each text's begin, and one more."""
    raw, out, ptr = tx.lower(texts), [], [0]
    for part in tx.chunks(raw):
        words = tx.Words(raw[part])
        out.append(np.insert(words.hashes(), words.ptr[1:], END))
        ptr += (ptr[-1] + words.ptr[1:] + np.arange(1, len(words.ptr))).tolist()
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.array(ptr)


def previous(token: np.ndarray) -> np.ndarray:
    """The token before each; the first of a text follows an end."""
    return np.r_[np.full(min(1, len(token)), END), token[:-1]]


def pairs(token: np.ndarray) -> np.ndarray:
    return tx.mix(previous(token) * np.uint64(0x9E3779B97F4A7C15) + token)


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes: answers put one after the other are in the order of the hashes."""
    return ((gram >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers: the upper ones are mostly zeros, which the shuffle's compression removes."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _packed(sorted_: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


def keyed(docs: DataFrame, blocks: int = 1, low: int = 0, width: float = 1.0) -> DataFrame:
    """doc_id, text, fold and grp: the block, parted into the tuning fold and the rest.

    Whole numbers as doc_ids lie in blocks of neighbours, width numbers from low on each; others are dealt to so many blocks
    by a hash, and rows without a doc_id to as many by a hash of their text.
    """
    doc = F.col("doc_id")
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    block = F.floor((doc - F.lit(low)) / F.lit(width)).cast("long") if _whole(docs) else dealt(doc)
    block = F.when(doc.isNull(), dealt(F.col("text")) + F.lit(1 << 59)).otherwise(block)
    return docs.select("doc_id", "text", fold(F.coalesce(doc.cast("string"), F.lit(""))).alias("fold"), block.alias("_block")).withColumn("grp", 2 * F.col("_block") + (F.col("fold") == TUNE).cast("long"))


def _whole(docs: DataFrame) -> bool:
    return docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """docs as keyed gives them, in blocks of about BLOCK_BYTES of text however dense doc_ids are: the width of a block goes by their
    mean distance, and blocks that come out large (doc_ids that are dense in places or repeated) are parted by a hash of the text.
    Rows that repeat a doc_id and its text stay together.
    """
    if _whole(docs):
        seen = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.sum(F.octet_length("text"))).first()
        low, high, n, size = (x or 0 for x in seen)
        rows = keyed(docs, blocks, low, max(1.0, (high - low + 1) / max(1, n) * max(1.0, BLOCK_BYTES * n / max(1, size))))
    else:
        rows = keyed(docs, blocks)
    sizes = rows.groupBy("_block").agg(F.sum(F.octet_length("text")).alias("size")).filter(F.col("size") > LARGE * BLOCK_BYTES)
    large = saved(sizes.select("_block", F.ceil(F.col("size") / BLOCK_BYTES).alias("_parts")), "large-blocks")
    if large.isEmpty():
        return rows.drop("_block")
    part = F.coalesce(F.pmod(F.xxhash64("text"), F.col("_parts")), F.lit(0))
    return rows.join(large, "_block", "left").withColumn("grp", F.col("grp") + 2 * F.shiftleft(part.cast("long"), 36)).drop("_block", "_parts")


def questions(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, grp, size, grams, counts): the distinct n-grams of size 1 and 2 of a block and how often its training documents have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, own in batch.groupby("grp", sort=False):
                token, ptr = tokens(own["text"])
                weight = np.repeat((own["fold"] != TEST).to_numpy(np.int64), np.diff(ptr))
                out = []
                for size, gram in ((1, token), (2, pairs(token))):
                    distinct, place = np.unique(gram, return_inverse=True)
                    count = np.bincount(place, weights=weight, minlength=len(distinct)).astype(np.int64)
                    cut = np.searchsorted(_shard(distinct, shards), np.arange(shards + 1))
                    out += [(s, grp, size, _packed(distinct[a:b]), _planes(count[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                yield pd.DataFrame(out, columns=["shard", "grp", "size", "grams", "counts"])

    return docs.mapInPandas(run, "shard int, grp long, size int, grams binary, counts binary")


def answer(batch: pd.DataFrame) -> pd.DataFrame:
    """What answers tells of one shard."""
    out, shard = [], int(batch["shard"].iloc[0])
    for size, rows in batch.groupby("size"):
        grams = [_unpacked(x) for x in rows["grams"]]
        counts = [_numbers(x) for x in rows["counts"]]
        tune = np.repeat(rows["grp"].to_numpy() % 2 == 1, [len(g) for g in grams])
        all_, n = np.concatenate(grams), np.concatenate(counts)
        distinct, place = np.unique(all_, return_inverse=True)
        whole, kept = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        np.add.at(whole, place, n)  # whole numbers throughout: no count wraps or is rounded
        np.add.at(kept, place[~tune], n[~tune])
        starts = np.cumsum([0, *map(len, grams)])
        by: dict[int, list[np.ndarray]] = {}
        for grp, a, b in zip(rows["grp"], starts[:-1], starts[1:]):
            by.setdefault(grp, []).append(place[a:b])
        for grp, own in by.items():
            at = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
            out.append((shard, grp, size, _planes(kept[at]) if grp % 2 else b"", _planes(whole[at]), 0, 0, 0))
        out.append((shard, None, size, None, None, int((whole > 0).sum()), int(whole.sum()), int(kept.sum())))
    return pd.DataFrame(out, columns=["shard", "grp", "size", "kept", "whole", "distinct", "total", "kept_total"]).assign(grp=pd.array([x[1] for x in out], "Int64"))


def answers(asked: DataFrame) -> DataFrame:
    """(shard, grp, size, kept, whole): counts without and with the tuning fold, in the order of the block's distinct n-grams there.

    A row without grp tells of a shard how many distinct training n-grams there are, and how often they come with and without the tuning fold.
    """
    return asked.groupBy("shard").applyInPandas(answer, "shard int, grp long, size int, kept binary, whole binary, distinct long, total long, kept_total long")


def _counts(answer: pd.DataFrame, size: int, column: str) -> np.ndarray:
    own = answer[answer["size"] == size].sort_values("shard")
    return np.concatenate([_numbers(x) for x in own[column]] + [np.zeros(0, np.int64)]).astype(float)


def _looked_up(token: np.ndarray, answer: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token, of each token's context and of both together."""
    one, two = _counts(answer, 1, column), _counts(answer, 2, column)
    distinct, place = np.unique(token, return_inverse=True)
    c = one[place]
    end = one[np.searchsorted(distinct, END)]
    context = np.r_[np.full(min(1, len(c)), end), c[:-1]]
    return c, context, two[np.unique(pairs(token), return_inverse=True)[1]]


def bucket(context: np.ndarray) -> np.ndarray:
    """0: not seen; else one more than the count's binary logarithm."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)), 0).astype(np.int64)


def _bin(p: np.ndarray) -> np.ndarray:
    """-1 for 0."""
    return np.where(p > 0, np.maximum(0, np.rint((np.log10(np.maximum(p, 1e-300)) - LOW) / STEP)), -1).astype(np.int64)


def mixture_weights(histogram: pd.DataFrame, uniform: float) -> np.ndarray:
    """weights[bucket] of the pair's, the word's and the uniform probability, by expectation-maximisation on held-out counts.

    histogram: bucket, two, one (bins of the probabilities) and n. A bucket without held-out tokens has those of all.
    """
    value = lambda b: np.where(b >= 0, 10.0 ** (LOW + STEP * b), 0.0)
    parts = np.stack([value(histogram["two"].to_numpy()), value(histogram["one"].to_numpy()), np.full(len(histogram), uniform)], axis=1)
    n, own = histogram["n"].to_numpy(float), histogram["bucket"].to_numpy()

    def learned(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) + 1e-3
            w /= w.sum()
        return w

    if not len(n):
        return np.full((65, 3), 1 / 3)
    out = np.tile(learned(parts, n), (65, 1))
    for b in np.unique(own):
        out[b] = learned(parts[own == b], n[own == b])
    out[0, 1:] += out[0, 0] / 2  # a context that was never seen has no pairs
    out[0, 0] = 0
    return out


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (of which doc_id and text are read).

    Scores are log10 probabilities of the whole text: base_score by single tokens with 0.1 added to each count, score by
    the interpolated model. Null and empty texts have one token, the end. Without training documents all counts are 0.
    Repeated rows are counted and scored each. A very long text lies in one block, whose n-grams are in one task's memory.
    n-grams are told apart by 64-bit hashes that are not verified: some 10**10 distinct ones give a few that share a count.
    """
    spark = docs.sparkSession
    tx.small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size, = docs.agg(F.sum(F.octet_length("text"))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // SHARD_BYTES))
    rows = in_blocks(docs, shards)
    told = saved(answers(questions(rows, shards).repartition(shards, "shard")), "counts")
    single = told.filter("grp is null and size = 1").agg(F.sum("distinct"), F.sum("total"), F.sum("kept_total")).first()
    vocabulary, total, kept_total = (x or 0 for x in single)
    told = told.filter("grp is not null").select("shard", "grp", "size", "kept", "whole")
    uniform = 1 / (vocabulary + 1)

    def held(key, texts: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"bucket": [], "two": [], "one": [], "n": []}, dtype=np.int64)
        token, _ = tokens(texts["text"])
        c, context, both = _looked_up(token, answer, "kept")
        cells = np.stack([bucket(context), _bin(both / np.maximum(context, 1)), _bin(c / max(1, kept_total))])
        distinct, n = np.unique(cells, axis=1, return_counts=True)
        return pd.DataFrame({"bucket": distinct[0], "two": distinct[1], "one": distinct[2], "n": n})

    tune = rows.filter(F.col("fold") == TUNE).repartition(shards, "grp").groupBy("grp").cogroup(told.filter("grp % 2 = 1").repartition(shards, "grp").groupBy("grp"))
    histogram = tune.applyInPandas(held, "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    weights = mixture_weights(histogram.toPandas(), uniform)  # as many rows as there are cells

    def scored(key, texts: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        token, ptr = tokens(texts["text"])
        if not len(token):
            return pd.DataFrame({"doc_id": texts["doc_id"], **{c: [] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}})
        c, context, both = _looked_up(token, answer, "whole")
        w = weights[bucket(context)]
        p = w[:, 0] * (both / np.maximum(context, 1)) + w[:, 1] * (c / max(1, total)) + w[:, 2] * uniform
        base = np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, ptr[:-1])  # noqa: E731  each text has a token
        return pd.DataFrame({"doc_id": texts["doc_id"], "held_out": texts["fold"] == TEST, "n_tokens": np.diff(ptr), "n_known": add((c > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(p))})

    out = rows.repartition(shards, "grp").groupBy("grp").cogroup(told.drop("kept").repartition(shards, "grp").groupBy("grp"))
    return out.applyInPandas(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
