"""Best-fit packing of token sequences after Martello and Toth's dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at most `capacity` counts, whatever the
number of documents. The plan is made on those counts (documents of one length are interchangeable); rows then find their
place by their rank among the pieces of their length. What the driver holds and sends is bounded by the capacity alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rillwise.llm import text as tx
from rillwise.store import saved

CAPACITY = 1024
SEPARATOR = 2
#: Byte-pair texts kept by each worker; a full cache starts anew.
CACHED = 250_000


class _Encoder(dict):
    """A chunk's ids as bytes of little-endian unsigned 32-bit numbers. Strings of the file's added tokens have their own ids."""

    def __init__(self, vocabulary: str):
        import tiktoken

        ranks, added = _ranks(vocabulary)
        self.plain = tiktoken.Encoding("byte_bpe", **ranks, special_tokens={}).encode_ordinary
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.apart = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        ids = self[chunk] = np.array(self.plain(chunk), "<u4").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        for found in self.apart.finditer(text):
            out += [self.ordinary(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return b"".join([*out, self.ordinary(text[at:])]) if out else self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        """Where no space is beside white space, pieces of the pattern never cross a space that starts a word."""
        if _BESIDE.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return (self[first] if first else b"") + b"".join([self[" " + x] for x in rest])


_BESIDE = re.compile(r" \s| \Z")


def _ranks(vocabulary: str) -> tuple[dict, dict[str, int]]:
    """Pattern and ranks of a byte-level vocabulary file of the tokenizers library, and its added tokens."""
    import json

    import public_tokenizers

    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in codes)}
    byte = {c: b for b, c in shown.items()}
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    added = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    return {"pat_str": public_tokenizers.PATTERN, "mergeable_ranks": ranks}, added


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, _Encoder] = {}


def encode(texts, vocabulary: str) -> list[bytes]:
    """Ids of each text as bytes; null counts as empty. The same ids as the tokenizers library gives for the file."""
    encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, _Encoder(vocabulary))
    return [encoder(t) if isinstance(t, str) else b"" for t in texts]


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids: each text's ids and the separator, cut into pieces of at most capacity ids.

    Only longer documents are cut: all their pieces but the first are full. ids are little-endian unsigned 32-bit numbers.
    Null and empty texts give the separator alone. Reads doc_id and text; a null doc_id is kept.
    """
    tx.small_batches(docs.sparkSession)
    path, tail = vocabulary or default_vocabulary(), np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, out = batch.iloc[at : at + 500], []
                for doc, ids in zip(part["doc_id"], encode(part["text"], path)):
                    ids += tail
                    n = len(ids) // 4
                    head = n % capacity or capacity
                    for piece, start in enumerate(range(head - capacity, n, capacity)):
                        begin, end = max(start, 0), start + capacity
                        out.append((doc, piece, begin, end - begin, ids[4 * begin : 4 * end]))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": part["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


class _Stock:
    """Counts of lengths, and the least and largest of what is there."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for size, count in counts.items():
            self.n[size] = count

    def largest(self, most: int) -> int:
        there = np.flatnonzero(self.n[1 : most + 1]) if most > 0 else ()
        return int(there[-1]) + 1 if len(there) else 0

    def smallest(self, k: int, above: int = 0) -> list[int]:
        out: list[int] = []
        for size in np.flatnonzero(self.n[above + 1 :])[:k] + above + 1:
            out += [int(size)] * min(k - len(out), int(self.n[size]))
            if len(out) == k:
                break
        return out

    def best_pair(self, most: int) -> tuple[int, int]:
        """The two whose sum is largest without exceeding most, the larger first; (0, 0) if none."""
        sizes = np.flatnonzero(self.n[: most + 1])
        best = (0, 0)
        for x in sizes[::-1]:
            if 2 * x <= sum(best):
                break
            self.n[x] -= 1
            y = self.largest(min(int(x), most - int(x)))
            self.n[x] += 1
            if y and x + y > sum(best):
                best = (int(x), y)
        return best


def dominating(stock: _Stock, size: int, room: int) -> tuple[int, ...] | None:
    """A set holding an item of that size which dominates every other feasible set that holds one; None if not proven.

    stock is what else there is. A set dominates another if the other's items can be parted among its items without any
    part being larger than its item; an optimal packing then exists that uses the set as a bin.
    """
    least = stock.smallest(3)
    if not least or least[0] > room:
        return (size,)
    fit = stock.largest(room)
    if fit == room or sum(least[:2]) > room or len(least) < 2:
        return (size, fit)
    if sum(least) > room or len(least) < 3:  # no more than two others fit
        a, b = stock.best_pair(room)
        if a + b <= fit:
            return (size, fit)
        stock.n[fit] -= 1
        b = stock.largest(room - fit)
        stock.n[fit] += 1
        above = stock.smallest(2, b)
        if b and (len(above) < 2 or sum(above) > room):
            return (size, fit, b)
    return None


Pattern = tuple[int, list[tuple[int, int]]]


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Bins that some optimal packing has, as (how many, [(length, how many in each)]), and the counts that are left."""
    stock, bins = _Stock(counts, capacity), []
    for size in range(capacity, 0, -1):
        while stock.n[size]:
            stock.n[size] -= 1
            found = dominating(stock, size, capacity - size)
            stock.n[size] += 1
            if not found:
                break
            need = defaultdict(int)
            for x in found:
                need[x] += 1
            times = min(int(stock.n[x]) // k for x, k in need.items())
            for x, k in need.items():
                stock.n[x] -= times * k
            bins.append((times, sorted(need.items(), reverse=True)))
    return bins, {int(x): int(stock.n[x]) for x in np.flatnonzero(stock.n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: each item goes to the open bin with the least room that holds it."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        rooms = sorted(r for r in open_ if r >= size and open_[r])
        while left:
            room = rooms[0] if rooms else capacity
            times, items = open_[room].pop() if rooms else (left, [])
            if rooms and not open_[room]:
                rooms.pop(0)
            each = room // size
            full = min(times, left // each)
            rest = min(left - full * each, each - 1) if full < times else 0
            if full:
                open_[room - each * size].append((full, [*items, (size, each)]))
            if rest:
                open_[room - rest * size].append((1, [*items, (size, rest)]))
            if items and times - full - bool(rest):
                open_[room].append((times - full - bool(rest), items))
            left -= full * each + rest
    return [p for group in open_.values() for p in group]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: of those with rank `rank` and on, `each` to a sequence from `sequence` on, at `offset`."""
    fixed, rest = reduce_instance(counts, capacity)
    rank, rows, sequence = defaultdict(int), [], 0
    for times, items in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for size, each in items:
            rows.append((size, rank[size], sequence, each, offset))
            rank[size] += times * each
            offset += each * size
        sequence += times
    return pd.DataFrame(rows, columns=["size", "rank", "sequence", "each", "offset"]).sort_values(["size", "rank"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: as few sequences of at most capacity as the method finds, without gaps.

    pieces must give the same rows whenever it is read (write it first); each length is a whole number from 1 to capacity,
    else an error is raised. Ranks are counted in buckets of rows, so no length meets in one task. An empty table packs into none.
    """
    spark = pieces.sparkSession
    if pieces.filter(F.col(length).isNull() | ~F.col(length).between(1, capacity)).limit(1).count():
        raise ValueError(f"{length} must lie between 1 and {capacity}")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)))
    counts = saved(keyed.groupBy(F.col(length).alias("_size"), "_bucket").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    place = plan(histogram, capacity)
    keys = (place["size"].to_numpy(np.int64) << 44) + place["rank"].to_numpy(np.int64) if len(place) else np.zeros(0, np.int64)
    columns = {c: place[c].to_numpy(np.int64) for c in ("size", "rank", "sequence", "each", "offset")}

    @F.pandas_udf("sequence_id long, offset long")
    def find(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (size << 44) + rank, "right") - 1
        local, each = rank - columns["rank"][at], columns["each"][at]
        return pd.DataFrame({"sequence_id": columns["sequence"][at] + local // each, "offset": columns["offset"][at] + local % each * size})

    before = F.coalesce(F.sum("_n").over(W.partitionBy("_size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_size", F.col("_bucket").alias("_b"), before.alias("_before"))
    own = F.row_number().over(W.partitionBy(length, "_bucket").orderBy(*pieces.columns)) - 1
    ranked = keyed.withColumn("_own", own).join(starts, (F.col(length) == F.col("_size")) & (F.col("_bucket") == F.col("_b")))
    placed = ranked.withColumn("_at", find(F.col(length).cast("long"), (F.col("_own") + F.col("_before")).cast("long")))
    return placed.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed. A very long text costs its own encoding in one task and is cut into many pieces."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs. The ids themselves stay out of the shuffle."""
    pieces = cut_documents(docs, capacity, vocabulary).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(saved(pieces, "pieces"), capacity)
