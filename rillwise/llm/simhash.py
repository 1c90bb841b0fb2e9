"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Fingerprints of 64 bits that differ in at most d bits share at least 8 - d of their 8 positional bytes. Postings of one
positional byte would be as long as the table, so the index is keyed by sets of positions: a family of 4-byte sets such
that any 5 shared bytes hold one of them. Fingerprints that meet under a key have their shared bytes tallied, pairs
with fewer than the guaranteed minimum go, and the rest are verified bit by bit. Equal fingerprints are one entry. Keys
meet by joins: with one fingerprint each first, so that a group of copies gives no pairs, then, under keys of five bytes,
those that are still apart with each other.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rillwise.llm import bitmap, text as tx
from rillwise.operators.graph import connected_components
from rillwise.store import discard, saved

BITS = 3
SHINGLE = 3
SEED = 42


def position_sets(shared: int, size: int, width: int = 8) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any `shared` positions hold one of them (greedy cover)."""
    open_ = set(combinations(range(width), shared))
    chosen = []
    while open_:
        best = max(combinations(range(width), size), key=lambda s: sum(set(s) <= set(x) for x in open_))
        chosen.append(best)
        open_ = {x for x in open_ if not set(best) <= set(x)}
    return chosen


def fingerprint_words(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    if not words:
        return 0
    import xxhash

    joined = [b" ".join(words)] if len(words) < shingle else [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in joined], "<u8")
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    ones = sum(np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), 4096))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a whole text: A-Z in lower case, words parted by ASCII white space."""
    import xxhash

    words = text.lower().split()
    n = len(words) - shingle + 1
    if n <= 0:
        return fingerprint_words(words, shingle)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), "<u8", n)
    return _majority(h)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with fp (long, the fingerprint's bits); text is dropped. A null text counts as empty: its fingerprint is 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in tx.utf8(batch["text"])], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp long")


#: Pivots that an id is compared with in each of the first two turns.
TRIED = 2


def _under(live: DataFrame, to: DataFrame) -> DataFrame:
    """live with the component (id, to) that each id has reached, itself if none, and whether it is still alone."""
    kept = [c for c in live.columns if c not in ("component", "alone")]
    return live.join(to, "id", "left").select(*kept, F.coalesce("to", "id").alias("component"), F.col("to").isNull().alias("alone"))


def linked_components(postings: DataFrame, close: Column, verify: Callable[[DataFrame], DataFrame] | None = None, finer: Callable[[DataFrame], DataFrame] | None = None, links: DataFrame | None = None, last: Column | None = None) -> DataFrame:
    """(node, component) over links between the ids that meet under a key; nodes without a link are not returned.

    links: known ones (u, v), each u once, v the least node that it reaches by them.
    postings: key, id and what `close`, a condition on a posting and another one (whose columns end in 2), reads. verify
    takes saved pairs (u, v) that are close and returns those that are links. Two rounds compare an id with pivots only, one for
    each key, the second with one that the first reached, so that groups of copies become one component; then ids of a key
    that are still in different components meet, under the finer keys or with the further columns that `finer` gives their
    postings, and with the condition `last` in place of `close` if there is one. All of these are joins of written tables, which adaptive execution can split: no task holds a key.
    """
    live = _under(postings.withColumn("component", F.col("id")), links.select(F.col("u").alias("id"), F.col("v").alias("to"))) if links is not None else postings.withColumn("component", F.col("id")).withColumn("alone", F.lit(True))
    own, done = [c for c in live.columns if c not in ("key", "alone")], []
    for turn in range(3):
        if turn == 2 and finer:
            live = finer(live)
            own = [c for c in live.columns if c not in ("key", "alone")]
        mixed = saved(live.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key"), "keys")
        live = saved(live.join(mixed, "key"), "postings")
        discard(mixed, *done)
        if turn < 2:
            nth = F.xxhash64("id") if turn == 0 else F.bitwise_not(F.xxhash64("id"))
            one = F.min(F.struct("alone", nth.alias("nth"), *own)).alias("one")
            other = saved(live.groupBy("key").agg(one).select("key", F.col("one.nth").alias("nth2"), *(F.col(f"one.{c}").alias(f"{c}2") for c in own)), "pivots")
        else:
            other = live.select("key", *(F.col(c).alias(f"{c}2") for c in own))
        met = live.join(other, "key").filter(F.col("component") != F.col("component2")).filter(last if turn == 2 and last is not None else close)
        if turn < 2:
            # a group's pivots are mostly few: each id tries the first of them now, and the others only if it is still apart from them
            met = met.groupBy("id", "id2", "nth2").agg(F.lit(1).alias("one")).withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("nth2", "id2"))).filter(F.col("n") <= TRIED)
        else:
            met = met.filter("id < id2")
        pairs = saved(met.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct(), "pairs")
        found = verify(pairs) if verify else pairs
        links = saved(links.unionByName(found) if links is not None else found, "similar")
        labels = saved(connected_components(links), "labels")
        discard(pairs, other, links)
        done = [live]  # until the next turn's postings are written
        # what was reached stays linked by its component
        links = labels.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        if turn < 2:
            live = _under(live, labels.select(F.col("node").alias("id"), F.col("component").alias("to")))
    return labels


def positional_index(prints: DataFrame, bits: int = BITS) -> tuple[DataFrame, Column, Callable[[DataFrame], DataFrame]]:
    """Postings of prints (id, fp and further columns) under their bytes, when two of them are close (count filter and bits), and their finer keys."""
    shared = 8 - bits
    if shared < 1:
        raise ValueError("bytes guarantee no match for so many bits")
    sets = position_sets(shared, min(4, shared))
    byte = lambda x, p: F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255))

    def key(part: int, positions: tuple[int, ...]) -> Column:
        out = F.lit(part).cast("long")
        for p in positions:
            out = F.shiftleft(out, 8).bitwiseOR(byte(F.col("fp"), p))
        return out

    postings = prints.select(*prints.columns, F.explode(F.array(*[key(i, s) for i, s in enumerate(sets)])).alias("key"))
    # tally of the bytes that two share; fewer than guaranteed can't be near, the others are verified bit by bit
    tally = sum(((byte(F.col("fp"), p) == byte(F.col("fp2"), p)).cast("int") for p in range(8)), F.lit(0))
    close = (tally >= shared) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= bits)

    def finer(live: DataFrame) -> DataFrame:
        """Each posting under one more byte of those that its key leaves open: near ones share `shared` bytes, more than the key has."""
        width = len(sets[0])
        if shared <= width:
            return live
        part = F.shiftright("key", 8 * width)
        more = F.array(*[F.struct(F.lit(p).alias("at"), byte(F.col("fp"), p).alias("byte")) for p in range(8)])
        fixed = F.element_at(F.array(*[F.array(*[F.lit(p) for p in s]) for s in sets]), part.cast("int") + 1)
        rest = live.withColumn("fixed", fixed).withColumn("more", F.explode(more)).filter(~F.array_contains("fixed", F.col("more.at")))
        return rest.withColumn("key", F.shiftleft(F.shiftleft("key", 3).bitwiseOR(F.col("more.at").cast("long")), 8).bitwiseOR(F.col("more.byte"))).drop("fixed", "more")

    return postings, close, finer


def fingerprint_components(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, component) of the distinct fingerprints in column fp, over all pairs within bits; only those with a link."""
    postings, close, finer = positional_index(fps.select(F.col("fp").alias("id"), "fp"), bits)
    return linked_components(postings, close, finer=finer)


def near_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that a document reaches over links of at most `bits` differing bits.

    One row for each row of docs, of which only doc_id and text are read. Null and empty texts have fingerprint 0 and are
    linked by it. Rows without a doc_id are linked too but name no component unless all of theirs have none (then null).
    """
    tx.small_batches(docs.sparkSession)
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    fps = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = fingerprint_components(fps, bits)
    whole = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    to = whole.join(least, "component").select("fp", "component_id")
    return prints.join(to, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component. A very long text costs one hash a word in one task, and 8 bytes after it."""
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates by similarity: words of a shingle, and the Jaccard similarity of shingle sets that links.
WORDS = 5
SIMILARITY = 0.8
#: One document of so many is counted to find common shingles, which are common if so many of those hold them; at most so many are sent to the tasks.
SAMPLED, COMMON, SENT = 16, 8, 100_000
#: Shared keys up to which a bitmap of them is made: an eighth of its bits.
MARKED = bitmap.SLOTS // 8


def shingle_sets(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text the set (sorted hashes) of its runs of five words; a text of fewer words is one shingle, one without words none."""
    for part in tx.chunks(raw):
        words = tx.Words([t.lower() for t in raw[part]])
        h = words.hashes()
        g = tx.grams(h, WORDS)
        for a, b in zip(words.ptr[:-1], words.ptr[1:]):
            yield np.unique(g[a : b - WORDS + 1]) if b - a >= WORDS else tx.grams(h[a:b], b - a) if b > a else h[:0]


def _common_shingles(docs: DataFrame) -> np.ndarray:
    """Common shingles, the most common last. They only order the sets: what is linked does not depend on them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in shingle_sets(tx.utf8(batch["text"])):
                yield pd.DataFrame({"g": s.view(np.int64)})

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    counted = sample.mapInPandas(run, "g long").groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    rows = counted.orderBy(F.desc("n"), "g").limit(SENT).collect()
    return np.array([r["g"] for r in rows][::-1], np.int64).view(np.uint64)


#: Most bits of a set's parity bitmap.
PARITY = 1 << 15


def _parity(shingles: np.ndarray) -> bytes:
    """Of each number modulo the width, whether an odd number of shingles has it; twice as wide as the set is large, at least 1,024."""
    width = min(PARITY, max(1024, 1 << (2 * len(shingles)).bit_length()))
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % width, minlength=width) % 2
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


#: Numbers of 64 bits that a set's short parity bitmap has.
SHORT = 4


def _short_parity(shingles: np.ndarray) -> np.ndarray:
    """As _parity, always 64 * SHORT bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * SHORT), minlength=64 * SHORT) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _differing(one: pd.Series, other: pd.Series) -> pd.Series:
    """Bits in which two parity bitmaps differ, the wider folded to the other's width: no more than the shingles that only one of the sets has."""
    out = []
    for a, b in zip(one, other):
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        while len(x) != len(y):
            x, y = (x, y) if len(x) > len(y) else (y, x)
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)))
    return pd.Series(out, dtype="int64")


def _overlap(n: Column, n2: Column, similarity: float) -> Column:
    """Shingles that sets of these sizes share at least if they are that similar."""
    return F.ceil(similarity / (1 + similarity) * (n + n2) - 1e-9)


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, most_marked: int = MARKED) -> DataFrame:
    """doc_id, component_id: the least doc_id that a document reaches over pairs whose five-word shingles are that similar.

    Exact: every link is verified by Jaccard similarity, and no similar pair of two components is left out. SimHash first:
    the sets' fingerprints meet in the inverted index of byte positions, those within BITS bits are tried and make components.
    Similar sets may differ in more bits, so what is still apart meets again, by shingles: sets are put in one order, common shingles last; similar sets share one of their first n - ceil(similarity * n) + 1 shingles, the keys.
    A first pass counts keys; a bounded bitmap of those that several documents hold goes to a second, which lets only
    them become postings. Pairs that meet are tried by size and place, then by parity bitmaps, and last by the sets, which
    only documents of such pairs send. doc_id names one text: see drop_near_copies for tables where it doesn't. Rows without
    a doc_id and texts without words are left out: they are no copies. With more than most_marked shared keys no bitmap is made.
    A very long text costs a key for each fifth of its words.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    tx.small_batches(spark)
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    last = _common_shingles(known)
    by = np.argsort(last)
    order = spark.sparkContext.broadcast((last[by], by))

    def keys_of(s: np.ndarray) -> np.ndarray:
        common, rank = order.value
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            s = s[np.argsort(np.where(common[at] == s, rank[at] + 1, 0), kind="stable")]
        return s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1] if len(s) else s

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in np.array_split(batch["text"].to_numpy(), max(1, -(-len(batch) // 500))):
                yield pd.DataFrame({"key": np.concatenate([keys_of(s) for s in shingle_sets(tx.utf8(part))] + [np.zeros(0, np.uint64)]).view(np.int64)})

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingle_sets(tx.utf8(batch["text"])))
            yield pd.DataFrame({"id": batch["doc_id"], "n": np.array([len(s) for s in sets], np.int32), "fp": np.array([_majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64), "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "parity": [_parity(s) for s in sets], **{f"p{i}": x for i, x in enumerate(np.array([_short_parity(s) for s in sets]).reshape(-1, SHORT).T)}})

    several = saved(known.mapInPandas(counted, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    # a bitmap that most keys would pass is of no use: then all keys become postings, and a join finds the shared ones
    sparse = several.count() <= most_marked
    bits = spark.sparkContext.broadcast(bitmap.collected(several, "key") if sparse else None)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for rows in np.array_split(np.arange(len(batch)), max(1, -(-len(batch) // 500))):
                who, n, at, key = [], [], [], []
                for i, s in zip(rows, shingle_sets(tx.utf8(batch["text"].iloc[rows]))):
                    own = keys_of(s)
                    met = np.flatnonzero(bitmap.holds(bits.value, own)) if bits.value is not None else np.arange(len(own))
                    who.append(np.full(len(met), i)), n.append(np.full(len(met), len(s), np.int32)), at.append(met.astype(np.int32)), key.append(own[met].view(np.int64))
                if who:
                    yield pd.DataFrame({"key": np.concatenate(key), "id": ids[np.concatenate(who)], "n": np.concatenate(n), "at": np.concatenate(at)})

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "grams": [s.view(np.int64) for s in shingle_sets(tx.utf8(batch["text"]))]})

    entries = saved(known.mapInPandas(described, f"id {kind}, n int, fp long, digest binary, parity binary, {', '.join(f'p{i} long' for i in range(SHORT))}").filter("n > 0"), "described")
    first = saved(entries.groupBy("digest").agg(F.min("id").alias("first")), "distinct-sets")
    same = saved(entries.select("id", "digest").join(first, "digest").filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")), "same-sets")
    # sets that are equal meet once, as the first of them
    postings = known.mapInPandas(posted, f"key long, id {kind}, n int, at int")
    postings = (postings if sparse else postings.join(several, "key", "left_semi")).join(same.select(F.col("u").alias("id")), "id", "left_anti")

    def verify(pairs: DataFrame) -> DataFrame:
        u, v = (entries.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "uv")
        n = F.col("n_u") + F.col("n_v")
        met = pairs.join(u, "u").join(v, "v").withColumn("differ", F.pandas_udf(_differing, "long")("parity_u", "parity_v"))
        near = saved(met.filter(F.col("differ") <= n - 2 * _overlap(F.col("n_u"), F.col("n_v"), similarity)).select("u", "v"), "near-pairs")
        ids = saved(near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))).distinct(), "asked-sets")
        sets = saved(bitmap.may_hold(known, F.col("doc_id"), ids, "id").mapInPandas(grams, f"id {kind}, grams array<long>"), "sets")
        both = F.size(F.array_intersect("a", "b"))
        met = near.join(sets.select(F.col("id").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("grams").alias("b")), "v")
        found = saved(met.filter(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("u", "v"), "verified")
        discard(near, ids, sets)
        return found

    # at the first shingle that two sets share, what follows in both must hold the overlap that the similarity asks for
    close = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= _overlap(F.col("n"), F.col("n2"), similarity)
    # the rest meets in pairs, of which short bitmaps rule most out before they are formed
    shorts = entries.select("id", *[f"p{i}" for i in range(SHORT)])
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}2"))) for i in range(SHORT)), F.lit(0))
    may = differ <= F.col("n") + F.col("n2") - 2 * _overlap(F.col("n"), F.col("n2"), similarity)
    prints, near, finer = positional_index(entries.select("id", "fp", "n").join(same.select(F.col("u").alias("id")), "id", "left_anti"))
    near = near & (F.least("n", "n2") >= _overlap(F.col("n"), F.col("n2"), similarity))
    labels = linked_components(prints, near, verify, finer=lambda live: finer(live.join(shorts, "id")), links=same, last=near & may)
    reached = saved(labels.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")), "by-bits")
    gc.collect()
    labels = linked_components(postings, close, verify, finer=lambda live: live.join(shorts, "id"), links=reached, last=close & may)
    bits.destroy(), order.destroy()
    gc.collect()  # Python lets go of the plans of all rounds, and so does the JVM
    return labels.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs but for those whose near-duplicate group has a smaller doc_id; all columns stay.

    One row of each group stays, that of the least doc_id; documents without near-duplicates all stay, and so do rows without
    a doc_id. Where a doc_id comes more than once, rows are judged each by its own text: of equal doc_ids in a group one stays.
    """
    known = docs.filter("doc_id is not null")
    if known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        gone = similar_components(docs, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias("_doc_id"))
        return docs.join(gone, F.col("doc_id") == F.col("_doc_id"), "left_anti")
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = saved(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "numbered")
    own = F.col(names[docs.columns.index("doc_id")])
    rows = numbered.filter(own.isNotNull()).select(F.col("row").alias("doc_id"), F.col(names[docs.columns.index("text")]).alias("text"))
    groups = similar_components(rows, similarity).select(F.col("doc_id").alias("row"), "component_id")
    placed = saved(groups.join(numbered.select("row", own.alias("own")), "row"), "groups")
    stays = placed.groupBy("component_id").agg(F.min(F.struct("own", "row")).alias("first"))
    gone = placed.join(stays, "component_id").filter("row <> first.row").select("row")
    return numbered.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)
