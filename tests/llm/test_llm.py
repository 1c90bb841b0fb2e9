"""Pipeline operators against brute force on small tables, and their edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwise.llm import decontamination as dc
from rillwise.llm import exact_dedup as ed
from rillwise.llm import license_scan as ls
from rillwise.llm import lm_score as lm
from rillwise.llm import packing as pk
from rillwise.llm import quality as ql
from rillwise.llm import secret_scan as ss
from rillwise.llm import simhash as sh
from rillwise.llm import substring_dedup as sd
from rillwise.llm import text as tx
from rillwise.llm import toxicity as ty

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, row string, digest string, kept string, length string"
WORDS = [f"w{i}" for i in range(400)]


def long_text(n: int, seed: int = 0) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z", "d", "k", "l") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, white space, repeated rows, equal texts, a null doc_id, a very long text."""
    long = long_text(40_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "a"), (None, "b c"), (6, long), (7, long), (8, long_text(300, 1)), (9, "é\x85x\xa0y\x1cz É"), (10, "b c")]
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)


def table(df):
    return df.toPandas().sort_values("doc_id", ignore_index=True)


EMPTY = [
    lambda d: pk.packed_documents(d), lambda d: sd.without_repeats(d), lambda d: ed.exact_dedup(d), lambda d: lm.lm_scores(d), lambda d: sh.near_components(d),
    lambda d: ls.license_blocks(d), lambda d: ql.quality(d), lambda d: sh.drop_near_copies(d), lambda d: ed.drop_copies(d),
]


@pytest.mark.parametrize("run", EMPTY)
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


# packing


def exact_bins(items, cap):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(150):
        items = rng.integers(1, 21, rng.integers(0, 9)).tolist()
        fixed, rest = pk.reduce_instance(collections.Counter(items), 20)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + exact_bins(left, 20) == exact_bins(items, 20)
        packed = collections.Counter()
        for times, parts in [*fixed, *pk.best_fit(rest, 20)]:
            assert sum(a * b for a, b in parts) <= 20
            for a, b in parts:
                packed[a] += times * b
        assert packed == collections.Counter(items)


def test_encoding_is_the_librarys():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pk.default_vocabulary())
    for x in ["x<|endoftext|>y <|endoftext|><|endoftext|>", "<|endoftext|", "a  b", " lead", "trail ", "x\n\n y", "foo\n bar", " ", "\n", "a \nb", "", "it's \t tab\xa0nb   em　x", "<|endoftext|> hi", "ÀÉ ß 12 a1b2 ...", "a\n \n b"]:
        assert np.frombuffer(pk.encode([x], pk.default_vocabulary())[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def check_packing(got):
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert (ends - got["length"] == got["offset"]).all() and ends.max() <= 1024
    return got["sequence_id"].nunique(), math.ceil(got["length"].sum() / 1024)


def test_packing_round_trip(spark, docs):
    got = pk.op1_best_fit_packing(spark, SF).toPandas()
    n, least = check_packing(got)
    assert n <= least + 2
    for doc, text in zip(docs["doc_id"], docs["text"]):
        ids = np.frombuffer(pk.encode([text], pk.default_vocabulary())[0] + b"\2\0\0\0", "<u4")
        own = got[got["doc_id"] == doc].sort_values("piece")
        assert own["length"].sum() == len(ids) and (len(ids) > 1024 or len(own) == 1) and (own["length"][1:] == 1024).all()
        assert all(zlib.crc32(ids[a : a + k].tobytes()) == c for a, k, c in zip(own["start"], own["length"], own["ids_crc32"]))


def test_packing_odd_rows(spark, odd):
    got = pk.packed_documents(odd).toPandas()
    check_packing(got)
    assert set(got["doc_id"].dropna()) == set(range(1, 11)) and got["doc_id"].isna().sum() == 1
    assert got[got["doc_id"] == 1]["length"].tolist() == [1]
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([(1, 1025)], "doc_id long, length long"))


# substring deduplication


def brute_repeats(rows, k=50):
    first, out = {}, []
    for doc, text in sorted(rows):
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            if first.setdefault(tuple(w[i : i + k]), doc) < doc:
                gone[i : i + k] = True
        out.append((doc, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    shared = [long_text(n, 100 + n).split() for n in (49, 50, 51, 60, 120, 300)]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(rng.integers(0, 5)):
            s = shared[rng.integers(len(shared))]
            cut = rng.integers(0, 30)
            parts += [s[cut:], rng.choice(WORDS, rng.integers(0, 40)).tolist(), s[: len(s) - cut]]
        rows.append((doc, " ".join(x for p in parts for x in p)))
    rows.append((60, "x " * 200))
    got = table(sd.without_repeats(frame(spark, rows).repartition(5)))
    want = brute_repeats(rows)
    assert list(got[["doc_id", "n_words", "n_removed", "kept"]].itertuples(index=False, name=None)) == want
    assert got["n_removed"].sum() > 1000


def test_substrings_on_documents(spark, docs):
    got = table(sd.op2_substring_dedup(spark, SF))
    want = [(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute_repeats(zip(docs["doc_id"], docs["text"]))]
    assert list(got[["doc_id", "n_words", "n_removed", "kept_sha256"]].itertuples(index=False, name=None)) == want


def test_substrings_of_texts_under_one_doc_id(spark):
    a, filler, other = long_text(100, 41), long_text(60, 42), long_text(400, 43)
    rows = [(1, a), (2, f"{filler} {a}"), (2, other), (3, other), (3, other), (None, a)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in sd.without_repeats(frame(spark, rows)).collect()}
    assert got == {(1, 100): 0, (2, 160): 100, (2, 400): 0, (3, 400): 400, (None, 100): 0}


def test_substrings_odd_rows(spark, odd):
    got = sd.without_repeats(odd).toPandas().set_index("doc_id")
    assert len(got) == 12 and got.loc[7, "n_removed"] == 40_000 and got.loc[6, "n_removed"] == 0
    assert got.loc[1, "n_words"] == got.loc[3, "n_words"] == 0 and got.loc[9, "n_words"] == 2


THUE = "a"
for _ in range(10):
    THUE += THUE.translate(str.maketrans("ab", "ba"))
EUHT = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_cheat_polynomial_hashes(spark):
    """Thue-Morse words and their complements collide under any polynomial modulo 2 ** 64."""
    assert len(set(tx.Words([f"{THUE} {EUHT} {THUE[:64]} {EUHT[:64]}".encode()]).hashes())) == 4
    filler = long_text(49, 77)
    got = table(sd.without_repeats(frame(spark, [(1, f"{filler} {THUE}"), (2, f"{filler} {EUHT}")])))
    assert got["n_removed"].tolist() == [0, 0]
    train, test = (next(d for d in range(100) if (zlib.crc32(str(d).encode()) % 10 == 0) == held) for held in (False, True))
    got = table(lm.lm_scores(frame(spark, [(train, f"x {THUE}"), (test, f"x {EUHT}")]))).set_index("doc_id")
    assert got.loc[test, "n_known"] == 2 and got.loc[train, "n_known"] == 3
    got = ls.license_blocks(frame(spark, [(1, EUHT)]), {THUE: "thue"}, {})
    assert got.first()["places"] == []


def test_hashes_are_of_the_words_alone():
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"y" * 300]
    together = tx.Words([b" ".join(words)]).hashes()
    assert together.tolist() == [int(tx.Words([b"  " + w]).hashes()[0]) for w in words] and len(set(together)) == len(words)
    assert tx.Words([b"abcdefghijkl"]).hashes(4)[0] == tx.Words([b"abcd"]).hashes()[0]
    one = tx.mix(np.arange(1, 60, dtype=np.uint64))
    for n in (1, 2, 3, 5, 18, 50):
        g = tx.grams(np.r_[one, one], n)
        assert len(g) == len(one) * 2 - n + 1 and g[0] == g[len(one)] and len(set(g)) == len(one)


def test_bitmap_lets_all_members_through(spark):
    from rillwise.llm import bitmap

    keys = spark.range(500).select((F.col("id") * 7).cast("string").alias("k"))
    rows = spark.range(5000).select(F.col("id").cast("string").alias("r"))
    got = {int(r["r"]) for r in bitmap.may_hold(rows, F.col("r"), keys, "k").collect()}
    assert set(range(0, 3500, 7)) <= got and len(got) < 510
    assert bitmap.may_hold(rows, F.col("r"), keys.limit(0), "k").count() == 0
    hashed = keys.select(F.xxhash64("k").alias("h"))
    bits, own = bitmap.collected(hashed, "h"), np.array([r["h"] for r in hashed.collect()]).view(np.uint64)
    assert bitmap.holds(bits, own).all() and bitmap.holds(bits, tx.mix(own)).sum() < 10


# exact deduplication


def test_exact_copies(spark, docs):
    got = table(ed.op3_exact_dedup(spark, SF))
    last = docs.groupby("text")["doc_id"].max()
    assert (got["keep_id"] == docs["text"].map(last)).all() and (got["kept"] == (got["keep_id"] == got["doc_id"])).all()
    assert (got["group_size"] == docs.groupby("text")["doc_id"].transform("size")).all()


def test_exact_copies_odd_rows(spark, odd):
    got = ed.exact_dedup(odd).toPandas()
    assert len(got) == 12 and got["kept"].sum() == 7
    a = got[got["text_sha256"] == hashlib.sha256(b"a").hexdigest()]
    assert a["group_size"].tolist() == [3] * 3 and a[a["kept"]]["doc_id"].tolist() == [5]
    left = ed.drop_copies(odd.unionByName(frame(spark, [(20, "twice"), (20, "twice")])))
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 7, 8, 9, 10, 20]


def test_state_goes_on(spark, tmp_path):
    """A second run of the stream reads only what is new and adds to the state."""
    source, state, updates = (str(tmp_path / x) for x in ("in", "state", "updates"))
    schema = "digest string, doc_id long, row_tag long, locator string"
    stream = spark.readStream.schema(schema).parquet
    spark.createDataFrame([("x", 1, 1, ""), ("y", 2, 2, "")], schema).coalesce(1).write.mode("append").parquet(source)
    ed.digest_state(stream(source), state, updates)
    spark.createDataFrame([("x", 7, 1, "")], schema).coalesce(1).write.mode("append").parquet(source)
    got = {r["digest"]: (r["group_size"], r["keep"]["doc_id"]) for r in ed.digest_state(stream(source), state, updates).collect()}
    assert got == {"x": (2, 7), "y": (1, 2)}


# decontamination


def test_alignment():
    a = np.arange(10, 30, dtype=np.uint64)
    assert dc.smith_waterman(a, a) == 1 and dc.smith_waterman(a, np.r_[a[:10], a[11:]]) == pytest.approx(0.92)
    assert dc.smith_waterman(a, a + np.uint64(1000)) == 0 and dc.smith_waterman(a[:0], a) == 0

    def slow(x, y):
        h = np.zeros((len(x) + 1, len(y) + 1))
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = max(0, h[i, j] + (dc.MATCH if x[i] == y[j] else dc.MISMATCH), h[i, j + 1] + dc.GAP, h[i + 1, j] + dc.GAP)
        return h.max() / len(x)

    rng = np.random.default_rng(1)
    for _ in range(60):
        x, y = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        assert dc.smith_waterman(x, y) == pytest.approx(slow(x, y))


def test_leaks(spark):
    item = [f"i{k}" for k in range(60)]
    edited = [w if k % 7 else "other" for k, w in enumerate(item)]
    rows = [(1, long_text(200, 1) + " " + " ".join(item) + ". " + long_text(50, 2)), (2, " ".join(edited).upper()), (3, long_text(3000, 3)), (4, None), (5, ""), (6, " ".join(item[:8]) + long_text(300, 4))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (None, "x")], "item_id long, text string")
    got = dc.contaminated(frame(spark, rows), bench).toPandas().set_index("doc_id")
    assert set(got.index) == {1, 2} and got.loc[1, "score"] == 1 and 0.5 < got.loc[2, "score"] < 0.9 and set(got["item_id"]) == {7}
    left = dc.drop_contaminated(frame(spark, rows), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6] and left.columns == frame(spark, []).columns
    assert dc.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_often_copied_item_keeps_its_seeds(spark):
    item = " ".join(f"i{k}" for k in range(40))
    rows = [(k, item if k < 150 else long_text(80, k)) for k in range(160)]
    assert dc.contaminated(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 150


def test_quoted_in_part_beside_a_whole_copy(spark):
    item = [f"i{k}" for k in range(40)]
    texts = [" ".join(item)] + [" ".join(item[:28]) + f" {long_text(30, k)}" for k in range(100)] + [" ".join(item[:9]) + f" {long_text(30, k)}" for k in range(100, 110)]
    got = dc.contaminated(frame(spark, list(enumerate(texts))), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).toPandas().set_index("doc_id")
    assert sorted(got.index) == list(range(101)) and got.loc[0, "score"] == 1 and (got.loc[1:, "score"] == 0.7).all()
    assert got.loc[0, "seeds"] == 12 and (got.loc[1:, "seeds"] == 0).all()


def whole_text_scores(texts, items, threshold=dc.THRESHOLD):
    """Smith-Waterman of every document that shares a 5-gram (or a whole shorter item) with an item, over its whole text, cell by cell."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for doc, text in texts.items():
        w = split(text)
        for item, asked in items.items():
            q = split(asked)
            n = min(dc.GRAM, len(q))
            if not n or not {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
                continue
            at = {x: [j for j, y in enumerate(w) if y == x] for x in set(q)}
            row, best = np.zeros(len(w) + 1), 0.0
            for x in q:
                gain = np.full(len(w), dc.MISMATCH)
                gain[at[x]] = dc.MATCH
                now = [0.0]
                for d, up, g in zip(row[:-1].tolist(), row[1:].tolist(), gain.tolist()):
                    now.append(max(0.0, d + g, up + dc.GAP, now[-1] + dc.GAP))
                row = np.array(now)
                best = max(best, row.max())
            if best / len(q) >= threshold - 1e-9:
                out[doc, item] = round(best / len(q), 6)
    return out


def test_leaks_against_whole_texts(spark):
    """Edited copies: words put in, left out and changed, up to one in two, in long texts and short ones."""
    rng = np.random.default_rng(11)
    items = {i: " ".join(f"q{i}x{k % 37}" for k in range(int(rng.integers(3, 60)))) for i in range(12)}
    items[12] = items[3]
    texts = {}
    for doc in range(400):
        copied = items[int(rng.integers(12))].split()
        out, rate = [], rng.random() * 0.5
        for k, w in enumerate(copied):
            r = rng.random()
            out += [w] if r > rate or 4 < k < 10 else [f"z{rng.integers(9)}", w][int(rng.integers(2)) :] * int(rng.integers(3))
        texts[doc] = " ".join([long_text(int(rng.integers(0, 30)), doc), *out, long_text(int(rng.integers(0, 60)), 999 - doc)])
    spread = " ".join(w if k == 0 or k % 5 else f"{w} filler" for k, w in enumerate(items[0].split()))
    texts[400], texts[401] = spread, " ".join(x for w in items[1].split()[:5] + items[1].split() for x in (w, "filler")) + " " + " ".join(items[1].split()[:5])
    got = dc.contaminated(frame(spark, list(texts.items())), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in got.collect()}
    want = whole_text_scores(texts, items)
    assert got == want and len(want) > 200


def test_leaks_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, benchmark = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    short = docs[docs["text"].str.len() < 6000]
    want = whole_text_scores(dict(zip(short["doc_id"], short["text"])), dict(zip(benchmark["item_id"], benchmark["text"])))
    best = {}
    for (doc, item), score in want.items():
        best[doc] = max(best.get(doc, (0, 0)), (float(score), -item))
    got = dc.op4_benchmark_decontamination(spark, sf).toPandas()
    got = got[got["doc_id"].isin(short["doc_id"])]
    assert {d: (s, -i) for d, s, i in zip(got["doc_id"], got["score"], got["item_id"])} == best and len(best) > 10


def test_leaks_odd_rows(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert dc.contaminated(odd, bench).count() == 0 and dc.contaminated(frame(spark, []), bench).count() == 0
    assert dc.drop_contaminated(frame(spark, []), bench).count() == 0
    item = " ".join(f"i{k}" for k in range(30))
    rows = frame(spark, [(1, item), (1, "another text"), (None, item), (2, item), (2, item)])
    own = spark.createDataFrame([(5, item), (4, item), (4, item)], "item_id long, text string")
    assert [r["text"] for r in dc.drop_contaminated(rows, own).collect()] == ["another text"]
    assert dc.contaminated(rows, own).count() == 4 * 3
    named = spark.createDataFrame([("d", item)], "doc_id string, text string")
    found = dc.contaminated(named, spark.createDataFrame([("b", item), ("a", item)], "item_id string, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {("d", "a"), ("d", "b")}


# toxicity


def brute_terms(text):
    """Counts of the words and of their beginnings, each word once for every length."""
    out = collections.Counter()
    for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.encode().lower()):
        out[w] += 1
        for n in ty.STARTS:
            out[(w[:n], n) if len(w) > n else w] += 1
    return out


def test_scores_by_hand(spark):
    """Scores and evidence of all documents from plain dictionaries: every term of every example, every cosine, no index."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    index = ty.fit(documents, ty.training_labels(labels))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    known = {r["doc_id"]: r["toxic"] for r in ty.training_labels(labels).collect()}
    n1, n0 = sum(known.values()), len(known) - sum(known.values())
    held = {0: collections.Counter(), 1: collections.Counter()}
    for d, y in known.items():
        held[y].update(brute_terms(texts[d]).keys())
    value = {t: float(ty.term_values(np.array([held[1][t]]), np.array([held[0][t]]), n1, n0)[0]) for t in held[0] | held[1]}

    def vector(text):
        v = {t: (1 + math.log(c)) * value[t] for t, c in brute_terms(text).items() if t in value}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    examples = {d: vector(texts[d]) for d in index.ids.tolist()}
    assert set(examples) == set(known)
    for row in ty.score(documents, index).collect():
        own = vector(texts[row["doc_id"]])
        cosine = {d: sum(x * v[t] for t, x in own.items() if t in v) for d, v in examples.items()}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[: ty.NEAREST]
        got = [(e["doc_id"], e["cosine"]) for e in row["evidence"]]
        assert [c for _, c in got] == pytest.approx(best, abs=1e-9) and all(c == pytest.approx(cosine[d], abs=1e-9) for d, c in got)
        w = [c * c for _, c in got]
        vote = sum(x * known[d] for x, (d, _) in zip(w, got)) / sum(w) if w else -1
        assert row["score"] == pytest.approx(float(np.interp(vote, *index.steps)), abs=1e-6)


def test_block_max_search_is_exact(spark, docs):
    documents, labels = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    index = ty.fit(documents, ty.training_labels(labels))
    assert len(index.label) > 2 * ty.BLOCK
    for term, weight in index.vectors(tx.lower(docs["text"])):
        who, cosine = index.nearest(term, weight, 5)
        dense = np.zeros(len(index.label))
        for t, w in zip(term, weight):
            a, b = index.postings[index.cells[t]], index.postings[index.cells[t + 1]]
            np.add.at(dense, index.example[a:b], w * index.weight[a:b])
        order = np.lexsort((np.arange(len(dense)), -np.round(dense, 12)))[:5]
        assert who.tolist() == [int(i) for i in order if dense[i] > 0] and (cosine <= 1 + 1e-9).all()
    toxic = ["stupid worthless idiot moron", None, "", "x", "the of and"]
    got = ty.score(frame(spark, list(enumerate(toxic))), index).toPandas()
    assert got["score"].between(0, 1).all() and (got["score"][1:] < 0.7).all()


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (5, 1, 1), (6, 1, 0), (None, 1, 1), (8, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = ty.score(odd, ty.fit(odd, labels)).toPandas()
    assert len(got) == 12 and got["score"].between(0, 1).all()
    assert ty.score(frame(spark, []), ty.fit(odd, labels)).count() == 0 and ty.fit(frame(spark, []), labels).label.size == 0
    chosen = {r["doc_id"]: r["toxic"] for r in ty.choose_examples(odd, labels).collect()}
    assert chosen == {1: 1, 5: 1, 6: 0}
    named = spark.createDataFrame([("a", "bad bad"), ("b", "good words")], "doc_id string, text string")
    own = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, toxic int")
    assert ty.score(named, ty.fit(named, own)).count() == 2


def test_toxic_namesakes(spark):
    """A toxic text goes, another of the same doc_id stays."""
    documents, labels = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    index = ty.fit(documents, ty.training_labels(labels))
    worst = ty.score(documents, index).orderBy(F.desc("score")).first()
    text = documents.filter(F.col("doc_id") == worst["doc_id"]).first()["text"]
    extra = spark.createDataFrame([(-1, text), (-1, "plain words of the day"), (-1, None)], "doc_id long, text string")
    left = ty.drop_toxic(documents.select("doc_id", "text").unionByName(extra), labels).filter("doc_id = -1").collect()
    assert worst["score"] >= 0.7 and sorted(r["text"] or "" for r in left) == ["", "plain words of the day"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = ty.op5_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    hit = held[held["toxic"] == 1]["predicted"].mean()
    false = held[held["toxic"] == 0]["predicted"].mean()
    assert hit > 0.8 and false < 0.01


def test_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = ty.drop_toxic(frame(spark, [(1, "a b"), (2, None)]), labels)
    assert got.count() == 2


# secrets


def test_secrets(spark, odd):
    text = 'é password = "abcdefghijkl" x API_KEY:short token=secret=AAAAAAAAAAAA AKIA' + "A" * 14 + " AKIAB 0123456789abcdef0 0123 -----BEGIN RSA PRIVATE KEY-----"
    spans = ss.find_spans(text, ss.RULES)
    base = [(k, text[a:b]) for k, a, b in spans if k in ("assign", "access", "hex")]
    assert ("assign", 'password = "abcdefghijkl') in base and ("assign", "token=secret=AAAAAAAAAAAA") in base and ("access", "AKIA" + "A" * 14) in base and ("hex", "0123456789abcdef0") in base and len(base) == 4
    assert any(k == "private_key" for k, _, _ in spans)
    found = ss.findings_by_path(odd, ss.scan(odd, ss.scratch(spark, "ledger")), ["doc_id"])
    assert found.count() == 12


def test_ledger_scans_only_what_is_new(spark):
    ledger = ss.scratch(spark, "ledger")
    one = frame(spark, [(1, "token=abcdefghijklmnop"), (2, "token=abcdefghijklmnop"), (3, "b")])
    assert ss.scan(one, ledger, ss.BASE).count() == 1
    seen = lambda: spark.read.parquet(f"{ledger}/seen").count()
    assert seen() == 2 * 3
    two = one.unionByName(frame(spark, [(4, "secret: zzzzzzzzzzzzzz")]))
    assert ss.scan(two, ledger, ss.BASE).count() == 2 and seen() == 3 * 3
    ss.scan(two, ledger, ss.BASE)
    assert seen() == 9
    ss.scan(two, ledger, ss.RULES)
    assert seen() == 3 * len(ss.RULES)


def test_secrets_on_documents(spark, docs):
    got = table(ss.op6_secret_scan(spark, SF))
    patterns = [(r.kind, re.compile(r.pattern, re.I | re.A if r.ignore_case else 0), r.group, r.least) for r in ss.BASE]
    for row, text in zip(got.itertuples(), docs["text"]):
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(patterns) for m in p.finditer(text) if len(m[g]) >= least)
        assert row.base_sha256 == hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()


def test_added_spans_against_plain_patterns(spark, docs):
    """Every rule by itself, without hints."""
    texts = [*docs["text"], "x ghp_" + "a" * 36 + " xoxb-" + "1" * 24 + " SK_LIVE sk_live_" + "b" * 20 + " https://me:secret1@host eyJ" + ".".join(["abcdefgh9"] * 3), "-----BEGIN EC PRIVATE KEY-----\nAAAA\n-----END EC PRIVATE KEY----- glpat-" + "c" * 20]
    for text in texts:
        want = [(r.kind, m.start(), m.end()) for r in ss.RULES for m in re.finditer(r.pattern, text, re.A | (re.I if r.ignore_case else 0)) if len(m[r.group]) >= r.least]
        assert ss.find_spans(text, ss.RULES) == want
    assert {k for k, _, _ in ss.find_spans(" ".join(texts[-2:]), ss.RULES)} >= {r.kind for r in ss.MORE}


def test_arrivals_change_nothing(spark, odd):
    """A ledger that saw part of the rows before, and one that saw none, give the same spans; an empty table gives none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = ss.findings_by_path(docs, ss.scan(docs, ss.scratch(spark, "ledger")), ["doc_id"])
    line = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans")
    assert once.select("doc_id", line).exceptAll(ss.op6_secret_scan(spark, SF).select("doc_id", "spans")).count() == 0
    ledger = ss.scratch(spark, "ledger")
    for there in ss.arrivals(odd):
        ss.scan(there, ledger)
    assert spark.read.parquet(f"{ledger}/seen").count() == len(ss.RULES) * odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert ss.scan(frame(spark, []), ss.scratch(spark, "ledger")).count() == 0
    twice = (ss.Rule("x", "a+", 1), ss.Rule("x", "b+", 1))
    ledger = ss.scratch(spark, "ledger")
    ss.scan(odd, ledger, twice[:1])
    assert ss.scan(odd, ledger, twice).filter("kind = 'x'").count() == 2


# quality


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = ql.op7_quality_classifier(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert got[got["quality"] == 1]["keep"].mean() > 0.95 and got[got["quality"] == 0]["keep"].mean() < 0.05


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    names = [x[0] for x in ql.LABELLERS]
    kind = np.where(rng.random(20_000) < 0.75, 0, rng.integers(1, 1 + len(ql.KINDS), 20_000))
    sees = np.array([[c > 0 and x in ql.KINDS[c - 1] for x in names] for c in range(1 + len(ql.KINDS))])[kind]
    v = np.where(rng.random(sees.shape) < np.where(sees, 0.85, 0.03), 0, 1)
    own, place, n = np.unique(ql.pattern(v), return_inverse=True, return_counts=True)
    good, accuracy = ql.label_model(own, n)
    right = (v == (kind == 0)[:, None]).mean(axis=0)
    classes = np.array([[c > 0 and x in ql.KINDS[c - 1] for x in names] for c in range(1 + len(ql.KINDS))])
    bad = np.where(classes, 0.85, 0.03)
    like = np.where(v[:, None] == 0, bad, 1 - bad).prod(axis=2) * np.array([0.75, *[0.25 / len(ql.KINDS)] * len(ql.KINDS)])
    best = ((like[:, 0] > like[:, 1:].sum(axis=1)) == (kind == 0)).mean()  # with the true rates known
    assert np.abs(accuracy - right).max() < 0.05 and ((good[place] > 0.5) == (kind == 0)).mean() > best - 0.02


def test_quality_odd_rows(spark, odd):
    got = ql.quality(odd).toPandas()
    assert len(got) == 12 and got["score"].between(0, 1).all()


# language model


def test_language_model(spark, docs):
    got = table(lm.op8_lm_score(spark, SF))
    tokens = [t.encode().lower().split() + [None] for t in docs["text"]]
    part = [zlib.crc32(str(d).encode()) % 10 for d in docs["doc_id"]]
    count = collections.Counter(w for t, k in zip(tokens, part) if k for w in t)
    total = sum(count.values())
    base = [sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in t) for t in tokens]
    assert np.allclose(got["base_score"], base) and (got["train_tokens"] == total).all()
    assert got["n_known"].tolist() == [sum(count[w] > 0 for w in t) for t in tokens] and got["held_out"].tolist() == [k == 0 for k in part]
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_interpolation_by_hand(spark):
    """Counts of pairs, contexts and words come back right for every token."""
    rows = [(d, long_text(60, d)) for d in range(40)]
    asked = lm.questions(lm.keyed(frame(spark, rows)), 4)
    told = lm.answers(asked).filter("grp is not null").toPandas()
    count = collections.Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            w = [None, *t.split(), None]
            count.update(zip(w, w[1:]))
    own = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 10 != 1]
    token, _ = lm.tokens([t for _, t in own])
    _, _, both = lm._looked_up(token, told[told["grp"] == 0], "whole")
    want = [count[p] for _, t in own for w in [[None, *t.split(), None]] for p in zip(w, w[1:])]
    assert both.tolist() == want


def test_interpolated_scores_token_by_token(spark, monkeypatch):
    """The model's score of every text from plain counts; the weights are learned by the same formula on the tuning fold."""
    rng, seen = np.random.default_rng(8), {}
    rows = [(d, " ".join(rng.choice(WORDS[:30], int(rng.integers(0, 40))))) for d in range(120)]
    learn = lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda h, u: seen.setdefault("weights", learn(seen.setdefault("histogram", h), u)))
    got = table(lm.lm_scores(frame(spark, rows)))
    part = {d: zlib.crc32(str(d).encode()) % 10 for d, _ in rows}
    tokens = {d: [None, *t.split(), None] for d, t in rows}

    def counted(folds):
        one, two = collections.Counter(), collections.Counter()
        for d, w in tokens.items():
            if part[d] in folds:
                one.update(w[1:])
                two.update(zip(w, w[1:]))
        return one, two, sum(one.values())

    one, two, total = counted(set(range(1, 10)))
    uniform = 1 / (len(one) + 1)
    for d, w in tokens.items():
        logs = 0.0
        for pair in zip(w, w[1:]):
            context = one[pair[0]]
            a, b, c = seen["weights"][0 if not context else 1 + int(math.log2(context))]
            logs += math.log10(a * two[pair] / max(context, 1) + b * one[pair[1]] / total + c * uniform)
        assert got.loc[got["doc_id"] == d, "score"].item() == pytest.approx(logs)
    one, two, total = counted(set(range(2, 10)))
    cells = collections.Counter()
    for d, w in tokens.items():
        if part[d] == lm.TUNE:
            for pair in zip(w, w[1:]):
                cells[int(lm.bucket(np.array([one[pair[0]]]))[0]), int(lm._bin(np.array([two[pair] / max(one[pair[0]], 1)]))[0]), int(lm._bin(np.array([one[pair[1]] / total]))[0])] += 1
    assert {tuple(x[:3]): x[3] for x in seen["histogram"].itertuples(index=False, name=None)} == cells


def test_language_model_counts_beyond_32_bits():
    big = np.array([2**32 + 5, 7], np.int64)
    assert lm._numbers(lm._planes(big)).tolist() == big.tolist()
    asked = pd.DataFrame({"shard": [0, 0], "grp": [0, 2], "size": [1, 1], "grams": [lm._packed(np.array([3, 9], np.uint64))] * 2, "counts": [lm._planes(big)] * 2})
    answer = next(x for x in [lm.answer(asked)])
    assert lm._counts(answer[answer["grp"] == 0], 1, "whole").tolist() == [2 * (2**32 + 5), 14]


def test_language_model_other_ids(spark):
    """Strings as doc_id, and many rows without one, which are dealt to several blocks."""
    texts = [long_text(20, k) for k in range(60)]
    named = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    got = lm.lm_scores(named).toPandas()
    assert len(got) == 60 and got["score"].lt(0).all() and got["held_out"].sum() == sum(zlib.crc32(f"d{k}".encode()) % 10 == 0 for k in range(60))
    nameless = frame(spark, [(None, t) for t in texts])
    assert lm.keyed(nameless, 8).select("grp").distinct().count() > 4 and lm.lm_scores(nameless).count() == 60


def test_language_model_odd_rows(spark, odd):
    got = lm.lm_scores(odd).toPandas()
    assert len(got) == 12 and np.isfinite(got["score"]).all() and (got["score"] < 0).all()
    assert sorted(got["n_tokens"])[:3] == [1, 1, 1]


# SimHash


def brute_components(ids, fps, bits=3):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits):
            a, b = top(i), top(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    return [least[top(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark, docs):
    got = table(sh.op9_simhash_near_dedup(spark, SF))
    fps = np.array([sh.fingerprint_words(t.encode().lower().split()) for t in docs["text"]], np.uint64)
    assert [int(x, 16) for x in got["fingerprint"]] == fps.tolist()
    assert got["component_id"].tolist() == brute_components(docs["doc_id"], fps)


def test_components_of_dense_groups(spark):
    """Thousands of fingerprints that share bytes: exact components, and pairs in proportion to the fingerprints."""
    rng = np.random.default_rng(2)
    near = np.unique(np.r_[rng.integers(0, 1 << 24, 800), np.arange(500), rng.integers(0, 1 << 62, 200)]).astype(np.uint64)
    want = brute_components(near.view(np.int64).tolist(), near)
    df = spark.createDataFrame(pd.DataFrame({"fp": near.view(np.int64)}))
    got = {r["node"]: r["component"] for r in sh.fingerprint_components(df).collect()}
    groups, own = {}, {}
    for x, w in zip(near.view(np.int64).tolist(), want):
        groups.setdefault(w, set()).add(x)
        own.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_every_five_bytes_hold_a_key():
    from itertools import combinations

    sets = [set(s) for s in sh.position_sets(5, 4)]
    assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), 5))


def test_simhash_odd_rows(spark, odd):
    got = sh.near_components(odd).toPandas()
    assert len(got) == 12 and set(got[got["fp"] == 0]["component_id"]) == {1}
    assert got[got["doc_id"] == 10]["component_id"].tolist() == [10]


def test_similar_documents(spark):
    base = long_text(400, 9).split()
    edit = lambda step, seed: " ".join(w if k % step else f"e{seed}{k}" for k, w in enumerate(base))
    rows = [(1, " ".join(base)), (2, edit(100, 2)), (3, edit(130, 3)), (4, edit(8, 4)), (5, long_text(400, 10)), (6, None), (7, ""), (8, "short one"), (9, " ".join(base).upper())]
    left = {r["doc_id"] for r in sh.drop_near_copies(frame(spark, rows)).collect()}
    assert left == {1, 4, 5, 6, 7, 8}


def test_similar_documents_against_brute_force(spark, monkeypatch):
    """Families whose members are 0.6 to 1 like their first and often less than 0.8 like each other; a line that all hold."""
    monkeypatch.setattr(sh, "SAMPLED", 1, raising=False)
    rng, rows = np.random.default_rng(5), []
    line = long_text(12, 99).split()
    for family in range(25):
        base = long_text(int(rng.integers(5, 300)), 1000 + family).split()
        for _ in range(12):
            edits = rng.choice(len(base), min(len(base), int(rng.integers(0, 1 + len(base) // 20))), replace=False)
            rows.append(" ".join([f"e{rng.integers(1 << 40)}" if k in edits else w for k, w in enumerate(base)] + line))
    rows += ["a b", "b a", "a  B", "one two three four", "one two three four", *(long_text(40, 5000 + k) + " " + " ".join(line) for k in range(30))]
    words = [t.lower().split() for t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))
    border = 0
    for i in range(len(rows)):
        for j in range(i):
            similarity = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            border += 0.7 < similarity < 0.9
            if similarity >= 0.8 and root[i] != root[j]:
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if x == b else x for x in root]
    table = frame(spark, list(enumerate(rows))).repartition(5)
    for most in (sh.MARKED, 0):  # with a bitmap of the shared keys, and by a join alone
        got = dict(sh.similar_components(table, most_marked=most).collect())
        assert border > 100 and [got.get(i, i) for i in range(len(rows))] == root


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_copies_under_one_doc_id(spark, kind):
    """Rows are judged by their own text where a doc_id has several."""
    base = long_text(200, 31)
    near = " ".join("e" if k == 100 else w for k, w in enumerate(base.split()))
    rows = [(3, base), (7, near), (7, long_text(200, 32)), (9, long_text(200, 33)), (9, long_text(200, 33)), (None, base), (None, base), (5, None), (5, None), (6, "")]
    docs = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    left = sh.drop_near_copies(docs)
    want = [rows[i] for i in (0, 2, 3, 5, 6, 7, 8, 9)]
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(a), str(b)) for a, b in want)


def test_similar_documents_meet_by_simhash_first(spark, monkeypatch):
    """Fingerprints under their byte positions link what differs in few bits; what is left goes to the shingles with these links."""
    runs, linked = [], sh.linked_components

    def seen(postings, *args, **named):
        out = linked(postings, *args, **named)
        runs.append((postings.columns, postings.count(), out.filter("node <> component").count()))
        return out

    monkeypatch.setattr(sh, "linked_components", seen)
    base = long_text(2000, 7).split()
    rows = [(i, " ".join(w if k != 5 + i else f"e{i}" for k, w in enumerate(base))) for i in range(20)] + [(30, long_text(400, 8)), (31, None), (32, long_text(400, 8))]
    got = {r.doc_id: r.component_id for r in sh.similar_components(frame(spark, rows)).collect()}
    assert got == {**dict.fromkeys(range(20), 0), 30: 30, 32: 30}
    (columns, n, by_bits), _ = runs
    assert "fp" in columns and n == 14 * 21 and by_bits > 10


def test_a_family_of_edited_copies_meets_few_pairs(spark, monkeypatch):
    """No list of a key's members in one task, and pairs in proportion to the family."""
    kept, saved = {}, sh.saved

    def count(df, name):
        out = saved(df, name)
        kept.setdefault(name, []).append((out.count(), [f.dataType.typeName() for f in out.schema]))
        return out

    monkeypatch.setattr(sh, "saved", count)
    base, n = long_text(200, 7).split(), 300
    rows = [(i, " ".join(w if k != 5 + i % 190 else f"e{i}" for k, w in enumerate(base))) for i in range(n)]
    got = sh.similar_components(frame(spark, rows)).toPandas()
    assert len(got) == n and set(got["component_id"]) == {0}
    assert 0 < sum(rows for rows, _ in kept["pairs"]) < 4 * n and all("array" not in types for _, types in kept["postings"])


# licenses


def test_licenses(spark, odd):
    rows = [(1, "All rights reserved. CC-BY and CC BY; all Rights; Reserved"), (2, "Licensed under the Apache License, Version 2.0."), (3, "all right reserved mit license"), (4, None), (5, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met")]
    got = ls.license_blocks(frame(spark, rows)).toPandas().set_index("doc_id")
    assert sorted((p["start"], p["label"]) for p in got.loc[1, "places"]) == [(0, "reserved"), (3, "cc-by"), (6, "cc-by"), (8, "reserved")]
    assert [m["label"] for m in got.loc[2, "matches"]] == ["apache-name"] and len(got.loc[3, "places"]) == len(got.loc[3, "matches"]) == 0
    assert [m["label"] for m in got.loc[5, "matches"]] == ["bsd"]
    assert ls.license_blocks(odd).count() == 12


def brute_blocks(ids, t):
    """Blocks by their definition: runs from each token of the template on, the ones that reach the threshold joined where they overlap."""
    own, size, out = set(t.tokens.tolist()), math.ceil(ls.SLACK * len(t.tokens)), []
    for p in range(len(ids)):
        inside = [q for q in range(p, min(len(ids), p + size)) if ids[q] in own]
        held = len({ids[q] for q in inside})
        if ids[p] in own and held >= t.least:
            new = (p, inside[-1] + 1, held / len(own))
            if out and p < out[-1][1]:
                new = (out[-1][0], new[1], max(new[2], out.pop()[2]))
            out.append(new)
    return out


def test_blocks_against_brute_force():
    rng, found = np.random.default_rng(4), 0
    for _ in range(600):
        n = int(rng.integers(3, 9))
        t = ls.Template("t", rng.permutation(20)[:n], False, math.ceil(0.8 * n - 1e-9))
        counts = rng.integers(1, 50, 20)
        own = np.unique(t.tokens)
        t.order = own[np.lexsort((own, counts[own]))]
        t.prefix = t.order[: n - t.least + 1]
        ids = np.where(rng.random(60) < 0.5, rng.choice(own, 60), rng.integers(-1, 20, 60))[: int(rng.integers(1, 61))]
        want = brute_blocks(ids.tolist(), t)
        found += len(want)
        assert ls.blocks(ids, t) == want
    assert found > 300


def test_blocks_on_documents(spark):
    """Against brute force over whole texts; the notices stand in the given table."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = frame(spark, [(-1, " ".join(ls.TEMPLATES.values()) + " " + long_text(50) + " " + ls.TEMPLATES["mit"] + " x " + ls.TEMPLATES["mit"].replace("hereby ", "")), (-2, ls.TEMPLATES["bsd"].upper() * 2)])
    both = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    got = {r["doc_id"]: sorted((m["label"], m["start"], m["end"], round(m["containment"], 9)) for m in r["matches"]) for r in ls.license_blocks(both).collect()}
    templates = ls.Templates(ls.PHRASES, ls.TEMPLATES, ls.THRESHOLD)
    texts = both.toPandas()
    for doc, text in zip(texts["doc_id"], texts["text"]):
        ids = templates.ids(tx.Words(tx.lower([text]), tx.ALNUM)).tolist()
        if len(ids) < 3000:
            assert got[doc] == sorted((t.label, a, b, round(c, 9)) for t in templates.all if not t.ordered and len(set(ids) & set(t.tokens.tolist())) >= t.least for a, b, c in brute_blocks(ids, t))
    assert len(got[-1]) > 10 and [m[0] for m in got[-2]] == ["bsd"] * len(got[-2])


def test_phrases_on_documents(spark, docs):
    got = table(ls.op10_license_scan(spark, SF))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for row, text in zip(got.itertuples(), docs["text"]):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = sorted((i, label) for phrase, label in ls.PHRASES.items() for q in [phrase.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q)
        assert (row.n_words, row.n_base, row.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert pd.isna(row.first_word) if not places else (row.first_word, row.last_word) == (places[0][0], places[-1][0])


# pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    now, seen = spark.read.parquet(f"{SF}/documents.parquet"), [set(docs["doc_id"])]
    columns = now.columns
    for name, stage in cp.STAGES[:-1]:
        now = cp.saved(stage(spark, now, SF), name)
        assert now.columns == columns
        seen.append({r["doc_id"] for r in now.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    texts = docs.set_index("doc_id")["text"]
    assert {texts[d] for d in seen[1]} == {texts[d] for d in seen[2]} and len(seen[2]) == texts[list(seen[1])].nunique()
    packed = cp.STAGES[-1][1](spark, now, SF).toPandas()
    assert set(packed["doc_id"]) == seen[-1]
    check_packing(packed)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pipeline_odd_rows(spark, odd):
    import corpus_pipeline as cp

    now = odd
    for name, stage in cp.STAGES:
        now = cp.saved(stage(spark, now, SF), name)
    assert {r["doc_id"] for r in now.select("doc_id").distinct().collect()} >= {2, 3, 5, 9}
    assert now.filter(F.col("length") < 1).count() == 0


def test_a_common_phrase_forms_few_pairs(spark, monkeypatch):
    """200 items and 300 documents that share one phrase and little else, and three documents with an item in them."""
    kept, saved = {}, dc.saved

    def count(df, name):
        out = saved(df, name)
        kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(dc, "saved", count)
    phrase = "in the course of this study we"
    items = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"i{i}x{k}" for k in range(30))) for i in range(200)], "item_id int, text string")
    body = lambda i: " ".join(f"d{i}y{k}" for k in range(60))
    leak = lambda i: f"{body(i)} " + " ".join(f"i{i}x{k}" for k in range(25))
    docs = frame(spark, [(i, f"{body(i)} {phrase} {body(i + 1000)}") for i in range(300)] + [(1000 + i, leak(i)) for i in range(3)])
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    assert got == {(1000 + i, i) for i in range(3)} and kept["pairs"] < 1000


def test_common_passages_are_found_by_their_words(spark, monkeypatch):
    """An item whose every n-gram is common, in blocks of few items."""
    monkeypatch.setattr(dc, "SEEDED", 2)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 60)
    text = long_text(40, 51)
    items = spark.createDataFrame([(1, text), (2, long_text(40, 52)), (3, long_text(30, 53))], "item_id int, text string")
    docs = frame(spark, [(i, f"{long_text(20, 60 + i)} {text if i % 2 else ' '.join(text.split()[:28])}") for i in range(12)])
    got = {(r.doc_id, r.item_id): (r.seeds, r.score) for r in dc.contaminated(docs, items).collect()}
    assert {k for k, (_, score) in got.items() if score > 0.6} == {(i, 1) for i in range(12)} and all(seeds == 0 for seeds, _ in got.values())
