"""Fill-in-middle, periodic runs and byte-pair encoding against brute force, and their edge cases."""

import base64
import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwise.llm import byte_bpe as bb
from rillwise.llm import fill_in_middle as fm
from rillwise.llm import periodic_runs as pr
from test_llm import SCHEMA, SF, frame, long_text

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, white space, markers, repeated rows, a null doc_id, characters beyond ASCII, a very long text."""
    texts = ["", " \n\t", "a", "a b <P> c", "<S>", "x<M>y", "é\x85x\xa0y\x1cz É", "  lead", "trail  ", "𝒳 𝒴𝒵 😀😀 x́", "a b " * 40, "a  b\n\n c"]
    rows = [(1, None), (4, "a"), (4, "a"), (None, "b c d e"), (None, None)] + [(10 + 7 * i + j, t) for i, t in enumerate(texts) for j in range(7)]
    return frame(spark, rows + [(500, long_text(60_000)), (503, "x y " * 30_000 + "z")]).repartition(3).cache()


def both(spark, odd):
    """The given documents and the odd ones."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return given.unionByName(odd.select("doc_id", "text"))


def rows_of(df):
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in df.collect()), key=repr)


# fill in the middle


def test_boundary_sets():
    rng = np.random.default_rng(1)
    cases = [np.arange(0), np.array([0]), np.arange(200_000), np.unique(rng.integers(0, 300_000, 90_000)), np.unique(rng.integers(0, 1 << 20, 500)), np.r_[5, 65_535, 65_536, 131_072, 400_000], np.arange(0, 300_000, 2), np.r_[np.arange(30), np.arange(70_000, 70_900, 3)]]
    kinds = set()
    for members in cases:
        s = fm.BoundarySet(members)
        kinds |= {type(c) for c in s.containers}
        assert len(s) == len(members)
        for k in {*range(min(70, len(members))), *rng.integers(0, max(len(members), 1), 200).tolist(), len(members) - 1} if len(members) else ():
            assert s.select(k) == members[k]
        for k in (-1, len(members)):
            with pytest.raises(IndexError):
                s.select(k)
    assert len(kinds) == 3


def test_token_ends():
    texts = ["", " ", "a", " a", "a ", "é  é\t", "𝒳 y\x0bz", "a\x85b \x1c"]
    for text, ends in zip(texts, fm.token_ends([t.encode() for t in texts])):
        assert ends.tolist() == [m.end() for m in TOKEN.finditer(text)]


def cut_by_hand(doc, text):
    text = text or ""
    tokens, h = TOKEN.findall(text), hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h4 % 100 < 80 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_fill_in_middle_by_hand(spark, odd):
    docs = both(spark, odd)
    made = fm.fill_in_middle(docs)
    got = rows_of(made.select("doc_id", "n", "form", "output", "prefix_chars", "middle_chars", fm.restored(F.col("output"), F.col("form"))))
    want = sorted(((r.doc_id, *cut_by_hand(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=repr)
    assert got == want and {r[2] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = fm.op11_fill_in_middle(spark, SF)
    want = db.execute(fm.ORACLE)
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got) == sorted(want.fetchall(), key=repr)


def test_parts_that_look_like_markers(spark):
    texts = ["<", "<P", "P>", "< S>", "<<P", "M><", "<S <P> ".replace("<P>", "P>")] * 30
    docs = frame(spark, list(enumerate(texts)))
    made = fm.fill_in_middle(docs, transformed=100).join(docs.select("doc_id", "text"), "doc_id")
    assert made.filter(fm.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0 and made.filter("form <> 'plain'").count() == len(texts)


# periodic runs


def runs_by_hand(words, least=6, power=4):
    """Every maximal stretch of each period, by comparing all words so far apart."""
    out = set()
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, power * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    rng = np.random.default_rng(5)
    seen = set()
    for _ in range(400):
        size = int(rng.integers(1, 4))
        words = rng.integers(0, size, rng.integers(0, 90)).tolist()
        for _ in range(int(rng.integers(0, 3))):
            q = int(rng.integers(1, 12))
            words += (rng.integers(0, size + 1, q).tolist() * 9)[: int(rng.integers(q, 9 * q + 1))]
        got = [tuple(r) for r in pr.Factors(np.array(words, np.int64)).runs().tolist()]
        assert got == runs_by_hand(words)
        seen |= {q for _, _, q in got}
    assert len(seen) > 8


def test_texts_side_by_side_do_not_run_on():
    ids = pr.word_ids([[b"a"] * 5, [b"a"] * 5, [b"a"] * 6])
    assert pr.Factors(ids).runs().tolist() == [[10, 6, 1]]


def planted_by_hand(doc, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc is None else str(doc)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def described_by_hand(doc, text, find=runs_by_hand):
    words = planted_by_hand(doc, text)
    runs = find(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), hashlib.sha256(kept).hexdigest()


def test_periodic_runs_by_hand(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    docs = docs[docs["text"].str.len() < 12_000]
    extra = [(None, "a b c"), (900_001, None), (900_002, ""), (900_003, " \t"), (900_004, "x " * 6), (900_005, "x " * 5), (900_006, "é b " * 4 + "c é b é b é b é b é"), (900_006, "y " * 9)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs).unionByName(spark.createDataFrame(extra, "doc_id long, text string")).write.parquet(f"{folder}/documents.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = rows_of(pr.op12_periodic_runs(spark, folder))
    assert got == sorted((described_by_hand(r.doc_id, r.text) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 10


def test_periodic_runs_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_words): r for r in pr.periodic_runs(odd).collect()}
    assert [tuple(x) for x in got[503, 60_001].runs] == [(0, 60_000, 2)] and got[503, 60_001].collapsed == "x y z"
    assert pr.periodic_runs(odd).count() == odd.count() and got[500, 60_000].runs == [] and got[1, 0].collapsed == ""
    with pytest.raises(ValueError):
        pr.periodic_runs(odd, power=3)


# byte-pair encoding


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as pt
    import tiktoken

    with open(pt.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_librarys(library):
    own, rng = bb.vocabulary(), np.random.default_rng(2)
    alphabets = ["ab", "a", "the in on er ", "0123456789", " \n\t\xa0\x85\x1c", "=-_*#.", "éß字😀́", "aAbB'sdt <|endoftext|>"]
    texts = ["", "<|endoftext|>", "a  b", " a", "it's 'll 'S", "x\n y", "\n\n ", "字" * 500, "A" * 5000, "supercalifragilisticexpialidocious" * 20]
    texts += [chr(c) + "a b" + chr(c) + " " + chr(c) for c in range(0x300)]
    texts += ["".join(rng.choice(list(a), rng.integers(1, 400))) for a in alphabets for _ in range(60)]
    for text in texts:
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_generations_of_the_cache(library, monkeypatch):
    monkeypatch.setattr(bb, "CACHED", 3)
    own = bb.Vocabulary(bb.vocabulary().ranks, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    for text in ["one two three one four five one six", "two one six", "", " one"] * 3:
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    assert len(own._spaced) <= 3 and len(own._spaced.old) <= 3


def test_long_and_short_merges_agree():
    own, rng = bb.vocabulary(), np.random.default_rng(6)
    for _ in range(200):
        raw = bytes(rng.choice(np.frombuffer([b"abc", b"ab", b" the", b"\x00\xff\xc3"][rng.integers(4)], np.uint8), rng.integers(0, 90)))
        short = own._merged_short(raw)
        assert short == own.merged(raw) and own.decode(np.array(short, np.int64)) == raw


def test_tree_of_bytes(library):
    """Joins at any place give what the whole gives, and windows do grow."""
    own, rng = bb.vocabulary(), np.random.default_rng(4)
    grown = 0
    for _ in range(300):
        raw = bytes(rng.choice(np.frombuffer([b"abc", b"ab", b" the", b"\x00\xff\xc3"][rng.integers(4)], np.uint8), rng.integers(2, 200)))
        at = int(rng.integers(1, len(raw)))
        left, right, whole = own.merged(raw[:at]), own.merged(raw[at:]), own.merged(raw)
        assert own.joined(left, right) == whole == own.tree(raw)
        grown += whole != left + right
    assert grown > 50 and own.joined([], [5]) == [5] and own.joined([5], []) == [5] and own.tree(b"") == []


def test_byte_bpe_query(spark, odd, library, tmp_path):
    both(spark, odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert rows_of(bb.op13_byte_bpe(spark, str(tmp_path))) == sorted(want, key=repr)


def test_decoding_keeps_other_columns(spark):
    rows = spark.createDataFrame([("x", [15496, 995], 1.5), (None, [], None), ("y", None, 2.0)], "name string, tokens array<int>, weight double")
    assert [(r.name, bytes(r.bytes), r.weight) for r in bb.decoded(rows).collect()] == [("x", b"Hello world", 1.5), (None, b"", None), ("y", b"", 2.0)]


@pytest.mark.parametrize("run", [fm.fill_in_middle, pr.periodic_runs, bb.encoded, lambda d: bb.decoded(bb.encoded(d))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_text_as_doc_id(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", None)], "doc_id string, text string")
    for made in (fm.fill_in_middle(docs), pr.periodic_runs(pr.with_planted_periods(docs)), bb.decoded(bb.encoded(docs))):
        assert {r.doc_id for r in made.collect()} == {"a", "b"}
