"""Statistics, votes, label model, features and scores of the quality classifier in plain Python; blocks of the language model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwise.llm import lm_score as lm
from rillwise.llm import quality as ql
from rillwise.llm import text as tx
from test_llm import SF, frame, long_text

STOP = {w.encode() for w in ql.STOP}


def plain_statistics(text: bytes) -> list[float]:
    words, low = text.split(), text.lower().split()
    n, size = len(words), len(text)
    share = lambda held, usual: (sum(held(b) for b in text) + 200 * usual) / (size + 200)
    pairs = list(zip([None, *low], low))
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    return [
        share(lambda b: b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b not in b" \t\n\r", 0.025), share(lambda b: b in b"#$%&*@!|<>{}[]\\^~_=+", 0.0), share(lambda b: 65 <= b <= 90, 0.016),
        sum(a == b for a, b in pairs) / (n + 20), (n - len(set(pairs))) / (n + 20), sum(x[-1:] not in b".!?:;\"')" for x in lines) / (len(lines) + 2),
        1 - (sum(w in STOP for w in low) + 20 * 0.14) / (n + 20), abs((sum(map(len, words)) + 20 * 5.2) / (n + 20) - 5.2), n,
    ]


def plain_votes(s: list[float]) -> list[int]:
    return [0 if s[-1] == 0 else 1 if x <= good else 0 if x > bad else -1 for x, (_, good, bad) in zip(s, ql.LABELLERS)]


def plain_model(votes: list[list[int]], rounds: int = 100) -> tuple[list[float], list[float]]:
    """Document by document."""
    classes, m = 1 + len(ql.KINDS), len(ql.LABELLERS)
    prior = [0.8, *[0.2 / len(ql.KINDS)] * len(ql.KINDS)]
    chance = [[{-1: 0.2, 0: 0.02, 1: 0.78} if c == 0 else {-1: 0.2, 0: 0.7, 1: 0.1} if ql.LABELLERS[i][0] in ql.KINDS[c - 1] else {-1: 0.3, 0: 0.1, 1: 0.6} for c in range(classes)] for i in range(m)]
    for _ in range(rounds):
        shares = []
        for v in votes:
            like = [prior[c] * np.prod([chance[i][c][v[i]] for i in range(m)]) for c in range(classes)]
            shares.append([x / sum(like) for x in like])
        total = [sum(s[c] for s in shares) + 1e-3 * len(votes) for c in range(classes)]
        prior = [t / sum(total) for t in total]
        for i in range(m):
            for c in range(classes):
                n = {k: 1 + sum(s[c] for s, v in zip(shares, votes) if v[i] == k) for k in (-1, 0, 1)}
                chance[i][c] = {k: x / sum(n.values()) for k, x in n.items()}
    right = [prior[0] * chance[i][0][1] + sum(prior[c] * chance[i][c][0] for c in range(1, classes)) for i in range(m)]
    return [s[0] for s in shares], right


def plain_features(text: bytes, s: list[float]) -> list[tuple[int, float]]:
    code = lambda x: int(tx.mix(np.array([x], np.uint64))[0]) % ql.SLOTS
    n: dict[int, int] = {}
    for w in text.lower().split():
        letters = sum(chr(b).isalpha() if b < 128 else True for b in w)
        last = w[-1] if w[-1] < 128 and not chr(w[-1]).isalpha() else 0
        for slot in (int(tx.Words([w]).hashes()[0]) % ql.SLOTS, code(min(len(w) - letters, 7) * 4096 + last + (1 << 40))):
            n[slot] = n.get(slot, 0) + 1
    norm = np.sqrt(sum(x * x for x in n.values())) or 1.0
    bins = [min(15, max(0, int(x / bad * 8))) for x, (_, _, bad) in zip(s, ql.LABELLERS)]
    return [(k, x / norm) for k, x in sorted(n.items())] + [(code(1 + b + 16 * i), 1.0) for i, b in enumerate(bins)]


def test_quality_in_plain_python(spark):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows += [(10_000, b""), (10_001, b" \n"), (10_002, b"a a a a"), (10_003, "É! #x #x".encode())]
    own = [plain_statistics(t) for _, t in rows]
    assert np.allclose(ql.statistics([t for _, t in rows]), own)
    assert np.allclose(np.concatenate([ql.statistics([t]) for _, t in rows]), own)  # no text depends on those beside it
    votes = [plain_votes(s) for s in own]
    posterior, right = plain_model(votes)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3)
    assert ql.labeller_accuracies(docs) == pytest.approx(dict(zip([x[0] for x in ql.LABELLERS], right)))
    vectors = [plain_features(t, s) for (_, t), s in zip(rows, own)]
    w = ql.train([(np.array([k for k, _ in v]), np.array([x for _, x in v])) for v in vectors], np.array(posterior))
    got = {r.doc_id: r for r in ql.quality(docs).collect()}
    for (i, _), v, p, vector in zip(rows, votes, posterior, vectors):
        assert list(got[i].votes) == v and got[i].posterior == pytest.approx(p, abs=1e-9)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(sum(w[k] * x for k, x in vector) + w[-1]))), abs=1e-6)
    assert len({tuple(v) for v in votes}) > 10


@pytest.mark.parametrize("spacing", [1, 5000])
def test_blocks_go_by_bytes(spark, monkeypatch, spacing):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    docs = frame(spark, [(i * spacing + 7, long_text(100 + i % 50, i)) for i in range(300)])
    size = lm.in_blocks(docs, 4).groupBy("grp").agg(F.sum(F.octet_length("text")).alias("n")).toPandas()["n"]
    assert size.max() <= lm.LARGE * lm.BLOCK_BYTES and 4 <= len(size) <= 30


def test_no_block_is_large(spark, monkeypatch):
    """Many rows of one doc_id, and doc_ids that are dense in one place; scores are those of one block."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    rows = [(5, long_text(80, i)) for i in range(120)] + [(1_000_000 + i, long_text(80, 500 + i)) for i in range(60)] + [(10**9, "x"), (None, "x y")]
    docs = frame(spark, rows)
    size = lm.in_blocks(docs, 4).groupBy("grp").agg(F.sum(F.octet_length("text")).alias("n")).toPandas()["n"]
    assert size.max() <= lm.LARGE * lm.BLOCK_BYTES
    key = lambda df: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in df.collect())
    parted = key(lm.lm_scores(docs))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 30)
    whole = key(lm.lm_scores(docs))
    assert [r[:5] for r in parted] == [r[:5] for r in whole] and np.allclose([r[5] for r in parted], [r[5] for r in whole], atol=0.02)
