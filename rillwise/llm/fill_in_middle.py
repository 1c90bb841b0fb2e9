"""Fill-in-middle transformation by a compressed set of token boundaries.

The places between a text's tokens, as code points, form a set of whole numbers. It is kept as in roaring bitmaps: numbers
that agree but for their last 16 bits share a container, which is a sorted array, a bitmap or a list of runs, whichever is
smallest, and cumulative cardinalities say how many members lie before each container. The k-th boundary is found by a
search for its container and a selection inside; two such selections give both cuts. Texts are only cut there, never
tokenised into strings. Documents don't meet: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillwise.llm import text as tx

SEED = 42
#: Of 100 documents so many are transformed, and of 100 of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class _Array:
    """Members one by one, 2 bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])


class _Bitmap:
    """A bit for each of 65,536 numbers, and how many are set before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        set_ = np.flatnonzero(np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(set_[k - self.before[word]])


class _Runs:
    """First number of each run of consecutive members, and how many members lie before it."""

    def __init__(self, low: np.ndarray, begin: np.ndarray):
        self.first, self.before = low[begin], begin

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


#: Bytes of a bitmap container; an array takes 2 a member and runs take 4 each.
BITMAP_BYTES = 1 << 13


def _container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
    begin = np.flatnonzero(np.concatenate([[True], np.diff(low.astype(np.int32)) != 1]))
    if 4 * len(begin) < min(2 * len(low), BITMAP_BYTES):
        return _Runs(low, begin)
    return _Array(low) if 2 * len(low) <= BITMAP_BYTES else _Bitmap(low)


class BoundarySet:
    """Rising whole numbers, of which the k-th (from 0) can be selected."""

    def __init__(self, members: np.ndarray):
        high = members >> 16
        begin = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(members) else np.zeros(0, np.int64)
        self.high, self.before = high[begin], np.append(begin, len(members))
        self.containers = [_container((members[a:b] & 0xFFFF).astype(np.uint16)) for a, b in zip(self.before[:-1], self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.high[at]) << 16) + self.containers[at].select(k - int(self.before[at]))


def token_ends(raw: list[bytes]) -> list[np.ndarray]:
    """Of each text the code points at which its tokens end: each word takes the white space before it, white space at the end is a token."""
    words = tx.Words(raw)
    points = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
    out = []
    for begin, text, a, b in zip(words.first, raw, words.ptr[:-1], words.ptr[1:]):
        ends, stop = words.end[a:b], begin + len(text)
        ends = np.append(ends, stop) if len(text) and not (len(ends) and ends[-1] == stop) else ends
        out.append(points[ends] - points[begin])
    return out


_CUTS = "n long, form string, output string, prefix_chars long, middle_chars long, containers int"


def _transform(transformed: int, suffix_first: int):
    @F.pandas_udf(_CUTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            texts, out = ["" if t is None else t for t in texts], []
            raw = tx.utf8(texts)
            for part in tx.chunks(raw):
                for text, key, ends in zip(texts[part], keys[part], token_ends(raw[part])):
                    n = len(ends)
                    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in range(0, 32, 8))
                    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= transformed:
                        out.append((n, "plain", text, None, None, 0))
                        continue
                    bounds = BoundarySet(np.append(0, ends))
                    first, second = (bounds.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, middle, suffix = text[:first], text[first:second], text[second:]
                    if h4 % 100 < suffix_first:
                        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                    else:
                        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
                    out.append((n, form, output, first, second - first, len(bounds.containers)))
            frame = pd.DataFrame(out, columns=["n", "form", "output", "prefix_chars", "middle_chars", "containers"])
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars, containers: one row for each row of docs, of which only doc_id and text are read.

    The text of n tokens is cut after two numbers of tokens drawn by seed and doc_id. output is the text itself (plain:
    empty texts, texts that hold a marker, and those not drawn), or its parts after the markers: prefix, suffix, middle (psm)
    or suffix, prefix, middle (spm). A null text counts as empty, a null doc_id as the empty string. Rows that repeat a
    doc_id draw the same numbers. containers says how many the boundary set has (plain texts need none: 0).
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = docs.select("doc_id", _transform(transformed, suffix_first)(F.coalesce("text", F.lit("")), key).alias("cut"))
    return cut.select("doc_id", "cut.*")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. Transformed texts hold no marker, so each stands once in their output."""

    def between(begin: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, begin, -1), end, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from what it was made into. A very long text costs 8 bytes a token while it is cut."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = digest(restored(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), back.alias("restored_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, sha256('42:' || doc_id) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, tokens, len(tokens) AS n, ('0x' || h[1:8])::UBIGINT % (len(tokens) + 1)::UBIGINT AS a, ('0x' || h[9:16])::UBIGINT % (len(tokens) + 1)::UBIGINT AS b,
         ('0x' || h[17:24])::UBIGINT % 100 AS c, ('0x' || h[25:32])::UBIGINT % 100 AS d
  FROM cut),
formed AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(tokens[1:least(a, b)::BIGINT], '') AS p, array_to_string(tokens[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS m,
         array_to_string(tokens[greatest(a, b)::BIGINT + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM formed
"""
