"""Byte-level byte-pair encoding as a tree reduction over a monoid, and its decoding.

The elements are byte strings with their tokens. A string's halves are encoded by themselves and joined: a window of tokens
round the border is encoded anew, and grows until the tokens beside it are stable. Two neighbouring tokens are stable if
their bytes alone encode to just these two. A sequence whose neighbours are all stable is the encoding of its bytes: the
first merge across a border of two tokens would be the first one within these two alone as well, as merges elsewhere don't
touch them. So a join is proven by two looks at the window's ends and touches nothing beyond them. Matches of the pattern
that cuts a text are encoded separately, so their sequences join without a window. Decoding concatenates bytes up a tree.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Strings of at most so many bytes are encoded at once, without halves (a power of two, so that halves start at multiples of it).
LEAF = 16
#: Strings of at most so many bytes look for their least pair in a list, longer ones in a heap.
SHORT = 48
#: Encoded strings kept by each worker in each of two generations (what is not met again while one fills is let go), and pairs.
CACHED = 200_000
#: Tokens that are decoded at once.
DECODED = 4096

#: Letters below this one are letters in every version of Unicode.
PLAIN = "\u0250"

_BESIDE = re.compile(r" \s| \Z")


class _Recent(dict):
    """Strings and what make gives for them, in two generations."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        known = self.old.get(text)
        if known is None:
            known = self.make(text)
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[text] = known
        return known


class Vocabulary:
    """Ranks of byte strings, all single bytes among them; a token is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.texts = ranks, {i: text for text, i in ranks.items()}
        self.matches = regex.compile(pattern).findall
        # whether the pattern is known to take a space and letters as one
        self.plain = all(self.matches(x) == [x] for x in (" aZ", "éß", " \u024f", "a"))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._bare, self._spaced = _Recent(self._packed), _Recent(lambda word: self._packed(" " + word))
        # tokens of single bytes, ranks of two bytes, and of two tokens that make one
        self._bytes = [ranks[bytes([i])] for i in range(256)]
        self._first = [ranks.get(bytes([a, b]), len(ranks)) for a in range(256) for b in range(256)]
        splits = ((ranks.get(t[:k]), ranks.get(t[k:]), i) for t, i in ranks.items() for k in range(1, len(t)))
        self._joins = {a << 20 | b: i for a, b, i in splits if a is not None and b is not None}
        # the bytes of all tokens one after the other, where each begins and how long it is
        length = np.zeros(max(self.texts, default=-1) + 1, np.int64)
        length[list(self.texts)] = [len(t) for t in self.texts.values()]
        self._all, self._length, self._begin = np.frombuffer(b"".join(self.texts.get(i, b"") for i in range(len(length))), np.uint8), length, np.cumsum(length) - length

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a byte string after merging the pair of the least rank, the leftmost of equals, as long as there is one."""
        n, ranks = len(piece), self.ranks
        if n <= SHORT:
            return self._merged_short(piece)
        end, begin = list(range(1, n + 1)), list(range(n))  # where the part that starts here ends; where the part that ends after this byte starts
        heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
        heapify(heap)
        gone = bytearray(n)
        while heap:
            _, a, c = heappop(heap)
            b = 0 if gone[a] else end[a]
            if not b or b >= c or gone[b] or end[b] != c:
                continue
            end[a], gone[b], begin[c - 1] = c, 1, a
            if a and (pair := piece[(before := begin[a - 1]) : c]) in ranks:
                heappush(heap, (ranks[pair], before, c))
            if c < n and (pair := piece[a : end[c]]) in ranks:
                heappush(heap, (ranks[pair], a, end[c]))
        out, a = [], 0
        while a < n:
            out.append(ranks[piece[a : end[a]]])
            a = end[a]
        return out

    def _merged_short(self, piece: bytes) -> list[int]:
        get, none = self._joins.get, len(self.ranks)
        tokens = list(map(self._bytes.__getitem__, piece))
        pairs = [self._first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            tokens[i] = least
            del tokens[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(tokens[i - 1] << 20 | least, none)
            if i < len(pairs):
                pairs[i] = get(least << 20 | tokens[i + 1], none)
        return tokens

    def stable(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to just these."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHED:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merged(self.texts[left] + self.texts[right]) == [left, right]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring strings' bytes, of which both have been encoded."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merged(b"".join(self.texts[t] for t in [*left[-a:], *right[:b]]))
            left_ok = a == len(left) or self.stable(left[-a - 1], window[0])
            right_ok = b == len(right) or self.stable(window[-1], right[b])
            if left_ok and right_ok:
                return left[:-a] + window + right[b:]
            a, b = a if left_ok else 2 * a, b if right_ok else 2 * b

    def tree(self, piece: bytes) -> list[int]:
        """The encoding of a byte string by halves."""
        n = len(piece)
        if n <= LEAF:
            return self._merged_short(piece)
        half = LEAF << ((n - 1) // LEAF).bit_length() - 1
        return self.joined(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, match: str) -> list[int]:
        """Tokens of a match of the pattern; one that is a token itself is that token."""
        raw = match.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return self.tree(raw) if whole is None else [whole]

    def _packed(self, chunk: str) -> bytes:
        """Tokens of a chunk as 32-bit numbers."""
        # letters of the first blocks, with or without a space before them, are one match of the pattern
        word = chunk[1:] if chunk[:1] == " " else chunk
        if self.plain and word.isalpha() and max(word) < PLAIN:
            return array("i", self.piece(chunk)).tobytes()
        return array("i", [t for match in self.matches(chunk) for t in self.piece(match)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Tokens of a text. Where no space stands beside white space, no match of the pattern crosses a space that starts a word."""
        if _BESIDE.search(text):
            packed = b"".join(map(self._bare.__getitem__, self.matches(text)))
        else:
            first, *rest = text.split(" ")
            packed = self._bare[first] + b"".join(map(self._spaced.__getitem__, rest))
        return np.frombuffer(packed, np.int32)

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes of the tokens, halves concatenated."""
        if len(tokens) > DECODED:
            half = len(tokens) // 2
            return self.decode(tokens[:half]) + self.decode(tokens[half:])
        size = self._length[tokens]
        place = np.arange(size.sum()) + np.repeat(self._begin[tokens] - np.cumsum(size) + size, size)
        return self._all[place].tobytes()


@cache
def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """Of a file of ranks (base64 of the bytes, a space, the rank); by default the public one and its pattern. One for each worker."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, f)}
    return Vocabulary(ranks, pattern or public_tokenizers.PATTERN)


def _tokens(texts: pa.Array, words: Vocabulary) -> pa.Array:
    each = [words.encode(t) for t in texts.to_pylist()]
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, each)]).astype(np.int32), pa.array(np.concatenate([*each, np.zeros(0, np.int32)]).astype(np.int32)))


def _bytes(tokens: pa.Array, words: Vocabulary) -> pa.Array:
    flat, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
    return pa.array([words.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())


def _replaced(rows: DataFrame, column: str, change: Callable[[pa.Array, Vocabulary], pa.Array], path: str | None, pattern: str | None, name: str, kind: str) -> DataFrame:
    """rows with the column changed by means of the vocabulary, under another name and type; other columns pass as they are."""
    at, fields = rows.columns.index(column), [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    fields[at] = f"{name} {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                columns = [change(c, words) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, [name if i == at else f for i, f in enumerate(part.schema.names)])

    return rows.mapInArrow(run, ", ".join(fields))


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, tokens (array of int): one row for each row of docs, of which only doc_id and text are read.

    The tokens are those of the tiktoken library's encode_ordinary: strings of special tokens are ordinary text. A null text
    counts as empty and has no tokens; repeated rows and null doc_ids are kept. path and pattern name another vocabulary.
    """
    return _replaced(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", _tokens, path, pattern, "tokens", "array<int>")


def decoded(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """rows with bytes (binary) in place of tokens; tokens that cut a character give parts of one, so these are bytes and no text. Null tokens count as none."""
    return _replaced(rows.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<int>"))), "tokens", _bytes, path, pattern, "bytes", "binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again. A very long text costs a number a token; a long match of the pattern is encoded by halves."""
    tokens = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " ").cast("binary"), 256)
    described = tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), "tokens")
    return decoded(described).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
