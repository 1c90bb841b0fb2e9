"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, functions as F

#: Words are runs of bytes other than these.
WHITE = np.ones(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of ASCII letters, digits and all bytes beyond ASCII.
ALNUM = np.array([chr(b).isalnum() or b > 127 for b in range(256)])

_U = np.uint64
_JOIN, _ONE, _TWO = _U(0xD1342543DE82EF95), _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Longer words are hashed one by one.
LONG = 64
#: Masks that keep so many bytes of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

#: Rows of an Arrow batch: texts are long, and Spark's own 10,000 of them fill a worker.
BATCH_ROWS = 2000


def small_batches(spark) -> None:
    """From now on the session sends workers BATCH_ROWS rows at once, unless it was told another number than Spark's own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def content_key(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def utf8(texts) -> list[bytes]:
    """Null counts as empty."""
    return [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]


def lower(texts) -> list[bytes]:
    """As utf8, A-Z in lower case."""
    return [t.lower() for t in utf8(texts)]


def chunks(raw: list[bytes], limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of about limit bytes, at least one text each: numpy's temporaries stay small."""
    start = size = 0
    for i, t in enumerate(raw):
        if size and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 1
    if start < len(raw):
        yield slice(start, len(raw))


def digest64(data: bytes) -> int:
    """The first 64 bits of BLAKE2b: equal ones of unequal data can't be constructed."""
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose result bits all depend on all input bits."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Words:
    """start and end (bytes in buf) of each word, ptr: the first word of each text, and one more; buf holds a line feed after each text."""

    def __init__(self, raw: list[bytes], word: np.ndarray = WHITE):
        joined = b"\n".join(raw) + b"\n"
        self.buf = np.frombuffer(joined, np.uint8)
        edge = np.diff(word[self.buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.cumsum([0, *(len(t) + 1 for t in raw)])
        self.ptr = np.searchsorted(self.start, self.first)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """Of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    @cached_property
    def _lanes(self) -> np.ndarray:
        """The eight bytes from each place in buf on, as one number."""
        padded = np.r_[self.buf, np.zeros(LONG + 8, np.uint8)]
        return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))

    def hashes(self, most: int = 1 << 62) -> np.ndarray:
        """64-bit hashes of the words, or of their first bytes.

        Words are read eight bytes at a time into two states that each number mixes; the few beyond LONG bytes have digest64.
        """
        size = np.minimum(self.end - self.start, most)
        one, two = mix(size.astype(_U) * _ONE), size.astype(_U) * _TWO
        live, start, left = slice(None), self.start, size
        for at in range(0, LONG, 8):
            if at:
                some = np.flatnonzero(left > 8)
                if not len(some):
                    break
                live, start, left = some if at == 8 else live[some], start[some] + 8, left[some] - 8
            lane = self._lanes[start] & _KEEP[np.minimum(left, 8)]
            one[live] = mix(one[live] * _JOIN + lane)
            two[live] = (two[live] ^ (lane + (lane << _U(23)))) * _TWO
            two[live] ^= two[live] >> _U(31)
        out = mix(one + two * _ONE)
        for i in np.flatnonzero(size > LONG):
            out[i] = digest64(self.buf[self.start[i] : self.start[i] + size[i]].tobytes())
        return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (over text borders too; mask with runs).

    Runs are put together from runs of 1, 2, 4 ... words, each join mixed, so that no linear relation of words cancels out.
    """
    if len(words) < n:
        return np.zeros(0, _U)
    total, out, at, size = len(words) - n + 1, None, 0, 1
    while True:
        if n & size:
            part = words[at : at + total]
            out = part if out is None else mix(out * _JOIN + part)
            at += size
        if at == n:
            return out
        words = mix(words[:-size] * _JOIN + words[size:])
        size *= 2


def runs(ptr: np.ndarray, n: int) -> np.ndarray:
    """Of each position whether n words from it on lie in one text; ptr as in Words."""
    total = int(ptr[-1])
    ends = np.repeat(ptr[1:], np.diff(ptr))
    return np.arange(total) + n <= ends


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
