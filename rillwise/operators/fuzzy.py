"""Fuzzy matching of names by the similarity ratio of their tokens.

Texts are compared once however often they meet: pairs of texts give distinct pairs of tokens, of which those that lengths
and letters don't rule out have their ratio worked out, and what is similar is joined back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rillwise.functions.names import distinctive_tokens, street_types_agree, tokens
from rillwise.store import saved

RATIO = 0.8


def _matrix(texts: list[str]) -> np.ndarray:
    """Code points, a row for each text, -1 after its end."""
    out = np.full((len(texts), max(map(len, texts), default=0)), -1, np.int64)
    for row, text in zip(out, texts):
        row[: len(text)] = [ord(c) for c in text]
    return out


def _longest(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and begin in a and b of the longest common block of each row within [lo, hi) of both; the first in a, then in b, of equals."""
    n, at = len(a), np.arange(b.shape[1])
    size, start = np.zeros(n, np.int64), np.zeros((2, n), np.int64)
    inside = (at >= lo[1][:, None]) & (at < hi[1][:, None])
    run = np.zeros((n, b.shape[1] + 1), np.int64)
    for i in range(a.shape[1]):
        equal = (a[:, i : i + 1] == b) & inside & ((i >= lo[0]) & (i < hi[0]))[:, None]
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        most = run[:, 1:].max(axis=1, initial=0)
        better = most > size
        size[better] = most[better]
        start[0, better] = i + 1 - most[better]
        start[1, better] = run[better, 1:].argmax(axis=1) + 1 - most[better]
    return size, start[0], start[1]


def ratios(one: list[str], other: list[str]) -> np.ndarray:
    """Twice the letters in matching blocks over the letters of both: the longest common block, then the longest on either side of it, and so on.

    All pairs go through each step together. Two empty texts are equal (1).
    """
    a, b = _matrix(one), _matrix(other)
    sizes = np.array([[len(x) for x in one], [len(x) for x in other]], np.int64).reshape(2, len(one))
    matched, pair, lo, hi = np.zeros(len(one), np.int64), np.arange(len(one)), np.zeros((2, len(one)), np.int64), sizes.copy()
    while len(pair):
        size, i, j = _longest(a[pair], b[pair], lo, hi)
        np.add.at(matched, pair, size)
        begin, end = np.stack([i, j]), np.stack([i + size, j + size])
        pair, lo, hi = np.concatenate([pair, pair]), np.concatenate([lo, end], axis=1), np.concatenate([begin, hi], axis=1)
        left = np.concatenate([size, size]) > 0
        left &= (lo < hi).all(axis=0)
        pair, lo, hi = pair[left], lo[:, left], hi[:, left]
    total = sizes.sum(axis=0)
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


@F.pandas_udf(T.DoubleType())
def similarity(one: pd.Series, other: pd.Series) -> pd.Series:
    out = [ratios(list(one[i : i + 2000]), list(other[i : i + 2000])) for i in range(0, len(one), 2000)]
    return pd.Series(np.concatenate(out) if out else np.zeros(0))


def _common_letters(w: Column, h: Column) -> Column:
    """Letters that both hold, each as often as the one that holds it less: no matching has more."""
    held = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.filter(F.split(w, ""), lambda c: c != "")), F.lit(0), lambda s, c: s + F.least(held(w, c), held(h, c)))


def similar_tokens(pairs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The distinct (w, h) whose similarity is at least the ratio. Lengths and letters bound it before it is worked out."""
    w, h = F.col("w"), F.col("h")
    both = F.length(w) + F.length(h)
    may = lambda letters: 2 * letters >= ratio * both - 1e-9
    short = saved(pairs.distinct(), "token-pairs").filter(may(F.least(F.length(w), F.length(h)))).filter(may(_common_letters(w, h)))
    return short.filter(similarity(w, h) >= ratio).select("w", "h")


def matched_names(rows: DataFrame, query: str, name: str, ratio: float = RATIO) -> DataFrame:
    """(query, name, named) of the distinct pairs of texts in rows: whether every distinctive token of the query is similar to a token of the name
    or stands in the name's joined tokens, and street types that both name agree. Queries without a distinctive token match nothing.
    """
    texts = rows.select(F.col(query).alias("q"), F.col(name).alias("n")).filter("q is not null and n is not null").distinct()
    want, have = F.array_distinct(distinctive_tokens(F.col("q"))), tokens(F.col("n"))
    # written: what is asked of the tokens would else move below the distinct, to every row, and the rows would be made anew for each use
    texts = saved(texts.select("q", "n", want.alias("want"), have.alias("have"), street_types_agree(F.col("q"), F.col("n")).alias("agree")), "names")
    open_ = texts.filter("agree and size(want) > 0").withColumn("w", F.explode("want")).withColumn("held", F.contains(F.array_join("have", ""), F.col("w")))
    asked = open_.filter("not held").select("w", F.explode(F.array_distinct("have")).alias("h"))
    near = similar_tokens(asked, ratio).groupBy("w").agg(F.collect_set("h").alias("near"))  # as many as tokens are similar to one
    found = open_.join(near, "w", "left").groupBy("q", "n").agg(F.min(F.col("held") | F.coalesce(F.arrays_overlap("have", "near"), F.lit(False))).alias("named"))
    return texts.select("q", "n").join(found, ["q", "n"], "left").select(F.col("q").alias(query), F.col("n").alias(name), F.coalesce("named", F.lit(False)).alias("named"))
