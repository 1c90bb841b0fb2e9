"""License scans: an exact set-similarity join between license templates and the blocks of all texts.

Blocks are all runs of as many consecutive words as a template has, and a quarter more. A block holds a template if it
has at least the threshold's share of the template's distinct tokens. Tokens are ordered by how often the whole corpus
has them: a block that reaches the threshold has one of the template's prefix tokens (its rarest ones), so only places of
these are looked at; texts without enough tokens of the template (length filter) and places of prefix tokens round which
too few tokens come later in the order (positional filter) go unread. Phrases are templates with all tokens, in their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rillwise.llm import text as tx

THRESHOLD = 0.8
SLACK = 1.25

# Phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that the licenses ask for, by label.
TEMPLATES = {
    "apache-name": "apache license version 2 0",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "cc by nc",
    "cc-by-sa": "cc by sa",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-name": "the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
}


@dataclass
class Template:
    label: str
    tokens: np.ndarray  # ids in the order of the text
    ordered: bool
    least: int = 0  # distinct tokens that a block must share
    order: np.ndarray | None = None  # distinct tokens by frequency, the rarest first
    prefix: np.ndarray | None = None


class Templates:
    """Templates over one vocabulary (sorted word hashes)."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], threshold: float):
        texts = [(label, phrase, True) for phrase, label in phrases.items()] + [(label, text, False) for label, text in templates.items()]
        words = tx.Words(tx.lower([t for _, t, _ in texts]), tx.ALNUM)
        h = words.hashes()
        self.vocabulary = np.unique(h)
        self.all = []
        for (label, _, ordered), a, b in zip(texts, words.ptr[:-1], words.ptr[1:]):
            tokens = np.searchsorted(self.vocabulary, h[a:b])
            n = len(np.unique(tokens))
            self.all.append(Template(label, tokens, ordered, n if ordered else math.ceil(threshold * n - 1e-9)))

    def ids(self, words: tx.Words) -> np.ndarray:
        """Of each word its place in the vocabulary, or -1."""
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def order(self, counts: np.ndarray) -> None:
        """Prefixes by global frequency: of n tokens, n - least + 1 rarest ones; later ones leave too few behind them."""
        for t in self.all:
            own = np.unique(t.tokens)
            own = own[np.lexsort((own, counts[own]))]
            t.order, t.prefix = own, own[: len(own) - t.least + 1]


def token_counts(docs: DataFrame, templates: Templates) -> np.ndarray:
    """How often all texts have each token of the templates."""
    shared = docs.sparkSession.sparkContext.broadcast(templates)  # bounded by the templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(shared.value.vocabulary), np.int64)
        for batch in batches:
            raw = tx.lower(batch["text"])
            for part in tx.chunks(raw):
                ids = shared.value.ids(tx.Words(raw[part], tx.ALNUM))
                n += np.bincount(ids[ids >= 0], minlength=len(n))
        yield pd.DataFrame({"token": np.arange(len(n)), "n": n})

    counts = np.zeros(len(templates.vocabulary), np.int64)
    for row in docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    return counts


def phrase_places(ids: np.ndarray, template: Template) -> list[int]:
    """Starts of the phrase's words in a row. Looked for where its rarest token is."""
    rare = template.prefix[0]
    first = int(np.flatnonzero(template.tokens == rare)[0])
    n = len(template.tokens)
    starts = np.flatnonzero(ids == rare) - first
    return [int(s) for s in starts if s >= 0 and s + n <= len(ids) and (ids[s : s + n] == template.tokens).all()]


def _seeds(ids: np.ndarray, template: Template, size: int) -> list[int]:
    """Places of prefix tokens that may be the first token, in the order of frequency, which a block shares with the template.

    Positional filter: after a token of rank i the template has n - 1 - i tokens, and what the words round the place hold
    of these must do with it.
    """
    own, n = template.order, len(template.order)
    rank = np.full(int(max(own.max(), ids.max())) + 2, n)  # the last entry is that of -1: no token
    rank[own] = np.arange(n)
    rank = rank[ids]
    out = []
    for p in np.flatnonzero(rank <= n - template.least):
        near = rank[max(0, p - size + 1) : p + size]
        if 1 + len(np.unique(near[(near > rank[p]) & (near < n)])) >= template.least:
            out.append(int(p))
    return out


def blocks(ids: np.ndarray, template: Template) -> list[tuple[int, int, float]]:
    """(start, end, containment) of each text block that holds the template.

    A block begins at a token of the template and has as many words as the template and a quarter more; those that reach
    the threshold and overlap are one, from its first token to behind its last, with the largest containment of them.
    """
    n = len(template.order)
    there = np.isin(ids, template.order)
    if len(np.unique(ids[there])) < template.least:  # length filter
        return []
    size = math.ceil(SLACK * len(template.tokens))
    seeds = _seeds(ids, template, size)
    if not seeds:
        return []
    places = np.flatnonzero(there)
    gap = np.searchsorted(seeds, places)
    seeds_ = np.r_[-size, seeds, len(ids) + size]
    near = places[(places - seeds_[gap] < size) | (seeds_[gap + 1] - places < size)].tolist()
    out: list[tuple[int, int, float]] = []
    held: dict[int, int] = {}
    behind = 0
    for begin, p in enumerate(near):
        while behind < len(near) and near[behind] < p + size:
            held[ids[near[behind]]] = held.get(ids[near[behind]], 0) + 1
            behind += 1
        if len(held) >= template.least:
            start, end, share = p, near[behind - 1] + 1, len(held) / n
            if out and start < out[-1][1]:
                start, share = out[-1][0], max(share, out.pop()[2])
            out.append((start, end, share))
        held[ids[p]] -= 1
        if not held[ids[p]]:
            del held[ids[p]]
    return out


def license_blocks(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (label, start) of the phrases, matches (label, start, end, containment): every block that reaches the threshold.

    One row for each row of docs, of which doc_id and text are read; words are runs of letters, digits and characters
    beyond ASCII, A-Z in lower case. Null and empty texts have no words and no matches. Equal templates match alike. A very
    long text is read in one task; only its places round prefix tokens are looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tx.small_batches(docs.sparkSession)
    prepared = Templates(phrases, templates, threshold)
    prepared.order(token_counts(docs, prepared))
    shared = docs.sparkSession.sparkContext.broadcast(prepared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = shared.value
        rare = np.unique(np.concatenate([t.prefix for t in templates.all]))
        for batch in batches:
            raw, docs = tx.lower(batch["text"]), batch["doc_id"].to_numpy()
            for part in tx.chunks(raw):
                words = tx.Words(raw[part], tx.ALNUM)
                ids, n = templates.ids(words), np.diff(words.ptr)
                some = np.add.reduceat(np.r_[np.isin(ids, rare), False].astype(np.int64), np.minimum(words.ptr[:-1], len(ids))) * (n > 0)
                places, matches = [[] for _ in n], [[] for _ in n]
                for i in np.flatnonzero(some):
                    own = ids[words.ptr[i] : words.ptr[i + 1]]
                    for t in templates.all:
                        if t.ordered:
                            places[i] += [{"label": t.label, "start": s} for s in phrase_places(own, t)]
                        else:
                            matches[i] += [{"label": t.label, "start": a, "end": b, "containment": c} for a, b, c in blocks(own, t)]
                yield pd.DataFrame({"doc_id": docs[part], "n_words": n, "places": places, "matches": matches})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_words long, places array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,end:long,containment:double>>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its phrases, its blocks (label:start:end) and labels."""
    found = license_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("places.label")
    contained = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, F.col("matches.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(contained).alias("score"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"])), ",").alias("blocks"),
    )
