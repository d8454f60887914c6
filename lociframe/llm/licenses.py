"""License statements: places of fixed phrases, and an exact set-similarity join with templates.

A text block is a window of as many words as a template has, and a quarter more (two at
least), that begins with a word of the template; line breaks do not count. It meets the template when it contains
at least ``threshold`` of the template's distinct tokens, all those that tell the template
from its siblings, and none that only a sibling has. Tokens stand in the order of their global
frequency, rarest first, counted over all texts. To meet the threshold a block must hold one
of the first |T| - needed + 1 tokens of a template T (prefix filter), have at least ``needed``
words of the template (length filter), and have enough tokens left after the place where the
two orders first meet (positional filter). What passes is compared in full, so each block
that meets the threshold is found and no other.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered.

Defined cases: null text counts as empty; a text without words has no places, no labels and
score 0; a template without tokens meets nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm import text as tx

# The phrases whose places are counted, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Template:
    """A statement's words, the label that a block meeting it gets, words it must have and words it must not have."""

    label: str
    text: str
    needs: str = ""
    lacks: str = ""

    @property
    def tokens(self) -> list[str]:
        return list(dict.fromkeys(self.text.split()))

    @property
    def window(self) -> int:
        n = len(self.text.split())
        return n + max(2, n // 4)


# Short statements and the first sentences of common licenses' notices.
TEMPLATES = (
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", "affero"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org", "compliance apache"),
    Template("boost-1.0", "distributed under the boost software license version 1 0", "boost"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4", "nc sa nd"),
    Template("cc-by-4.0", "licensed under the creative commons attribution 4 0 international license", "commons attribution", "noncommercial sharealike noderivatives"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "nc"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "sa"),
    Template("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", "waived"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu 3", "lesser affero"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu", "lesser affero"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser"),
    Template("mit", "released under the mit license", "mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "charge obtaining"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    Template("rights-reserved", "all rights reserved"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    Template("zlib", "this software is provided as is without any express or implied warranty", "warranty"),
)


def _hashes(words: Sequence[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return tx.words(data, np.array([0, len(data)]), tx.ALNUM).hashes if words else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens of the templates, in global order: rank r has the r-th rarest."""

    hashes: np.ndarray  # by rank
    templates: Sequence[Template]
    ranks: list[np.ndarray]  # each template's sorted ranks
    needs: list[np.ndarray]
    lacks: list[np.ndarray]
    threshold: float

    def needed(self, t: int) -> int:
        return max(1, int(np.ceil(self.threshold * len(self.ranks[t]) - 1e-9)))


def tokens_of(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in f"{t.text} {t.needs} {t.lacks}".split()})


def frequencies(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each of the template tokens occurs in all texts."""
    wanted = _hashes(tokens)
    order = np.argsort(wanted)
    ranked = wanted[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, data, offsets in tx.slices(batch):
                h = tx.words(data, offsets, tx.ALNUM).hashes
                at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                total += np.bincount(at[ranked[at] == h], minlength=len(tokens))
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(tokens)), "n": total})

    counted = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = dict.fromkeys(tokens, 0)
    for at, n in counted.collect():  # one row a template token
        out[tokens[order[at]]] = n
    return out


def vocabulary(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = 0.8) -> Vocabulary:
    tokens = tokens_of(templates)
    n = frequencies(docs, tokens)
    order = sorted(tokens, key=lambda w: (n[w], w))
    rank = {w: i for i, w in enumerate(order)}
    ranks = lambda text: np.array(sorted({rank[w] for w in text.split()}), np.int64)
    return Vocabulary(_hashes(order), templates, *([ranks(x) for x in xs] for xs in zip(*((t.text, t.needs, t.lacks) for t in templates), strict=True)), threshold)


def meets(block: np.ndarray, t: int, v: Vocabulary) -> float:
    """How much of template ``t`` a block contains, 0 where it does not meet it; ``block`` has the sorted distinct ranks of its words."""
    template, need = v.ranks[t], v.needed(t)
    prefix = template[: len(template) - need + 1]
    mine = block[np.isin(block, template, assume_unique=True)]
    if len(mine) < need:
        return 0.0
    at = np.searchsorted(mine, prefix)
    hit = np.flatnonzero((at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == prefix))
    if not len(hit) or 1 + min(len(template) - hit[0] - 1, len(mine) - at[hit[0]] - 1) < need:
        return 0.0
    if not np.isin(v.needs[t], block).all() or np.isin(v.lacks[t], block).any():
        return 0.0
    return len(mine) / len(template)


def blocks_of(known: np.ndarray, rank: np.ndarray, ends: np.ndarray, t: int, v: Vocabulary) -> list[tuple[int, float]]:
    """(place in ``known``, share) of the blocks that meet template ``t``: of blocks that overlap the fullest, the first of equals.

    ``known`` has the places of words of the vocabulary, ``rank`` their ranks, and ``ends``
    where the text of each ends.
    """
    template, need, size = v.ranks[t], v.needed(t), v.templates[t].window
    own = np.zeros(len(v.hashes), np.int64)
    own[template] = 1
    rare = np.zeros(len(v.hashes), np.int64)
    rare[template[: len(template) - need + 1]] = 1
    hits = np.flatnonzero(own[rank])
    if len(hits) < need:
        return []
    to = np.searchsorted(known, np.minimum(known[hits] + size, ends[hits]))  # the block's words of the vocabulary end here
    words, rares = (np.append(0, np.cumsum(x[rank])) for x in (own, rare))
    maybe = np.flatnonzero((words[to] - words[hits] >= need) & (rares[to] > rares[hits]))
    out: list[tuple[int, float]] = []
    last = -1
    for k in maybe:
        a, b = hits[k], to[k]
        share = meets(np.unique(rank[a:b]), t, v)
        if not share:
            continue
        if out and known[a] < last:
            if share > out[-1][1]:
                out[-1] = int(a), share
        else:
            out.append((int(a), share))
        last = known[a] + size if known[a] + size <= ends[a] else ends[a]
    return out


def places(w: tx.Words, phrase: np.ndarray) -> np.ndarray:
    """Indices of words with which the phrase begins, within one text."""
    n = len(w.hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for j, h in enumerate(phrase):
        ok &= w.hashes[j : j + n] == h
    at = np.flatnonzero(ok)
    return at[np.repeat(w.first[1:], w.counts)[at] - at >= len(phrase)]


def scan(docs: DataFrame, v: Vocabulary, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) what is found in its whole text.

    doc_id, n_words, n_base (places of phrases), first_word, last_word (of these, from 0),
    base_labels, labels (with the templates' labels, both sorted and comma-joined), score (the
    largest share of a template in a block that meets it, else 0), and blocks: the matches as
    (start in words from 0, label, share), of overlapping blocks the fullest.
    """
    spoken = [(_hashes(p.split()), label) for p, label in phrases.items()]
    order = np.argsort(v.hashes)
    ranked = v.hashes[order]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, data, offsets in tx.slices(batch):
                yield one(cut, tx.words(data, offsets, tx.ALNUM))

    def one(cut: pa.RecordBatch, w: tx.Words) -> pa.RecordBatch:
        n = cut.num_rows
        text_of = w.text_of()
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in spoken:
            at = places(w, phrase)
            doc = text_of[at]
            n_base += np.bincount(doc, minlength=n)
            np.minimum.at(first, doc, at - w.first[doc])
            np.maximum.at(last, doc, at - w.first[doc])
            for d in np.unique(doc):
                base[d].add(label)
        labels, score = [set(b) for b in base], np.zeros(n)
        blocks: list[list[dict]] = [[] for _ in range(n)]
        at = np.minimum(np.searchsorted(ranked, w.hashes), len(ranked) - 1)
        known = np.flatnonzero(ranked[at] == w.hashes)
        rank, doc_of = order[at[known]], text_of[known]
        for t, template in enumerate(v.templates):
            for k, share in blocks_of(known, rank, w.first[doc_of + 1], t, v):
                d = int(doc_of[k])
                labels[d].add(template.label)
                score[d] = max(score[d], share)
                blocks[d].append({"start": int(known[k] - w.first[d]), "label": template.label, "share": share})
        none = n_base == 0
        join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                cut.column(cut.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(w.counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                join(base), join(labels), pa.array(score), pa.array(blocks, pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
        )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start: long, label: string, share: double>>"
    return docs.select("doc_id", "text").mapInArrow(find, schema)
