"""License scan: base phrases, and an exact set-similarity join of text blocks with license
templates by containment.

Tokens of the templates are ordered by their number of places in the whole corpus, rarest
first. A block can reach a template's threshold only if it holds a token of the template's
prefix (prefix filter), has enough template tokens at all (length filter), and enough are left
on both sides after the first common one (positional filter). What passes is compared in full,
so every block that meets the threshold is found. The templates are the stated, bounded side;
each task holds them, and documents are scanned where they lie.

Blocks are overlapping windows of the whole document's words, whatever the line breaks, in which any
passage of twice the longest template lies whole; and each line, a longer one likewise in windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN_ALNUM as _BETWEEN
from .common import slices, text_buffers, word_hashes, word_spans

# Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices and opening sentences of common licenses, in lower case.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache", "licensed under the apache license version"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
            "terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial international license"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

THRESHOLD = 0.9
#: Least words of a window, and least step between windows.
WINDOW, STEP = 96, 48


def _hash(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), _BETWEEN)
    return word_hashes(raw, starts, ends)


class Vocabulary:
    """Token numbers of the templates' and base phrases' words, by hash and checked by bytes."""

    def __init__(self, phrases: list[str]):
        self.words = sorted({w for p in phrases for w in p.split()})
        hashes = _hash(self.words)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token number of each word, -1 for others."""
        h = word_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        ids = np.where(self.sorted[at] == h, self.number[at], -1)
        for k in np.flatnonzero(ids >= 0):
            if raw[starts[k]:ends[k]].tobytes().lower() != self.words[ids[k]].encode():
                ids[k] = -1
        return ids


def token_places(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Places of each template token in all documents (at most one row per token is collected)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                part = raw[offsets[a]:offsets[b]]
                starts, ends, _ = word_spans(part, offsets[a:b + 1] - offsets[a], _BETWEEN)
                h = word_hashes(part, starts, ends)
                at = np.minimum(np.searchsorted(vocabulary.sorted, h), len(vocabulary.sorted) - 1)
                total += np.bincount(vocabulary.number[at[vocabulary.sorted[at] == h]],
                                     minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])],
                                         names=["token", "n"])

    rows = (docs.select(F.col("text").cast("string")).mapInArrow(count, "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(len(vocabulary.words), np.int64)
    for r in rows:
        out[r["token"]] = r["n"]
    return out


class Join:
    """The templates' side of the join: rank-ordered token sets and an index of prefixes."""

    def __init__(self, templates: list[tuple[str, str]], vocabulary: Vocabulary,
                 places: np.ndarray, threshold: float):
        order = np.lexsort((np.arange(len(places)), places))  # rarest first
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        number = {w: i for i, w in enumerate(vocabulary.words)}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({int(self.rank[number[w]]) for w in text.split()}) for _, text in templates]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (tokens, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for j, token in enumerate(tokens[:len(tokens) - need + 1]):
                self.index.setdefault(token, []).append((t, j))
        self.prefix = np.zeros(len(places), bool)
        self.prefix[[k for k, r in enumerate(self.rank) if int(r) in self.index]] = True

    def matches(self, block: list[int]) -> dict[int, float]:
        """Containment of each template that the block (sorted ranks) holds to the threshold."""
        found: dict[int, float] = {}
        seen: set[int] = set()
        held = set(block)
        for i, token in enumerate(block):
            for t, j in self.index.get(token, ()):
                need = self.need[t]
                if t in seen or len(block) < need:  # length filter
                    continue
                if 1 + min(len(block) - i, len(self.sets[t]) - j) - 1 < need:  # positional filter
                    continue
                seen.add(t)
                common = sum(x in held for x in self.sets[t])
                if common >= need:
                    found[t] = common / len(self.sets[t])
        return found


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    Base places are counted in the whole text, across lines. ``score`` is 1 with a base place,
    otherwise the best containment found, 0 if none. Defined cases: a null or empty text has
    no words, empty label strings, null word places and score 0; repeated rows are scanned
    each; no rows give no rows; other columns are not read; texts of any length are scanned
    whole.
    """
    vocabulary = Vocabulary([*BASE, *(t for _, t in templates)])
    join = Join(templates, vocabulary, token_places(docs, vocabulary), threshold)
    number = {w: i for i, w in enumerate(vocabulary.words)}
    step = max(STEP, 2 * max((len(t.split()) for _, t in templates), default=0))
    window = max(WINDOW, 2 * step)
    phrases = [([number[w] for w in phrase.split()], label) for phrase, label in BASE.items()]
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            rows = []
            for a, b in slices(offsets):
                rows += _scan(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a],
                              vocabulary, join, phrases, window, step)
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def _windows(at: np.ndarray, marked: np.ndarray, window: int, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of the places ``at`` that the windows with a marked word hold; a window that reaches
    no further word than the one before it is left out."""
    low = np.arange(at[0], at[-1] + 1, step)
    a, b = np.searchsorted(at, low), np.searchsorted(at, low + window)
    held = np.concatenate([[0], np.cumsum(marked)])
    keep = held[b] > held[a]
    keep[1:] &= b[1:] > b[:-1]
    return zip(a[keep].tolist(), b[keep].tolist(), strict=True)


def _scan(raw, offsets, vocabulary, join, phrases, window=WINDOW, step=STEP) -> list[tuple]:
    starts, ends, first = word_spans(raw, offsets, _BETWEEN)
    ids = vocabulary.ids(raw, starts, ends)
    n = len(ids)
    row = np.searchsorted(first, np.arange(n), "right") - 1
    rows = len(offsets) - 1
    places: list[list[int]] = [[] for _ in range(rows)]
    base: list[set[str]] = [set() for _ in range(rows)]
    for tokens, label in phrases:
        m = len(tokens)
        hit = np.flatnonzero(ids[:max(0, n - m + 1)] == tokens[0])
        for j in range(1, m):
            hit = hit[ids[hit + j] == tokens[j]]
        for k in hit[row[hit] == row[hit + m - 1]]:
            places[row[k]].append(int(k - first[row[k]]))
            base[row[k]].add(label)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    labels = [set(x) for x in base]
    best = [1.0 if p else 0.0 for p in places]
    known = np.flatnonzero(ids >= 0)
    where, which = row[known], line[known]
    marked = join.prefix[ids[known]]
    blocks: set[tuple[int, int]] = set()
    if marked.any():
        other = np.diff(where) != 0
        for cut in (other, other | (np.diff(which) != 0)):  # whole documents, then lines
            bounds = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(known)]])
            some = np.add.reduceat(marked, bounds[:-1], dtype=np.int64) > 0
            for g in np.flatnonzero(some):
                x, y = int(bounds[g]), int(bounds[g + 1])
                blocks.update((x + a, x + b) for a, b in _windows(known[x:y], marked[x:y], window, step))
    ranks = join.rank[ids[known]]
    for x, y in blocks:
        r = where[x]
        for t, share in join.matches(sorted(set(ranks[x:y].tolist()))).items():
            labels[r].add(join.labels[t])
            best[r] = max(best[r], share)
    counts = np.diff(first)
    return [(int(counts[r]), len(places[r]), min(places[r], default=None), max(places[r], default=None),
             ",".join(sorted(base[r])), ",".join(sorted(labels[r])), best[r]) for r in range(rows)]
