"""Benchmark decontamination by latent semantic retrieval.

The benchmark's words are the vocabulary; other words of the corpus have no weight against it.
Passages are windows of ``WINDOW`` words, every ``STEP`` words, of documents and of items. Their
TF-IDF vectors, with counts over all documents, span the term space whose leading directions a
randomised SVD finds, fitted on the items and on all documents: each task multiplies its passages
with a thin matrix and back, and the sums, one row per term, are added by Spark. Passages whose latent vectors have a cosine of at least
``COSINE`` with a window of an item are candidates. A candidate's surroundings are compared with
the whole item: the longest common subsequence of their content words, and the share of the item's
last sentence (its answer) that is there, decide.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN_ALNUM, slices, text_buffers, word_hashes, word_spans, without, written

WINDOW, STEP = 32, 16
#: Latent dimensions, further ones while they are sought, and passes of the power iteration.
RANK, OVER, PASSES = 96, 16, 2
COSINE = 0.6
#: Share of passages from which a word is no content word, and least content words of an item.
COMMON, LEAST_WORDS = 0.01, 6
#: Share of an item's content words in common order: enough alone, and enough with its answer.
ALONE, WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
#: Items that one search holds at a time; more items are searched in blocks of so many.
BLOCK_ITEMS = 1000
#: Vocabulary up to which a task adds up its passages' products of terms before it multiplies.
GRAM_TERMS = 4096
#: Tokens of one vectorised step, and passages whose vectors are summed together.
STEP_TOKENS, SUM_ROWS = 50_000, 512


def _words(text: str | None) -> list[str]:
    return [w.decode() for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())]


@dataclass
class Items:
    """The items of a block: vocabulary, content words in order, answers, latent windows."""
    ids: list[int]
    words: list[list[str]]
    answers: list[set[str]]
    vocabulary: list[str] = field(default_factory=list)
    hashes: np.ndarray = field(default=None)
    number: np.ndarray = field(default=None)
    slots: np.ndarray = field(default=None)
    idf: np.ndarray = field(default=None)
    content: np.ndarray = field(default=None)
    tokens: list[np.ndarray] = field(default_factory=list)
    masks: list[dict[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Items:
        ids, words, answers = [], [], []
        for item, text in rows:
            own = _words(text)
            if own:
                ids.append(item)
                words.append(own)
                last = [s for s in re.split(r"[.!?\n]+", text) if _words(s)][-1]
                answers.append(set(_words(last)))
        self = cls(ids, words, answers)
        self.vocabulary = sorted({w for own in words for w in own})
        raw = np.frombuffer(" ".join(self.vocabulary).encode(), np.uint8)
        starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), BETWEEN_ALNUM)
        h = word_hashes(raw, starts, ends)
        order = np.argsort(h)
        self.hashes, self.number = h[order], order
        # whether some word's hash begins with these 20 bits: most words need no search
        self.slots = np.zeros(1 << 20, bool)
        self.slots[self.hashes >> np.uint64(44)] = True
        return self

    def lookup(self, raw: np.ndarray, offsets: np.ndarray):
        """(row, place, term) of the vocabulary's words in the rows of a slice, words per row."""
        starts, ends, first = word_spans(raw, offsets, BETWEEN_ALNUM)
        h = word_hashes(raw, starts, ends)
        known = np.flatnonzero(self.slots[h >> np.uint64(44)])
        h = h[known]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[at] == h
        known, at = known[same], at[same]
        row = np.searchsorted(first, known, "right") - 1
        return row, known - first[row], self.number[at], np.diff(first)

    def weigh(self, passages: int, holding: np.ndarray) -> None:
        """Weights and content words from the number of passages, and of those with each term."""
        self.idf = np.log((passages + 1) / (holding + 1)) + 0.1
        self.content = holding <= COMMON * passages
        number = {w: i for i, w in enumerate(self.vocabulary)}
        terms = [[number[w] for w in own] for own in self.words]
        for own in terms:  # an item of common words only is sought by all of them
            if self.content[own].sum() < LEAST_WORDS:
                self.content[own] = True
        self.tokens = [np.array([t for t in own if self.content[t]]) for own in terms]
        for own in self.tokens:
            masks: dict[int, int] = {}
            for i, t in enumerate(own.tolist()):
                masks[t] = masks.get(t, 0) | 1 << i
            self.masks.append(masks)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, term) occurrences of the items' windows, and the item of each window."""
        number = {w: i for i, w in enumerate(self.vocabulary)}
        window, term, item = [], [], []
        for k, own in enumerate(self.words):
            for a in range(0, max(1, len(own) - WINDOW + STEP), STEP):
                part = [number[w] for w in own[a:a + WINDOW] if self.content[number[w]]]
                window += [len(item)] * len(part)
                term += part
                item.append(k)
        return np.array(window), np.array(term), np.array(item)

    def shares(self, item: int, region: list[int]) -> tuple[float, float]:
        """Shares of the item's content words in the longest common subsequence with the region,
        and of its answer's content words that the region holds."""
        masks, n = self.masks[item], len(self.tokens[item])
        full = (1 << n) - 1
        row = full
        for t in region:
            m = masks.get(t)
            if m:
                u = row & m
                row = ((row + u) | (row - u)) & full
        held = {self.vocabulary[t] for t in region}
        number = {self.vocabulary[t] for t in self.tokens[item].tolist()}
        answer = self.answers[item] & number or number
        return (n - row.bit_count()) / n, len(answer & held) / len(answer)


def weighted(passage: np.ndarray, term: np.ndarray, idf: np.ndarray):
    """(passage, term, weight) of unit TF-IDF vectors, ordered by passage."""
    key, tf = np.unique(passage * len(idf) + term, return_counts=True)
    passage, term = key // len(idf), key % len(idf)
    w = (1 + np.log(tf)) * idf[term]
    edge = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    norm = np.sqrt(np.add.reduceat(w * w, edge)) if len(w) else w
    return passage, term, (w / np.repeat(norm, np.diff(np.append(edge, len(w))))).astype(np.float32), edge


def known_words(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n_words, places, terms) of every document that has words: the benchmark's words
    in it, as int32 bytes. This is the one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                row, place, term, words = items.lookup(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                place, term = place.astype(np.int32), term.astype(np.int32)
                edge = np.searchsorted(row, np.arange(b - a + 1))
                some = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(words[some].astype(np.int64)),
                     *(pa.array([x[edge[r]:edge[r + 1]].tobytes() for r in some], pa.binary()) for x in (place, term))],
                    names=["doc_id", "n_words", "places", "terms"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, places binary, terms binary")


def found_terms(tokens: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    """Number of passages of all documents, and of those that hold each term (summed by Spark)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(len(items.vocabulary), np.int64), 0
        for batch in batches:
            passages += int((-(-batch.column("n_words").to_numpy() // STEP)).sum())
            for _, _, place, term in _steps(batch, None):
                cell = (place // STEP) * len(total) + term
                total += np.bincount(np.unique(cell) % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(total[some], passages))], names=["term", "n"])

    got = tokens.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    holding, passages = np.zeros(len(items.vocabulary), np.int64), 0
    for r in got:
        if r["term"] < 0:
            passages = r["n"]
        else:
            holding[r["term"]] = r["n"]
    return passages, holding


def _steps(batch: pa.RecordBatch, content: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, base, place, term) of groups of documents of a batch, content words only if these
    are given; places are laid end to end with
    gaps, so that no window holds words of two documents; base: each document's first place."""
    ids, base, places, terms, at, held = [], [], [], [], WINDOW, 0
    for doc, p, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "places", "terms")), strict=True):
        place, term = np.frombuffer(p, np.int32).astype(np.int64), np.frombuffer(t, np.int32)
        if content is not None:
            ok = content[term]
            place, term = place[ok], term[ok]
        if not len(term):
            continue
        ids.append(doc)
        base.append(at)
        places.append(place + at)
        terms.append(term)
        at = (int(places[-1][-1]) // STEP + 2) * STEP + WINDOW
        held += len(term)
        if held >= STEP_TOKENS:
            yield ids, np.array(base), np.concatenate(places), np.concatenate(terms)
            ids, base, places, terms, at, held = [], [], [], [], WINDOW, 0
    if ids:
        yield ids, np.array(base), np.concatenate(places), np.concatenate(terms)


def _passages(place: np.ndarray, term: np.ndarray, idf: np.ndarray):
    """TF-IDF triples of the windows: each word is in two of them."""
    half = place // STEP
    return weighted(np.concatenate([half - 1, half]), np.concatenate([term, term]), idf)


def _sums(thin: np.ndarray, term: np.ndarray, w: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """thin[term] * w summed over each passage. Passages of equal length are summed together,
    ``SUM_ROWS`` at a time, one term of each in a step: their sums stay in the cache. The terms after
    the first are added in 8 lanes, as numpy adds."""
    size = np.diff(np.append(edge, len(term)))
    out = np.empty((len(edge), thin.shape[1]), np.result_type(thin, w))
    for n in np.unique(size).tolist():
        equal = np.flatnonzero(size == n)
        for a in range(0, len(equal), SUM_ROWS):
            own = equal[a:a + SUM_ROWS]
            rows = (thin[term[at]] * w[at, None] for at in (edge[own] + j for j in range(n)))
            total, left = next(rows), n - 1
            if left >= 8:
                lane = [next(rows) for _ in range(8)]
                for j in range(8, left - left % 8):
                    lane[j % 8] += next(rows)
                rest = ((lane[0] + lane[1]) + (lane[2] + lane[3])) + ((lane[4] + lane[5]) + (lane[6] + lane[7]))
            elif left:
                rest = next(rows)
            for row in rows:
                rest += row
            out[own] = total + rest if left else total
    return out


def _add_gram(gram: np.ndarray, passage: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
    """Adds w w' of every passage to the upper half of the flat ``gram``; terms ascend in a passage."""
    terms, at, apart = math.isqrt(len(gram)), np.arange(len(term)), 0
    while len(at):
        np.add.at(gram, term[at] * terms + term[at + apart], w[at] * w[at + apart])
        apart += 1
        at = at[at + apart < len(term)]
        at = at[passage[at] == passage[at + apart]]


def _multiplied(tokens: DataFrame, items: Items, thin: np.ndarray) -> np.ndarray:
    """A'(A thin) over the documents' passages A: tasks add up their own, Spark adds the tasks'.
    With a vocabulary of at most ``GRAM_TERMS`` a task forms A'A of its passages first."""
    k, thin = thin.shape[1], thin.astype(np.float32)
    terms = len(thin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, k))
        gram = np.zeros(terms * terms, np.float32) if terms <= GRAM_TERMS else None
        for batch in batches:
            for _, _, place, term in _steps(batch, items.content):
                passage, term, w, edge = _passages(place, term, items.idf)
                if gram is not None:
                    _add_gram(gram, passage, term, w)
                    continue
                down = _sums(thin, term, w, edge)
                back = np.repeat(down, np.diff(np.append(edge, len(w))), axis=0) * w[:, None]
                order = np.argsort(term, kind="stable")
                own, first = np.unique(term[order], return_index=True)
                total[own] += np.add.reduceat(back[order], first, axis=0)
        if gram is not None:
            upper = gram.reshape(terms, terms)
            total = upper @ thin + upper.T @ thin - upper.diagonal()[:, None] * thin
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, j].astype(np.float64)) for j in range(k))],
                                         names=["term", *(f"y{j}" for j in range(k))])

    rows = (tokens.mapInArrow(run, "term long, " + ", ".join(f"y{j} double" for j in range(k)))
            .groupBy("term").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(k)]).toPandas())
    out = np.zeros(thin.shape)
    out[rows["term"].to_numpy()] = rows.drop(columns="term").to_numpy()
    return out


def latent_directions(tokens: DataFrame, items: Items, weight: float = 1.0, rank: int = RANK, over: int = OVER,
                      passes: int = PASSES) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF matrix of the given
    documents' and the items' passages; each of the latter counts as ``weight`` passages."""
    terms = len(items.vocabulary)
    window, term, _ = items.windows()
    passage, term, w, _ = weighted(window, term, items.idf)
    own = np.zeros((int(window.max(initial=-1)) + 1, terms))
    own[passage, term] = w
    thin = np.linalg.qr(np.random.Generator(np.random.PCG64(1)).standard_normal((terms, min(terms, rank + over))))[0]
    for i in range(passes):
        image = _multiplied(tokens, items, thin) + weight * (own.T @ (own @ thin))
        if i < passes - 1:
            thin = np.linalg.qr(image)[0]
    value, vector = np.linalg.eigh(thin.T @ image)
    return thin @ vector[:, np.argsort(-value)[:rank]]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _search(tokens: DataFrame, items: Items, directions: np.ndarray) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer) of candidates that the comparison confirms."""
    window, term, item = items.windows()
    passage, term, w, edge = weighted(window, term, items.idf)
    queries = np.zeros((len(item), directions.shape[1]))
    queries[passage[edge]] = _sums(directions, term, w, edge)
    queries, thin = _unit(queries), directions.astype(np.float32)
    longest = max(len(own) for own in items.words)
    schema = "doc_id long, item_id long, cosine double, common double, answer double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, base, place, term in _steps(batch, items.content):
                passage, own, w, edge = _passages(place, term, items.idf)
                z = _unit(_sums(thin, own, w, edge))
                number = passage[edge]
                best: dict[tuple[int, int], tuple] = {}
                seen: set[tuple[int, int]] = set()
                for a in range(0, len(z), 4096):
                    cos = z[a:a + 4096] @ queries.T
                    near = np.flatnonzero(cos >= COSINE)  # flat: several times faster than by two axes
                    for p, q in zip(*np.divmod(near, cos.shape[1]), strict=True):
                        at, k = int(number[a + p]) * STEP, int(item[q])
                        if (at, k) in seen:
                            continue
                        seen.add((at, k))
                        doc = int(np.searchsorted(base, at + WINDOW - 1, "right")) - 1
                        end = base[doc + 1] if doc + 1 < len(base) else 1 << 62
                        low, high = np.searchsorted(place, [max(base[doc], at - longest),
                                                            min(end, at + WINDOW + longest)])
                        common, answer = items.shares(k, term[low:high].tolist())
                        if common >= ALONE or common >= WITH_ANSWER and answer >= ANSWER:
                            new = (common, answer, float(cos[p, q]))
                            best[doc, k] = max(best.get((doc, k), new), new)
                out += [(ids[d], items.ids[k], c, x, y) for (d, k), (x, y, c) in best.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=[x.split()[0] for x in schema.split(", ")])

    return tokens.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer): the documents that hold a benchmark item.

    The benchmark is the stated query set; its items are searched in blocks against all passages
    of all documents. Defined cases: null or empty texts, and items without words, match
    nothing; rows that repeat an id give one row per pair of ids, with the largest values; a null
    doc_id is reported as null; without items or documents there are no rows; other columns are
    not read; texts of any length are searched whole.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "doc_id long, item_id long, cosine double, common double, answer double")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    out, block = empty, []

    def hits(block: list[tuple]) -> DataFrame:
        items = Items.of(block)
        if not items.ids:
            return empty
        tokens = written(known_words(docs, items), "tokens")
        passages, holding = found_terms(tokens, items)
        if not passages:
            return empty
        items.weigh(passages, holding)
        weight = passages / len(items.windows()[2])  # items and documents count alike
        return _search(tokens, items, latent_directions(tokens, items, weight))

    for r in rows.toLocalIterator():
        block.append(tuple(r))
        if len(block) == block_items:
            out, block = out.unionByName(hits(block)), []
    if block:
        out = out.unionByName(hits(block))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "common", "answer")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, told apart by doc_id, null too, and text."""
    return without(docs, lambda rows: contaminated(rows, benchmark))
