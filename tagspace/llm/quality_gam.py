"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of shape features (character classes, repetition, word and line
lengths). Each feature is cut into bins, and shallow trees, boosted in turn over the features,
add to a table of one value per bin. The strongest pairs of features then get tables of their own
in the same way. A score is the logistic of the sum of the looked-up values, so scoring is a few
vectorised additions per feature, and every contribution can be read off its table.

The tables are fitted on at most ``SAMPLE`` labelled rows, those whose doc_id hashes lowest;
features are computed, and scores given, for every row where it lies. Language, source, doc_id and
labels are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers, word_hashes, word_spans

#: Most labelled rows that the model is fitted on.
SAMPLE = 60_000
#: Folds by crc32 of doc_id; fold 0 is held out. Scores from CUT on are predicted as label 1.
FOLDS, CUT = 5, 0.3

BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE, LEAST_WEIGHT = 48, 12, 120, 40, 8, 0.1, 1.0, 1.0

FEATURES = ["bytes", "words", "word_bytes", "upper", "digit", "bar", "symbol", "exclaim", "stop", "punctuation",
            "beyond_ascii", "distinct", "adjacent", "commonest", "short", "line_words", "line_distinct",
            "capital", "pair_distinct", "longest"]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _UPPER | _mask(bytes(range(97, 123))) | (np.arange(256) >= 128)
_CLASSES = {"digit": _mask(b"0123456789"), "bar": _mask(b"|"), "symbol": _mask(b"#$%&*"), "exclaim": _mask(b"!?"),
            "stop": _mask(b".,;:"), "punctuation": _mask(b"\"'()+-/<=>@[\\]^_`{}~"),
            "beyond_ascii": np.arange(256) >= 128}


def _features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of a slice; a text without words has zeros but its length."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=False)
    lengths = ends - starts

    def total(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float64)

    size, words = np.diff(offsets).astype(np.float64), np.diff(first).astype(np.float64)
    chars, per = np.maximum(size, 1), np.maximum(words, 1)
    col = {"bytes": np.log1p(size), "words": np.log1p(words), "word_bytes": total(lengths, first) / per}
    letters = np.maximum(total(_LETTER[raw], offsets), 1)
    col["upper"] = total(_UPPER[raw], offsets) / letters
    for name, mask in _CLASSES.items():
        col[name] = total(mask[raw], offsets) / (chars if name in ("digit", "punctuation", "beyond_ascii") else per)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = first[:-1][words > 0]
    same[inner] = False
    col["adjacent"] = total(same, first) / per
    col["short"] = total(lengths <= 2, first) / per
    col["capital"] = total(_UPPER[raw[starts]], first) / per if len(starts) else np.zeros(rows)
    line = np.concatenate([[0], np.cumsum(raw == 10)])
    lines = (line[offsets[1:]] - line[offsets[:-1]] + 1).astype(np.float64)
    col["line_words"] = np.log1p(words / lines)
    out = {k: np.zeros(rows) for k in ("distinct", "commonest", "line_distinct", "pair_distinct", "longest")}
    of_word = line[starts] if len(starts) else np.zeros(0, np.int64)
    for r in np.flatnonzero(words > 0):
        a, b = first[r], first[r + 1]
        own = np.sort(hashes[a:b])
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        out["distinct"][r] = (len(new) - 1) / (b - a)
        out["commonest"][r] = np.diff(new).max() / (b - a)
        out["longest"][r] = np.log1p(lengths[a:b].max())
        if b - a > 1:
            pairs = hashes[a:b - 1] * np.uint64(3) + hashes[a + 1:b]
            out["pair_distinct"][r] = len(np.unique(pairs)) / (b - a - 1)
        edge = np.flatnonzero(np.diff(of_word[a:b])) + 1
        sums = np.add.reduceat(hashes[a:b] * np.uint64(2654435761), np.concatenate([[0], edge]))
        out["line_distinct"][r] = len(np.unique(sums)) / len(sums)
    col |= out
    return np.column_stack([col[f] for f in FEATURES])


def feature_rows(text: pa.Array) -> np.ndarray:
    raw, offsets = text_buffers(text)
    parts = [_features(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """Bin edges and tables; ``scores`` adds the looked-up values."""
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for table, b in zip(self.tables, self.bins(x, self.edges), strict=True):
            total += table[b]
        if self.pairs:
            c = self.bins(x, self.coarse)
            for (i, j), table in self.pairs.items():
                total += table[c[i], c[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; 0 gain if no cut is allowed."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT),
                    _gain(gl, hl) + _gain(gr, hr) - _gain(g.sum(), h.sum()), 0.0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step per bin of a tree of the given depth."""
    gain, k = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -RATE * g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step per cell of a tree that cuts one axis, then the other on each side."""
    best, step = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(a)):
            sides, gain = [], -_gain(g.sum(), h.sum())
            for part, weight in ((a[:k], b[:k]), (a[k:], b[k:])):
                if weight.sum() < LEAST_WEIGHT:
                    gain = -1.0
                    break
                cut, at = _best_cut(part.sum(0), weight.sum(0))
                gain += cut + _gain(part.sum(), weight.sum())
                sides.append((part, weight, at if cut > 1e-9 else 0))
            if gain > best:
                best, out = gain, np.zeros_like(a)
                low = 0
                for part, weight, at in sides:
                    for cols in (slice(0, at), slice(at, a.shape[1])):
                        if part[:, cols].size:
                            out[low:low + len(part), cols] = (
                                -RATE * part[:, cols].sum() / (weight[:, cols].sum() + RIDGE))
                    low += len(part)
                step = out if axis == 0 else out.T
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted tables of ``x`` (rows of FEATURES) for labels ``y``. Without rows of both labels
    the score is constant: the smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        model.edges = [np.zeros(0)] * len(FEATURES)
        model.tables = [np.zeros(1)] * len(FEATURES)
        return model
    model.edges = [_cuts(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins, total = model.bins(x, model.edges), np.full(len(x), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for f, (table, b) in enumerate(zip(model.tables, bins, strict=True)):
            g, h = slopes()
            step = _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            model.tables[f] = table + step
            total += step[b]
    model.coarse = [_cuts(x[:, f], COARSE) for f in range(x.shape[1])]
    cells = model.bins(x, model.coarse)

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        flat = cells[i] * shape[1] + cells[j]
        g, h = slopes()
        return (np.bincount(flat, g, shape[0] * shape[1]).reshape(shape),
                np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))

    ranked = sorted(((-_pair_tree(*grid(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)))
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = _pair_tree(*grid(i, j))[1]
            table += step
            total += step[cells[i], cells[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Model of the labelled rows outside the held-out fold, at most ``sample`` of them. Of
    repeated label rows of a doc_id the largest label counts; null labels are no labels."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold != 0))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c) for c in x.T)], names=["doc_id", "y", *FEATURES])

    got = rows.select("doc_id", "text", "y").mapInArrow(
        run, "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES))
    # one row of a repeated doc_id (with the least features), so that the bound holds for rows too
    got = got.groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("x")).select("doc_id", "x.*").toPandas()
    got = got.sort_values("doc_id")
    return fit(got[FEATURES].to_numpy(np.float64), got["y"].to_numpy(np.float64))


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores, in one pass; ``column`` must be a new name."""
    if column in docs.columns:
        raise ValueError(f"column {column!r} exists")
    at = docs.columns.index("text")
    schema = docs.schema.jsonValue()
    schema["fields"].append({"name": column, "type": "double", "nullable": False, "metadata": {}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(feature_rows(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)],
                                             names=[*batch.schema.names, column])

    return docs.mapInArrow(run, type(docs.schema).fromJson(schema))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Defined cases: a null text counts as empty, and empty texts get the score of their (zero)
    features; a null doc_id is not held out; without labels of both kinds every score is the
    smoothed share of label 1 (0.5 without labels); repeated rows are scored each; no rows give
    no rows; other columns are not read; whole texts are read.
    """
    model = train(docs, labels)
    rows = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   F.col("text").cast("string").alias("text")), model)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score below ``cut``; its columns stay as they are,
    whatever their names."""
    score = "quality_score"
    while score in docs.columns:
        score = "_" + score
    return with_scores(docs, train(docs, labels), score).where(F.col(score) >= cut).drop(score)
