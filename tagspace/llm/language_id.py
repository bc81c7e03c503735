"""Language of a text by multinomial naive Bayes over hashed character n-grams.

A text is read as its letters, lower-cased code point by code point, with every run of other
characters as one space. Its n-grams of one to ``LONGEST`` code points that do not consist of a
space alone are hashed into ``BUCKETS`` buckets. Training adds up, per language, the buckets of all
training texts: tasks count into arrays, and one row per language and bucket is summed by Spark. The
driver gets those sums (languages x buckets, whatever the corpus) and broadcasts the matrix of
log-probabilities. A text is scored from its sparse bucket counts, as counts times matrix rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, text_buffers

FOLDS, HELD_OUT = 4, 2
LONGEST = 4
BUCKETS = 1 << 16
#: Added to every count before the shares are taken.
SMOOTHING = 0.5
UNKNOWN = "und"
#: Most cells of the matrix (256 languages at 65,536 buckets); with more languages, fewer buckets.
CELLS = 1 << 24
#: Languages whose counts a task holds at a time.
HELD = 64

_SPACE = 32
_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point, its lower-case letter, or a space where it is no letter."""
    global _lower
    if _lower is None:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _lower = table
    return _lower


def buckets_for(languages: int) -> int:
    """Buckets with which a matrix of ``languages`` columns has at most ``CELLS`` cells."""
    n = BUCKETS
    while n > 256 and n * languages > CELLS:
        n //= 2
    return n


Grams = list[tuple[np.ndarray, np.ndarray]]


def grams(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[Grams, np.ndarray]:
    """For each length, the buckets of the rows' n-grams (row after row) and the first of each row
    (with an end entry); and which rows have a letter."""
    rows = len(offsets) - 1
    lead = (raw & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])[offsets]
    codes = _letters()[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    framed = np.insert(codes, points[:-1], _SPACE)  # every row begins with a space
    letter = framed != _SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of spaces the first
    starts = points[:-1] + np.arange(rows)
    keep[starts] = True      # and the one that begins a row
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    text, letter = framed[keep].astype(np.uint64), letter[keep]
    first = np.append(kept[starts], len(text))
    out, state = [], np.zeros(len(text), np.uint64)
    ended = np.ones(len(text), bool)  # n-grams that the row's end or a double space cuts
    for n in range(1, LONGEST + 1):
        m = max(len(text) - n + 1, 0)
        state = mix(state[:m] * np.uint64(0x9E3779B97F4A7C15) + text[n - 1:] + np.uint64(n))
        if n == 1:
            ended = ~letter
        else:
            # a space may begin or end an n-gram; a row's first code point ends none
            ended = (ended if n > 2 else np.zeros(len(text), bool))[:m].copy()
            at = first[1:-1, None] - np.arange(1, n)
            ended[at[(at >= 0) & (at < m)]] = True
        ok = ~ended
        made = np.concatenate([[0], np.cumsum(ok, dtype=np.int64)])
        out.append(((state[ok] & np.uint64(buckets - 1)).astype(np.uint16), made[np.minimum(first, m)]))
    some = np.diff(np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])[first]) > 0
    return out, some


def training_rows(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(text, lang) of the rows to learn from: a language is given, and the row is not held out."""
    return (docs.where(F.col(lang).isNotNull() & ~held_out(id_col))
            .select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``HELD_OUT``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def gram_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n): occurrences of the buckets in all ``rows`` (text, lang); bucket -1
    counts the texts that have a letter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(counts[at])],
                    names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                found, some = grams(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], buckets)
                own, row = np.unique(langs[a:b].astype(str), return_inverse=True)
                for k, lang in enumerate(own):
                    if lang not in held and len(held) >= HELD:
                        yield from out()
                    counts = held.setdefault(str(lang), np.zeros(buckets + 1, np.int64))
                    counts[0] += int(some[row == k].sum())
                    for bucket, first in found:
                        of = np.repeat(row == k, np.diff(first))
                        counts[1:] += np.bincount(bucket[of], minlength=buckets)
        yield from out()

    part = rows.mapInArrow(run, "lang string, bucket int, n long")
    return part.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in code-point order, their log shares of texts, log-probabilities (bucket, language)."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix

    @property
    def buckets(self) -> int:
        return len(self.matrix)

    def score(self, found: np.ndarray) -> tuple[int, float]:
        """The likeliest language (the first of equals) of a text's buckets and its posterior share."""
        own = np.sort(found, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.append(edge, len(own))).astype(np.float64)
        total = counts @ self.matrix[own[edge]] + self.prior
        best = int(total.argmax())
        return best, float(1 / np.exp(total - total[best]).sum())


def train(rows: DataFrame) -> Model | None:
    """Model of all ``rows`` (text, lang); None where no row has a letter."""
    languages = rows.agg(F.approx_count_distinct("lang", 0.02)).first()[0]
    buckets = buckets_for(int(languages * 1.1) + 1)
    got = gram_counts(rows, buckets).toPandas()  # at most CELLS cells, however many texts
    known = sorted(got.loc[got["bucket"] == -1, "lang"])
    if not known:
        return None
    place = {x: k for k, x in enumerate(known)}
    counts, texts = np.zeros((buckets, len(known))), np.zeros(len(known))
    column = got["lang"].map(place).to_numpy()
    gram = got["bucket"].to_numpy()
    texts[column[gram < 0]] = got["n"].to_numpy()[gram < 0]
    counts[gram[gram >= 0], column[gram >= 0]] = got["n"].to_numpy()[gram >= 0]
    matrix = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * buckets)
    return Model(known, np.log(texts / texts.sum()), matrix)


def with_language(rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, text) rows with lang_pred and score instead of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            raw, offsets = text_buffers(batch.column(2))
            for a, b in slices(offsets) if model is not None else ():
                found, some = grams(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], model.buckets)
                for r in np.flatnonzero(some):
                    best, scores[a + r] = model.score(
                        np.concatenate([bucket[first[r]:first[r + 1]] for bucket, first in found]))
                    names[a + r] = model.languages[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0, as is
    every text where nothing was learned; a null doc_id is not held out; a null lang is not learned
    from; of languages that score alike the first in code-point order is taken; repeated rows count
    and are scored each; no rows give no rows; other columns are not read; whole texts are read.
    Learned from are all rows outside the held-out fold that have a language.
    """
    model = train(training_rows(docs))
    return with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                                     F.col("text").cast("string").alias("text")), model)
