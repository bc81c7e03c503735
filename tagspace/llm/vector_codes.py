"""Product quantisation of vectors in integers, with nearest entries found in the Walsh-Hadamard domain.

A vector's components become integers, and its ``PARTS`` consecutive parts have a codebook each.
Parts and entries are zero-padded to a power of two and transformed by the integer Walsh-Hadamard
transform, whose rows are taken in sequency order (by number of sign changes). The sum of squared
differences of all coefficients is the squared distance times the padded length, so partial sums are
lower bounds: entries whose partial sum exceeds the whole distance of a first guess are out. All
arithmetic is on integers: 64-bit ones, or Python's where the values are too large for that.

Each round is one pass over the written vectors: tasks sum count and components per entry, Spark
adds up the tasks' sums, and the driver holds the codebooks (``PARTS`` x ``ENTRIES`` entries).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with the entries at a time.
BLOCK = 1024
#: Coefficients that every entry is compared on before any is left out.
FIRST = 4
#: Differences that are held at a time.
CELLS = 1 << 22
#: Bits of a component beyond which Python's integers are used.
NARROW = 24


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit integers or, where one is large, Python's."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0 ** NARROW / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    whole = lambda x: int(x) * SCALE if abs(x) >= 2.0 ** 53 else math.floor(x * SCALE)
    return np.array([whole(float(x)) for x in values.ravel()], dtype=object).reshape(values.shape)


def sequency(size: int) -> np.ndarray:
    """Natural index of each row of the transform, by its number of sign changes."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    out = np.zeros(size, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def transform(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows of ``parts``, zero-padded, in sequency order."""
    rows, width = parts.shape
    size = 1 << max(width - 1, 0).bit_length()
    x = np.zeros((rows, size), parts.dtype)
    x[:, :width] = parts
    step = 1
    while step < size:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x[:, sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and squared distance of each part."""
    if parts.dtype != entries.dtype:
        parts, entries = parts.astype(object), entries.astype(object)
    index, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    if not parts.shape[1]:
        return index, far
    book = transform(entries)
    size = book.shape[1]
    for at in range(0, len(parts), BLOCK):
        x = transform(parts[at:at + BLOCK])
        begun = min(FIRST, size)
        partial = np.zeros((len(x), len(book)), parts.dtype)
        for k in range(begun):
            d = x[:, k, None] - book[None, :, k]
            partial += d * d
        guess = partial.argmin(axis=1)
        d = x - book[guess]
        most = (d * d).sum(axis=1)
        row, entry = np.nonzero(partial <= most[:, None])
        left = partial[row, entry]
        while begun < size:  # an entry that is out at a partial sum stays out
            end = min(begun + min(begun, max(1, CELLS // len(row))), size)
            d = x[row, begun:end] - book[entry, begun:end]
            left = left + (d * d).sum(axis=1)
            stay = left <= most[row]
            row, entry, left, begun = row[stay], entry[stay], left[stay], end
        # rows are in order, and a row's entries too
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(left, first)
        equal = np.flatnonzero(left == np.repeat(least, np.diff(np.append(first, len(row)))))
        own = np.unique(row[equal], return_index=True)[1]
        index[at:at + BLOCK], far[at:at + BLOCK] = entry[equal[own]], least // size
    return index, far


Books = list[np.ndarray]


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as integers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return integers(values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0)))


def _cut(vectors: np.ndarray) -> list[np.ndarray]:
    return np.split(vectors, PARTS, axis=1)


def _sums(rows: DataFrame, books: Books) -> DataFrame:
    """(slot, n, sums): of every part and entry that has parts, their number and, as text, the
    sums of their components; slot is part * ENTRIES + entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(PARTS * ENTRIES, np.int64), [0] * (PARTS * ENTRIES)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, (part, book) in enumerate(zip(_cut(_vectors(batch.column(0))), books, strict=True)):
                index, _ = nearest(part, book)
                order = np.argsort(index, kind="stable")
                own, first, n = np.unique(index[order], return_index=True, return_counts=True)
                for e, s, k in zip(own, np.add.reduceat(part[order], first, axis=0), n, strict=True):
                    slot = p * ENTRIES + int(e)
                    count[slot] += k
                    total[slot] = total[slot] + s.astype(object)
        slots = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots.astype(np.int32)), pa.array(count[slots]),
             pa.array([[str(x) for x in total[k]] for k in slots], pa.list_(pa.string()))], names=["slot", "n", "sums"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.array([int(x) for x in s], dtype=object) for s in part["sums"])
        return pd.DataFrame({"slot": part["slot"].iloc[:1], "n": [part["n"].sum()], "sums": [[str(x) for x in total]]})

    schema = "slot int, n long, sums array<string>"
    # one row per task and slot; a slot's group has at most as many rows as there are tasks
    return rows.select("vector").mapInArrow(run, schema).groupBy("slot").applyInPandas(added, schema)


def _moved(books: Books, sums: list) -> Books:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    out = [b.astype(object) for b in books]
    for slot, n, total in sums:
        out[slot // ENTRIES][slot % ENTRIES] = [int(x) // n for x in total]
    wide = max((abs(x) for b in out for x in b.ravel()), default=0) >= 1 << NARROW
    return out if wide else [b.astype(np.int64) for b in out]


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, vector, label) of the rows whose vector is there and has finite components only."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.col(label).alias("label"))
            .where(F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False))))


def train(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    """Codebooks of ``rows`` (vec_id, vector): begun with the smallest vec_ids (nulls last; rows of
    one id by their vectors), then moved ``rounds`` times over all rows."""
    begin = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    if not begin:
        return []
    books = _cut(integers(np.array([r["vector"] for r in begin], np.float64).reshape(len(begin), -1)))
    for _ in range(rounds):
        books = _moved(books, [tuple(r) for r in _sums(rows, books).collect()])
    return books


def codes(rows: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of ``rows`` (vec_id, vector, label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(part, book) for part, book in zip(_cut(_vectors(batch.column(2))), books, strict=True)]
            index = np.column_stack([i for i, _ in found]).astype(np.uint8)
            error = sum(d.astype(object) for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in index], pa.string()),
                 pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "vector").mapInArrow(
        run, f"vec_id long, label {kind}, code string, error long")


def compressed(rows: DataFrame) -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256.

    Defined cases: rows whose vector is null or holds a null or non-finite component are dropped;
    null vec_ids are encoded, and begin a codebook entry only after all others; repeated rows
    count each; fewer than ``ENTRIES`` rows make as many entries; an error beyond 64 bits is null,
    and so is a label's sum with such an error; empty vectors have code 00000000 and error 0; no
    rows give no rows; other columns are not read. Vectors of different lengths, or of a length
    that ``PARTS`` does not divide, have no parts to compare and end the query with an error.
    """
    kept = written(kept_vectors(rows), "vectors")
    lengths = [r[0] for r in kept.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1 or any(n % PARTS for n in lengths):
        raise ValueError(f"vectors need one length that {PARTS} divides, not {lengths}")
    books = train(kept)
    text = ",".join(str(int(x)) for book in books for x in book.ravel())
    coded = written(codes(kept, books), "codes")
    sums = coded.groupBy("label").agg(
        F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error"))
    sums = small(written(sums.withColumnRenamed("label", "of"), "label-errors"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
