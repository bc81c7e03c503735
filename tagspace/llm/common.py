"""Helpers shared by the operators of this subpackage: written tables in the shared
folder, size-checked broadcasts and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspace.session import ensure_checkpoint_dir

#: Words of the contracts on white space: runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a table that is broadcast; beyond it a plain join is planned.
BROADCAST_ROWS = 100_000

#: Bytes of text that one vectorised step handles at a time; a longer text is one step.
CHUNK_BYTES = 1 << 21


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written) marked for broadcast if it has at most ``rows`` rows;
    otherwise unchanged, and the join is a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose ids ``find`` returns (doc_id) for rows (doc_id, text).

    Rows are told apart by doc_id, null too, and text: where an id is null or repeated, ``find``
    sees each of its different texts under a number of its own above all ids. Rows that agree in
    both go or stay together. Other columns, whatever their names, stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd_ids = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
                      .select(F.col("doc_id").alias("odd_id")), "odd-ids")
    if odd_ids.isEmpty():
        gone = written(find(rows).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    of_odd = F.col("doc_id").eqNullSafe(F.col("odd_id"))
    after = F.lit((rows.agg(F.max("doc_id")).first()[0] or 0) + 1)
    odd = written(rows.join(odd_ids, of_odd, "left_semi").distinct()
                  .select((after + F.monotonically_increasing_id()).alias("row_id"), "doc_id", "text"), "odd")
    seen = rows.join(odd_ids, of_odd, "left_anti").unionByName(odd.select(F.col("row_id").alias("doc_id"), "text"))
    gone = written(find(seen).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    digest = lambda text: F.sha2(text.cast("string").cast("binary"), 256)
    lost = (odd.join(gone, F.col("row_id") == F.col("gone_id"), "left_semi")
            .select(F.col("doc_id").alias("lost_id"), digest(F.col("text")).alias("lost_sha256")))
    out = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    return out.join(lost, docs["doc_id"].eqNullSafe(lost["lost_id"])
                    & digest(docs["text"]).eqNullSafe(lost["lost_sha256"]), "left_anti")


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about ``most`` bytes together."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


# --- hashing -----------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes between words of ASCII letters, digits and any other characters beyond ASCII.
BETWEEN_ALNUM = np.ones(256, bool)
BETWEEN_ALNUM[48:58] = BETWEEN_ALNUM[65:91] = BETWEEN_ALNUM[97:123] = BETWEEN_ALNUM[128:] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        grown[0] = 1
        have = _powers[int(base)] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_spans(raw: np.ndarray, offsets: np.ndarray,
               between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (with an end entry).
    ``between``: by byte value, whether it stands between words."""
    inside = ~between[raw]
    n = len(raw)
    before = np.concatenate([[False], inside])
    before[offsets] = False
    after = np.concatenate([inside, [False]])
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased when asked: prefix polynomial hashes, so
    that every byte is read once however the words are cut."""
    n = len(raw)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[raw] * powers(_P, n), dtype=np.uint64, out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * powers(_PINV, n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row, row after row, and the first of each
    row (with an end entry). A row with fewer words, but any, has the whole sequence as one."""
    counts = np.diff(first)
    n = len(words)
    full = np.zeros(n, np.uint64)
    if n >= size:
        run = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            run = mix(run + words[j:n - size + 1 + j] + np.uint64(j + 1))
        full[:len(run)] = run
    is_start = np.ones(n, bool)
    last = first[1:]
    for j in range(1, size):  # the last size-1 words of a row start no run
        at = last - j
        is_start[at[at >= first[:-1]]] = False
    short = np.flatnonzero((counts > 0) & (counts < size))
    for row in short:
        value = np.zeros(1, np.uint64)
        for at in range(first[row], first[row + 1]):
            value = mix(value + words[at:at + 1] + np.uint64(97))
        full[first[row]] = value[0]
        is_start[first[row]] = True
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return full[is_start], np.concatenate([[0], np.cumsum(made)])
