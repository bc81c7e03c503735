"""Spelling variants: words that one inserted, deleted or replaced code point turns into each other.

Two words are near if their common prefix and common suffix together reach the length of the longer
one less one. The code points of the longer word are cut into segments of ``SEGMENT``; the edit lies
in one of them, so near words agree in all that stands before and after that segment. A word is
therefore dealt, for each segment and for either length of the longer word (its own, or one more), to
the tile of the rest. Words are distinct and use at most 90 different code points, so a tile holds at
most 90^2 + 90 words, whatever the data. Inside a tile padded code-point matrices are compared row by
row with themselves shifted by 1, 2, ... rows, and prefix and suffix lengths decide. A pair that
shares several tiles is reported in the first of them only.

Words of more than ``LONG`` code points would be copied too often. They are first dealt by id alone,
and only those that share a tile with another word follow with their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, written

# --- fixed values of the contract -----------------------------------------------------------
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, LEAST_N, DROPPED, RATIO = 7, 2, 31, 10
# --------------------------------------------------------------------------------------------
SEGMENT, LONG = 2, 64
#: Cells of a code-point matrix that are handled at a time.
CELLS = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POINT = mix(np.arange(1, 257, dtype=np.uint64))
KEYS = "key long, place long, id long"
WHOLE = KEYS + ", n long, word string"


def vocabulary(docs: DataFrame, least: int = LEAST, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the words of all texts: maximal runs of letters, A-Z lower-cased. A run that
    crc32 of ``<doc_id>:<run>`` picks loses a code point. Runs shorter than ``least`` make no word
    and are not read."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"([a-zÀ-ÿ]{{{least},}})"), F.lit(1))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    less = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"),
                    F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    word = F.when(F.col("h") % DROPPED == 0, less).otherwise(F.col("run"))
    return (rows.select(word.alias("word")).where(F.length("word") >= least)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n))


def points(words: list[str], width: int, backwards: bool = False) -> np.ndarray:
    """Code points (at most 255) of the words, zero-padded at the end; or of the reversed words."""
    fit = "".join((w[::-1] if backwards else w).ljust(width, "\0") for w in words)
    return np.frombuffer(fit.encode("latin-1"), np.uint8).reshape(len(words), width)


def _prefix_hashes(matrix: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the prefixes of 0, 1, ... code points of words of one length."""
    rows, width = matrix.shape
    scale = np.cumprod(np.full(width, _BASE, np.uint64), dtype=np.uint64)
    out = np.zeros((rows, width + 1), np.uint64)
    np.cumsum(_POINT[matrix] * scale, axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def _tiles(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of words of one length: a column for each segment of a longer word of that
    length, then of one more. A place is the longer length and the number of the segment."""
    ahead = _prefix_hashes(points(words, length))
    back = _prefix_hashes(points(words, length, True))
    keys, places = [], []
    for longer in (length, length + 1):
        start = np.arange(0, longer, SEGMENT)
        place = (np.int64(longer) << 32) + np.arange(len(start))
        rest = longer - np.minimum(start + SEGMENT, longer)
        key = mix(mix(ahead[:, start] + np.uint64(1)) + mix(back[:, rest] ^ _BASE) + place.astype(np.uint64))
        keys.append(key)
        places.append(place)
    return np.concatenate(keys, axis=1).view(np.int64), np.concatenate(places)


def tile_keys(words: DataFrame, whole: bool) -> DataFrame:
    """(key, place, id) of the tiles of each (id, n, word); with n and word when ``whole``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).to_pylist()
            lengths = np.array([len(w) for w in text], np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                step = max(1, int(CELLS // (length + 1) // 16))
                for part in np.split(rows, np.arange(step, len(rows), step)):
                    keys, places = _tiles([text[r] for r in part], int(length))
                    of = pa.array(np.repeat(part, len(places)))
                    more = [batch.column(k).take(of) for k in (range(3) if whole else range(1))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(places, len(part))), *more],
                                                     names=["key", "place", "id", "n", "word"][:2 + len(more)])

    return words.select("id", "n", "word").mapInArrow(run, WHOLE if whole else KEYS)


def near_in_tiles(key: np.ndarray, place: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near words, of rows sorted by tile; each pair once over all its tiles."""
    n = len(words)
    length = np.array([len(w) for w in words], np.int64)
    longer, segment = place >> 32, place & 0xFFFFFFFF
    left, right = [], []
    at = np.arange(n)
    for shift in range(1, n):
        at = at[at + shift < n]
        at = at[(key[at] == key[at + shift]) & (place[at] == place[at + shift])]
        if not len(at):
            break
        # one of the two has the tile's length; words that are both one shorter meet elsewhere
        pair = at[np.maximum(length[at], length[at + shift]) == longer[at]]
        widths = longer[pair]
        for width in np.unique(widths):
            rows = pair[widths == width]
            step = max(1, int(CELLS // (width + 1)))
            for part in np.split(rows, np.arange(step, len(rows), step)):
                ahead, back = (_common(words, part, part + shift, int(width), b) for b in (False, True))
                near = ahead + back >= width - 1
                # the first segment that ends behind the last differing code point
                own = np.maximum(-(-(width - back) // SEGMENT) - 1, 0)
                near &= segment[part] == own
                left.append(part[near])
                right.append(part[near] + shift)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(left), join(right)


def _common(words: list[str], a: np.ndarray, b: np.ndarray, width: int, backwards: bool) -> np.ndarray:
    """Lengths of the common prefixes (suffixes) of distinct words a and b."""
    rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    matrix = points([words[r] for r in rows], width + 1, backwards)
    differ = matrix[where[:len(a)]] != matrix[where[len(a):]]
    return differ.argmax(axis=1)


def near_words(words: DataFrame) -> DataFrame:
    """(id, near, near_n, near_id): for each word of (id, word, n) that has near words their
    number, and the n and id of the one with the largest n (of equals the smallest id)."""
    is_long = F.shiftright("place", 32) > LONG
    short = tile_keys(words.where(F.length("word") <= LONG), True).where(~is_long)
    apart = words.where(F.length("word") >= LONG)
    long_ = written(tile_keys(apart, False).where(is_long), "long-keys")
    shared = long_.groupBy("key", "place").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "place")
    long_ = long_.join(shared, ["key", "place"], "left_semi").join(apart, "id")
    return _compared(short.unionByName(long_))


def _compared(rows: DataFrame) -> DataFrame:
    schema = "id long, near long, near_n long, near_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last tile, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[batch.num_rows - 1].as_py(), batch.column(1)[batch.num_rows - 1].as_py()
            if len(held) > 1 and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == last:
                continue
            table = pa.Table.from_batches(held)
            key, place = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = int(np.flatnonzero((key != last[0]) | (place != last[1]))[-1]) + 1 if (
                (key[0], place[0]) != last) else 0
            if cut:
                yield best(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield best(pa.Table.from_batches(held))

    def best(table: pa.Table) -> pa.RecordBatch:
        """Per word of these tiles: near words, and the best of them."""
        key, place, ids, n = (table.column(k).to_numpy() for k in range(4))
        same = (key[1:] == key[:-1]) & (place[1:] == place[:-1])
        some = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        a, b = near_in_tiles(key[some], place[some], table.column(4).take(pa.array(some)).to_pylist())
        own, other = some[np.concatenate([a, b])], some[np.concatenate([b, a])]
        order = np.lexsort([ids[other], -n[other], ids[own]])
        own, other = own[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], ids[own][1:] != ids[own][:-1]])) if len(own) else order
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[own[first]], np.diff(np.append(first, len(own))).astype(np.int64),
                                   n[other[first]], ids[other[first]])], names=["id", "near", "near_n", "near_id"])

    parts = rows.repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, schema)
    top = F.min(F.struct((-F.col("near_n")).alias("n"), "near_id")).alias("top")
    return (parts.groupBy("id").agg(F.sum("near").alias("near"), top)
            .select("id", "near", (-F.col("top.n")).alias("near_n"), F.col("top.near_id").alias("near_id")))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): the end of each chain of forms. A form has at least ``RATIO``
    times the occurrences, so chains end; each round doubles the steps taken."""
    at = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = written(at.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the
    hash; repeated rows count each; of near words with the same n the first in code-point order is
    the form; very long runs are words like any other; no rows or no words give no rows; other
    columns are not read.
    """
    # ids grow in code-point order: the range-partitioned sort is read in order
    words = written(vocabulary(docs).orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"),
                    "words")
    near = written(near_words(words), "near")
    known = words.join(near, "id", "left").withColumn(
        "form", F.when(F.col("near_n") >= RATIO * F.col("n"), F.col("near_id")))
    known = written(known.select("id", "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), "form"),
                    "forms")
    ends = roots(known.where("form IS NOT NULL"))
    name = lambda id_, word, *more: words.select(F.col("id").alias(id_), F.col("word").alias(word), *more)
    out = (known.join(ends.withColumnRenamed("root", "end"), "id", "left")
           .join(name("form", "form_word", F.col("n").alias("form_n")), "form", "left")
           .join(name("end", "end_word"), "end", "left"))
    return out.select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n",
                      F.coalesce("end_word", "word").alias("root"))
