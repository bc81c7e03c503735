"""Removal of repeated byte strings: every byte that a string of ``LENGTH`` bytes covers which
also starts earlier (in a document with a smaller doc_id, or before it in the same document).

Each window of LENGTH bytes has an anchor, the leftmost of its ``GRAM``-byte grams of least
hash. Equal windows have equal anchors, so only windows of one anchor gram can be equal. The
windows of a document that share an anchor are consecutive; their bytes are one unit.

1. Units are hashed where the text lies. Units of one batch, then of all documents, that equal an
   earlier unit in the anchor gram's hash and in 64 further bits over the whole unit are removed whole.
2. The first units of an anchor gram with several different units may still share windows. Their
   bytes are brought together by anchor gram, and the suffixes from the anchor on, and the
   reversed ones to its left, are sorted: prefix polynomial hashes and binary search give the
   common extension of two suffixes, hence their order, in a logarithmic number of steps, and a
   merge sort of whole levels at a time uses such comparisons only. Extensions of neighbours are
   verified byte by byte. A window, an offset from the anchor, is equal to another one exactly if
   both lie in one class of the sorted suffixes on either side.
3. Anchor grams with more than ``GROUP`` such units would make a hot task. Their windows are
   instead compared one by one, through sums by window hash before and after the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _P, _PINV, mix, powers, release, slices, text_buffers, written

LENGTH, GRAM = 100, 32
#: Units of an anchor gram that one group compares.
GROUP = 2000
SPAN = LENGTH - GRAM + 1  # grams of a window

UNITS = "gram long, unit long, doc_id long, place long"


def prefix_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes and inverse powers: bytes a..b hash to (h[b] - h[a]) * inv[a]."""
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(_P, len(raw)), dtype=np.uint64, out=h[1:])
    return h, powers(_PINV, len(raw) + 1)


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its leftmost least one."""
    at, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        span += step
    return at


def find_units(raw: np.ndarray, offsets: np.ndarray):
    """(row, gram, unit, first window, anchor's offset in it, windows) of the units of a slice."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h, inv = prefix_hashes(raw)
    grams = mix((h[GRAM:] - h[:-GRAM]) * inv[:n - GRAM + 1])
    anchor = leftmost_least(grams, SPAN)
    p = np.arange(n - LENGTH + 1)
    row = np.searchsorted(offsets, p, "right") - 1
    ok = p + LENGTH <= offsets[row + 1]
    p, row, anchor = p[ok], row[ok], anchor[ok]
    if not len(p):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    low, high, at = p[first], p[last], anchor[first]
    shape = (at - low).astype(np.uint64) * np.uint64(LENGTH) + (high - low).astype(np.uint64)
    unit = mix((h[high + LENGTH] - h[low]) * inv[low] + mix(shape))
    # a second hash, of the unit's mixed grams, so that few differing bytes count in all 64 bits too
    g = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * powers(_P, len(grams)), dtype=np.uint64, out=g[1:])
    unit = mix(unit + (g[high + SPAN] - g[low]) * inv[low])
    return row[first], grams[at], unit, low - offsets[row[first]], at - low, high - low + 1


def _pack(low, off, n):
    return low << 16 | off << 8 | n


def _unpack(place):
    return place >> 16, place >> 8 & 255, place & 255


def unit_rows(docs: DataFrame) -> DataFrame:
    """Units (UNITS) that no earlier document of their batch has; those that one has, and those
    that the document itself has before, as rows without gram: windows to remove."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = text_buffers(batch.column(1))
            parts = []
            for a, b in slices(offsets):
                row, gram, unit, low, off, n = find_units(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                parts.append((ids[row + a], gram, unit, _pack(low, off, n)))
            if not parts:
                continue
            doc, gram, unit, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, doc, unit, gram))
            doc, gram, unit, place = doc[order], gram[order], unit[order], place[order]
            again = np.zeros(len(doc), bool)
            again[1:] = (gram[1:] == gram[:-1]) & (unit[1:] == unit[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64), mask=again), pa.array(unit.view(np.int64)), pa.array(doc),
                 pa.array(place)], names=["gram", "unit", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, UNITS)


def _extension(h, inv, a, b, most) -> np.ndarray:
    """Common extension of the strings at a and at b, up to ``most``, by binary search on hashes."""
    low, high = np.zeros_like(most), most.copy()
    for _ in range(int(max(1, most.max(initial=0))).bit_length()):
        mid = (low + high + 1) >> 1
        same = (h[a + mid] - h[a]) * inv[a] == (h[b + mid] - h[b]) * inv[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(raw: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
    """Merge sort of strings (``size`` bytes at ``start``) by group and bytes, and the common
    extension of each with its predecessor (-1 across groups)."""
    h, inv = prefix_hashes(raw)
    bytes_ = np.append(raw, np.uint8(0)).astype(np.int16)

    def compare(x, y):
        most = np.minimum(size[x], size[y])
        ext = _extension(h, inv, start[x], start[y], most)
        inside = ext < most
        by = np.where(inside, bytes_[np.minimum(start[x] + ext, len(raw))] - bytes_[np.minimum(start[y] + ext, len(raw))],
                      np.sign(size[x] - size[y]))
        return np.where(group[x] != group[y], np.sign(group[x] - group[y]), by)

    n, order, width = len(start), np.arange(len(start)), 1
    place = np.arange(n)
    while width < n:
        run = place // width
        first = (run ^ 1) * width
        low, high = np.minimum(first, n), np.minimum(first + width, n)
        begin = low.copy()
        right = run & 1  # equal strings keep their order: those of the left run come first
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            c = compare(order[open_], order[mid])
            past = (c > 0) | ((c == 0) & (right[open_] == 1))
            low[open_] = np.where(past, mid + 1, low[open_])
            high[open_] = np.where(past, high[open_], mid)
        to = (run // 2) * 2 * width + (place - run * width) + (low - begin)
        merged = np.empty_like(order)
        merged[to] = order
        order, width = merged, width * 2
    x, y = order[:-1], order[1:]
    ext = np.where(group[x] == group[y], _extension(h, inv, start[x], start[y], np.minimum(size[x], size[y])), -1)
    steps = np.arange(int(size.max(initial=0)))
    for a in range(0, len(x), 4096):  # verification of the hashes by the bytes themselves
        e = ext[a:a + 4096, None]
        i = np.minimum(start[x[a:a + 4096], None] + steps, len(raw) - 1)
        j = np.minimum(start[y[a:a + 4096], None] + steps, len(raw) - 1)
        if ((raw[i] != raw[j]) & (steps < e)).any():
            raise ArithmeticError("prefix hashes of different strings collide")
    return order, np.concatenate([[-1], ext])


def repeated_windows(gram, doc, low, off, n, texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(doc, first window, last window) of the units' windows that an earlier unit also has."""
    order = np.lexsort((low + off, doc))
    gram, doc, low, off, n = (x[order] for x in (gram, doc, low, off, n))
    texts = [texts[i] for i in order]
    size = np.array([len(t) for t in texts])
    _, group = np.unique(gram, return_inverse=True)
    right = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    left = right[::-1]
    classes = []
    for raw, start, length in ((right, begin + off, size - off), (left, len(right) - begin - off, off)):
        at, ext = suffix_order(raw, start, length, group)
        classes.append((at, ext))
    k = len(doc)
    gone = np.zeros((k, SPAN + 2), bool)  # by offset of the anchor in the window, from 1
    side = np.empty((2, k), np.int64)
    for o in range(int((off - n + 1).min()), int(off.max()) + 1):
        have = np.flatnonzero((off >= o) & (off - n + 1 <= o))
        if len(have) < 2:
            continue
        for s, depth in ((0, LENGTH - o), (1, o)):
            at, ext = classes[s]
            side[s, at] = np.cumsum(ext < depth)
        # on the left, depth 0 tells nothing apart but groups, which the right classes do
        _, first = np.unique(side[0, have] * (k + 1) + side[1, have], return_index=True)
        again = np.ones(len(have), bool)
        again[first] = False
        gone[have[again], o + 1] = True
    edge = np.diff(gone.astype(np.int8), axis=1)
    r1, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)  # offsets a..b-1 go; a greater offset is an earlier window
    place = (low + off)[r1]
    return list(zip(doc[r1].tolist(), (place - b + 1).tolist(), (place - a).tolist(), strict=True))


def _compared(contexts: DataFrame) -> DataFrame:
    """Windows to remove, of units brought together by anchor gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            low, off, n = _unpack(rows.column("place").to_numpy())
            out = repeated_windows(rows.column("gram").to_numpy(), rows.column("doc_id").to_numpy(), low, off, n,
                                   rows.column("bytes").to_pylist())
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column("gram").to_numpy()
            last = int(np.searchsorted(grams, grams[-1], "left"))  # the last group may go on
            if last:
                yield found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    rows = contexts.repartition("gram").sortWithinPartitions("gram")
    return rows.mapInArrow(run, "doc_id long, low long, high long")


def _one_by_one(contexts: DataFrame) -> DataFrame:
    """Windows to remove, of units of hot anchor grams: by two independent hashes of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, doc, place, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc_id", "place", "bytes")),
                                              strict=True):
                low, off, n = _unpack(place)
                wins = [hashlib.blake2b(data[i:i + LENGTH], digest_size=16).digest() for i in range(n)]
                two = np.frombuffer(b"".join(wins), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([doc] * n, pa.int64()),
                     pa.array(np.arange(low, low + n))], names=["x", "y", "doc_id", "low"])

    wins = written(contexts.mapInArrow(run, "x long, y long, doc_id long, low long"), "windows")
    first = wins.groupBy("x", "y").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = wins.join(first, ["x", "y"])
    start = own.where("doc_id = doc").groupBy("x", "y").agg(F.min("low").alias("start"))
    return (own.join(start, ["x", "y"]).where("doc_id <> doc OR low <> start")
            .select("doc_id", "low", F.col("low").alias("high")))


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, low, high): starts of windows to remove, of (doc_id, text) with unique ids."""
    place = F.col("place")
    runs = [F.shiftright(place, 16).alias("low"),
            (F.shiftright(place, 16) + place.bitwiseAND(255) - 1).alias("high")]
    units = written(unit_rows(docs), "units")
    at_once = units.where("gram IS NULL").select("doc_id", *runs)
    units_ = units.where("gram IS NOT NULL")
    grams = (units_.groupBy("gram").agg(F.min("unit").alias("u"), F.max("unit").alias("v"),
                                        F.count(F.lit(1)).alias("k")).where("k > 1"))
    shared = units_.join(grams.select("gram", (F.col("u") != F.col("v")).alias("mixed")), "gram")
    shared = written(shared, "shared")
    firsts = shared.groupBy("gram", "unit").agg(F.min("doc_id").alias("first"))
    judged = written(shared.join(firsts, ["gram", "unit"]), "judged")
    whole = judged.where("doc_id <> first").select("doc_id", *runs)
    partly = judged.where("doc_id = first AND mixed").select("gram", "doc_id", "place")
    crowds = written(partly.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select("gram"),
                     "crowds")
    wanted = partly.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "place")).alias("units"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py().encode()
                for u in batch.column(2)[i].as_py():
                    low, _, n = _unpack(u["place"])
                    rows.append((u["gram"], batch.column(0)[i].as_py(), u["place"], data[low:low + n + LENGTH - 1]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["gram", "doc_id", "place", "bytes"])

    contexts = written(docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(
        cut, "gram long, doc_id long, place long, bytes binary"), "contexts")
    compared = _compared(contexts.join(crowds, "gram", "left_anti"))
    singly = _one_by_one(contexts.join(crowds, "gram", "left_semi"))
    out = written(at_once.unionByName(whole).unionByName(compared).unionByName(singly), "removed")
    release(units, shared, judged, contexts)
    return out


def _identified(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text, own) with unique ids in the documents' order, and whether they are new.
    Only null or repeated ids make it sort and number the rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1)
    if not odd.count():
        return rows, False
    rows = rows.withColumnRenamed("doc_id", "own").orderBy(F.col("own").asc_nulls_last(), "text")
    return written(rows.withColumn("doc_id", F.monotonically_increasing_id()), "numbered"), True


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``kept``,
    the remaining bytes, if asked for (they need not be whole characters).

    Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; null ids come
    after all others; rows that repeat an id are documents of their own, in the order of their
    texts; no rows give no rows; other columns are not read; whole texts are compared.
    """
    rows, numbered = _identified(docs)
    gone = (removed_windows(rows).groupBy("doc_id")
            .agg(F.collect_list(F.struct("low", "high")).alias("runs")))
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = fields + (", kept binary" if with_text else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, runs = batch.column(0).to_pylist(), batch.column(2)
            for i, doc in enumerate(ids):
                data = batch.column(1)[i].as_py().encode()
                spans = []
                own = runs[i].as_py() or []
                for a, b in sorted((u["low"], u["high"] + LENGTH) for u in own):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                at, parts = 0, []
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                row = (doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            cols = list(zip(*out, strict=True)) or [[]] * (5 + with_text)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)],
                                             names=[x.split()[0] for x in schema.split(", ")])

    if numbered:
        joined = rows.join(gone, "doc_id", "left").select("own", "text", "runs")
    else:
        joined = rows.join(gone, "doc_id", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(apply, schema)
