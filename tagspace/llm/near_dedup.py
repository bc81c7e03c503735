"""Near-duplicate documents by HyperMinHash sketches.

A document's set of word shingles is hashed once per register; the register stores the minimum
as its count of leading zeros and the next ``MANTISSA`` bits. Bands of registers bring
candidates together. A pair's Jaccard similarity is estimated from the share of equal registers,
corrected for equal registers of different minima; only pairs far below the threshold are let go.
The rest are compared on their full shingle sets.

Documents with equal sets are one node, whatever their number. Within a bucket of a band not all
pairs are formed:

1. every document is compared with the smallest of the smallest members of its buckets;
2. while buckets hold several components, every document in such a bucket is compared with one
   more centre of its buckets, for ``STARS`` rounds: at most one pair per document and round;
3. buckets of at most ``FEW`` members that still do give their pairs of different components;
4. the larger ones that still do are compared in groups. Buckets that share documents hold largely
   the same ones, once per band; a group is therefore all documents of buckets that hang together,
   each once, or a single bucket where that moves fewer rows. Groups are cut into tiles of two
   blocks of at most about ``BLOCK`` documents; a tile compares registers, then counts the shingles
   that its documents have in common by one matrix product, and returns at most one link for
   each of its documents.

A link between two members of one bucket is thus either found or joins documents that are already
in one component, but for two chances: that a pair at the threshold shares no band, (1 - 0.85^5)^25,
less than one in a million (at 80 percent (1 - 0.8^5)^25, 5 in 100,000), and that its registers
estimate it six standard deviations too low (less than one in ten million).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, release, shingle_hashes, slices, small, text_buffers, without, word_hashes, word_spans, written
from .components import components

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, MANTISSA = 25, 5, 10
#: Rounds of one comparison per document; members of a bucket whose pairs are formed.
STARS, FEW = 2, 4
#: Documents of one side of a tile and shingles that they have together, on average at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Columns (shingles) of the matrices that a tile multiplies at a time.
COLUMNS = 2048
#: Parts that the members of a bucket are dealt to.
SALT = 16
#: Standard deviations below the threshold from which an estimate lets a pair go.
DEVIATIONS = 6.0
#: Chance that two registers of equally large, disjoint sets agree, times 2**MANTISSA.
COLLISION = 0.16992

_RNG = np.random.Generator(np.random.PCG64(85))
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, registers binary, bands array<long>"


def compress(minima: np.ndarray) -> np.ndarray:
    """Registers of 64-bit minima: leading zeros, then the bits after the leading one."""
    m, e = np.frexp((minima >> np.uint64(11)).astype(np.float64))
    zeros = 53 - e
    return ((zeros << MANTISSA) | ((m * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)


def _shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(raw, offsets)
    return shingle_hashes(word_hashes(raw, starts, ends), first, size)


def _sketch(raw: np.ndarray, offsets: np.ndarray, size: int):
    """(n, set_a, set_b, registers, band keys) of the rows of a slice."""
    hashes, first = _shingles(raw, offsets, size)
    rows = len(offsets) - 1
    n, fp = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    for r in some:
        own = np.unique(hashes[first[r]:first[r + 1]])
        n[r] = len(own)
        with np.errstate(over="ignore"):
            fp[r] = mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    minima = np.zeros((rows, len(_XOR)), np.uint64)
    at = first[some]
    if len(at):
        for j, (x, m) in enumerate(zip(_XOR, _MUL, strict=True)):
            minima[some, j] = np.minimum.reduceat((hashes ^ x) * m, at)
    registers = compress(minima)
    keys = np.column_stack([_band_keys(registers, band) for band in range(BANDS)])
    return n, fp.view(np.int64), registers, keys


def _band_keys(registers: np.ndarray, band: int) -> np.ndarray:
    """Key of a band of registers, for each row."""
    key = np.full(len(registers), band + 1, np.uint64)
    for j in range(band * ROWS, (band + 1) * ROWS):
        key = mix(key + registers[:, j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Sketch of every row; a set without shingles has no registers and no bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                n, fp, registers, keys = _sketch(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                none = n == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(n), pa.array(fp[:, 0], mask=none),
                    pa.array(fp[:, 1], mask=none),
                    pa.array([None if x else r.tobytes() for x, r in zip(none, registers, strict=True)], pa.binary()),
                    pa.array([[] if x else k for x, k in zip(none, keys, strict=True)], pa.list_(pa.int64()))],
                    names=[x.split()[0] for x in SKETCH.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles): the sorted distinct 64-bit shingle hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                hashes, first = _shingles(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                sets = [np.unique(hashes[first[r]:first[r + 1]]).tobytes() for r in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, shingles binary")


def least_estimate(percent: int) -> float:
    """Estimates below this cannot, but for six standard deviations, belong to a link."""
    j = percent / 100
    return j - DEVIATIONS * (j * (1 - j) / (BANDS * ROWS)) ** 0.5


def estimated(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for collisions."""
    x = n / m
    chance = COLLISION / (1 << MANTISSA) * 4 * x / (1 + x) ** 2
    return (equal - chance) / (1 - chance)


def _likely(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow a link."""
    low = least_estimate(percent)
    side = [sketched.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n{k}"),
                            F.col("registers").alias(f"r{k}")) for k in "ab"]
    rows = (pairs.join(side[0], "a").join(side[1], "b")
            .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .select("a", "b", "na", "nb", "ra", "rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ra, rb = batch.columns
            if not batch.num_rows:
                continue
            equal = (_matrix(ra) == _matrix(rb)).mean(axis=1)
            ok = pa.array(estimated(equal, na.to_numpy(), nb.to_numpy()) >= low)
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _matrix(registers) -> np.ndarray:
    joined = b"".join(x if isinstance(x, bytes) else x.as_py() for x in registers)
    return np.frombuffer(joined, np.uint16).reshape(len(registers), -1)


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    rows = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
            .select("a", "b", "sa", "sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([_link(*(np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3)), percent)
                           for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)],
                                             names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _by_bucket(rows: DataFrame, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (key, doc_id, ...) joined to ``buckets``, one row per key: members are dealt to
    ``SALT`` parts of their bucket, each of which meets a copy, so no bucket goes to one task."""
    salted = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
            .join(salted, ["key", "salt"], how).drop("salt"))


def _active(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, doc_id, label) of the buckets with several components."""
    if labels is None:
        rows = members.withColumn("label", F.col("doc_id"))
    else:
        rows = (members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .select("key", "doc_id", F.coalesce("component", "doc_id").alias("label")))
    open_ = (rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
             .where("low < high").select("key"))
    return _by_bucket(rows, open_, "left_semi")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_centres(active: DataFrame, priority) -> DataFrame:
    """One pair for each document with a centre of another component: a bucket's centre is its
    member of least priority, and a document takes the least of its buckets' centres."""
    centre = active.groupBy("key").agg(F.min(F.struct(priority.alias("p"), "doc_id", "label")).alias("c"))
    own = (_by_bucket(active, centre).where(F.col("label") != F.col("c.label"))
           .groupBy("doc_id").agg(F.min("c").alias("c")))
    return own.select(*_ordered("doc_id", "c.doc_id")).distinct()


def _few(active: DataFrame, few: int = FEW) -> DataFrame:
    """Pairs of different components in buckets of at most ``few`` members."""
    ids = F.sort_array(F.collect_list(F.struct("doc_id", "label")))
    held = active.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= few).select("key")
    rows = _by_bucket(active, held, "left_semi").groupBy("key").agg(ids.alias("ids"))
    one = rows.select("ids", F.posexplode("ids").alias("at", "x"))
    both = one.select("x", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("y"))
    return both.where("x.label <> y.label").select(*_ordered("x.doc_id", "y.doc_id")).distinct()


def _groups(active: DataFrame, nodes: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(gid, doc_id, label, blocks) of the groups in which the members of open buckets are compared:
    all documents of connected buckets, or the buckets by themselves, whichever moves fewer rows."""
    sized = active.join(nodes.select("doc_id", "n_shingles"), "doc_id")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("total") / shingles)).cast("int")
    size = [F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")]
    lowest = active.groupBy("key").agg(F.min("doc_id").alias("low"))
    whole = components(_by_bucket(active, lowest).select(F.col("low").alias("a"), F.col("doc_id").alias("b")))
    of = written(sized.join(whole.withColumnRenamed("node", "doc_id"), "doc_id"), "hanging")
    once = of.select("component", "doc_id", "label", "n_shingles").distinct()
    joint = once.groupBy("component").agg(*size).select("component", blocks.alias("blocks"), "n")
    apart = of.groupBy("component", "key").agg(*size).select("component", "key", blocks.alias("blocks"), "n")
    apart = written(apart, "apart")
    cost = (apart.groupBy("component").agg(F.sum(F.col("blocks") * F.col("n")).alias("cost"))
            .join(joint, "component"))
    cheap = written(cost.select("component", (F.col("n") * F.col("blocks") <= F.col("cost")).alias("joined"), "blocks"), "cheap")
    together = (once.join(small(cheap.where("joined")), "component")
                .select(F.struct(F.lit(0).alias("kind"), F.col("component").alias("id")).alias("gid"), "doc_id", "label", "blocks"))
    shape = apart.join(cheap.where("NOT joined").select("component"), "component", "left_semi").select("key", "blocks")
    alone = (_by_bucket(active, shape)
             .select(F.struct(F.lit(1).alias("kind"), F.col("key").alias("id")).alias("gid"), "doc_id", "label", "blocks"))
    return together.unionByName(alone)


def _tiles(groups: DataFrame) -> DataFrame:
    """A row of (gid, lo, hi, block, ...) for each tile of a document: its block and any block."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = groups.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("gid.kind", "gid.id", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                       "block", "doc_id", "label")


def common_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    used = np.union1d(left, right)
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, n = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, column = owner[shared], (np.cumsum(n > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(used), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        out += (held[place[left]] @ held[place[right]].T).astype(np.int64)  # whole numbers up to COLUMNS
    return out


def _links_in_tile(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a tile's documents, at most one for each document."""
    label, n, ids, block = (rows.column(c).to_numpy() for c in ("label", "n_shingles", "doc_id", "block"))
    if rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py():
        names, count = np.unique(label, return_counts=True)
        left, right = np.flatnonzero(label != names[count.argmax()]), np.arange(len(ids))
    else:
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    if not len(left) or (label == label[0]).all():
        return []
    registers = _matrix(rows.column("registers").to_pylist())
    equal = np.zeros((len(left), len(right)), np.int16)
    for j in range(registers.shape[1]):
        equal += registers[left, j][:, None] == registers[right, j][None, :]
    a, b = n[left][:, None], n[right][None, :]
    likely = ((label[left][:, None] != label[right][None, :])
              & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
              & (estimated(equal / registers.shape[1], a, b) >= least_estimate(percent)))
    some, others = likely.any(axis=1), likely.any(axis=0)
    left, right, likely = left[some], right[others], likely[some][:, others]
    if not len(left):
        return []
    common = common_shingles([np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()], left, right)
    linked = likely & (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common))
    out, part = [], np.unique(label, return_inverse=True)[1]
    for k in np.flatnonzero(linked.any(axis=1)):
        to = right[linked[k]]
        parts, first = np.unique(part[to], return_index=True)
        new = parts != part[left[k]]
        out += [tuple(sorted((int(ids[left[k]]), int(ids[to[f]])))) for f in first[new]]
        if new.any():
            part[np.isin(part, parts)] = part[left[k]]
    return out


def _across(active: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, **sizes) -> DataFrame:
    """Links between components in the open buckets, enough of them to join what is linked."""
    rows = (_tiles(_groups(active, nodes, **sizes)).join(nodes.select("doc_id", "n_shingles", "registers"), "doc_id")
            .join(sets, "doc_id"))
    tile = ["kind", "id", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last tile, which the next batch may go on with
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            rows = pa.Table.from_batches(held) if held else None
            if rows is None or not rows.num_rows:
                continue
            at = np.column_stack([rows.column(c).to_numpy() for c in tile])
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
            ends = np.append(edge[1:], len(at))
            done = list(zip(edge, ends, strict=True))[:None if batch is None else -1]
            out = [link for a, b in done for link in _links_in_tile(rows.slice(a, b - a), percent)]
            held = rows.slice(edge[-1]).to_batches()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links: 100 * intersection >= percent * union of the shingle sets. Defined cases: a null or
    empty text, or one without words, has an empty set and is linked with nothing; a text of
    fewer words than a shingle has its whole sequence as the one shingle; rows that repeat a
    doc_id are one document that has the links of each; a null doc_id is linked with nothing and
    kept; no rows give no rows; other columns are not read.
    """
    sketched = written(sketches(docs, size), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = written(known.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .where("first < last").select(*key, "first"), "equal")
    nodes = known.join(equal, key, "left").where(F.col("doc_id") == F.coalesce("first", "doc_id"))
    nodes = written(nodes.dropDuplicates(["doc_id", "set_a", "set_b"])
                    .select("doc_id", "n_shingles", "registers", "bands"), "nodes")
    keyed = nodes.select("doc_id", F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(keyed.join(shared, "key", "left_semi"), "members")
    wanted = members.select("doc_id").distinct()
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(wanted, "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]))
    sets = written(shingle_sets(texts, size), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        likely = written(_likely(pairs, nodes, percent), "likely")
        found = written(_linked(likely, sets, percent), "links")
        release(likely)
        return found

    def still_active(rows: DataFrame) -> DataFrame:
        left = written(_active(rows.drop("label"), labels), "active")
        release(rows)
        return left

    tested = links = labels = None
    active, compared = members, []
    for turn in range(STARS + 1):
        active = still_active(active)
        if turn < STARS:
            pairs = _with_centres(active, F.xxhash64(F.lit(turn), "doc_id") if turn else F.col("doc_id"))
        else:
            pairs = _few(active)
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = verified(pairs)
        compared.append(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if turn < STARS:
            labels = written(components(links), "labels")
    larger = active.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("key")
    wide = written(_by_bucket(active, larger, "left_semi"), "wide")
    if not wide.isEmpty():
        links = links.unionByName(written(_across(wide, nodes, sets, percent), "links"))
    labels = written(components(links), "labels")
    compared.append(wide)
    release(active, nodes, sets, *compared)  # the result reads none of them

    out = (sketched.select("doc_id", *key).join(equal, key, "left")
           .withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")))
           .join(labels, "node", "left")
           .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")))
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents of a group but its smallest doc_id. Rows are told apart by
    doc_id, null too, and text; of a group the rows whose id is null or repeated go first."""
    return without(docs, lambda rows: near_groups(rows, percent).where(~F.col("kept")))
