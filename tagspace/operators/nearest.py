"""Exact nearest vectors of every group, without multiplying all pairs (V4).

Unit vectors lie on a sphere, where angles obey the triangle inequality. Up to ``PIVOTS`` vectors are
pivots, and each vector belongs to the cell of its nearest pivot. For a cell and a group, the
smallest and largest angle of the group's members to the pivot bound the angle between any of
them and a vector whose angle to the pivot is known. So:

1. every vector visits, for each group, the cell with the best bound; its best similarity there is
   a lower bound;
2. it then visits every other cell whose bound reaches the lower bound of some group, and asks for
   those groups' members. No other members can be nearer, or as near.

Visitors, dealt by a hash, and members, dealt by cell, meet in a grid of tiles: about ``SIDE`` tiles a
side, of ``TILE_ROWS`` to ``WIDE_ROWS`` rows, whatever the size of a cell. A vector is copied once per tile of
its row or column; which cells and groups of a tile it visits is decided, and the bests over all
of them are kept, inside the tile. So the rows that move do not grow with the visits. Zero vectors have no angle: they are a cell of their
own, with bound 0, and as visitors (similar to nothing) they get each group's smallest id.

Vectors without clusters have no bounds that help. Before the visits ``SAMPLE`` vectors make theirs;
where that multiplies more than ``MOST`` of their pairs, ``None`` is returned and the caller multiplies
all pairs. The choice changes the work, not the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspace.session import cut_lineage

PIVOTS, DRAWN, CELL_ROWS = 1024, 4, 256
TILE_ROWS, WIDE_ROWS, SIDE, BLOCK_ROWS = 4096, 32768, 8, 512
SAMPLE, MOST = 512, 0.1
#: Vectors from which a search by cells is tried unasked: the pairs of fewer are soon multiplied.
FEW = 8192
#: Angles and similarities closer than this are not told apart.
SLACK = 1e-6
#: Bounds, or similarities, that are held at a time.
BOUNDS = 1 << 21


@dataclass
class Cells:
    """Pivots (P x length) and, by cell (the last one of zero vectors) and group, the number of
    members and their smallest and largest angle to the pivot."""

    pivots: np.ndarray
    groups: list
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def angles(self, u: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(u @ self.pivots.T, -1.0, 1.0))

    def bounds(self, u: np.ndarray) -> np.ndarray:
        """(rows, cells, groups): no member of the cell and group is more similar to the row."""
        t = self.angles(u)[:, :, None]
        apart = np.maximum(t - self.high[None, :-1], self.low[None, :-1] - t) - SLACK
        out = np.zeros((len(u), len(self.count), len(self.groups)))
        out[:, :-1] = np.cos(np.clip(apart, 0.0, math.pi)) + SLACK
        out[:, self.count == 0] = -np.inf
        return out

    def steps(self, rows: int) -> Iterator[slice]:
        step = max(1, BOUNDS // (self.count.size + 1))
        return (slice(a, a + step) for a in range(0, rows, step))


@dataclass
class Search:
    """What a search multiplied."""

    vectors: int
    cells: int
    pairs: int

    @property
    def share(self) -> float:
        return self.pairs / max(1, self.vectors) ** 2


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _placed(u: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, grp, u, cell, angle); zero vectors are in the cell after the last pivot's."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            own = _matrix(pdf["u"])
            sims = own @ pivots.T
            cell = sims.argmax(axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(own)), cell], -1.0, 1.0))
            zero = ~own.any(axis=1)
            yield pdf.assign(cell=np.where(zero, len(pivots), cell).astype(np.int32), angle=np.where(zero, 0.0, angle))

    return u.mapInPandas(run, f"id {u.schema['id'].dataType.simpleString()}, grp string, u array<double>, cell int, angle double")


def _pivots(u: DataFrame, want: int) -> np.ndarray:
    """At most ``want`` vectors, each the farthest from those before it among a sample, drawn by a
    hash, of ``DRAWN`` times as many: no cluster of the sample is left without."""
    if want < 2:
        return np.zeros((0, 0))
    rows = u.where(F.exists("u", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(DRAWN * want)
    sample = np.array([r["u"] for r in rows.select("u").toLocalIterator()])
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < want and near.min() < 1.0 - SLACK:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _cells(placed: DataFrame, pivots: np.ndarray) -> Cells:
    rows = placed.groupBy("cell", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"),
                                             F.max("angle").alias("high")).collect()  # cells x groups
    groups = sorted({r["grp"] for r in rows}, key=lambda g: (g is None, g or ""))
    at = {g: k for k, g in enumerate(groups)}
    shape = len(pivots) + 1, len(groups)
    out = Cells(pivots, groups, np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape))
    for r in rows:
        place = r["cell"], at[r["grp"]]
        out.count[place], out.low[place], out.high[place] = r["n"], r["low"], r["high"]
    return out


def _first_visits(placed: DataFrame, shared) -> DataFrame:
    """``placed`` with ``seen``, each group's cell with the best bound (as cell * groups + group)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: Cells = shared.value
        groups = len(cells.groups)
        for pdf in frames:
            if pdf.empty:
                continue
            out, own = [], _matrix(pdf["u"])
            for part in cells.steps(len(pdf)):
                out += (cells.bounds(own[part]).argmax(axis=1) * groups + np.arange(groups)).tolist()
            yield pdf.assign(seen=out).drop(columns="angle")

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields if f.name != "angle"]
    return placed.where(F.col("cell") < len(shared.value.pivots)).mapInPandas(run, ", ".join([*fields, "seen array<int>"]))


def _dealt(held: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(cell, tile, parts): neighbouring cells share a tile of at most ``most`` members; a cell of more
    is cut into parts with a tile each."""
    out, tile, filled = [], 0, 0
    for cell, n in enumerate(held.tolist()):
        parts = math.ceil(n / most)
        if filled and filled + n > most:
            tile, filled = tile + 1, 0
        if parts:
            out.append((cell, tile, parts))
            tile, filled = (tile + parts, 0) if parts > 1 else (tile, filled + n)
    return out


def _tile(a: pd.DataFrame, b: pd.DataFrame, cells: Cells, again: bool) -> pd.DataFrame:
    """Bests of the visitors ``a`` among those members ``b`` that they ask for: in the cell they have
    ``seen`` for a group or, ``again``, in any other whose bound reaches the least that they know."""
    groups = len(cells.groups)
    at = {g: k for k, g in enumerate(cells.groups)}
    codes = pd.factorize(pd.concat([a["id"], b["id"]], ignore_index=True), sort=True)[0]
    ids_a, ids = codes[:len(a)], codes[len(a):]
    key = b["cell"].to_numpy().astype(np.int64) * groups + np.array([at[g] for g in b["grp"]])
    order = np.lexsort((ids, key))  # so that argmax takes the smallest id
    key, ids, ub = key[order], ids[order], _matrix(b["u"])[order]
    edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
    present = np.unique(key // groups)
    placed = present[present < len(cells.pivots)]
    parts = []
    step = max(BLOCK_ROWS, 4 * BOUNDS // len(present))
    for start in range(0, len(a), step):
        some = a.iloc[start:start + step]
        own, own_ids, seen = _matrix(some["u"]), ids_a[start:start + step], _matrix(some["seen"]) // groups
        shape = len(some), groups
        best, excl, who, work = np.full(shape, -np.inf), np.full(shape, -np.inf), np.full(shape, -1), np.zeros(shape, np.int64)
        if again:
            angle = np.arccos(np.clip(own @ cells.pivots[placed].T, -1.0, 1.0))
            least = _matrix(some["least"])
            reach = np.arccos(np.clip(least - 2 * SLACK, -1.0, 1.0)) + SLACK
        for s, e in itertools.pairwise(edges):
            c, k = divmod(int(key[s]), groups)
            if not again:
                asks = seen[:, k] == c
            elif c == len(cells.pivots):
                asks = (least[:, k] <= SLACK) & (seen[:, k] != c)
            else:
                t = angle[:, np.searchsorted(placed, c)]
                asks = (t - cells.high[c, k] <= reach[:, k]) & (cells.low[c, k] - t <= reach[:, k]) & (seen[:, k] != c)
            asking = np.flatnonzero(asks)
            rows = max(1, BOUNDS // (e - s))
            for r in (asking[i:i + rows] for i in range(0, len(asking), rows)):
                sims = own[r] @ ub[s:e].T
                j = sims.argmax(axis=1)
                sim = sims[np.arange(len(r)), j]
                other = sim.copy()
                first = np.searchsorted(ids[s:e], own_ids[r])
                same = np.flatnonzero(ids[s + np.minimum(first, e - s - 1)] == own_ids[r])
                for q in same:  # the row itself, and rows of its id
                    sims[q, first[q]:np.searchsorted(ids[s:e], own_ids[r[q]], "right")] = -np.inf
                if len(same):
                    other[same] = sims[same].max(axis=1)
                old = best[r, k]
                better = (sim > old) | ((sim == old) & (ids[s + j] < ids[who[r, k]]))
                best[r[better], k], who[r[better], k] = sim[better], (s + j)[better]
                excl[r, k] = np.maximum(excl[r, k], other)
                work[r, k] += e - s
        r, k = np.nonzero(work)
        parts.append(pd.DataFrame({
            "a_id": some["id"].to_numpy()[r], "a_grp": some["grp"].to_numpy()[r], "k": k.astype(np.int32), "best_sim": best[r, k],
            "best_id": b["id"].to_numpy()[order[who[r, k]]],
            "excl_sim": np.where(np.isneginf(excl[r, k]), np.nan, excl[r, k]), "work": work[r, k]}))
    return pd.concat(parts, ignore_index=True)


def _visited(rows: DataFrame, n: int, placed: DataFrame, shared) -> DataFrame:
    """(a_id, a_grp, k, best_sim, best_id, excl_sim, work): bests in group number k, and with how many
    members they were compared. Rows (id, grp, u, seen) make their first visits; with ``least``,
    the best similarity known in each group, those that remain. A vector is copied once per tile of
    its row or column, however many cells it visits. ``n``: number of rows."""
    cells: Cells = shared.value
    again, held = "least" in rows.columns, cells.count.sum(axis=1)
    most = min(WIDE_ROWS, max(TILE_ROWS, math.ceil(int(held.sum()) / SIDE)))
    dealt, deep = _dealt(held, most), max(1, math.ceil(n / most))
    wide = max(tile + parts for _, tile, parts in dealt)
    grid = F.broadcast(placed.sparkSession.createDataFrame(dealt, "cell int, tile int, parts int"))  # a row per cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if not again:
        rows = rows.withColumn("least", F.lit(None).cast("array<double>"))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    come = rows.select("id", "grp", "u", F.lit(None).cast("int").alias("cell"), "seen", "least",
                       part(F.lit(deep)).alias("i"), every(wide).alias("j"))
    stay = placed.join(grid, "cell").select(
        "id", "grp", "u", "cell", F.lit(None).cast("array<int>").alias("seen"), F.lit(None).cast("array<double>").alias("least"),
        every(deep).alias("i"), (F.col("tile") + part(F.col("parts"))).alias("j"))
    kind = placed.schema["id"].dataType.simpleString()
    schema = f"a_id {kind}, a_grp string, k int, best_sim double, best_id {kind}, excl_sim double, work long"
    names = [x.split()[0] for x in schema.split(", ")]

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        comes = pdf["seen"].notna().to_numpy()
        a, b = pdf[comes], pdf[~comes]
        out = _tile(a, b, shared.value, again) if len(a) and len(b) else pd.DataFrame()
        if out.empty:
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        return out.astype({c: object for c in names if not pd.api.types.is_numeric_dtype(out[c])})

    return come.unionByName(stay).groupBy("i", "j").applyInPandas(tile, schema)


def _zero_rows(placed: DataFrame, cells: Cells) -> DataFrame:
    """Bests of zero vectors: similarity 0 with everything, so each group's smallest id."""
    kind = placed.schema["id"].dataType
    least = placed.groupBy("grp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).collect()  # one row per group
    each = F.array(*[F.struct(F.lit(r["grp"]).cast("string").alias("g"), F.lit(r["id"]).cast(kind).alias("id"),
                              F.lit(r["n"]).alias("n")) for r in least])
    rows = placed.where(F.col("cell") == len(cells.pivots)).select("id", "grp", F.explode(each).alias("x"))
    others = F.when((F.col("x.n") > 1) | ~F.col("x.g").eqNullSafe(F.col("grp")), F.lit(0.0))
    return rows.select(F.col("id").alias("a_id"), F.col("grp").alias("a_grp"), F.col("x.g").alias("g"),
                       F.lit(0.0).alias("best_sim"), F.col("x.id").alias("best_id"), others.alias("excl_sim"))


def pruned(u: DataFrame, most: float = MOST, cell_rows: int = CELL_ROWS,
           least: int = 0) -> tuple[DataFrame, Search] | None:
    """Partial bests (a_id, a_grp, g, best_sim, best_id, excl_sim) of all vectors ``u`` (id, grp, u), to
    be reduced per row and group; and what was multiplied. None where bounds would leave more than
    ``most`` of the pairs, or where there are fewer than ``least`` vectors."""
    n = u.count()
    if n < max(least, 2 * cell_rows):
        return None
    u = cut_lineage(u.select("id", "grp", "u"))
    pivots = _pivots(u, min(PIVOTS, n // cell_rows))
    if len(pivots) < 2:
        return None
    placed = cut_lineage(_placed(u, pivots))
    cells = _cells(placed, pivots)
    shared = placed.sparkSession.sparkContext.broadcast(cells)
    numbers, unknown = F.sequence(F.lit(0), F.lit(len(cells.groups) - 1)), F.lit(-math.inf)
    own = F.get(F.array(*[F.lit(g).cast("string") for g in cells.groups]), F.col("k"))

    def search(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
        first = cut_lineage(_first_visits(rows, shared))
        found = cut_lineage(_visited(first, n, placed, shared).withColumn("g", own))
        # the row itself is no bound for its own group
        sim = F.when(F.col("g").eqNullSafe(F.col("a_grp")), F.col("excl_sim")).otherwise(F.col("best_sim"))
        known = (found.groupBy("a_id", "a_grp", "k").agg(F.max(sim).alias("sim"))
                 .groupBy("a_id", "a_grp").agg(F.map_from_entries(F.collect_list(F.struct("k", "sim"))).alias("m"))
                 .select("a_id", "a_grp", F.transform(numbers, lambda k: F.coalesce(F.col("m")[k], unknown)).alias("least")))
        same = F.col("id").eqNullSafe(F.col("a_id")) & F.col("grp").eqNullSafe(F.col("a_grp"))
        none = F.transform(numbers, lambda k: unknown)
        other = first.join(known, same, "left").select("id", "grp", "u", "seen", F.coalesce("least", none).alias("least"))
        both = found.unionByName(cut_lineage(_visited(other, n, placed, shared).withColumn("g", own)))
        return both.drop("k", "work"), both.agg(F.sum("work")).first()[0] or 0

    draw = placed.where(F.col("cell") < len(pivots)).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(SAMPLE)
    draw = cut_lineage(draw)
    drawn = draw.count()
    _, pairs = search(draw, drawn)
    if pairs > most * drawn * n:
        return None
    rows, pairs = search(placed, n)
    return rows.unionByName(_zero_rows(placed, cells)), Search(n, len(pivots), pairs)
