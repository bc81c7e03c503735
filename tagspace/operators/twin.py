"""Twin matching (V4-V6): nearest-neighbour similarity between groups of texts.

For a in A and group B: t(a) = argmax_b cos(a, b) (smallest id on ties);
C_A(a) = max(0, max over a' in A, a' != a of cos(a, a')).
S(A, B) = mean over a of cos(a, t(a)) / (C_A(a) + C_B(t(a))).

Plan (exact, memory bounded): vectors with clusters are searched cell by cell, with
bounds that leave out most pairs (``operators.nearest``). Where bounds do not help, all
pairs are multiplied: vectors are dealt by a hash of their id into the
rows and columns of a square grid of tiles, as wide as the tasks need, or as
``TILE_ROWS`` asks for. Every unordered pair meets in one ``applyInPandas`` group (an
equi-join on the pair key, not a cross join). Inside a tile, blocks of rows are
multiplied with the other side, and only the best (similarity, id) of each row
and group, and the best excluding the row itself, leave the tile. Spark reduces
them per (row, group). That work is quadratic in the number of vectors; a vector is
copied once per tile of its row, no task holds more than one tile, and no pair of
vectors is ever a row.

A mean over rows of which one has a zero denominator is undefined: NULL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspace.operators import nearest
from tagspace.operators.distance import unit_embeddings
from tagspace.session import cut_lineage

TILE_ROWS = 32768   # most vectors of one side of a tile
_BEST = ("a_id", "a_grp", "g", "best_sim", "best_id", "excl_sim")
BLOCK_ROWS = 512    # rows of a tile that meet the other side at a time


def _side(a: pd.DataFrame, b: pd.DataFrame) -> list[pd.DataFrame]:
    """Bests of the rows of ``a`` among ``b``, block by block of ``a``. ``b`` is laid out once, group
    by group and by id, so that a group is a slice of the products, and argmax takes the smallest id."""
    if a.empty or b.empty:  # a tile of which one side has no vectors
        return []
    ids, grp, groups, order, at = b["id"].to_numpy(), b["grp"].to_numpy(), [], [], 0
    for g in pd.unique(grp):
        cols = np.flatnonzero(grp == g)
        cols = cols[np.argsort(ids[cols], kind="stable")]
        groups.append((g, slice(at, at + len(cols)), ids[cols]))
        order.append(cols)
        at += len(cols)
    if not groups or not at:
        return []
    ub = np.stack(b["u"].to_numpy()[np.concatenate(order)])
    return [p for i in range(0, len(a), BLOCK_ROWS) for p in _block(a.iloc[i:i + BLOCK_ROWS], ub, groups)]


def _block(a: pd.DataFrame, ub: np.ndarray, groups: list[tuple]) -> list[pd.DataFrame]:
    sims = np.stack(a["u"].to_numpy()) @ ub.T
    ids_a, rows, parts = a["id"].to_numpy(), np.arange(len(a)), []
    for g, cols, ids in groups:
        if not len(ids):
            continue
        sg = sims[:, cols]
        j = sg.argmax(axis=1)
        best = sg[rows, j]
        # the row itself, which only its own group holds
        first = np.searchsorted(ids, ids_a)
        own = np.flatnonzero(ids[np.minimum(first, len(ids) - 1)] == ids_a)
        excl = best.copy()
        for r in own:
            sg[r, first[r]:np.searchsorted(ids, ids_a[r], "right")] = -np.inf
        if len(own):
            excl[own] = sg[own].max(axis=1)
        parts.append(pd.DataFrame({
            "a_id": ids_a, "a_grp": a["grp"].to_numpy(), "g": g, "best_sim": best,
            "best_id": ids[j], "excl_sim": np.where(np.isneginf(excl), np.nan, excl)}))
    return parts


def _block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    a, b = pdf[pdf["blk"] == lo], pdf[pdf["blk"] == hi]
    parts = _side(a, a) if lo == hi else _side(a, b) + _side(b, a)
    if not parts:
        return pd.DataFrame({c: [] for c in _BEST}, dtype=object)
    out = pd.concat(parts, ignore_index=True)
    texts = [c for c in ("a_id", "a_grp", "g", "best_id") if not pd.api.types.is_numeric_dtype(out[c])]
    return out.astype({c: object for c in texts})


def tiles(n: int, tasks: int, tile_rows: int = TILE_ROWS) -> int:
    """Side of the grid: about one tile per task, never wider tiles than ``tile_rows``."""
    return max(1, math.ceil(n / tile_rows), min(math.ceil(math.sqrt(2 * tasks)), math.ceil(n / BLOCK_ROWS)))


def _bests_schema(vecs: DataFrame) -> str:
    kind = vecs.schema["id"].dataType.simpleString()
    return f"a_id {kind}, a_grp string, g string, best_sim double, best_id {kind}, excl_sim double"


def _reduced(parts: DataFrame) -> DataFrame:
    return parts.groupBy("a_id", "a_grp", "g").agg(
        F.max("best_sim").alias("best_sim"),
        F.min_by("best_id", F.struct(-F.col("best_sim"), F.col("best_id"))).alias("best_id"),
        F.max("excl_sim").alias("excl_sim"))


def nearest_pruned(vecs: DataFrame, most: float = nearest.MOST, cell_rows: int | None = None,
                   least: int = 0) -> tuple[DataFrame, nearest.Search] | None:
    """The rows of ``nearest_by_group`` without multiplying all pairs, and how many were; None
    where more than ``most`` of them would be, or there are fewer than ``least`` vectors."""
    got = nearest.pruned(unit_embeddings(vecs.select("id", "grp", "embedding")), most, cell_rows or nearest.CELL_ROWS, least)
    return got and (_reduced(got[0]), got[1])


def nearest_by_group(vecs: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(a_id, a_grp, g, best_sim, best_id, excl_sim) for every vector and group.

    ``vecs`` has (id, grp, embedding); ids may be of any orderable type. With ``n_blocks`` all
    pairs are multiplied, in a grid of so many tiles a side.
    """
    if n_blocks is None and (got := nearest_pruned(vecs, least=nearest.FEW)):
        return got[0]
    schema = _bests_schema(vecs)
    u = unit_embeddings(vecs.select("id", "grp", "embedding"))
    if n_blocks is None:
        n_blocks = tiles(vecs.count(), int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    blk = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    rep = u.withColumn("blk", blk).withColumn("j", F.explode(others))
    rep = rep.withColumn("lo", F.least("blk", "j")).withColumn("hi", F.greatest("blk", "j"))
    local = (rep.select("lo", "hi", "blk", "id", "grp", "u")
             .groupBy("lo", "hi").applyInPandas(_block_pair, schema))
    return _reduced(local)


def twin_similarity_matrix(vecs: DataFrame, checkpoint: bool = True, **kw) -> DataFrame:
    """V5: S(g1, g2) for every ordered pair of groups, the diagonal included.

    The per-row bests are written once to the checkpoint folder (they are read
    twice: for each row and as the twins' own C); C of a row comes from a window
    over its G rows.
    """
    nn = nearest_by_group(vecs, **kw)
    if checkpoint:
        nn = cut_lineage(nn)
    c = F.greatest(F.lit(0.0), F.coalesce("excl_sim", F.lit(0.0)))
    nn = nn.withColumn("c_a", F.max(F.when(F.col("g") == F.col("a_grp"), c))
                       .over(Window.partitionBy("a_id")))
    own = nn.filter(F.col("g") == F.col("a_grp")).select(F.col("a_id").alias("t_id"),
                                                         F.col("c_a").alias("c_t"))
    j = nn.join(own, nn.best_id == own.t_id)
    ratio = F.try_divide(F.col("best_sim"), F.col("c_a") + F.col("c_t"))
    return j.groupBy(F.col("a_grp").alias("g1"), F.col("g").alias("g2")).agg(
        F.when(F.count(ratio) == F.count(F.lit(1)), F.avg(ratio)).alias("value"))


def twin_distance_matrix(vecs: DataFrame, **kw) -> DataFrame:
    """V6: diagonal of S set to 1, then D = 1 - (S + S^T) / 2."""
    s = twin_similarity_matrix(vecs, **kw)
    s = s.withColumn("value", F.when(F.col("g1") == F.col("g2"), F.lit(1.0))
                     .otherwise(F.col("value")))
    t = s.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), F.col("value").alias("vt"))
    return s.join(t, ["g1", "g2"]).select(
        "g1", "g2", (F.lit(1.0) - (F.col("value") + F.col("vt")) / 2.0).alias("value"))
