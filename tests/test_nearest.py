"""The search by cells against all pairs: same rows, and how much of the pairs it multiplies."""

import numpy as np
import pytest

from tagspace.operators import nearest
from tagspace.operators import twin as TW

VECS = "id string, grp string, embedding array<double>"


def clustered(n, around, dim=16, seed=1, spread=0.08):
    """n vectors around n / around centres; every cluster has all of four groups."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // around), dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return [(f"v{i:05d}", "abcd"[i // len(centres) % 4], (centres[i % len(centres)] + spread * r.normal(size=dim)).tolist())
            for i in range(n)]


def bests(df):
    return {(r.a_id, r.a_grp, r.g): (round(r.best_sim, 9), r.best_id, None if r.excl_sim is None else round(r.excl_sim, 9))
            for r in df.collect()}


def test_same_rows_with_zero_vectors_copies_and_null_groups(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE_ROWS", 32)  # hot cells are cut
    rows = clustered(240, 12)
    rows += [(f"z{i}", "abe"[i % 3], [0.0] * 16) for i in range(7)]
    rows += [(f"c{i}", "a", rows[5][2]) for i in range(80)]  # a third of all are copies
    rows += [("n1", None, rows[9][2]), ("n2", None, [1.0] + [0.0] * 15), ("far", "f", [-x for x in rows[0][2]])]
    v = spark.createDataFrame(rows, VECS)
    want = bests(TW.nearest_by_group(v, n_blocks=2))
    got, search = TW.nearest_pruned(v, most=1.0, cell_rows=8)
    got = bests(got)
    assert set(got) == set(want)
    assert [k for k in want if got[k] != want[k]] == []
    assert search.vectors == len(rows) and 0 < search.share < 0.6


def test_pairs_grow_less_than_quadratically(spark):
    pairs = []
    for n in (400, 1600):
        _, search = TW.nearest_pruned(spark.createDataFrame(clustered(n, 20), VECS), most=1.0, cell_rows=16)
        pairs.append(search.pairs)
    assert pairs[1] < 8 * pairs[0]  # all pairs would be 16 times as many
    assert pairs[1] < 0.2 * 1600 ** 2


def test_vectors_without_clusters_are_left_to_all_pairs(spark):
    r = np.random.default_rng(2)
    noise = [(f"v{i}", "ab"[i % 2], r.normal(size=48).tolist()) for i in range(200)]
    v = spark.createDataFrame(noise, VECS)
    assert TW.nearest_pruned(v, cell_rows=8) is None
    assert TW.nearest_pruned(v.limit(0)) is None
    assert TW.nearest_pruned(spark.createDataFrame([("z", "a", [0.0, 0.0])] * 3, VECS), cell_rows=1) is None


@pytest.mark.parametrize("cell_rows", [8, 10 ** 6])
def test_similarity_matrix_either_way(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(nearest, "FEW", 0)
    v = spark.createDataFrame(clustered(200, 20, spread=0.02), VECS)
    tiles = {(r.g1, r.g2): r.value for r in TW.twin_similarity_matrix(v, n_blocks=2).collect()}
    got = {(r.g1, r.g2): r.value for r in TW.twin_similarity_matrix(v).collect()}
    assert got == pytest.approx(tiles, abs=1e-9)


def test_bests_are_kept_inside_a_tile(spark):
    """A vector whose group is missing in its cluster visits most cells: it leaves a row per group all the same."""
    r = np.random.default_rng(5)
    rows = [(i, g, v) for i, (_, g, v) in enumerate(clustered(600, 12))]
    rows = [(i, "rare" if r.random() < 0.02 else g, v) for i, g, v in rows] + [(3, "other", rows[40][2])]  # an id in two groups
    u = TW.unit_embeddings(spark.createDataFrame(rows, "id long, grp string, embedding array<double>"))
    parts, search = nearest.pruned(u, most=1.0, cell_rows=8)
    visits = parts.count()
    assert visits <= 2 * len(rows) * 6  # of first visits and of the others; a row per visited cell would be many more
    assert search.pairs > 0.05 * len(rows) ** 2
    want = bests(TW.nearest_by_group(u.withColumnRenamed("u", "embedding"), n_blocks=2))
    assert bests(TW._reduced(parts)) == want


def test_cells_are_dealt_to_tiles():
    assert nearest._dealt(np.array([3, 2, 0, 25, 1, 9]), 10) == [(0, 0, 1), (1, 0, 1), (3, 1, 3), (4, 4, 1), (5, 4, 1)]
    assert nearest._dealt(np.array([10, 1]), 10) == [(0, 0, 1), (1, 1, 1)]
