import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspace.operators import distance as DS
from tagspace.operators import twin as TW

R2 = 1 / math.sqrt(2)


def _micro(spark):
    rows = [("A", 1, [1.0, 0.0]), ("A", 2, [0.0, 1.0]), ("B", 3, [1.0, 0.0]), ("B", 4, [R2, R2])]
    return spark.createDataFrame(rows, "grp string, id long, embedding array<double>")


def test_category_distance_golden(spark):
    v = _micro(spark)
    s = DS.category_distance(v, "sum").first()
    m = DS.category_distance(v, "mean").first()
    assert (s.g1, s.g2) == ("A", "B")
    assert s.value == pytest.approx(1.585786, abs=1e-6)
    assert m.value == pytest.approx(0.396447, abs=1e-6)
    # the per-dimension sum gives the same value
    assert DS.category_distance(v, "sum", dim=2).first().value == pytest.approx(s.value, abs=1e-12)


def test_zero_vector_has_cosine_zero(spark):
    v = spark.createDataFrame([("A", 1, [0.0, 0.0]), ("B", 2, [1.0, 0.0])],
                              "grp string, id long, embedding array<double>")
    assert DS.category_distance(v, "sum").first().value == pytest.approx(1.0)


def test_twin_goldens_and_tie(spark):
    v = _micro(spark)
    s = {(r.g1, r.g2): r.value for r in TW.twin_similarity_matrix(v).collect()}
    assert s[("A", "B")] == pytest.approx(1.207107, abs=1e-6)
    assert s[("B", "A")] == pytest.approx(1.207107, abs=1e-6)
    d = {(r.g1, r.g2): r.value for r in TW.twin_distance_matrix(v).collect()}
    assert d[("A", "B")] == pytest.approx(-0.207107, abs=1e-6)
    assert d[("A", "A")] == pytest.approx(0.0) and d[("B", "B")] == pytest.approx(0.0)


def _brute_twin(ids, grps, vecs):
    u = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    sims = u @ u.T
    out = {}
    groups = sorted(set(grps))
    idx = {g: [i for i in np.argsort(ids) if grps[i] == g] for g in groups}
    c = np.zeros(len(ids))
    for g in groups:
        for i in idx[g]:
            others = [sims[i, j] for j in idx[g] if j != i]
            c[i] = max([0.0] + others)
    for g1 in groups:
        for g2 in groups:
            vals = []
            for i in idx[g1]:
                cand = idx[g2]
                j = cand[int(np.argmax([sims[i, k] for k in cand]))]
                vals.append(sims[i, j] / (c[i] + c[j]))
            out[(g1, g2)] = float(np.mean(vals))
    return out


def test_twin_blocked_equals_brute_force(spark):
    from tagspace.sources.tables import table
    emb = table(spark, "/root/testdata/sf0.001", "embeddings").filter(F.col("label") < 4)
    v = emb.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"),
                   "embedding")
    rows = v.collect()
    want = _brute_twin(np.array([r.id for r in rows]), [r.grp for r in rows],
                       np.array([r.embedding for r in rows], dtype="float64"))
    for nb in (1, 3):
        got = {(r.g1, r.g2): r.value
               for r in TW.twin_similarity_matrix(v, n_blocks=nb).collect()}
        assert set(got) == set(want)
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_tag_matrix_symmetric_hollow(spark):
    from tagspace.catalog import QUERIES
    m = {(r.g1, r.g2): r.value for r in
         QUERIES["tag_distance_matrix"](spark, "/root/testdata/sf0.001").collect()}
    gs = sorted({g for g, _ in m})
    assert len(m) == len(gs) ** 2
    for a in gs:
        assert m[(a, a)] == 0.0
        for b in gs:
            assert m[(a, b)] == pytest.approx(m[(b, a)])


def test_vector_of_another_length_ends_the_query(spark):
    v = spark.createDataFrame([("A", 1, [1.0, 0.0]), ("B", 2, [0.0, 1.0, 5.0])],
                              "grp string, id long, embedding array<double>")
    with pytest.raises(Exception, match="length 2"):
        DS.category_distance(v, "sum", dim=2).collect()


def test_twin_undefined_row_makes_the_mean_null(spark):
    rows = [("A", "a1", [1.0, 0.0]), ("A", "a2", [1.0, 0.0]), ("A", "a3", [0.0, 0.0]), ("B", "b1", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "grp string, id string, embedding array<double>")
    s = {(r.g1, r.g2): r.value for r in TW.twin_similarity_matrix(v).collect()}
    assert s[("A", "B")] is None  # a3 has no denominator


def test_twin_string_ids_and_ties(spark):
    rows = [("A", "x2", [1.0, 0.0]), ("B", "y9", [1.0, 0.0]), ("B", "y10", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "grp string, id string, embedding array<double>")
    for nb in (1, 3):
        best = {(r.a_id, r.g): r.best_id for r in TW.nearest_by_group(v, n_blocks=nb).collect()}
        assert best[("x2", "B")] == "y10"


def test_twin_tiles_follow_tasks_then_memory():
    assert TW.tiles(1, 200) == 1 and TW.tiles(2000, 200) == 4
    assert TW.tiles(10 ** 6, 200) == 31  # tiles bounded by memory
    assert TW.tiles(20_000, 10 ** 6) == 40 and TW.tiles(30_000, 8) == 4  # copies bounded by tasks


def test_distances_and_sums_by_tag_move_no_vectors_twice(spark):
    """One shuffle of the mentions' stored vectors by tag; sums, complete tags and
    distances are formed where the rows lie, whether a tag is used often or not."""
    rows = [(i, "AB"[i % 2], f"#t{i % 3}", i % 3 == 0 or None) for i in range(60)]
    m = spark.createDataFrame(rows, "post_id long, grp string, tag string, often boolean")
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "post_id long, embedding array<float>")
    split = DS.tag_group_vectors(m, v, ["A", "B"], dim=2)
    whole = DS.tag_group_vectors(m.drop("often"), DS.unit_embeddings(v, dim=2), ["A", "B"], dim=2)
    key = lambda df: sorted((r.tag, r.grp, r.n, *[round(x, 9) for x in r.s]) for r in df.collect())
    assert key(split) == key(whole) and len(key(split)) == 6
    prof = DS.tag_group_vectors(m.drop("often"), v, ["A", "B"], dim=2)
    cells = DS.tag_distance_cells(DS.complete_tags(prof, 2), (), "sum", dim=2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = cells._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("hashpartitioning(tag") == 1 and "SortMergeJoin [tag" not in plan
    got = {(r.g1, r.g2): (r.value, r.n_tags) for r in cells.collect()}
    assert got[None, None][1] == 3 and set(got) == {(None, None), ("A", "B")}


def test_twin_side_equals_pairs_with_repeated_ids():
    """the members of a tile are laid out once, not for each block of rows."""
    import pandas as pd
    r = np.random.default_rng(1)
    a = pd.DataFrame({"id": r.permutation(np.r_[np.arange(900), np.arange(20)]), "grp": r.choice(["x", "y"], 920), "u": list(r.standard_normal((920, 4)))})
    got = pd.concat(TW._side(a, a)).sort_values(["a_id", "g"]).reset_index(drop=True)
    u, ids, grp = np.stack(a["u"]), a["id"].to_numpy(), a["grp"].to_numpy()
    s = u @ u.T
    for x in got.iloc[::97].itertuples():
        row = [k for k in np.flatnonzero(ids == x.a_id) if np.isclose(s[k][grp == x.g].max(), x.best_sim)]
        assert row and any(np.isclose(s[k][(grp == x.g) & (ids != x.a_id)].max(), x.excl_sim) for k in row)
