import pytest
from pyspark.sql import functions as F

from tagspace import catalog as C
from tagspace.plans import experiment as XP
from tagspace.plans.grid import Config, readme_grid
from tagspace.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_grid_rows_equal_single_runs(spark):
    posts = FX.posts_event(spark, SF)
    emb = FX.event_embeddings(spark, SF)
    y = C.event_salience(spark, SF)
    configs = [Config("full"), Config("elected"), Config("random", seed=6, fraction=0.5),
               Config("random", seed=6, fraction=0.75), Config("content")]
    grid = {(r.marker, r.method): r for r in
            XP.experiment_grid(posts, emb, y, C.EVENT_GROUPS, configs, 5, 5).collect()}
    assert grid
    for c in configs:
        one = XP.run_experiment(posts, emb, y, C.EVENT_GROUPS, c, num_groups=5, threshold=5)
        for r in one.collect():
            g = grid[(r.marker, r.method)]
            assert (g.r, g.p, g.n_perm) == pytest.approx((r.r, r.p, r.n_perm), abs=1e-9)


def test_readme_grid_shape():
    g = readme_grid()
    assert len(g) == 59
    assert sum(c.mode == "random" for c in g) == 40
    assert sum(c.mode == "time" for c in g) == 12


def test_every_configuration_has_rows(spark):
    posts = FX.posts_event(spark, SF)
    configs = [Config("full"), Config("time", month_start=13, month_end=13)]
    rows = XP.experiment_grid(posts, FX.event_embeddings(spark, SF), C.event_salience(spark, SF),
                              C.EVENT_GROUPS, configs, 5, 5).collect()
    assert sorted((r.config, r.method) for r in rows) == [(i, m) for i in (0, 1) for m in ("pearson", "spearman")]
    none = [r for r in rows if r.config == 1]
    assert all((r.r, r.p, r.z, r.n_tags) == (None, None, None, 0) for r in none)
    assert all(r.r is not None and r.n_tags > 0 for r in rows if r.config == 0)
