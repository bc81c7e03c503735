import pytest

from tagspace.operators.mantel import mantel
from tagspace.operators.salience import salience_columns, salience_matrix

CELLS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
G = ["a", "b", "c", "d"]


def _m(spark, vals):
    return spark.createDataFrame([(G[i], G[j], float(v)) for (i, j), v in zip(CELLS, vals)],
                                 "g1 string, g2 string, value double")


def test_mantel_goldens(spark):
    res = {r.method: r for r in mantel(_m(spark, [1, 2, 3, 4, 5, 6]),
                                       _m(spark, [2, 1, 4, 3, 6, 5]), G).collect()}
    for method in ("pearson", "spearman"):
        r = res[method]
        assert r.r == pytest.approx(0.828571, abs=1e-6)
        assert r.p == pytest.approx(5 / 24, abs=1e-9)
        assert r.z == pytest.approx(1.435128, abs=1e-6)
        assert r.n_perm == 24


def test_mantel_spearman_ties(spark):
    x = _m(spark, [1, 1, 2, 3, 3, 4])
    y = _m(spark, [1, 2, 2, 3, 4, 4])
    r = {row.method: row for row in mantel(x, y, G).collect()}
    import itertools

    import numpy as np
    import pandas as pd
    xs = pd.Series([1, 1, 2, 3, 3, 4], dtype=float).rank().to_numpy()
    ys = np.array([1, 2, 2, 3, 4, 4], dtype=float)
    ym = np.zeros((4, 4))
    for (i, j), v in zip(CELLS, pd.Series(ys).rank().to_numpy()):
        ym[i, j] = ym[j, i] = v
    rs = []
    for p in itertools.permutations(range(4)):
        yp = np.array([ym[p[i], p[j]] for i, j in CELLS])
        rs.append(np.corrcoef(xs, yp)[0, 1])
    rs = np.array(rs)
    assert r["spearman"].r == pytest.approx(rs[0], abs=1e-9)
    assert r["spearman"].p == pytest.approx(np.mean(np.abs(np.round(rs, 12)) >= abs(round(rs[0], 12))))
    assert r["spearman"].z == pytest.approx((rs[0] - rs.mean()) / rs.std(), abs=1e-9)


def test_mantel_sampled_permutations(spark):
    r = mantel(_m(spark, [1, 2, 3, 4, 5, 6]), _m(spark, [2, 1, 4, 3, 6, 5]), G, perms=10,
               methods=("pearson",)).first()
    assert r.n_perm == 10 and r.r == pytest.approx(0.828571, abs=1e-6)


def test_salience_first_category_dropped_and_filters(spark):
    rows = [(199709, "Germany", "X", 10.0, 1.0, 5.0, 1.0, 2.0),
            (199709, "Germany", "Y", 20.0, 2.0, 9.0, 4.0, None),
            (199709, "Austria", "X", 0.0, 0.0, 0.0, 0.0, 0.0),
            (199309, "Germany", "Y", 0.0, 0.0, 0.0, 0.0, 0.0)]
    wide = spark.createDataFrame(rows, "date int, countryname string, partyabbrev string, "
                                       "pervote double, peruncod double, per101 double, "
                                       "per102 double, per103_1 double")
    assert salience_columns(wide.columns, "full") == ["per101", "per102", "per103_1"]
    assert salience_columns(wide.columns, "cat") == ["per101", "per102"]
    m = {(r.g1, r.g2): r.value for r in salience_matrix(wide, 1997, ["X", "Y"]).collect()}
    assert m[("X", "Y")] == pytest.approx((3.0 ** 2 + 2.0 ** 2) ** 0.5)  # per101 dropped, null → 0
    assert m[("X", "X")] == 0.0
    m2 = {(r.g1, r.g2): r.value
          for r in salience_matrix(wide, 1997, ["X", "Y"], drop_first=False).collect()}
    assert m2[("X", "Y")] == pytest.approx((4.0 ** 2 + 3.0 ** 2 + 2.0 ** 2) ** 0.5)
    with pytest.raises(ValueError):
        salience_columns(wide.columns, "nope")


def test_mantel_missing_cells_and_explicit_method(spark):
    y = _m(spark, [2, 1, 4, 3, 6, 5])
    x = _m(spark, [1, 2, 3, 4, 5, 6])
    for part in (x.filter("g1 <> 'a'"), x.limit(0)):
        rows = mantel(part, y, G).collect()
        assert len(rows) == 2 and all((r.r, r.p, r.z, r.n_perm) == (None, None, None, 24) for r in rows)
    assert mantel(x, y, G, perms=10, exact=True).first().n_perm == 24
    r = mantel(x, y, G, perms=30, exact=False, methods=("pearson",)).first()
    assert r.n_perm == 30 and not r.method_exact
    with pytest.raises(ValueError):
        mantel(x, y, [str(i) for i in range(12)], exact=True)


def test_salience_rows_are_validated(spark):
    rows = [(199709, "Germany", "X", 5.0, 1.0), (199709, "Germany", "Y", 9.0, 4.0), (199709, "Germany", "Y", 1.0, 1.0)]
    wide = spark.createDataFrame(rows, "date int, countryname string, partyabbrev string, per101 double, per102 double")
    for groups in (["X", "Y"], ["X", "Z"]):
        with pytest.raises(Exception, match="salience rows of group"):
            salience_matrix(wide, 1997, groups).collect()
    mapped = salience_matrix(wide.limit(2), 1997, ["U", "Y"], name_map={"X": "U"}).collect()
    assert {(r.g1, r.g2) for r in mapped} == {(a, b) for a in "UY" for b in "UY"}
