"""Mantel permutation test of two distance matrices (M1 Pearson, M2 Spearman).

Permutations are rows: every upper-triangle cell of X is exploded into one row
per permutation id, the permuted Y cell is found by an equi-join on the
relabelled indices, and Pearson's r comes from sums per (keys, method,
permutation). ``exact=True`` uses all n! relabellings (the identity is
permutation 0) and is refused when there are more than ``MOST_EXACT``; ``exact=False`` uses
``perms`` rows, the identity and md5-seeded shuffles. With ``exact=None`` the usual rule of the
test decides (all when n! <= ``perms``). The result says in ``method_exact`` which it was. A
matrix that lacks a cell has no correlation: r, p and z are NULL.
p = share of permutations with |r_perm| >= |r| (identity included), z = (r - mean)
/ population std of the permuted r.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspace.functions.hashing import hash_hex

MOST_EXACT = math.factorial(9)
R_DIGITS = 12      # r rounded before |r_perm| >= |r| so equal permutations tie
RANK_DIGITS = 10   # values rounded before ranking so float noise makes no false order


def n_permutations(n: int, perms: int = 10000, exact: bool | None = None) -> tuple[int, bool]:
    """(number of permutation rows, exhaustive?)."""
    f = math.factorial(n)
    if exact is None:
        exact = perms == 0 or perms >= f
    if exact and f > MOST_EXACT:
        raise ValueError(f"{n} groups have {f} relabellings; pass exact=False to sample them")
    return (f, True) if exact else (perms, False)


def permutation(pid: Column, n: int, exhaustive: bool, seed: int = 0) -> Column:
    """Array π of 0..n-1 for a permutation id (a pure expression of ``pid``)."""
    base = F.sequence(F.lit(0), F.lit(n - 1))
    if exhaustive:
        facts = F.array(*[F.lit(math.factorial(k)) for k in range(n)])

        def step(acc, i):
            f = F.element_at(facts, F.lit(n) - i)              # (n-1-i)!
            d = F.floor(pid / f).cast("int") % (F.lit(n) - i)  # Lehmer digit
            pick = F.element_at(acc["rem"], d + 1)
            return F.struct(F.array_remove(acc["rem"], pick).alias("rem"),
                            F.concat(acc["out"], F.array(pick)).alias("out"))

        init = F.struct(base.alias("rem"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(base, init, step)["out"]
    shuffled = F.transform(
        F.array_sort(F.transform(base, lambda g: F.struct(hash_hex(F.lit(seed), pid, g)
                                                          .alias("h"), g.alias("g")))),
        lambda s: s["g"])
    return F.when(pid == 0, base).otherwise(shuffled)


def _indexed(m: DataFrame, groups: list[str], keys: tuple[str, ...], val: str) -> DataFrame:
    idx = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(i))])
    return (m.select(*keys, idx[F.col("g1")].alias("i"), idx[F.col("g2")].alias("j"),
                     F.col("value").cast("double").alias(val))
            .filter(F.col("i") < F.col("j")))


def _avg_rank(df: DataFrame, keys: tuple[str, ...], col: str) -> DataFrame:
    """Average ranks (ties share the mean rank) within ``keys``.

    The window holds one matrix (n(n-1)/2 cells) per key.
    """
    r = F.round(F.col(col), RANK_DIGITS)
    w = Window.partitionBy(*keys).orderBy(r)
    ties = Window.partitionBy(*keys, r)
    return df.withColumn(col, (F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
                         .cast("double"))


def mantel(x: DataFrame, y: DataFrame, groups: list[str], keys: tuple[str, ...] = (),
           y_keys: tuple[str, ...] = (), methods=("pearson", "spearman"), perms: int = 10000,
           seed: int = 0, exact: bool | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(keys…, method, r, p, z, n_perm, method_exact) for matrices ``x`` (keys…, g1, g2, value) and
    ``y`` (y_keys…, g1, g2, value); ``y_keys`` ⊆ ``keys`` lets one Y serve many X.

    Both methods come from one pass: each row carries the value and its average
    rank, and one aggregation per (keys, permutation) sums both. ``runs`` (keys…) lists
    the matrices that must have rows even if they have no cell at all.
    """
    for m in methods:
        if m not in ("pearson", "spearman"):
            raise ValueError("method must be 'pearson' or 'spearman'")
    n = len(groups)
    n_perm, exhaustive = n_permutations(n, perms, exact)
    drop_key = not keys
    if drop_key:  # one matrix: give it a constant key so every step joins on keys
        x, keys = x.withColumn("_m", F.lit(0)), ("_m",)
        runs = x.sparkSession.range(1).select(F.lit(0).alias("_m"))
    xc = _indexed(x, groups, keys, "x")
    xc = xc.withColumn("xr", F.col("x"))
    xc = _avg_rank(xc, keys, "xr")
    yc = _indexed(y, groups, y_keys, "y")
    yc = _avg_rank(yc.withColumn("yr", F.col("y")), y_keys, "yr")
    # each permutation is decoded once; the table has n_perm rows of n numbers
    decoded = x.sparkSession.range(n_perm).select(F.col("id").cast("int").alias("pid"))
    decoded = F.broadcast(decoded.select("pid", permutation(F.col("pid"), n, exhaustive, seed).alias("pi")))
    rows = xc.select(*keys, "i", "j", "x", "xr",
                     F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("pid"))
    rows = rows.join(decoded, "pid")
    a = F.element_at("pi", F.col("i") + 1)
    b = F.element_at("pi", F.col("j") + 1)
    rows = rows.select(*keys, "pid", "x", "xr", F.least(a, b).alias("i"),
                       F.greatest(a, b).alias("j"))
    # one Y has n(n-1)/2 cells; with keys of its own its size is Spark's to judge
    joined = rows.join(yc if y_keys else F.broadcast(yc), [*y_keys, "i", "j"])
    sums = []
    for m, (u, v) in (("pearson", ("x", "y")), ("spearman", ("xr", "yr"))):
        if m not in methods:
            continue
        sums += [F.sum(u).alias(f"{m}_sx"), F.sum(v).alias(f"{m}_sy"),
                 F.sum(F.col(u) * F.col(v)).alias(f"{m}_sxy"),
                 F.sum(F.col(u) * F.col(u)).alias(f"{m}_sxx"),
                 F.sum(F.col(v) * F.col(v)).alias(f"{m}_syy")]
    s = joined.groupBy(*keys, "pid").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)

    def r_of(m):
        c = lambda k: F.col(f"{m}_{k}")
        num = F.col("n") * c("sxy") - c("sx") * c("sy")
        den = F.sqrt((F.col("n") * c("sxx") - c("sx") ** 2) * (F.col("n") * c("syy") - c("sy") ** 2))
        whole = F.col("n") == F.lit(n * (n - 1) // 2)
        return F.struct(F.lit(m).alias("method"), F.when(whole, F.try_divide(num, den)).alias("r"))

    rs = s.select(*keys, "pid", F.explode(F.array(*[r_of(m) for m in methods])).alias("mr"))
    rs = rs.select(*keys, "pid", "mr.method", "mr.r")
    # the observed r (identity permutation) beside every permuted r; a window holds
    # the permutations of one matrix and method (at most ``perms`` rows)
    w = Window.partitionBy(*keys, "method")
    rs = rs.withColumn("r_obs", F.max(F.when(F.col("pid") == 0, F.col("r"))).over(w))
    ge = (F.abs(F.round("r", R_DIGITS)) >= F.abs(F.round("r_obs", R_DIGITS))).cast("double")
    res = rs.groupBy(*keys, "method").agg(
        F.first("r_obs").alias("r"), F.avg(ge).alias("p"),
        F.avg("r").alias("_mean"), F.stddev_pop("r").alias("_std"),
        F.count(F.lit(1)).cast("bigint").alias("n_perm"))
    res = res.select(*keys, "method", "r", "p",
                     F.try_divide(F.col("r") - F.col("_mean"), F.col("_std")).alias("z"), "n_perm")
    if runs is not None:
        every = runs.select(*keys, F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
        res = every.join(res, [*keys, "method"], "left").withColumn(
            "n_perm", F.coalesce("n_perm", F.lit(n_perm).cast("bigint")))
    # without r there is no share of permutations to give
    res = res.withColumn("p", F.when(F.col("r").isNotNull(), F.col("p")))
    res = res.withColumn("method_exact", F.lit(exhaustive))
    return res.drop("_m") if drop_key else res
