"""The experiment (X1) and the whole robustness grid in one job.

Plan, for any number of configurations:

1. mentions of the posts, restricted to tags that pass the common-tag test on
   all posts (every configuration is a subset, so this is a safe superset);
2. each mention row is tagged with its *atoms*: one structured atom (month,
   elected, incumbent, content) and, per random seed, the index of the smallest
   grid fraction that keeps the post; atoms are expanded to the configurations that
   contain them (a small table). Counts per (config, tag, grp) decide which tags each
   configuration keeps: common and complete ones;
3. the mentions of kept tags join the stored vectors on post_id and are shuffled once by tag,
   as floats; all sums per (config, tag, grp) and the distances of each tag, by the centroid
   identity, are then formed where the rows lie. Tags used very often are summed before;
4. per configuration: mean over tags, then the Mantel tests against the salience matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspace.functions.hashing import unit_draw
from tagspace.functions.predicates import content as content_pred
from tagspace.functions.vectors import vector_sum
from tagspace.operators import tags as TG
from tagspace.operators.distance import OFTEN, matrix_of, often_used, summed_by_tag, tag_distance_cells
from tagspace.operators.mantel import mantel
from tagspace.plans.grid import Config, config_table
from tagspace.session import cut_lineage


def _flag3(c: str):
    """0, 1, or 2 for anything else (NULL included): no predicate keeps 2."""
    return F.when(F.col(c) == 1, 1).when(F.col(c) == 0, 0).otherwise(2)


def _fractions(configs: list[Config]) -> dict[int, list[float]]:
    seeds = sorted({c.seed for c in configs if c.mode == "random"})
    return {s: sorted({float(c.fraction) for c in configs if c.mode == "random" and c.seed == s})
            for s in seeds}


def _bucket_columns(fr: dict[int, list[float]]) -> list:
    """Per post and seed: index of the smallest grid fraction keeping it (-1: none)."""
    cols = []
    for s, fracs in fr.items():
        u = F.col(f"_u{s}")
        b = F.lit(-1)
        for k, f in reversed(list(enumerate(fracs))):
            b = F.when(u < F.lit(f), F.lit(k)).otherwise(b)
        cols.append((f"_u{s}", unit_draw(F.lit(s), F.col("post_id")), f"_b{s}", b))
    return cols


def _used(configs: list[Config]) -> set[str]:
    """The columns of the structured atom that some configuration asks for."""
    used = set()
    for c in configs:
        used |= {"time": {"month"}, "content": {"cont"}, "elected": {"el"}, "incumbent": {"inc"}}.get(
            c.mode, {"el", "inc"} if c.mode.endswith("elected") else set())
    return used


def _atoms(fr: dict[int, list[float]], configs: list[Config]):
    """Array of the atoms of a row: one structured atom, if some configuration is not random,
    and one per seed. What no configuration asks for is constant, so atoms stay few."""
    used = _used(configs)
    col = lambda c, other: (F.col(c) if c in used else F.lit(other)).alias(c)
    items = [F.struct(F.lit("s").alias("kind"), F.lit(-1).alias("seed"), F.lit(-1).alias("b"),
                      col("month", 0), col("el", 2), col("inc", 2), col("cont", False))]
    if all(c.mode == "random" for c in configs):
        items = []
    for s in fr:
        items.append(F.struct(F.lit("r").alias("kind"), F.lit(s).alias("seed"),
                              F.col(f"_b{s}").alias("b"), F.lit(0).alias("month"),
                              F.lit(2).alias("el"), F.lit(2).alias("inc"),
                              F.lit(False).alias("cont")))
    return F.array(*items)


def _member(c: Config, fr) -> F.Column:
    """Predicate on an atom row: does configuration ``c`` contain it."""
    s_kind = F.col("kind") == "s"
    if c.mode == "random":
        k = fr[c.seed].index(float(c.fraction))
        return ((F.col("kind") == "r") & (F.col("seed") == c.seed) & (F.col("b") >= 0)
                & (F.col("b") <= k))
    table = {
        "full": lambda: s_kind,
        "time": lambda: s_kind & F.col("month").between(c.month_start, c.month_end),
        "elected": lambda: s_kind & (F.col("el") == 1),
        "incumbent": lambda: s_kind & (F.col("inc") == 1),
        "reelected": lambda: s_kind & (F.col("el") == 1) & (F.col("inc") == 1),
        "newly_elected": lambda: s_kind & (F.col("el") == 1) & (F.col("inc") == 0),
        "not_reelected": lambda: s_kind & (F.col("el") == 0) & (F.col("inc") == 1),
        "content": lambda: s_kind & F.col("cont"),
    }
    if c.mode not in table:
        raise ValueError(f"mode {c.mode!r} not supported in the grid")
    return table[c.mode]()


ATOM = ["kind", "seed", "b", "month", "el", "inc", "cont"]


def atom_configs(spark, configs: list[Config], fr) -> DataFrame:
    """(atom…, config): every possible atom with each configuration containing it.

    The atom domain is fixed by construction (13 months × 3 × 3 flags × 2, plus
    one atom per seed and fraction), so the table has at most a few hundred
    atoms times the number of configurations and is broadcast.
    """
    rows = [F.struct(F.lit("s").alias("kind"), F.lit(-1).alias("seed"), F.lit(-1).alias("b"),
                     F.lit(m).alias("month"), F.lit(e).alias("el"), F.lit(i).alias("inc"),
                     F.lit(c).alias("cont"))
            for m in range(13) for e in range(3) for i in range(3) for c in (False, True)]
    rows += [F.struct(F.lit("r").alias("kind"), F.lit(s).alias("seed"), F.lit(k).alias("b"),
                      F.lit(0).alias("month"), F.lit(2).alias("el"), F.lit(2).alias("inc"),
                      F.lit(False).alias("cont"))
             for s, fracs in fr.items() for k in range(len(fracs))]
    atoms = spark.range(1).select(F.inline(F.array(*rows)))
    member = F.array(*[F.when(_member(c, fr), F.lit(i)) for i, c in enumerate(configs)])
    out = atoms.select(*ATOM, F.explode(member).alias("config")).filter(
        F.col("config").isNotNull())
    return F.broadcast(out)


def config_profiles(posts: DataFrame, emb: DataFrame, configs: list[Config], groups,
                    num_groups: int = 6, threshold: int = 50,
                    count_null_group: bool = True, dim: int | None = None) -> DataFrame:
    """(config, tag, grp, n, s) for the complete common tags of every configuration.

    Which (config, tag) pairs qualify is decided on counts alone; the vectors
    are aggregated once and only for those pairs.
    """
    spark = posts.sparkSession
    fr = _fractions(configs)
    base = posts.select(
        "post_id", "grp", "text",
        F.coalesce(F.month("created_at"), F.lit(0)).alias("month"),
        _flag3("elected").alias("el"), _flag3("incumbent").alias("inc"),
        F.coalesce(content_pred(), F.lit(False)).alias("cont"))
    for u_name, u, b_name, b in _bucket_columns(fr):  # one draw per post and seed
        base = base.withColumn(u_name, u).withColumn(b_name, b).drop(u_name)
    keep_cols = ("month", "el", "inc", "cont", *[f"_b{s}" for s in fr])
    ments = TG.mentions(base, keep=keep_cols)
    # every configuration is a subset of the posts: tags failing on all posts fail everywhere
    cand = cut_lineage(TG.common_tags(ments, num_groups, threshold, count_null_group=count_null_group))
    # the mention table feeds two branches: written once instead of re-extracted
    ments = cut_lineage(TG.restrict_to(ments, cand))
    atoms = _atoms(fr, configs)
    ac = atom_configs(spark, configs, fr)

    def atom_rows(df, cols):
        return (df.select(*cols, F.explode(atoms).alias("a")).select(*cols, "a.*")
                .filter((F.col("kind") == "s") | (F.col("b") >= 0)))

    # counts: (config, tag, grp) → common and complete (config, tag); every key holds the tag, so
    # one shuffle of the mentions by tag serves them all
    c1 = (atom_rows(ments.select(*keep_cols, "tag", "grp").repartition("tag"), ["tag", "grp"]).groupBy(*ATOM, "tag", "grp")
          .agg(F.count(F.lit(1)).alias("n")))
    c2 = c1.join(ac, ATOM).groupBy("config", "tag", "grp").agg(F.sum("n").alias("n"))
    # the rows of a (config, tag) are its groups, each once
    keep = (c2.groupBy("config", "tag")
            .agg(F.sum("n").alias("_n"), F.sum((F.col("grp").isNotNull() | F.lit(count_null_group)).cast("int")).alias("_g"),
                 F.sum(F.coalesce(F.col("grp").isin(list(groups)), F.lit(False)).cast("int")).alias("_l"))
            .filter((F.col("_g") >= num_groups) & (F.col("_n") >= threshold)
                    & (F.col("_l") == len(groups)))
            .groupBy("tag").agg(F.collect_list("config").alias("kept")))

    # vectors: only of tags that some configuration keeps, one shuffle by post_id and one by tag
    rows = (ments.filter(F.col("grp").isin(list(groups))).join(cut_lineage(keep), "tag")
            .join(often_used(cand, OFTEN * len(configs)), "tag", "left"))

    def profile(rows):
        each = atom_rows(rows, ["tag", "grp", "kept", "u"]).join(ac, ATOM).where(F.expr("array_contains(kept, config)"))
        return each.groupBy("config", "tag", "grp").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                                        vector_sum("u", dim=dim).alias("s"))

    return summed_by_tag(rows, emb.select("post_id", "embedding"), profile, dim)


def experiment_grid(posts: DataFrame, emb: DataFrame, salience: DataFrame, groups,
                    configs: list[Config], num_groups: int = 6, threshold: int = 50,
                    agg: str = "sum", perms: int = 10000,
                    methods=("pearson", "spearman"), dim: int | None = None) -> DataFrame:
    """One result row per (configuration, method): r, p, z of the Mantel test of the
    tag distance matrix against the salience matrix (g1, g2, value), and the number of tags
    that the matrix is made of. A configuration without common tags has NULL r, p and z."""
    spark = posts.sparkSession
    prof = config_profiles(posts, emb, configs, groups, num_groups, threshold, dim=dim)
    # a few rows per configuration, and the number of its tags: no vectors are written
    cells = cut_lineage(tag_distance_cells(prof, ("config",), agg, dim=dim))
    x = matrix_of(cells, ("config",))
    cfg = config_table(spark, configs)  # one row per configuration
    res = mantel(x, salience, list(groups), keys=("config",), methods=methods, perms=perms,
                 runs=cfg.select("config"))
    n_tags = cells.where(F.col("g1").isNull()).select("config", "n_tags")
    return (res.join(F.broadcast(cfg), "config").join(n_tags, "config", "left")
            .withColumn("n_tags", F.coalesce("n_tags", F.lit(0)).cast("bigint")))


def run_experiment(posts: DataFrame, emb: DataFrame, salience: DataFrame, groups,
                   config: Config = Config(), **kw) -> DataFrame:
    """One configuration end to end."""
    return experiment_grid(posts, emb, salience, groups, [config], **kw)
