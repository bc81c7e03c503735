"""Group-by-group distances from embeddings.

Category distance uses the centroid identity (R1)

    sum_{a in A, b in B} (1 - cos(a, b)) = nA * nB - (sum_a â) · (sum_b b̂)

so each (tag, group) is reduced to a count and one summed unit vector by a
partial aggregation, and no pair of posts is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspace.functions.vectors import (NORM_EPS, as_double, dot, norm_fixed, of_length,
                                        scaled_fixed, vector_sum)

#: Mentions from which the vectors of a tag are summed before a shuffle.
OFTEN = 8192


def unit_embeddings(emb: DataFrame, col: str = "embedding", dim: int | None = None,
                    expand: bool = False) -> DataFrame:
    """Normalise once; everything downstream uses unit vectors (array<double> ``u``).

    By default Spark ML's ``Normalizer`` runs in the JVM (measured fastest inside
    the full plans); ``expand=True`` with a known length writes the norm and
    quotients as per-element column expressions instead. A zero vector stays
    zero, so its cosine with anything is 0. With ``dim`` every vector must have that
    length: a longer or shorter one ends the query instead of being cut or padded.
    """
    if dim is not None:
        emb = emb.withColumn(col, of_length(col, dim))
    if dim is not None and expand:
        e = emb.withColumn("_n", F.greatest(norm_fixed(col, dim), F.lit(NORM_EPS)))
        return e.withColumn("u", scaled_fixed(col, F.col("_n"), dim)).drop(col, "_n")
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = emb.withColumn("_v", array_to_vector(as_double(col))).drop(col)
    w = Normalizer(p=2.0, inputCol="_v", outputCol="_w").transform(v)
    return w.withColumn("u", vector_to_array("_w")).drop("_v", "_w")


def group_profile(rows: DataFrame, keys: list[str], dim: int | None = None) -> DataFrame:
    """(keys…, n, s): count and summed unit vector per key (A5 without the lists)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                   vector_sum("u", dim=dim).alias("s"))


def tag_group_vectors(ments: DataFrame, uemb: DataFrame, groups=None,
                      keys: tuple[str, ...] = (), dim: int | None = None) -> DataFrame:
    """A5: per (keys…, tag, grp): mentions n and summed unit vector s.

    ``ments`` has (post_id, grp, tag, …); ``uemb`` has (post_id, u), or (post_id, embedding),
    vectors as they are stored, which are normalised after the shuffles. One vector per
    mention, so a tag twice in a post counts its vector twice. Mentions of tags that the column
    ``often`` of ``ments`` marks are summed before their shuffle; the others, of which a task
    holds few each, are sent as they are, once.
    """
    m = ments
    if groups is not None:
        m = m.filter(F.col("grp").isin(list(groups)))
    return summed_by_tag(m, uemb, lambda rows: group_profile(rows, [*keys, "tag", "grp"], dim), dim)


def often_used(common: DataFrame, least: int = OFTEN) -> DataFrame:
    """(tag, often): the tags with at least ``least`` mentions (n), so no more than mentions / ``least``."""
    return F.broadcast(common.where(F.col("n") >= least).select("tag", F.lit(True).alias("often")))


def summed_by_tag(ments: DataFrame, emb: DataFrame, profile: Callable[[DataFrame], DataFrame], dim: int | None = None) -> DataFrame:
    """``profile`` of the mentions with their unit vectors u, whose keys hold the tag: rows of a tag
    that is not used often are brought together first."""
    vector = "u" if "u" in emb.columns else "embedding"
    if vector != "u" and dim is not None:  # vectors of posts without mentions too
        emb = emb.withColumn(vector, of_length(vector, dim))

    def unit(rows: DataFrame) -> DataFrame:
        return rows if vector == "u" else unit_embeddings(rows, vector)

    if "often" not in ments.columns:
        return profile(unit(ments.join(emb, "post_id").repartition("tag")))
    often = F.coalesce("often", F.lit(False))
    hot = ments.where(often).drop("often").join(emb, "post_id")
    rest = ments.where(~often).drop("often").join(emb, "post_id")
    return profile(unit(rest.repartition("tag"))).unionByName(profile(unit(hot)))


def complete_tags(profile: DataFrame, n_groups: int, keys: tuple[str, ...] = (),
                  on_incomplete: str = "drop") -> DataFrame:
    """Keep tags present in all listed groups (or raise).

    ``profile`` has one row per (keys…, tag, grp), so a window over (keys…, tag)
    holds at most G rows and counts the groups without a second pass.
    """
    w = Window.partitionBy(*keys, "tag")
    cnt = profile.withColumn("_g", F.count(F.lit(1)).over(w))
    if on_incomplete == "error":
        if not cnt.filter(F.col("_g") != n_groups).isEmpty():
            raise ValueError("a common tag lacks one of the listed groups")
    return cnt.filter(F.col("_g") == n_groups).drop("_g")


def pair_distances(profile: DataFrame, keys: list[str], agg: str = "sum",
                   strict: bool = True, dim: int | None = None, marked: bool = False) -> DataFrame:
    """V2 for every pair of groups inside each key: (keys…, g1, g2, value).

    ``strict`` pairs g1 < g2 (combinations); otherwise g1 <= g2. The few groups of a key are
    brought together in one row, so rows that lie together by their keys are not moved.
    ``marked`` adds a row without groups and value for each key.
    """
    if not keys:  # one matrix: pair the group rows through a constant key
        profile, keys = profile.withColumn("_k", F.lit(0)), ["_k"]
    if agg not in ("sum", "mean"):
        raise ValueError("agg must be 'sum' or 'mean'")
    held = profile.groupBy(*keys).agg(F.collect_list(F.struct("grp", "n", "s")).alias("l"))
    for k in keys:  # a join on the keys leaves nulls out
        held = held.where(F.col(k).isNotNull())
    one = held.select(*keys, "l", F.explode(F.array_append("l", F.lit(None)) if marked else F.col("l")).alias("x"))
    first = F.col("x.grp")
    after = F.filter("l", lambda y: (first < y["grp"]) if strict else (first <= y["grp"]))
    if marked:
        after = F.when(F.col("x").isNull(), F.array(F.lit(None).cast(profile.select(F.struct("grp", "n", "s").alias("y")).schema["y"].dataType))).otherwise(after)
    j = one.select(*keys, "x", F.explode(after).alias("y"))
    total = (F.col("x.n") * F.col("y.n")).cast("double") - dot(F.col("x.s"), F.col("y.s"), dim)
    value = total if agg == "sum" else F.try_divide(total, (F.col("x.n") * F.col("y.n")).cast("double"))
    return j.select(*[k for k in keys if k != "_k"], F.col("x.grp").alias("g1"), F.col("y.grp").alias("g2"), value.alias("value"))


def category_distance(emb_groups: DataFrame, agg: str = "sum",
                      keys: tuple[str, ...] = (), dim: int | None = None) -> DataFrame:
    """V2 over groups of vectors: (keys…, g1, g2, value) for g1 < g2.

    ``emb_groups`` has (keys…, grp, embedding).
    """
    prof = group_profile(unit_embeddings(emb_groups, dim=dim), [*keys, "grp"], dim)
    return pair_distances(prof, list(keys), agg, dim=dim)


def mean_over_tags(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cell-wise mean of the per-tag matrices."""
    return cells.groupBy(*keys, "g1", "g2").agg(F.avg("value").alias("value"),
                                                F.count(F.lit(1)).alias("n_tags"))


def symmetrise(cells: DataFrame, keys: tuple[str, ...] = (), diagonal: float = 0.0,
               groups: DataFrame | None = None) -> DataFrame:
    """V8: mirror the g1 < g2 cells and add the diagonal.

    One pass over the cells: each emits itself, its mirror and the two diagonal
    cells of its groups; duplicates of a diagonal cell are merged by a small
    aggregation. ``groups`` (keys…, grp) adds diagonal cells of groups without
    any pair.
    """
    d = F.lit(float(diagonal))
    cell = lambda a, b, v: F.struct(F.col(a).alias("g1"), F.col(b).alias("g2"), v.alias("value"))
    out = cells.select(*keys, F.explode(F.array(
        cell("g1", "g2", F.col("value")), cell("g2", "g1", F.col("value")),
        cell("g1", "g1", d), cell("g2", "g2", d))).alias("c")).select(*keys, "c.*")
    if groups is not None:
        out = out.unionByName(groups.select(*keys, F.col("grp").alias("g1"),
                                            F.col("grp").alias("g2"), d.alias("value")))
    return out.groupBy(*keys, "g1", "g2").agg(F.max("value").alias("value"))


def tag_distance_cells(profile: DataFrame, keys: tuple[str, ...] = (),
                       agg: str = "sum", dim: int | None = None) -> DataFrame:
    """(keys…, g1, g2, value, n_tags): means over tags of the per-tag distances, and a row without
    groups with the number of tags of each key."""
    return mean_over_tags(pair_distances(profile, [*keys, "tag"], agg, dim=dim, marked=True), keys)


def tag_distance_matrix(profile: DataFrame, keys: tuple[str, ...] = (),
                        agg: str = "sum", dim: int | None = None) -> DataFrame:
    """V3: per-tag pair distances, mean over tags, mirrored with zero diagonal.

    ``profile`` is (keys…, tag, grp, n, s) restricted to complete common tags.
    """
    return matrix_of(tag_distance_cells(profile, keys, agg, dim), keys)


def matrix_of(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The matrix of the cells that have groups."""
    return symmetrise(cells.where(F.col("g1").isNotNull()).drop("n_tags"), keys, 0.0)
