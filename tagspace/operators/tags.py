"""Tag statistics: mentions, counts, groups per tag, common tags, co-occurrence.

A1-A4, J2, J8. All are one explode and one hash aggregation with map-side partial
aggregation, so a hot tag is pre-aggregated in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspace.functions.text import tags_of
from tagspace.operators.taglists import text_matches_tags  # noqa: F401  (F20, kept under this name)


def mentions(posts: DataFrame, text: str = "text", group: str = "grp",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per tag mention: (post_id, grp, tag, pos, *keep). Duplicates kept."""
    cols = [F.col("post_id"), F.col(group).alias("grp"), *[F.col(c) for c in keep]]
    return (posts.select(*cols, F.posexplode(tags_of(text)).alias("pos", "tag")))


def _n_groups(count_null_group: bool):
    n = F.count_distinct("grp")
    if count_null_group:
        # a NULL group is a group of its own in the reference's set of groups
        n = n + F.max(F.col("grp").isNull().cast("int"))
    return n.cast("bigint")


def tag_counts(ments: DataFrame, count: str = "mentions") -> DataFrame:
    """A1: occurrences per tag (``mentions``) or posts per tag (``posts``)."""
    if count == "mentions":
        n = F.count(F.lit(1))
    elif count == "posts":
        n = F.count_distinct("post_id")
    else:
        raise ValueError("count must be 'mentions' or 'posts'")
    return ments.groupBy("tag").agg(n.cast("bigint").alias("n"))


def tag_groups(ments: DataFrame, count_null_group: bool = True) -> DataFrame:
    """A2: number of distinct groups per tag and their sorted list."""
    return ments.groupBy("tag").agg(
        _n_groups(count_null_group).alias("n_groups"),
        F.array_join(F.array_sort(F.collect_set("grp")), ",").alias("groups"))


def tag_stats(ments: DataFrame, count: str = "mentions", count_null_group: bool = True,
              keys: tuple[str, ...] = ()) -> DataFrame:
    """A1 and A2 in one aggregation: (keys…, tag, n, n_groups)."""
    n = F.count(F.lit(1)) if count == "mentions" else F.count_distinct("post_id")
    return ments.groupBy(*keys, "tag").agg(
        n.cast("bigint").alias("n"), _n_groups(count_null_group).alias("n_groups"))


def common_tags(ments: DataFrame, num_groups: int = 6, threshold: int = 50,
                count: str = "mentions", count_null_group: bool = True,
                keys: tuple[str, ...] = ()) -> DataFrame:
    """A3: tags used by ≥ num_groups groups with ≥ threshold mentions."""
    st = tag_stats(ments, count, count_null_group, keys)
    return st.filter((F.col("n_groups") >= num_groups) & (F.col("n") >= threshold))


def restrict_to(df: DataFrame, tags: DataFrame, on=("tag",)) -> DataFrame:
    """Keep rows whose tag is in ``tags`` (left semi join).

    Catalyst/AQE broadcast the tag list when its measured size is under the
    broadcast threshold and fall back to a shuffle join otherwise.
    """
    return df.join(tags.select(*on), list(on), "left_semi")


def tag_cooccurrence(posts: DataFrame, filter_tags: DataFrame | None = None,
                     text: str = "text") -> DataFrame:
    """Distinct edges (tag, other): ``other`` occurs in a post with ``tag``.

    The tag itself is included. Done by exploding the tag list twice in the same
    stage (no self join on post_id); ``filter_tags`` None means all tags.
    """
    t = posts.select(tags_of(text).alias("tags")).filter(F.size("tags") > 0)
    t = t.select("tags", F.explode("tags").alias("tag"))
    if filter_tags is not None:
        t = restrict_to(t, filter_tags)
    edges = t.select("tag", F.explode("tags").alias("other"))
    return edges.distinct()
