"""Embeddings of the posts that pass a mask.

The reference pairs posts and vectors by position inside each group; here
both are keyed by ``post_id`` and paired by an equi-join, so group order no
longer matters. The reference's length assertion becomes a key-coverage check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_embeddings(posts: DataFrame, emb: DataFrame, check: bool = False) -> DataFrame:
    """Posts ⋈ embeddings on post_id; ``check`` raises when a post has no vector."""
    if check:
        missing = posts.select("post_id").join(emb.select("post_id"), "post_id", "left_anti")
        if not missing.isEmpty():
            raise ValueError("posts without an embedding: check the post/embedding tables")
    return posts.join(emb, "post_id")


def apply_mask(posts: DataFrame, emb: DataFrame, mask: Column, groups=None,
               check: bool = False) -> DataFrame:
    """(post_id, grp, embedding) of the posts passing ``mask`` (listed groups only)."""
    p = posts
    if groups is not None:
        p = p.filter(F.col("grp").isin(list(groups)))
    p = p.filter(mask).select("post_id", "grp")
    return attach_embeddings(p, emb, check)
