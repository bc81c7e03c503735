"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Misra-Gries counters (``DataFrame.freqItems``, which counts with them in mergeable form) name
every digest that may hold more than ``support`` of the rows, at most ``1 / support`` of them.
Their true sizes and winners are counted over all rows with map-side partial sums. These
verified winners, a table bounded by ``1 / support``, are broadcast, so that rows of a heavy
digest get their result without a shuffle. All other digests, each below ``support`` of the
rows, go through an ordinary shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Share of the rows from which a digest may count as heavy; at most 1 / SUPPORT winners.
SUPPORT = 0.0005


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows with equal texts the one with the largest doc_id stays. Defined cases: a null
    text is an empty text; a null doc_id counts in group_size, is never the winner while the
    group has an id, and is kept only in a group without any id (whose keep_id is null); a row
    that repeats the winner's doc_id is kept as well; no input rows give no rows; other
    columns of the input, whatever their names, are not read.
    """
    digests = written(text_digests(docs, id_col, text_col), "digests")
    frequent = digests.freqItems(["text_sha256"], support)
    suspects = frequent.select(F.explode("text_sha256_freqItems").alias("text_sha256")).distinct()
    largest = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = written(digests.join(F.broadcast(suspects), "text_sha256", "left_semi")
                      .groupBy("text_sha256").agg(*largest)
                      .where(F.col("group_size") > 1), "winners")
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = (digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
             .select("text_sha256", "doc_id", F.max("doc_id").over(group).alias("keep_id"),
                     F.count(F.lit(1)).over(group).alias("group_size")))
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops, told apart by doc_id (null too) and
    text; rows that repeat the winner's doc_id and text count as one row, and one of them stays."""
    odd = written(exact_groups(docs, support=support)
                  .groupBy(F.col("doc_id").alias("own_id"), F.col("text_sha256").alias("own_sha256"))
                  .agg(F.first("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
                  .where("NOT stays OR n > 1"), "copies")
    digest = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)
    mark = "_drop_exact_copies_sha256"

    def same(rows: DataFrame):
        return docs["doc_id"].eqNullSafe(rows["own_id"]) & (digest == rows["own_sha256"])

    out = docs.join(odd, same(odd), "left_anti")
    again = odd.where("stays")
    if not again.limit(1).count():
        return out
    one = docs.join(again, same(again), "left_semi").withColumn(mark, digest).dropDuplicates(["doc_id", mark])
    return out.unionByName(one.drop(mark))
