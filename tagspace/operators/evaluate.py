"""Agreement of labelled pairs with embedding similarity (M3).

For each pair (id1, id2, label): cosine similarity, negative Manhattan and
Euclidean distance and dot product of the two embeddings; then Pearson and
Spearman correlation of each score with the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspace.functions.vectors import as_double, dot, norm
from tagspace.operators.ranks import count_ranks, pearson
from tagspace.session import Scratch

METRICS = ("cosine", "manhattan", "euclidean", "dot")
RANK_DIGITS = 10


def pair_scores(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """(id1, id2, label, cosine, manhattan, euclidean, dot). ``emb`` is (id, embedding).

    Every pair has a row; one of whose sides has no vector has NULL scores."""
    e1 = emb.select(F.col("id").alias("id1"), F.col("embedding").alias("e1"))
    e2 = emb.select(F.col("id").alias("id2"), F.col("embedding").alias("e2"))
    j = pairs.join(e1, "id1", "left").join(e2, "id2", "left")  # vectors move as they are stored
    j = j.withColumns({"e1": as_double("e1"), "e2": as_double("e2")})
    diff = F.zip_with("e1", "e2", lambda a, b: a - b)
    d = dot("e1", "e2")
    return j.select(
        "id1", "id2", F.col("label").cast("double").alias("label"),
        # a zero vector has cosine 0 with anything (normalised zero stays zero)
        F.when(d.isNotNull(), F.coalesce(F.try_divide(d, norm("e1") * norm("e2")), F.lit(0.0)))
        .alias("cosine"),
        (-F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + F.abs(x))).alias("manhattan"),
        (-F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x * x))).alias("euclidean"),
        d.alias("dot"))


def pair_similarity_eval(pairs: DataFrame, emb: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(metric, pearson, spearman, n_pairs, n_scored) — one row per similarity.

    Pairs without both vectors count in n_pairs only. The scores are made once and written without
    the pairs' ids to ``scratch``, which the caller may clear when the result has been read; ranks come
    from counts per (metric, score, label), and the rank of a label from the labels' totals.
    """
    scratch = Scratch(pairs.sparkSession) if scratch is None else scratch
    s = scratch.keep(pair_scores(pairs, emb).select("label", *METRICS))
    long = s.select("label", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS]))
        .alias("ms")).select("label", "ms.metric", "ms.score")
    sizes = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("score").alias("n_scored"))
    long = long.filter(F.col("score").isNotNull())
    p = pearson(long, "label", "score", ("metric",)).withColumnRenamed("r", "pearson")
    # scores are ranked at RANK_DIGITS so float noise does not split ties
    counts = (long.groupBy("metric", F.round("score", RANK_DIGITS).alias("value"), "label")
              .agg(F.count(F.lit(1)).alias("c")))
    ranked = count_ranks(counts, "value", "rs", ("metric",))
    # labels are a few classes: their totals are one small table, ranked in one window
    totals = s.filter(F.col(METRICS[0]).isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("label")
    labels = totals.select("label", (F.sum("c").over(upto) - F.col("c") + (F.col("c") + 1) / 2.0).alias("rl"))
    sp = pearson(ranked.join(labels, "label"), "rl", "rs", ("metric",), "c").withColumnRenamed("r", "spearman")
    return sizes.join(p, "metric", "left").join(sp, "metric", "left").select(
        "metric", "pearson", "spearman", "n_pairs", "n_scored")
