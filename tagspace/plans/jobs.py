"""End-to-end jobs (X3-X6): read, transform, write; each returns the output folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspace.functions.predicates import mode_predicate
from tagspace.operators import embed as EM
from tagspace.operators import pairs as PR
from tagspace.operators.evaluate import pair_similarity_eval
from tagspace.operators.masks import apply_mask
from tagspace.operators.salience import PARTY_NAME_DICT, salience_matrix
from tagspace.plans.experiment import experiment_grid
from tagspace.plans.grid import Config
from tagspace.session import Scratch, cut_lineage
from tagspace.sources import files as FS
from tagspace.sources import sinks as SK


def marker_of(mode: str, seed: int = 0, fraction: float = 1.0, month_start: int = 1,
              month_end: int = 12) -> str:
    """P11 on the driver, for folder names."""
    if mode == "full":
        return "full"
    if mode == "random":
        return f"random-seed{seed}-{fraction}"
    if mode == "time":
        return f"time-({month_start}, {month_end})"
    return mode


def filter_job(posts: DataFrame, emb: DataFrame, out: str, mode: str, groups=None,
               seed: int = 0, fraction: float = 1.0, month_start: int = 1,
               month_end: int = 12, check: bool = True) -> str:
    """Embeddings of the posts passing a mode's mask, written by mode and config."""
    if mode == "no_hashtags":
        from tagspace.functions.text import with_tags
        posts = with_tags(posts)
    pred = mode_predicate(mode, seed=seed, fraction=fraction, month_start=month_start,
                          month_end=month_end)
    kept = apply_mask(posts, emb, pred, groups, check)
    return SK.write_filtered(kept, out, mode,
                             marker_of(mode, seed, fraction, month_start, month_end))


def gather_job(spark: SparkSession, path: str, out: str, year_lower: int = 2013,
               year_upper: int = 2016, num_groups: int = 3, threshold: int = 50,
               n_samples: int = PR.N_SAMPLES, seed: int = 42, suffix: str | None = None,
               schema: T.StructType | None = None, id_col: str = "tweet_id",
               group_col: str = "party", merge=None, k: int = PR.K_POSTS, fmt: str = "csv") -> str:
    """Posts of a year range → pair dataset → 80/20 split → CSV by year and split."""
    kw = {} if schema is None else {"schema": schema}
    posts = FS.read_posts_range(spark, path, year_lower, year_upper, id_col=id_col,
                                group_col=group_col, merge=merge, fmt=fmt, **kw)
    year = year_lower if year_lower == year_upper else f"{year_lower}-{year_upper}"
    with Scratch(spark) as scratch:
        ds = PR.pair_dataset(posts, num_groups, threshold, seed, n_samples, k, scratch)
        return SK.write_split(PR.split_dataset(ds, seed), out, year, suffix)


# the groups that the embedding job writes when none are listed (fixed values)
JOB_GROUPS = ["AfD", "CDU/CSU", "FDP", "GRÜNE", "DIE LINKE", "SPD"]


def embed_job(spark: SparkSession, path: str, out: str, year: int, model: str = "hash-32",
              groups=JOB_GROUPS, schema: T.StructType | None = None, id_col: str = "tweet_id",
              group_col: str = "party", merge=None, dim: int | None = None,
              words: DataFrame | None = None, fmt: str = "csv") -> str:
    """Posts of a year and of the listed groups (None: all) → embeddings by the encoder
    that ``model`` names → Parquet by model and year."""
    kw = {} if schema is None else {"schema": schema}
    posts = FS.read_posts(spark, path, year, id_col=id_col, group_col=group_col, merge=merge,
                          fmt=fmt, **kw)
    if groups is not None:
        posts = posts.filter(F.col("grp").isin(list(groups)))
    emb = EM.encode_posts(posts, model, dim, words)
    emb = emb.join(posts.select("post_id", "grp"), "post_id")
    return SK.write_embeddings(emb.select("post_id", "grp", "embedding"), out, model, year)


def evaluate_job(spark: SparkSession, pairs_path: str, split: str = "val", model: str = "hash-32",
                 dim: int | None = None, words: DataFrame | None = None,
                 fmt: str = "csv", out: str | None = None) -> DataFrame:
    """Validation pairs → embeddings of both texts by ``model`` → correlations (M3), written to
    ``out`` where it is given."""
    pairs = FS.read_pairs(spark, pairs_path, fmt, split)
    key = lambda text: F.unhex(F.md5(text))
    with Scratch(spark) as scratch:
        texts = scratch.keep(pairs.select(F.col("sent1").alias("text")).union(pairs.select(F.col("sent2"))).distinct())
        emb = EM.encode_posts(texts.withColumn("post_id", key("text")), model, dim, words)
        emb = scratch.keep(emb.select(F.col("post_id").alias("id"), "embedding"))
        p = pairs.select(key("sent1").alias("id1"), key("sent2").alias("id2"), "label")
        result = cut_lineage(pair_similarity_eval(p, emb, scratch))  # four rows
    if out is not None:
        SK.write_evaluation(result, out, model, split)
    return result


def experiment_job(spark: SparkSession, posts_path: str, emb_path: str, salience_path: str,
                   out: str, year: int, model: str, groups, configs: list[Config],
                   salience_mode: str = "full", name_map=PARTY_NAME_DICT, fmt: str = "csv",
                   schema: T.StructType | None = None, id_col: str = "tweet_id",
                   group_col: str = "party", merge=None, **kw) -> str:
    """X1 by path: posts and salience table of ``year``, the embeddings that ``model`` made of
    it → Mantel tests per configuration → result rows committed to ``out`` (read by
    ``read_results``); a repeated run, of the same model, year, evaluation and configurations,
    replaces its rows."""
    more = {} if schema is None else {"schema": schema}
    posts = FS.read_posts(spark, posts_path, year, id_col=id_col, group_col=group_col, merge=merge,
                          fmt=fmt, **more)
    emb = FS.read_embeddings(spark, emb_path, SK.safe_name(model), year).select("post_id", "embedding")
    y = salience_matrix(FS.read_salience(spark, salience_path), year, groups, salience_mode, name_map=name_map)
    res = experiment_grid(posts, emb, y, groups, configs, **kw)
    evaluation = f"{salience_mode}_manifesto_matrix"
    runs = hashlib.md5(repr([*configs]).encode()).hexdigest()[:12]
    return SK.commit_results(result_columns(res, model, year, evaluation), out, f"{model}-{year}-{evaluation}-{runs}")


def result_columns(res: DataFrame, model: str, year: int, evaluation: str) -> DataFrame:
    """One row per run as results are kept: model, year, mode (the run's marker), eval, and r, p
    and z of either method."""
    wide = res.groupBy(F.col("marker").alias("mode")).agg(*[
        F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{m}")
        for m in ("pearson", "spearman") for c in ("r", "p", "z")])
    return wide.select(F.lit(model).alias("model"), F.lit(int(year)).alias("year"), "mode",
                       F.lit(evaluation).alias("eval"), *wide.columns[1:])
