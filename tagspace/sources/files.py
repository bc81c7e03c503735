"""File sources of the reference's inputs.

CSV is read with a header, multi-line fields and doubled quotes, in PERMISSIVE
mode: a field that does not parse becomes NULL and the row is kept. Posts and pairs, whose
columns are given, are read in byte ranges by many tasks (``csv_ranges``); they may also be
Parquet (``fmt="parquet"``). The small salience table, whose types are inferred, is read
by Spark's multi-line reader, one task a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspace.functions import predicates as P
from tagspace.functions import text as TX
from tagspace.schema import POSTS, check_required
from tagspace.sources.csv_ranges import read_csv_ranges


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             header: bool = True, sep: str = ",", infer: bool = False) -> DataFrame:
    r = (spark.read.option("header", header).option("sep", sep).option("multiLine", True)
         .option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE"))
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def read_rows(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None,
              **options) -> DataFrame:
    """CSV, or Parquet with the columns of ``schema`` (all of them without one)."""
    if fmt == "csv" and schema is not None:
        return read_csv_ranges(spark, path, schema, **options)
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}")
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def _posts(df: DataFrame, id_col: str, group_col: str, merge) -> DataFrame:
    if "post_id" not in df.columns:
        df = df.withColumn("post_id", F.col(id_col))
    if group_col != "grp" or merge:
        df = TX.merge_groups(df, merge if merge is not None else {}, src=group_col, dst="grp")
    return df


def read_posts(spark: SparkSession, path: str, year: int, schema: T.StructType = POSTS,
               required=None, id_col: str = "tweet_id", group_col: str = "party",
               merge=None, sep: str = ",", fmt: str = "csv") -> DataFrame:
    """Posts of one calendar year with the merged group column ``grp``."""
    df = read_rows(spark, path, fmt, schema, **({"sep": sep} if fmt == "csv" else {}))
    if schema is POSTS:
        check_required(df)
    elif required:
        check_required(df, required)
    df = TX.with_year(df).filter(P.year_is(year))
    return _posts(df, id_col, group_col, TX.DEFAULT_MERGE if merge is None else merge)


def read_posts_range(spark: SparkSession, path: str, year_lower: int = 2013,
                     year_upper: int = 2016, schema: T.StructType = POSTS, header: bool = True,
                     sep: str = ",", id_col: str = "tweet_id", group_col: str = "party",
                     merge=None, fmt: str = "csv") -> DataFrame:
    """Posts of an inclusive year range that carry at least one tag."""
    df = read_rows(spark, path, fmt, schema, **({"header": header, "sep": sep} if fmt == "csv" else {}))
    df = _posts(df, id_col, group_col, TX.DEFAULT_MERGE if merge is None else merge)
    df = TX.with_n_tags(TX.with_tags(df))
    df = TX.with_year(df)
    return df.filter(P.year_between(year_lower, year_upper) & P.has_tags())


def read_embeddings(spark: SparkSession, path: str, model: str | None = None,
                    year: int | None = None) -> DataFrame:
    """S3: (post_id, grp, embedding, model, year) from Parquet partitioned by model, year.

    Filters on the partition columns prune folders before any file is opened.
    """
    df = spark.read.parquet(path)
    if model is not None:
        df = df.filter(F.col("model") == model)
    if year is not None:
        df = df.filter(F.col("year") == year)
    return df


def read_salience(spark: SparkSession, path: str) -> DataFrame:
    """Manifesto-style table; types inferred, file column order kept."""
    return read_csv(spark, path, infer=True)


PAIRS = T.StructType([T.StructField("sent1", T.StringType()), T.StructField("sent2", T.StringType()),
                      T.StructField("label", T.IntegerType())])


def read_pairs(spark: SparkSession, path: str, fmt: str = "csv", split: str | None = None) -> DataFrame:
    """(sent1, sent2, label) pairs; of one split where the folder has splits."""
    if split is None:
        return read_rows(spark, path, fmt, PAIRS)
    of_split = F.col("split") == split
    if fmt == "csv":
        return read_csv_ranges(spark, path, PAIRS, where=of_split)
    return read_rows(spark, path, fmt, T.StructType([*PAIRS.fields, T.StructField("split", T.StringType())])) \
        .filter(of_split).drop("split")
