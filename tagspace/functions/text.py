"""Projections and scalar column functions on posts.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's for equal results) -------------
# Tag pattern: '#' followed by one or more letters, digits or underscores
# (Unicode aware, the same set Python's \w matches on the data).
TAG_PATTERN = r"#[\p{L}\p{N}_]+"
# Groups merged into one: CDU and CSU become CDU/CSU.
DEFAULT_MERGE = {"CDU": "CDU/CSU", "CSU": "CDU/CSU"}
# Character marking a truncated (quoted) post text.
ELLIPSIS = "…"
# ------------------------------------------------------------------------------


def merge_groups(df: DataFrame, mapping: dict[str, str] | None = None,
                 src: str = "party", dst: str = "grp") -> DataFrame:
    """Map listed group names to a merged name into ``dst``; others kept."""
    mapping = DEFAULT_MERGE if mapping is None else mapping
    col = F.col(src)
    expr = None
    for target in sorted(set(mapping.values())):
        keys = sorted(k for k, v in mapping.items() if v == target)
        cond = col.isin(keys)
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    return df.withColumn(dst, col if expr is None else expr.otherwise(col))


def with_year(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Calendar year."""
    return df.withColumn("year", F.year(ts))


def with_month(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Calendar month 1-12."""
    return df.withColumn("month", F.month(ts))


def with_day(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Day of month."""
    return df.withColumn("day", F.dayofmonth(ts))


def tags_of(text: Column | str, pattern: str = TAG_PATTERN) -> Column:
    """P5: all tag matches in textual order; duplicates and case kept.

    A null text gives an empty list (no tags), not null.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 0),
                      F.array().cast("array<string>"))


def with_tags(df: DataFrame, text: str = "text", out: str = "tags",
              pattern: str = TAG_PATTERN) -> DataFrame:
    """P5 as a column: ``tags`` array<string>."""
    return df.withColumn(out, tags_of(text, pattern))


def with_n_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Number of tags."""
    return df.withColumn("n_tags", F.size(tags).cast("int"))


def flatten_newlines(text: Column | str) -> Column:
    """Line breaks become spaces before encoding."""
    text = F.col(text) if isinstance(text, str) else text
    return F.replace(text, F.lit("\n"), F.lit(" "))


def config_marker(mode: Column, seed: Column, fraction: Column,
                  month_start: Column, month_end: Column) -> Column:
    """Run marker: ``full``, ``random-seed{seed}-{fraction}``,
    ``time-({start}, {end})`` or the mode name."""
    return (F.when(mode == "full", F.lit("full"))
            .when(mode == "random",
                  F.concat(F.lit("random-seed"), seed.cast("string"), F.lit("-"),
                           fraction.cast("string")))
            .when(mode == "time",
                  F.concat(F.lit("time-("), month_start.cast("string"), F.lit(", "),
                           month_end.cast("string"), F.lit(")")))
            .otherwise(mode))


def model_from_path(path: Column) -> Column:
    """File base name without extension and without its last ``-part``."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    base = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.regexp_replace(base, r"-[^-]*$", "")
