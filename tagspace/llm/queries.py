"""The registered queries of this subpackage and their DuckDB SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    quality_gam,
    repeats,
    spelling,
    unigram_counts,
    vector_codes,
    warc,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_html_text": op3_html_text,
    "op4_near_dedup": op4_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_repeats": op9_repeats,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_language_id": op11_language_id,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling": op13_spelling,
}


def _codes_sql(rounds: int = 4) -> str:
    """The contract of op12 step by step: every part meets every entry in every round."""
    near = """
        near{r} AS MATERIALIZED (
            SELECT id, p, min(d) AS d, arg_min(e, d * 256 + e) AS e
            FROM (SELECT id, q.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                  FROM parts q JOIN book{r} b ON q.p = b.p) GROUP BY id, p)"""
    book = """
        book{s} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
                SELECT p, e, list(v ORDER BY j) AS c FROM (
                    SELECT n.p, n.e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS v
                    FROM near{r} n JOIN parts q ON n.id = q.id AND n.p = q.p, unnest(range(1, len(x) + 1)) AS u(j)
                    GROUP BY n.p, n.e, j) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
    steps = ",".join(near.format(r=r) + "," + book.format(r=r, s=r + 1) for r in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        parts AS MATERIALIZED (
            SELECT id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS r(p)),
        book0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c FROM parts WHERE id <= 256),{steps},{near.format(r=rounds)},
        coded AS (
            SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM near{rounds} GROUP BY id),
        hashed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               h AS codebooks_sha256
        FROM coded JOIN kept USING (id), hashed"""


ORACLE: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
