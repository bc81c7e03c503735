import os

from pyspark.sql import functions as F

from tagspace.operators import embed as EM
from tagspace.operators.evaluate import pair_similarity_eval
from tagspace.plans import jobs as JB
from tagspace.sources import sinks as SK

POSTS = "post_id long, grp string, text string, created_at timestamp_ntz"


def _bytes_left(spark):
    """Bytes under the checkpoint folder, without what jobs write for others."""
    top = spark.sparkContext.getCheckpointDir()
    top = top[len("file:"):] if top.startswith("file:") else top
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(os.path.dirname(top))
               for f in names if "tagspace-out" not in d and not f.endswith(".crc"))


def _posts(spark):
    return spark.range(3000).select(
        F.col("id").alias("post_id"), F.concat(F.lit("g"), F.col("id") % 5).alias("grp"),
        F.concat(F.lit("some words, \"and\" "), "id", F.lit(" #t"), F.col("id") % 23, F.lit(" #u"), F.col("id") % 101).alias("text"),
        F.lit("2024-03-01").cast("timestamp_ntz").alias("created_at"))


def test_gather_job_leaves_its_pairs_only(spark):
    """the steps' tables are removed, and no checkpoint of ids, hashes or candidates stays."""
    path = SK.scratch_path(spark, "posts")
    _posts(spark).write.parquet(path)
    before = _bytes_left(spark)
    out = JB.gather_job(spark, path, SK.scratch_path(spark, "pairs"), 2024, 2024, 5, 10, 50, schema=POSTS,
                        id_col="post_id", group_col="grp", merge={}, fmt="parquet")
    assert JB.FS.read_pairs(spark, out, split="train").count() > 1000
    # small tables of one row per tag: 124 tags
    assert _bytes_left(spark) - before < 200_000


def test_evaluate_job_leaves_its_result_only(spark):
    """F2: vectors and scores are removed; ids of texts are keys of any encoder."""
    texts = [f"text {i % 37} of {i % 11} words" + " more" * (i % 5) for i in range(400)]
    rows = [(a, b if i % 9 else None, i % 2) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))] * 10
    pairs = spark.createDataFrame(rows, "sent1 string, sent2 string, label int")
    out = SK.scratch_path(spark, "pairs")
    SK.write_pairs(pairs, pairs, out, 2013)
    EM.register_encoder("counts-3", lambda: lambda ts: [[len(t), len(t.split()), t.count("e")] for t in ts])
    words = spark.createDataFrame([(w, [float(len(w)), 1.0, -float(i)]) for i, w in enumerate(["text", "of", "words", "3", "7"])],
                                  "word string, vector array<double>")
    ids = spark.createDataFrame([(t,) for t in {*texts}], "text string").withColumn("post_id", F.col("text"))
    for model, more in (("hash-32", {}), ("counts-3", {"dim": 3}), ("fasttext", {"words": words, "dim": 3})):
        before = _bytes_left(spark)
        got = JB.evaluate_job(spark, f"{out}/year=2013", "val", model, **more)
        left = _bytes_left(spark) - before
        emb = EM.encode_posts(ids, model, more.get("dim"), more.get("words")).select(F.col("post_id").alias("id"), "embedding")
        want = pair_similarity_eval(pairs.select(F.col("sent1").alias("id1"), F.col("sent2").alias("id2"), "label"), emb)
        rounded = lambda df: sorted((r.metric, round(r.pearson, 8), round(r.spearman, 8), r.n_pairs, r.n_scored) for r in df.collect())
        assert rounded(got) == rounded(want) and len(rounded(got)) == 4
        assert left < 30_000
