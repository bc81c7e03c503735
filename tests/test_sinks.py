import os

from pyspark.sql import functions as F

from tagspace.sources import sinks as SK
from tagspace.sources.files import read_embeddings


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_embeddings_partitioned_and_model_name_escaped(spark):
    emb = spark.createDataFrame([(1, "A", [1.0, 0.0]), (2, "B", [0.0, 1.0])],
                                "post_id long, grp string, embedding array<double>")
    out = SK.scratch_path(spark, "emb")
    SK.write_embeddings(emb, out, "org/model-x", 2013)
    SK.write_embeddings(emb.limit(1), out, "other", 2017)
    assert os.path.isdir(os.path.join(_local(out), "model=org_model-x", "year=2013"))
    back = read_embeddings(spark, out, model="org_model-x", year=2013)
    assert sorted(r.post_id for r in back.collect()) == [1, 2]
    assert read_embeddings(spark, out, year=2017).count() == 1


def test_pairs_by_year_and_split_with_suffix(spark):
    df = spark.createDataFrame([('a, "b"', "c\nd", 1), ("e", "f", 0)],
                               "sent1 string, sent2 string, label int")
    out = SK.scratch_path(spark, "pairs")
    SK.write_pairs(df.limit(1), df.filter("label = 0"), out, 2013, suffix="v2")
    assert os.path.isdir(os.path.join(_local(out), "year=2013_v2", "split=train"))
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema("sent1 string, sent2 string, label int, year string, split string").csv(out))
    rows = {(r.sent1, r.sent2, r.label, r.split) for r in back.collect()}
    assert rows == {('a, "b"', "c\nd", 1, "train"), ("e", "f", 0, "val")}


def test_filtered_and_results_append(spark):
    emb = spark.createDataFrame([(1, "A", [1.0])], "post_id long, grp string, embedding array<double>")
    out = SK.scratch_path(spark, "filtered")
    SK.write_filtered(emb, out, "time", "time-(6, 9)")
    SK.write_filtered(emb, out, "content", "content")
    back = spark.read.parquet(out)
    assert {(r.mode, r.config) for r in back.collect()} == {("time", "time-(6, 9)"),
                                                             ("content", "content")}
    res = SK.scratch_path(spark, "results")
    row = spark.range(1).select(F.lit("full").alias("marker"), F.lit(0.5).alias("r"))
    SK.write_results(row, res)
    SK.write_results(row, res)
    assert spark.read.parquet(res).count() == 2


def test_rerun_and_other_year_keep_partitions(spark):
    emb = spark.createDataFrame([(1, "A", [1.0])], "post_id long, grp string, embedding array<double>")
    out = SK.scratch_path(spark, "emb")
    for year in (2013, 2017, 2013):
        SK.write_embeddings(emb, out, "m", year)
    assert sorted(r.year for r in read_embeddings(spark, out).collect()) == [2013, 2017]
    pairs = spark.createDataFrame([("a", "b", 1)], "sent1 string, sent2 string, label int")
    out = SK.scratch_path(spark, "pairs")
    for year in (2013, 2017, 2013):
        SK.write_pairs(pairs, pairs, out, year)
    assert sorted(os.listdir(_local(out)))[-2:] == ["year=2013", "year=2017"]
    from tagspace.sources.files import read_pairs
    assert read_pairs(spark, f"{out}/year=2013", split="val").count() == 1
    out = SK.scratch_path(spark, "filtered")
    for _ in range(2):
        SK.write_filtered(emb, out, "time", "time-(6, 9)")
    assert spark.read.parquet(out).count() == 1


def test_results_are_committed_once_per_run(spark):
    out = SK.scratch_path(spark, "committed")
    row = lambda x: spark.createDataFrame([("full", x), ("time", x)], "mode string, r double")
    SK.commit_results(row(0.1), out, "m/a 2013")
    SK.commit_results(row(0.2), out, "other")
    SK.commit_results(row(0.3), out, "m/a 2013")  # the same run again
    row(0.9).write.parquet(f"{out}/data/killed")  # a job that ended between its rows and the commit
    assert sorted((r.mode, r.r) for r in SK.read_results(spark, out).collect()) == [
        ("full", 0.2), ("full", 0.3), ("time", 0.2), ("time", 0.3)]


def test_evaluation_is_written_by_model_and_split(spark):
    out = SK.scratch_path(spark, "evaluation")
    row = spark.createDataFrame([("cosine", 0.5)], "metric string, pearson double")
    for model, split in (("a/b", "val"), ("c", "val"), ("a/b", "val"), ("a/b", "train")):
        SK.write_evaluation(row, out, model, split)
    assert sorted((r.model, r.split) for r in spark.read.parquet(out).collect()) == [
        ("a_b", "train"), ("a_b", "val"), ("c", "val")]


def test_pairs_are_written_compressed_and_read_back(spark):
    """three copies of the pairs lie on the disk while one of them is written again."""
    from tagspace.sources.files import read_pairs
    rows = [('a, "b"', "c\nd", 1), ("e", "f,\n\n\"", 0), ("ü" * 50, "", 1)] * 40
    pairs = spark.createDataFrame(rows, "sent1 string, sent2 string, label int")
    out = SK.scratch_path(spark, "pairs")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    for _ in range(2):
        SK.write_pairs(pairs, pairs.limit(3), out, 2013)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == (before or "0")
    files = [f for _, _, names in os.walk(_local(out)) for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    back = lambda split: sorted(tuple(r) for r in read_pairs(spark, f"{out}/year=2013", split=split).fillna("").collect())
    assert back("train") == sorted(rows) and back("val") == sorted(rows[:3])
