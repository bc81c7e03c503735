import unicodedata

from pyspark.sql import functions as F

from tagspace.functions import predicates as P
from tagspace.functions import text as T
from tagspace.functions.hashing import hash32


def test_tag_extraction_unicode(spark):
    s = "#GRÜNE #spd2021 #a_b #x² #日本 #" + unicodedata.normalize("NFD", "é") + "x ##dup #-no"
    df = spark.createDataFrame([(s,), ("#CDU/CSU #cdu",), (None,)], "text string")
    out = [r[0] for r in df.select(F.array_join(T.tags_of("text"), ",")).collect()]
    assert out == ["#GRÜNE,#spd2021,#a_b,#x²,#日本,#e,#dup", "#CDU,#cdu", ""]


def test_merge_groups_and_calendar(spark):
    df = spark.createDataFrame([("CDU",), ("CSU",), ("SPD",), (None,)], "party string")
    got = [r.grp for r in T.merge_groups(df).collect()]
    assert got == ["CDU/CSU", "CDU/CSU", "SPD", None]


def test_config_marker_and_model_name(spark):
    df = spark.createDataFrame([("time", 0, 1.0, 6, 9), ("random", 42, 0.5, 1, 12),
                                ("full", 0, 1.0, 1, 12), ("elected", 0, 1.0, 1, 12)],
                               "mode string, seed int, fraction double, ms int, me int")
    m = df.select(T.config_marker(F.col("mode"), F.col("seed"), F.col("fraction"),
                                  F.col("ms"), F.col("me")).alias("m"))
    assert [r.m for r in m.collect()] == ["time-(6, 9)", "random-seed42-0.5", "full", "elected"]
    p = spark.createDataFrame([("/x/y/sbert-ht-2013.pkl",)], "p string")
    assert p.select(T.model_from_path(F.col("p"))).first()[0] == "sbert-ht"


def test_hash_golden_and_random_mask_invariants(spark):
    assert spark.range(1).select(hash32(F.lit(42), F.lit(7))).first()[0] == 1409445407
    df = spark.range(2000).withColumnRenamed("id", "post_id")
    a = {r.post_id for r in df.filter(P.random_keep(0.25, 6)).collect()}
    b = {r.post_id for r in df.filter(P.random_keep(0.5, 6)).collect()}
    assert a <= b and 300 < len(a) < 700  # nested in the fraction
    c = {r.post_id for r in df.repartition(17).filter(P.random_keep(0.25, 6)).collect()}
    d = {r.post_id for r in df.repartition(1).filter(P.random_keep(0.25, 6)).collect()}
    assert a == c == d  # independent of partitioning


def test_content_and_election_predicates(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 0, "ok", 1, 1), (2, 1, 0, 0, "rt", 1, 0), (3, 0, 0, 0, "cut …", 0, 1),
         (4, 0, 0, 0, None, None, 1)],
        "post_id long, is_retweet int, is_quoted int, is_reply int, text string, elected int, "
        "incumbent int")
    ids = lambda p: sorted(r.post_id for r in df.filter(p).collect())
    assert ids(P.content()) == [1]
    assert ids(P.reelected()) == [1]
    assert ids(P.newly_elected()) == [2]
    assert ids(P.not_reelected()) == [3]
