"""Derived views over the given tables that stand in for the reference's inputs.

They are plain projections and joins of the given tables, so every query that
reads them grows with the data. The DuckDB oracle defines the same views in SQL
(``tagspace.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspace.functions.text import ELLIPSIS, merge_groups
from tagspace.session import cut_lineage
from tagspace.sources.tables import table

# --- fixed values of the test views --------------------------------------------
DOC_MERGE = {"src0": "src0/1", "src1": "src0/1"}
DOC_INCUMBENT_PRIORITIES = ["1-URGENT", "2-HIGH"]
EMBEDDING_DIM = 64  # length of every vector of the embeddings table
SALIENCE_DATE = 199709
SALIENCE_COUNTRY = "Germany"
# per-type columns added to the salience view, filled by p_type in name order, cycling
SALIENCE_TYPE_COLUMNS = ["per201", "per202", "per203", "per305", "per401", "per402",
                         "per403", "per501", "per601"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]  # in name order
N_BRANDS = 25
# -------------------------------------------------------------------------------


def posts_event(spark: SparkSession, sf_dir: str, with_embedding: bool = False,
                gaps: bool = False) -> DataFrame:
    """posts_event: one post per event; tags ``#k<props.k>`` and ``#u<user_id>``."""
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    tagged = F.concat(F.col("event_type"), F.lit(" #k"), k, F.lit(" #u"),
                      F.col("user_id").cast("string"))
    if gaps:
        tagged = F.when(F.col("event_id") % 17 == 0, F.col("event_type")).otherwise(tagged)
    text = F.concat(tagged, F.when(F.col("event_id") % 13 == 0, F.lit(" " + ELLIPSIS))
                    .otherwise(F.lit("")))
    posts = ev.select(
        F.col("event_id").alias("post_id"),
        # a sixth group, which the listed groups leave out
        F.when(F.col("event_id") % 19 == 0, F.lit("other")).otherwise(F.col("event_type")).alias("grp"),
        # the events lie in one month; the view spreads them over a year
        (F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("event_id") % 12).cast("int"))).alias("created_at"),
        text.alias("text"),
        (F.col("user_id") % 2).cast("int").alias("elected"),
        F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("incumbent"),
        F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("is_retweet"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("is_quoted"),
        F.when(F.col("event_id") % 11 == 0, 1).otherwise(0).alias("is_reply"),
    )
    if with_embedding:
        posts = posts.join(event_embeddings(spark, sf_dir), "post_id")
    return posts


def with_hot_tag(posts: DataFrame) -> DataFrame:
    """Posts of which nine in ten carry one more tag, as a collection's own hashtag does."""
    return posts.withColumn("text", F.when(F.col("post_id") % 10 == 0, F.col("text")).otherwise(
        F.concat("text", F.lit(" #all"))))


def with_heavy_tags(posts: DataFrame, tags: int = 20) -> DataFrame:
    """Posts with ``tags`` more tags, each on three posts in ten."""
    own = [F.when(F.pmod(F.floor(F.col("post_id") * (2 * j + 3) / (j + 1)), F.lit(10)) < 3, F.lit(f" #heavy{j}")).otherwise("")
           for j in range(tags)]
    return posts.withColumn("text", F.concat("text", *own))


def event_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding table keyed by post: event e takes vector ``e mod count``."""
    emb = table(spark, sf_dir, "embeddings")
    n = emb.count()
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"), (F.col("event_id") % F.lit(n)).alias("vec_id"))
    return ev.join(emb.select("vec_id", "embedding"), "vec_id").select("post_id", "embedding")


def clustered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, embedding): vectors that lie around others of the table, about 20 around each;
    every 97th is zero."""
    emb = table(spark, sf_dir, "embeddings")
    centres = max(25, emb.count() // 20)
    around = emb.select(F.col("vec_id").alias("c"), F.col("embedding").alias("ce"))
    rows = emb.withColumn("c", F.col("vec_id") % F.lit(centres)).join(around, "c")
    moved = F.zip_with(F.col("ce").cast("array<double>"), F.col("embedding").cast("array<double>"), lambda c, e: c * 6 + e)
    zero = F.transform("embedding", lambda e: F.lit(0.0))
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"),
                       F.when(F.col("vec_id") % 97 == 96, zero).otherwise(moved).alias("embedding"))


def posts_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts_doc: documents joined to orders for a date and election flags."""
    docs = table(spark, sf_dir, "documents")
    orders = table(spark, sf_dir, "orders")
    joined = docs.join(orders, docs.doc_id == orders.o_orderkey)
    posts = joined.select(
        F.col("doc_id").alias("post_id"),
        F.col("source").alias("party"),
        F.col("text"),
        F.col("lang"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("elected"),
        F.when(F.col("o_orderpriority").isin(DOC_INCUMBENT_PRIORITIES), 1).otherwise(0)
        .alias("incumbent"),
    )
    return merge_groups(posts, DOC_MERGE, src="party", dst="grp")


def salience_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifesto stand-in: one row per market segment, ``per*`` shares of quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = (li.join(part, li.l_partkey == part.p_partkey)
            .join(orders, li.l_orderkey == orders.o_orderkey)
            .join(cust, orders.o_custkey == cust.c_custkey)
            .select(F.col("c_mktsegment").alias("seg"),
                    F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("brand"),
                    "p_type", "l_quantity"))
    brands = list(range(1, N_BRANDS + 1))
    types = PART_TYPES
    q = F.col("l_quantity")
    sums = [F.sum(F.when(F.col("brand") == b, q)).alias(f"b{b}") for b in brands]
    sums += [F.sum(F.when(F.col("p_type") == t, q)).alias(f"t{i}") for i, t in enumerate(types)]
    wide = rows.groupBy("seg").agg(F.sum(q).alias("q"), *sums)
    grand = F.sum("q").over(_whole())

    def pct(c):
        return F.coalesce(F.col(c), F.lit(0.0)) * 100.0 / F.col("q")

    cols = [F.lit(SALIENCE_DATE).alias("date"), F.lit(SALIENCE_COUNTRY).alias("countryname"),
            F.col("seg").alias("partyabbrev"), (F.col("q") * 100.0 / grand).alias("pervote"),
            F.lit(0.0).alias("peruncod")]
    for b in brands:
        value = pct(f"b{b}")
        if b == 5:  # a category that a group's programme does not have
            value = F.when(F.col("seg") != "BUILDING", value)
        cols.append(value.alias(f"per{100 + b}"))
        if b == 3:
            cols.append((pct(f"b{b}") / 2.0).alias("per103_1"))
    for i, name in enumerate(SALIENCE_TYPE_COLUMNS):
        cols.append(pct(f"t{i % len(types)}").alias(name))
    own = wide.select(*cols)
    # rows of another year, another country and another group, which the filters leave out
    per101 = F.col("per101") + 1.0
    more = (own.withColumns({"date": F.lit(199309), "per101": per101})
            .unionByName(own.withColumns({"countryname": F.lit("Austria"), "per102": per101}))
            .unionByName(own.filter("partyabbrev = 'BUILDING'").withColumn("partyabbrev", F.lit("UNLISTED"))))
    # a few rows per segment, read by every matrix built from it: written once
    return cut_lineage(own.unionByName(more))


def _whole():
    from pyspark.sql import Window
    # the salience view has one row per segment (a handful), so one window is bounded
    return Window.partitionBy()


def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type and c_mktsegment matched by alphabetical rank: (grp, seg)."""
    from pyspark.sql import Window
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp")).distinct()
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg")).distinct()
    # both sides are distinct category values (a handful), ranked in one small window
    ev = ev.withColumn("r", F.row_number().over(Window.orderBy("grp")))
    seg = seg.withColumn("r", F.row_number().over(Window.orderBy("seg")))
    return ev.join(seg, "r").select("grp", "seg")


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive vectors (i, i+1); label 1 when both share a label."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"),
                     F.col("vec_id").alias("id2"))
    return (emb.join(nxt, "vec_id")
            .select(F.col("vec_id").alias("id1"), "id2",
                    (F.col("label") == F.col("label2")).cast("int").alias("label")))


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors (word, vector): three of four words of posts_doc, by a hash of the word, so
    that a quarter of them is unknown; word w has vector ``hash(w) mod count``."""
    from tagspace.functions.hashing import hash32
    from tagspace.operators.embed import tokens
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vecs.count()
    words = posts_doc(spark, sf_dir).select(F.explode(tokens()).alias("word")).distinct()
    words = words.filter(F.pmod(hash32(F.col("word")), F.lit(4)) != 0)
    return words.withColumn("vec_id", F.pmod(hash32(F.col("word")), F.lit(n))).join(vecs, "vec_id").select("word", "vector")


def with_blank_texts(posts: DataFrame) -> DataFrame:
    """Posts of which some have an empty text and some none (every 50th, and the one after)."""
    return posts.withColumn("text", F.when(F.col("post_id") % 50 == 0, F.lit("")).when(
        F.col("post_id") % 50 == 1, F.lit(None).cast("string")).otherwise(F.col("text")))
