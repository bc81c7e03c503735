import math

from pyspark.sql import functions as F

from tagspace.operators import pairs as PR
from tagspace.operators import tags as TG
from tagspace.operators.ranks import count_ranks
from tagspace.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def _setup(spark):
    tp = PR.tagged_posts(FX.posts_event(spark, SF))
    ments = tp.select("post_id", "grp", F.posexplode("tags").alias("pos", "tag"))
    common = TG.common_tags(ments, 5, 10).select("tag")
    cooc = TG.tag_cooccurrence(tp, common)
    return tp, common, cooc


def test_clean_negatives_equal_full_anti_join(spark):
    tp, common, cooc = _setup(spark)
    # small buckets force several doubling rounds
    got = {(r.tag, r.post_id, r.rank) for r in
           PR.clean_negatives(tp.select("post_id", "tags"), common, cooc, 42,
                              bucket_posts=8, first_buckets=1).collect()}
    # brute force on the driver over the small fixture: every tag against every post
    import hashlib

    def h(x):
        return int(hashlib.md5(f"42:{x}".encode()).hexdigest()[:8], 16)
    edges = {(r.tag, r.other) for r in cooc.collect()}
    posts = [(r.post_id, r.tags) for r in tp.select("post_id", "tags").collect()]
    want = set()
    for t in [r.tag for r in common.collect()]:
        clean = [p for p, tags in posts if not any((t, u) in edges for u in tags)]
        clean.sort(key=lambda p: ((h(p) - h(t)) % (1 << 32), p))
        want |= {(t, p, i + 1) for i, p in enumerate(clean[:100])}
    assert got == want and len(got) > 0


def test_hot_tag_does_not_make_every_tag_scan_all_posts(spark, monkeypatch):
    posts = FX.with_hot_tag(FX.posts_event(spark, SF))
    tp = PR.tagged_posts(posts)
    ments = tp.select("post_id", "grp", F.posexplode("tags").alias("pos", "tag"))
    common = TG.common_tags(ments, 5, 10).select("tag")
    cooc = TG.tag_cooccurrence(tp, common)
    rows, real = [], PR._scanned

    def counted(*args):
        out = real(*args)
        rows.append(out.count())
        return out
    monkeypatch.setattr(PR, "_scanned", counted)
    PR.clean_negatives(tp.select("post_id", "tags"), common, cooc, 42).count()
    assert sum(rows) < 0.2 * common.count() * tp.count()


def test_twenty_heavy_tags_give_few_candidates(spark, monkeypatch):
    """Candidates stay near twice the posts asked for, although most posts carry a heavy tag; and
    what a small first range leaves open is found in further rounds."""
    posts = FX.with_heavy_tags(FX.posts_event(spark, SF), 20)
    tp = PR.tagged_posts(posts).select("post_id", "grp", "tags").cache()
    ments = tp.select("post_id", "grp", F.posexplode("tags").alias("pos", "tag"))
    common = TG.common_tags(ments, 5, 10).select("tag")
    cooc = PR.tag_cooccurrence_of_lists(tp, common)
    rows, real = [], PR._scanned

    def counted(*args):
        out = real(*args)
        rows.append(out.count())
        return out
    monkeypatch.setattr(PR, "_scanned", counted)
    whole = {(r.tag, r.post_id, r["rank"]) for r in PR.clean_negatives(tp.select("post_id", "tags"), common, cooc, 42).collect()}
    assert sum(rows) < 0.05 * common.count() * tp.count()
    small = {(r.tag, r.post_id, r["rank"]) for r in PR.clean_negatives(
        tp.select("post_id", "tags"), common, cooc, 42, bucket_posts=4, first_buckets=3).collect()}
    assert small == whole


def test_pair_invariants_and_split(spark):
    posts = FX.posts_event(spark, SF)
    ds = PR.pair_dataset(posts, 5, 10, 42, 230).cache()
    tags = PR.tagged_posts(posts).select("post_id", "tags")
    t1 = tags.select(F.col("post_id").alias("id1"), F.col("tags").alias("t1"))
    t2 = tags.select(F.col("post_id").alias("id2"), F.col("tags").alias("t2"))
    j = ds.join(t1, "id1").join(t2, "id2")
    pos = j.filter("label = 1")
    assert pos.filter(~(F.array_contains("t1", F.col("tag")) & F.array_contains("t2", F.col("tag")))).count() == 0
    assert pos.filter(F.col("id1") == F.col("id2")).count() == 0
    neg = j.filter("label = 0")
    assert neg.filter(~F.array_contains("t1", F.col("tag")) | F.array_contains("t2", F.col("tag"))).count() == 0
    assert ds.groupBy("tag", "label").count().filter("count > 230").count() == 0
    sp = PR.split_dataset(ds, 42)
    n = ds.count()
    cnt = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    assert cnt["train"] == math.floor(0.8 * n) and cnt["train"] + cnt["val"] == n
    assert sp.select("tag", "id1", "id2", "label").distinct().count() == n


def test_count_ranks(spark):
    import pandas as pd
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 1.0, 7.0, 2.0] * 5
    rows = [(k, v, i % 2) for k in ("a", "b") for i, v in enumerate(vals if k == "a" else vals[:3])]
    df = spark.createDataFrame(rows, "k string, x double, label int")
    counts = df.groupBy("k", "x", "label").agg(F.count(F.lit(1)).alias("c"))
    got = {(r.k, r.x): r.rx for r in count_ranks(counts, "x", "rx", ("k",), partitions=3).collect()}
    for k, own in (("a", vals), ("b", vals[:3])):
        want = pd.Series(own).rank(method="average").to_list()
        assert [got[k, v] for v in own] == want


def test_pairs_of_a_bounded_hash_equal_all_pairs_in_order(spark, monkeypatch):
    """pairs beyond a hash bound are never sorted; a bound that leaves too few is none."""
    import hashlib
    pos = [("a", i, i + 1) for i in range(60)] + [("b", 1, 1), ("b", 2, 2)] + [("c", 5, 1)]
    neg = [("a", 100 + i, i + 1) for i in range(50)] + [("b", 7, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "tag string, post_id long, rank int")
    def first(tag, pairs, salt):
        return sorted(pairs, key=lambda p: hashlib.md5(f"42:{salt}:{tag}:{p[0]}:{p[1]}".encode()).hexdigest())[:20]
    ids = {t: [p for u, p, _ in pos if u == t] for t in "abc"}
    want_pos = {(t, *p) for t in "abc" for p in first(t, [(x, y) for i, x in enumerate(ids[t]) for y in ids[t][i + 1:]], "pp")}
    want_neg = {(t, *p) for t in "ab" for p in first(t, [(x, y) for x in ids[t] for u, y, _ in neg if u == t], "np")}
    for spare in (10.0, -4.0):  # the second leaves too few
        monkeypatch.setattr(PR, "SPARE", spare)
        assert {tuple(r) for r in PR.positive_pairs(frame(pos), 42, 20).collect()} == want_pos
        assert {tuple(r) for r in PR.negative_pairs(frame(pos), frame(neg), 42, 20).collect()} == want_neg


def test_pairs_are_not_sorted_by_rows(spark):
    """no window over the k x k pairs of a tag."""
    rows = spark.createDataFrame([("a", i, i + 1) for i in range(5)], "tag string, post_id long, rank int")
    plan = PR.negative_pairs(rows, rows, 42, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_few_candidates_where_tags_meet_many_tags_that_no_bitmap_tells(spark, monkeypatch):
    """tags that co-occur with many middling tags are no reason to scan twenty times too far."""
    monkeypatch.setattr(PR, "HEAVY", 4)
    rows = [(i, f"g{i % 5}", [f"#k{(i * 7919) % 100}", f"#u{i % 60}"]) for i in range(20_000)]
    tp = spark.createDataFrame(rows, "post_id long, grp string, tags array<string>").cache()
    common = spark.createDataFrame([(f"#u{i}",) for i in range(60)], "tag string")
    cooc = PR.tag_cooccurrence_of_lists(tp, common)
    cooc = cooc.where("tag = other or abs(xxhash64(tag, other)) % 2 = 0").cache()
    seen, real = [], PR._scanned

    def counted(*args):
        out = real(*args)
        seen.append(out.count())
        return out
    monkeypatch.setattr(PR, "_scanned", counted)
    got = PR.clean_negatives(tp.select("post_id", "tags"), common, cooc, 42, k=10)
    assert got.count() == 60 * 10
    assert sum(seen) < 60 * 10 * 12


def test_deep_scans_leave_out_posts_with_heavy_tags(spark):
    """the posts without the first heavy tags are a table of their own."""
    posts = spark.createDataFrame([(x,) for x in [0] * 50 + [1] * 30 + [4] * 20], "clear int")
    assert PR._depths(posts, 100, 4) == [(0, 100), (1, 50), (2, 20)]


def _repeated_posts(spark):
    """Posts of which some ids come twice, with another text, and some posts have no id."""
    rows = [(i, f"g{i % 5}", f"a{i} #t{i % 3} #u{i % 7}" + (" #w" if i % 11 == 0 else "")) for i in range(120)]
    rows += [(i, f"g{i % 5}", f"again {i} #t{i % 3}") for i in range(0, 120, 10)]
    rows += [(i, "g1", None) for i in range(5, 120, 25)] + [(None, "g2", "no id #t1 #u2"), (None, "g3", "none #w")]
    return spark.createDataFrame(rows, "post_id long, grp string, text string")


def test_pairs_of_repeated_posts_have_each_of_their_texts(spark):
    """texts come as lists per tag; the rows are those of two joins on the posts."""
    posts = _repeated_posts(spark)
    _, pos, neg = PR.pair_parts(posts, 3, 5, 42, 40, 15)
    both = pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
    t1, t2 = (posts.select(F.col("post_id").alias(f"id{x}"), F.col("text").alias(f"sent{x}")) for x in (1, 2))
    want = both.join(t1, "id1").join(t2, "id2").select("tag", "id1", "id2", "sent1", "sent2", "label")
    got = PR.pair_dataset(posts, 3, 5, 42, 40, 15)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert order(got) == order(want)
    assert got.count() > both.count() > both.distinct().count() - 1 and got.where("sent1 is null").count() > 0


def test_pairs_are_read_and_split_without_moving_them(spark, monkeypatch):
    """no join, shuffle or checkpoint of the pairs and of their hashes."""
    ds = PR.pair_dataset(_repeated_posts(spark), 3, 5, 42, 40, 15)
    monkeypatch.setattr(PR, "cut_lineage", lambda df: 1 / 0)
    split = PR.split_dataset(ds, 42)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    n = split.count()
    train = split.where("split = 'train'")
    assert math.floor(0.8 * n) - 4 <= train.count() <= math.floor(0.8 * n)  # equal hashes stay together
    assert train.count() and train.agg(F.max(F.md5(F.concat_ws(":", F.lit(42), F.lit("split"), "tag", "id1", "id2", "label")))).first()[0] < \
        split.where("split = 'val'").agg(F.min(F.md5(F.concat_ws(":", F.lit(42), F.lit("split"), "tag", "id1", "id2", "label")))).first()[0]


def test_samples_of_a_tag_of_many_groups(spark, monkeypatch):
    """a tag's posts sorted in several groups give the first k of all, for each salt."""
    import hashlib
    monkeypatch.setattr(PR, "GROUP_POSTS", 16)
    rows = [("a", i) for i in range(200)] * 2 + [("b", i) for i in range(3)] + [("b", None), ("c", 1)]
    frame = spark.createDataFrame(rows, "tag string, post_id long")
    common = spark.createDataFrame([("a",), ("b",)], "tag string")

    def first(tag, salt):
        ids = sorted({p for t, p in rows if t == tag}, key=lambda p: hashlib.md5(
            ":".join(str(x) for x in (42, salt, tag, p) if x is not None).encode()).hexdigest())
        return [(tag, p, i + 1) for i, p in enumerate(ids[:10])]
    for salt in ("pos", "pos2"):
        got = {tuple(r) for r in PR.positive_sample(frame, common, 42, salt, 10).collect()}
        assert got == {*first("a", salt), *first("b", salt)}
