from tagspace.operators import tags as TG


def _posts(spark, rows):
    return spark.createDataFrame(rows, "post_id long, grp string, text string")


def test_mentions_count_duplicates(spark):
    p = _posts(spark, [(1, "A", "#a #a"), (2, "B", "#b")])
    m = TG.mentions(p)
    counts = {r.tag: r.n for r in TG.tag_counts(m, "mentions").collect()}
    posts = {r.tag: r.n for r in TG.tag_counts(m, "posts").collect()}
    assert counts["#a"] == 2 and posts["#a"] == 1


def test_null_group_counts_as_group(spark):
    p = _posts(spark, [(1, "A", "#t"), (2, None, "#t"), (3, "B", "#t"), (4, "B", "#u")])
    g = {r.tag: r.n_groups for r in TG.tag_groups(TG.mentions(p)).collect()}
    assert g["#t"] == 3
    g2 = {r.tag: r.n_groups for r in TG.tag_groups(TG.mentions(p), count_null_group=False).collect()}
    assert g2["#t"] == 2


def test_common_tags_thresholds(spark):
    rows = [(i, "ABC"[i % 3], "#x #y" if i < 6 else "#x") for i in range(12)]
    c = {r.tag for r in TG.common_tags(TG.mentions(_posts(spark, rows)), 3, 10).collect()}
    assert c == {"#x"}


def test_cooccurrence_includes_self_and_all_partners(spark):
    p = _posts(spark, [(1, "A", "#a #b"), (2, "B", "#a #c"), (3, "C", "#d")])
    common = spark.createDataFrame([("#a",)], "tag string")
    e = {(r.tag, r.other) for r in TG.tag_cooccurrence(p, common).collect()}
    assert e == {("#a", "#a"), ("#a", "#b"), ("#a", "#c")}
    # a text filter is a substring regex, as in the reference
    m = TG.text_matches_tags(_posts(spark, [(1, "A", "#k10"), (2, "A", "#k2")]), ["k1"])
    assert [r.post_id for r in m.collect()] == [1]


def test_encoder_dispatch():
    from tagspace.operators import embed as EM
    assert EM.encoder_for("cc.de.300.fasttext") == "word_average"
    assert EM.encoder_for("bert-base-german-cased") == "batched"
    assert EM.encoder_for("sbert-ht") == "batched"  # the legacy name rule (D22)
    assert EM.encoder_for("paraphrase-multilingual") == "sentence"
    EM.register_encoder("sbert-ht", lambda: EM.numpy_hash_encoder(8))
    assert EM.encoder_for("sbert-ht") == "registered"
    assert EM.encoder_for("sbert-ht", legacy_dispatch=True) == "batched"


def test_tag_lists_literal_and_whole(spark):
    import random
    import re
    r = random.Random(6)
    parts = ["#k1", "#k10", "#k.1", "#kx1", "#K1", "##k1", "#k1#k2", "#ü", "#k1-", "#k1_", "#k1\u0301", "k1", " ", "#", "#1", "\n"]
    rows = [(i, "A", "".join(r.choice(parts) for _ in range(r.randrange(6)))) for i in range(300)] + [(900, "A", None), (901, "A", "")]
    df = _posts(spark, rows)
    for tags in (["k1"], ["k.1", "ü"], ["k1", "k2", "", "not a tag"], [f"k{i}" for i in range(1000)]):
        ids = lambda **kw: {x.post_id for x in TG.text_matches_tags(df, tags, **kw).collect()}  # noqa: E731, B023
        assert ids(literal=True) == {i for i, _, t in rows if t is not None and any("#" + x in t for x in tags)}
        own = {i: set(re.findall(r"#[\w]+", t or "")) for i, _, t in rows}
        assert ids(whole_tag=True) == {i for i in own if own[i] & {"#" + x for x in tags if x}}
    assert TG.text_matches_tags(df, []).count() == 0
