from pyspark.sql import functions as F

from tagspace.schema import POST_COLUMNS
from tagspace.sources import files as FS
from tagspace.sources.sinks import scratch_path


def _row(**kv):
    base = {c: "" for c in POST_COLUMNS}
    base.update(kv)
    return base


def _csv_field(v):
    v = str(v)
    if any(ch in v for ch in ',"\n'):
        return '"' + v.replace('"', '""') + '"'
    return v


def test_read_posts_tolerant_csv(spark):
    rows = [
        _row(tweet_id="1", party="CDU", text='say "hi", #a\nnew line #b', created_at="2013-05-01 10:00:00",
             elected="1", incumbent="0", is_retweet="0", is_quoted="0", is_reply="0", likes="70000"),
        _row(tweet_id="2", party="CSU", text="#a", created_at="2013-06-01 10:00:00",
             elected="x", incumbent="1", is_retweet="0", is_quoted="0", is_reply="0"),
        _row(tweet_id="3", party="SPD", text="#c", created_at="2014-01-01 00:00:00"),
    ]
    lines = [",".join(POST_COLUMNS)]
    for r in rows:
        lines.append(",".join(_csv_field(r[c]) for c in POST_COLUMNS))
    lines.append("4,short")  # a short row
    path = scratch_path(spark, "posts-csv")
    spark.sparkContext.parallelize(["\n".join(lines)], 1).saveAsTextFile(path)
    df = FS.read_posts(spark, path, 2013)
    got = {r.post_id: r for r in df.collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].grp == "CDU/CSU" and got["2"].grp == "CDU/CSU"
    assert got["1"].text == 'say "hi", #a\nnew line #b'
    assert got["1"].likes == 70000
    assert got["2"].elected is None  # non-numeric flag → NULL, row kept
    rng = FS.read_posts_range(spark, path, 2013, 2014)
    assert sorted(r.post_id for r in rng.collect()) == ["1", "2", "3"]
    assert {r.post_id: r.n_tags for r in rng.collect()}["1"] == 2
