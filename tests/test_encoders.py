import math

import pytest

from tagspace.operators import embed as EM
from tagspace.operators.evaluate import pair_similarity_eval
from tagspace.session import ensure_checkpoint_dir


def _posts(spark):
    return spark.createDataFrame([("x1", "a b a"), ("x2", ""), ("x3", None), ("x4", "unseen")],
                                 "post_id string, text string")


def test_word_average_skips_unseen_words_and_keeps_posts(spark):
    words = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<double>")
    got = {r.post_id: (r.n_tokens, list(r.embedding)) for r in EM.word_average(_posts(spark), words, dim=2).collect()}
    assert got["x1"] == (3, pytest.approx([2 / 3, 1 / 3]))
    assert got["x2"] == got["x3"] == got["x4"] == (0, [0.0, 0.0])


def test_word_average_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(EM, "BLOCK_POSTS", 3)
    monkeypatch.setattr(EM, "BLOCK_TOKENS", 4)
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i + 3))) for i in range(12)] + [(5, "w1 w1 w9"), (None, "w1"), (20, None)]
    vec = {f"w{k}": [float(k), 1.0, -2.0] for k in range(5)} | {"w9": [0.0, 0.0, 0.0]}
    posts = spark.createDataFrame(rows, "post_id long, text string")
    vectors = [*vec.items(), ("w1", [0.0, 3.0, 4.0])]  # a word of two rows counts with both
    words = spark.createDataFrame(vectors, "word string, vector array<float>")
    out = EM.word_average(posts, words, dim=3)
    got = sorted(((r.post_id is None, r.post_id), r.n_tokens, list(r.embedding)) for r in out.collect())
    want = []
    for i, _ in rows:
        own = [v for j, t in rows if i is not None and j == i for w in (t or "").split() for x, v in vectors if x == w]
        unit = [[x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for v in own]
        want.append(((i is None, i), len(own), [sum(c) / len(own) for c in zip(*unit)] if own else [0.0] * 3))
    want.sort()
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2]) for g, w in zip(got, want))
    # the posts are dealt once, and what comes back is not summed in another shuffle
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate(keys=[post_id" not in plan
    assert EM.word_average(posts.limit(0), words).count() == 0
    assert {len(r.embedding) for r in EM.word_average(posts, words).collect() if r.n_tokens == 0} == {0}


def test_dispatch_by_name(spark):
    posts = _posts(spark)
    assert EM.encode_posts(posts, "hash-8").count() == 4
    assert len(EM.encode_posts(posts, "hash/8").first().embedding) == 8
    words = spark.createDataFrame([("a", [2.0, 0.0])], "word string, vector array<double>")
    assert EM.encode_posts(posts, "fasttext-de", 2, words).count() == 4
    for name in ("sbert-x", "bert-base", "some-model", "fasttext-de"):
        with pytest.raises(ValueError, match="encoder"):
            EM.encode_posts(posts, name)

    def ones():
        import numpy as np
        return lambda texts: np.ones((len(texts), 2))
    EM.register_encoder("sbert-x", ones)
    try:
        out = EM.encode_posts(posts, "sbert-x", 2)
        assert dict(out.dtypes)["post_id"] == "string" and {tuple(r.embedding) for r in out.collect()} == {(1.0, 1.0)}
    finally:
        del EM.ENCODERS["sbert-x"]
    assert EM.encoder_for("sbert-x") == "batched" and EM.encoder_for("x") == "sentence"


def test_pairs_without_vector_are_counted(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 0), (2, 3, 1), (1, 9, 0)], "id1 long, id2 long, label int")
    rows = pair_similarity_eval(pairs, emb).collect()
    assert {(r.n_pairs, r.n_scored) for r in rows} == {(4, 3)} and len(rows) == 4


def test_no_scratch_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
    assert ensure_checkpoint_dir(spark)
