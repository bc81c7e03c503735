"""The pipeline's stages against what each must do to its own input."""

import hashlib
import random

import corpus_pipeline
import __spark_entry__ as entry
from tagspace.llm import decontaminate, mixing, quality_gam

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(columns), name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids), name
        docs, ids = out, kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(last.doc_id) == ids and abs(last.taken.sum() - 1.5 * last["size"].sum()) < 20


def test_quality_stage_keeps_what_is_predicted(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    want = {r.doc_id for r in quality_gam.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in STAGE["quality_classifier"](spark, docs, SF01).collect()} == want
    known = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    bad = [i for i, q in known.items() if q == 0]
    assert sum(i in want for i in bad) < 0.1 * len(bad)


def test_exact_stage_against_digests(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = {}
    for r in docs.collect():
        key = hashlib.sha256((r.text or "").encode()).hexdigest()
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in STAGE["exact_dedup"](spark, docs, SF).collect()} == set(last.values())


def test_decontamination_stage_drops_planted_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in STAGE["decontamination"](spark, docs, SF).collect()}
    held = {r.doc_id for r in docs.collect() if any(" ".join(i.split()) in " ".join((r.text or "").split()) for i in items)}
    assert held and not held & set(kept)
    found = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(kept) == {r.doc_id for r in docs.select("doc_id").collect()} - found


def test_mixing_stage_is_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = STAGE["mixing"](spark, docs, SF).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(got.collect()) == sorted(mixing.mixed_documents(docs).select(*got.columns).collect())


def odd_documents(spark, rows):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, quality_score double, "
              "label long, key long, hash long, gone_id long, odd_id long, row_id long, lost_id long")
    return spark.createDataFrame([(i, t, "en", "s", None, *[None] * 8) for i, t in rows], schema)


def test_stages_on_no_rows_and_clashing_columns(spark):
    docs = odd_documents(spark, [(1, "one two three"), (None, None), (None, "x"), (2, ""), (2, "one two three")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == docs.columns, name
        out.collect()


def test_drops_go_by_id_and_text(spark):
    """Null and repeated ids: the contaminated and near-copied rows go, their namesakes stay."""
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = [text(60) for _ in range(5)]
    docs = odd_documents(spark, [(None, f"{text(20)} {item} {text(20)}"), (None, clean[0]), (5, item), (5, clean[1]), (6, clean[2])])
    kept = {(x.doc_id, x.text) for x in STAGE["decontamination"](spark, docs, SF).collect()}
    assert kept == {(None, clean[0]), (5, clean[1]), (6, clean[2])}
    rows = [(None, clean[3] + " x"), (None, clean[4]), (9, clean[3] + " y"), (9, clean[0]), (4, clean[3]), (7, clean[4] + " z")]
    kept = {(x.doc_id, x.text) for x in STAGE["near_dedup"](spark, odd_documents(spark, rows), SF).collect()}
    assert kept == {(9, clean[0]), (4, clean[3]), (7, clean[4] + " z")}


def test_repeated_ids_do_not_break_the_training_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y: seen.append(len(x)))
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    quality_gam.train(docs, labels)
    assert 0 < seen[0] <= 3


def test_entry_registers_the_dealt_queries():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
