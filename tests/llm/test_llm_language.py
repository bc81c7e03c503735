"""Language ID against a plain naive Bayes over dictionaries, and on held-out documents."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tagspace.llm import language_id, queries
from tagspace.llm.common import mix, text_buffers

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, held_out boolean, score double, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", 1, None, 0.0, 3) for i, t, la in rows], DOCS)


def brute_buckets(text):
    """Buckets of a text's n-grams, one by one."""
    out, last = [" "], " "
    for c in text:
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or last != " ":
            out.append(c)
        last = c
    found = []
    for n in range(1, language_id.LONGEST + 1):
        for k in range(len(out) - n + 1):
            gram = out[k:k + n]
            if gram == [" "]:
                continue
            state = np.zeros(1, np.uint64)
            for j, c in enumerate(gram):
                state = mix(state * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(c)) + np.uint64(j + 1))
            found.append(int(state[0]) % language_id.BUCKETS)
    return found


TEXTS = ["", "  ", "a", "Ab1", " ab", "ab ", "İstanbul ǅ ß 42!", "été, où", "x" * 30, "日本語 テキスト", "\U0001d400b", "é"]


def test_buckets_against_brute_force():
    raw, offsets = text_buffers(pa.array(TEXTS + [None]))
    found, some = language_id.grams(raw, offsets)
    for r, text in enumerate([*TEXTS, ""]):
        got = sorted(int(x) for bucket, first in found for x in bucket[first[r]:first[r + 1]])
        assert got == sorted(brute_buckets(text)), text
        assert some[r] == any(c.isalpha() for c in text)


def brute_languages(rows):
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, texts = {}, {}
    for i, t, la in rows:
        if la is None or fold(i) or not any(c.isalpha() for c in t or ""):
            continue
        texts[la] = texts.get(la, 0) + 1
        for b in brute_buckets(t):
            counts.setdefault(la, {})[b] = counts.setdefault(la, {}).get(b, 0) + 1
    out = []
    for i, t, _ in rows:
        if not texts or not any(c.isalpha() for c in t or ""):
            out.append((i, fold(i), "und", 0.0))
            continue
        total = {}
        for la in sorted(texts):
            n = sum(counts[la].values()) + 0.5 * language_id.BUCKETS
            total[la] = math.log(texts[la] / sum(texts.values())) + sum(
                math.log((counts[la].get(b, 0) + 0.5) / n) for b in brute_buckets(t))
        best = max(sorted(total), key=lambda la: total[la])
        out.append((i, fold(i), best, 1 / sum(math.exp(x - total[best]) for x in total.values())))
    return out


def test_languages_against_brute_force(spark):
    r = random.Random(5)
    words = {"en": ["the", "and", "of", "house"], "de": ["über", "und", "Häuser", "der"], "fr": ["été", "où", "la", "les"]}
    rows = []
    for i in range(120):
        la = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[la]) for _ in range(r.randrange(1, 9))), la if i % 7 else None))
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 34 !", "de"), (None, "the house", "en"), (503, "the", "en"),
             (503, "the", "en"), (504, "日本", None), (505, "z " * 60_000, "en"), (506, "é", "és")]
    key = lambda x: (x[0] if x[0] is not None else -1, x[2], x[3])
    got = sorted([tuple(x) for x in language_id.languages(frame(spark, rows)).collect()], key=key)
    want = sorted(brute_languages(rows), key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-6, abs=1e-9)


def test_nothing_to_learn_from(spark):
    assert language_id.languages(frame(spark, [(1, "a", "en")]).limit(0)).count() == 0
    got = language_id.languages(frame(spark, [(1, "some words", None), (2, None, "en")])).collect()
    assert [(x.lang_pred, x.score) for x in got] == [("und", 0.0)] * 2


def test_matrix_is_bounded():
    assert language_id.buckets_for(4) == language_id.BUCKETS
    assert language_id.buckets_for(5_000) * 5_000 <= language_id.CELLS


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op11_language_id(spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert len(held) > 200
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())
