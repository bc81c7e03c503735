"""Spelling groups against a search over all pairs of words."""

import random
import re
import zlib

import numpy as np
import pytest

from tagspace.llm import queries, spelling

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, word string, n long, id long, form string, root string"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "y", "z") for i, t in rows], DOCS)


def brute_words(rows):
    out = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(x) for x in spelling.spelling_groups(frame(spark, rows)).select(
        "word", "n", "n_near", "form", "form_n", "root").collect())


def test_groups_against_all_pairs(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(6, 12))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = r.choice(base[:6] if r.random() < 0.6 else base)
            while r.random() < 0.25:
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abéZ") + w[k:], w[:k] + "c" + w[k + 1:]])
            words.append(w)
        rows.append((i, r.choice([" ", ", ", "-", "9"]).join(words)))
    want = brute(rows)
    assert sum(x[3] is not None for x in want) > 50 and any(x[5] not in (x[0], x[3]) for x in want if x[3])
    assert run(spark, rows) == want


def test_odd_rows(spark):
    long_ = "".join(random.Random(1).choice("abcdeft") for _ in range(5000))
    edge = "q" * 64
    rows = [(1, None), (2, ""), (3, "short 123"), (None, "nullidword NULLIDWORD"), (None, "nullidwordx nullidwordx"),
            (4, "twice twice repeated repeated"), (4, "twice twice repeated repeated"),
            (5, f"{long_} {long_} {long_[:-1]} {long_[:-1]} {long_[:70]}z{long_[71:]}"), (6, f"{long_[:70]}z{long_[71:]}"),
            (7, f"{edge} {edge}q {edge}z {edge} {edge}q {edge}z {edge[:-1]} {edge[:-1]}"),
            (8, "÷×÷×÷×÷ ÷×÷×÷×÷ ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ"), (9, "aaaaaaa " * 3 + "aaaaaaaa " * 40 + "aaaaaaaaa " * 400)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {x[0] for x in got if x[2] == 2} >= {long_, edge + "q"}
    assert run(spark, [(1, "few words")]) == []
    assert spelling.spelling_groups(frame(spark, rows).limit(0)).count() == 0


def test_every_split_of_an_edit_shares_one_reporting_tile():
    words = ["abcdefg", "bcdefg", "abcdef", "abdefg", "abccdefg", "abcdefgg", "aabcdefg", "xbcdefg", "abcdefx", "abcxefg"]
    words = [w + "tail" for w in words]
    rows = []
    for w in words:
        keys, places = spelling._tiles([w], len(w))
        rows += [(int(k), int(p), w) for k, p in zip(keys[0], places, strict=True)]
    rows.sort()
    a, b = spelling.near_in_tiles(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows])
    found = sorted(tuple(sorted((rows[i][2], rows[j][2]))) for i, j in zip(a, b, strict=True))
    assert found == sorted(tuple(sorted((v, w))) for k, v in enumerate(words) for w in words[k + 1:] if one_edit(v, w))


@pytest.mark.parametrize("sf", [SF001])
def test_query_against_all_pairs_of_wildcards(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = brute_words(rows)
    holes = {}
    for w in n:
        for k in range(len(w)):
            holes.setdefault(w[:k] + "?" + w[k + 1:], []).append(w)
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            near[w].update(holes[w[:k] + "?" + w[k + 1:]])
            shorter = w[:k] + w[k + 1:]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    got = {x.word: (x.n, x.n_near) for x in queries.op13_spelling(spark, sf).collect()}
    assert got == {w: (n[w], len(near[w] - {w})) for w in n}
