"""Vector codes against plain integer k-means, exact at every step."""

import hashlib
import math
import random

import numpy as np
import pytest

from tagspace.llm import vector_codes

ROWS = "vec_id long, embedding array<double>, label int, vector string, code string, error long, slot int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", "y", 1, 2, 3) for i, v, la in rows], ROWS)


def brute(rows):
    kept = [(i, [math.floor(x * 1024) if abs(x) < 2 ** 53 else int(x) * 1024 for x in v], la) for i, v, la in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(4)]
    begin = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[cut(v)[p] for _, v, _ in begin] for p in range(4)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))

    def near(x, book):
        return min((far(x, c), e) for e, c in enumerate(book))

    for _ in range(4):
        for p in range(4):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c
                        for e, c in enumerate(books[p])]
    out = []
    for i, v, la in kept:
        found = [near(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), la))
    text = ",".join(str(x) for b in books for c in b for x in c)
    sums = {}
    for _, _, e, la in out:
        sums[la] = sums.get(la, 0) + e
    return sorted(((i, c, e, sums[la], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, la in out), key=str)


def test_sequency_counts_sign_changes():
    for size in (1, 2, 8, 32):
        rows = vector_codes.transform(np.eye(size, dtype=np.int64)).T
        assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(size))


@pytest.mark.parametrize("width", [1, 3, 4, 7, 16])
def test_nearest_against_all_entries(width):
    r = np.random.default_rng(width)
    for spread in (2, 50, 1 << 20):
        parts, book = r.integers(-spread, spread, (700, width)), r.integers(-spread, spread, (90, width))
        book[40:50] = book[:10]  # equal entries: the lower index counts
        far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        for kind in (np.int64, object):
            index, least = vector_codes.nearest(parts[:60 if kind is object else None].astype(kind), book.astype(kind))
            assert (index == far.argmin(axis=1)[:len(index)]).all()
            assert (least == far.min(axis=1)[:len(index)]).all()


def test_codes_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(12)], i % 3 if i % 5 else None) for i in range(300)]
    rows += [(400, None, 1), (401, [0.1] * 11 + [None], 1), (402, [0.1] * 11 + [math.nan], 1),
             (403, [math.inf] + [0.1] * 11, 1), (404, [0.25] * 12, None), (404, [0.25] * 12, None),
             (None, [-0.25] * 12, 2), (405, [-1e-9] * 12, 7)]
    got = [(x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256)
           for x in vector_codes.compressed(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_few_large_and_empty_vectors(spark):
    rows = [(1, [3e7, -1e15, 2.5, 0.0], 1), (2, [3e7 + 1, -1e15, 2.5, 0.0], 1), (3, [-9e8, 1e12, 0.1, 4.0], None)]
    got = [(x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256)
           for x in vector_codes.compressed(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    empty = vector_codes.compressed(frame(spark, [(1, [], 1), (2, [], None)])).collect()
    assert {(x.vec_id, x.code, x.error, x.label_error) for x in empty} == {(1, "00000000", 0, 0), (2, "00000000", 0, 0)}
    assert vector_codes.compressed(frame(spark, [(1, [1.0] * 4, 1)]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compressed(frame(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]))


def test_errors_beyond_a_long_are_null(spark):
    rows = [(i, [1e17 * i, 0.0, 0.0, 0.0], 1) for i in range(300)] + [(300, [1e30, 0.0, 0.0, 0.0], 1)]
    got = {x.vec_id: x for x in vector_codes.compressed(frame(spark, rows)).collect()}
    assert len(got) == 301 and any(x.error is None for x in got.values())
    assert all(x.label_error is None for x in got.values())
