"""Units of one anchor gram that agree in 32 bits of their hash, but not in their bytes."""

import numpy as np
import pytest

from tagspace.llm import repeats


def colliding():
    """Two texts of one window each, around the same anchor gram, with equal upper unit bits."""
    r = np.random.Generator(np.random.PCG64(4))
    phrases = r.integers(97, 123, (200_000, repeats.GRAM), dtype=np.uint8)
    h, inv = repeats.prefix_hashes(phrases.reshape(-1))
    at = np.arange(len(phrases)) * repeats.GRAM
    least = repeats.mix((h[at + repeats.GRAM] - h[at]) * inv[at]).argmin()
    texts = r.integers(97, 123, (400_000, repeats.LENGTH), dtype=np.uint8)
    texts[:, 34:34 + repeats.GRAM] = phrases[least]
    seen = {}
    for a in range(0, len(texts), 20_000):
        part = texts[a:a + 20_000]
        row, gram, unit, _, off, _ = repeats.find_units(part.reshape(-1), np.arange(len(part) + 1) * repeats.LENGTH)
        own = np.flatnonzero(off == 34)
        for k, key in zip(row[own].tolist(), (unit[own] >> np.uint64(32)).tolist(), strict=True):
            if key in seen:
                return texts[seen[key]].tobytes().decode(), part[k].tobytes().decode()
            seen[key] = a + k
    raise AssertionError("no two of them collide")


@pytest.mark.parametrize("parts", [1, 2])
def test_units_that_share_32_bits_lose_nothing(spark, parts):
    x, y = colliding()
    assert x != y
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string").repartitionByRange(parts, "doc_id")
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(docs).collect()}
    assert got == {1: 0, 2: 0}
