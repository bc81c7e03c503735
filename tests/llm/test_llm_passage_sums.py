"""Sums of the passages' latent vectors: equal to the plain ones, without a row per occurrence."""

import tracemalloc

import numpy as np

from tagspace.llm import decontaminate


def test_sums_without_a_row_per_occurrence():
    rng = np.random.default_rng(3)
    size = np.concatenate([[1, 32, 1], rng.integers(1, 33, 6000)])
    edge = np.cumsum(size) - size
    term, w = rng.integers(0, 500, size.sum()), rng.random(size.sum(), np.float32)
    thin = rng.standard_normal((500, 96)).astype(np.float32)
    tracemalloc.start()
    got = decontaminate._sums(thin, term, w, edge)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.add.reduceat(thin[term] * w[:, None], edge, axis=0)
    assert got.dtype == want.dtype and np.allclose(got, want, atol=1e-4)
    assert peak < len(term) * thin.shape[1] * 4 / 3
    assert decontaminate._sums(thin, term[:0], w[:0], edge[:0]).shape == (0, 96)
