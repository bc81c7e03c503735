"""Connected components: what the loop returns and how many steps it takes."""

import random

from tagspace.llm import components


def found(spark, monkeypatch, edges):
    steps, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: steps.append(name) or write(df, name))
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    monkeypatch.undo()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.component for r in got}, steps.count("stars")


def reached(edges):
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in low:
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    return low


def test_stars_take_no_step(spark, monkeypatch):
    edges = [(1, 2), (3, 1), (1, 4), (1, 4), (7, 6), (9, 9), (None, 5), (5, None)]
    assert found(spark, monkeypatch, edges) == ({1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}, 0)
    assert found(spark, monkeypatch, []) == ({}, 0)


def test_other_shapes_take_few_steps(spark, monkeypatch):
    around_largest = [(10, 50), (50, 20), (30, 50), (40, 50)]
    got, steps = found(spark, monkeypatch, around_largest)
    assert got == reached(around_largest) and steps == 1
    rng = random.Random(5)
    names = rng.sample(range(10_000), 64)
    path = [tuple(rng.sample(p, 2)) for p in zip(names, names[1:], strict=False)]
    some = [(20_000 + rng.randrange(60), 20_000 + rng.randrange(60)) for _ in range(45)]
    got, steps = found(spark, monkeypatch, path + some)
    assert got == reached(path + some) and steps <= 8
