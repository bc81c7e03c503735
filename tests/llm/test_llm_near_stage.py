"""The pipeline's near-dedup stage against all pairs at 80 percent."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def all_pairs(rows, percent):
    """The ids that all pairs from ``percent`` on leave: of each group the smallest."""
    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    return {i for i in low if low[i] == i}


def test_near_stage_against_all_pairs(spark):
    rows = []
    for g in range(30):
        r = random.Random(g)
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 6):  # c changed words: 0.95, 0.90, 0.86, 0.81 and 0.77 of the base
            w = list(base)
            for k in range(c):
                w[20 + 25 * k] = f"v{g}"
            if c > 2 or g % 2:
                rows.append((10 * g + c, " ".join(w)))
        if g % 3 == 0:  # nothing between the base and the band from 0.80 to 0.85
            rows = [x for x in rows if x[0] // 10 != g or x[0] % 10 in (0, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id for x in corpus_pipeline.remove_near_copies(spark, docs, SF).collect()}
    assert got == all_pairs(rows, 80) != all_pairs(rows, 85)
