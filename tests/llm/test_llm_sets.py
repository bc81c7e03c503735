"""Exact dedup, near dedup, repeats and mixing against brute force, with odd rows."""

import hashlib
import random
import re

import pandas as pd
import pytest

from tagspace.llm import exact_dedup, mixing, near_dedup, queries, repeats

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def frame(spark, rows, extra=""):
    """documents rows of (doc_id, text[, source]) with columns whose names the operators use inside."""
    rows = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 1, "x", 2, 3) for r in rows]
    return spark.createDataFrame(rows, DOCS + ", key long, gram string, size long, label long")


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


def test_exact_groups_odd_rows(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "b"), (None, "c"), (5, "b"), (9, "x" * 200_000)]
    got = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in
                  exact_dedup.exact_groups(frame(spark, rows)).collect()))
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 3, True),
                          (5, 5, 3, True), (0, 5, 3, False), (0, 0, 1, True), (9, 9, 1, True)])
    assert exact_dedup.exact_groups(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_exact_heavy_and_light_paths_agree(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(900)]
    whole = [tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows), support=0.5).orderBy("doc_id").collect()]
    split = [tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows), support=0.01).orderBy("doc_id").collect()]
    assert whole == split
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    for (i, t), r in zip(rows, whole, strict=True):
        assert r == (i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    left = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert {r.doc_id for r in left.collect()} == {max(g) for g in groups.values()}


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 0.85 * max(len(x), len(y)) <= min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    low[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_groups_against_all_pairs(spark):
    rows, r = [], random.Random(5)
    for g in range(12):
        base = words(60 + 40 * g, g)
        for c in range(6):
            w = list(base)
            for _ in range(c):
                w[r.randrange(len(w))] = f"v{r.randrange(10 ** 6)}"
            rows.append((100 * g + c, " ".join(w)))
        if g % 3 == 0:  # a chain: each a link of its neighbours only
            w = list(base)
            for c in range(8):
                at = c * len(w) // 9
                w[at:at + 1 + len(w) // 70] = [f"u{g}{c}"] * (1 + len(w) // 70)
                rows.append((100 * g + 20 + c, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One two"), (5004, "one  TWO"), (5005, "a b c d e"),
             (5006, "Ä b c d e"), (5007, "ä b c d e"), (5008, "z " * 30_000), (5009, "z " * 9)]
    want = brute_components([x for x in rows if x[0] != 5008] + [(5008, "z " * 9)])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert got == want
    assert got[5000] == (0, 5000) and got[5004] == (1, 5003) and got[5009] == (1, 5008)


def test_near_groups_null_and_repeated_ids_and_no_rows(spark):
    text = " ".join(words(50, 1))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, None), (8, text + " x"), (8, "something else")]
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in near_dedup.near_groups(frame(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 0, True), (3, 3, True), (7, 3, False), (7, 3, False),
                   (8, 3, False), (8, 3, False)]
    assert near_dedup.near_groups(frame(spark, rows).limit(0)).count() == 0


def test_near_registers_estimate(spark):
    import numpy as np
    a = near_dedup.compress(np.array([1 << 63, (1 << 63) - 1, 1, 0, 1 << 40], np.uint64))
    assert a[0] >> 10 == 0 and a[1] >> 10 == 1 and a[4] >> 10 == 23
    assert abs(near_dedup.estimated(np.array([1.0]), np.array([50]), np.array([50]))[0] - 1) < 1e-9


def test_near_across_finds_links_between_small_components(spark):
    """The third step, alone: links of different components of a bucket, whatever the tiles."""
    from pyspark.sql import functions as F
    rows = [(i, " ".join(words(80, i // 2)) + (" tail" * (i % 2))) for i in range(40)]
    sketched, sets = near_dedup.sketches(frame(spark, rows)).cache(), near_dedup.shingle_sets(frame(spark, rows))
    label = F.when(F.col("doc_id") < 10, 0).otherwise(F.col("doc_id")).alias("label")
    active = sketched.select("doc_id", label, F.explode("bands").alias("key"))
    for size in ({"block": 1}, {"block": 7}, {}, {"shingles": 200}):
        got = {(r.a, r.b) for r in near_dedup._across(active, sketched, sets, 85, **size).collect()}
        assert {tuple(sorted(p)) for p in got} == {(i, i + 1) for i in range(10, 40, 2)}


def test_common_shingles_against_sets(monkeypatch):
    import numpy as np
    monkeypatch.setattr(near_dedup, "COLUMNS", 16)
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 300, r.integers(0, 200)).astype(np.uint64)) for _ in range(30)]
    left, right = np.array([3, 0, 29, 7]), np.arange(30)
    want = [[len(set(sets[a].tolist()) & set(sets[b].tolist())) for b in right] for a in left]
    assert near_dedup.common_shingles(sets, left, right).tolist() == want


@pytest.mark.parametrize("percent", [80, 85])
def test_large_group_of_near_copies_against_all_pairs(spark, percent, monkeypatch):
    """Copies about as far from one another as the threshold: most are in no large component."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    base = words(150, 5)
    rows = []
    for i in range(220):
        r = random.Random(i)
        rows.append((i, " ".join(w if r.random() > 0.02 else f"x{r.randrange(10 ** 6)}" for w in base)))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    want = {i: root(i) for i in sets}
    assert 5 < len(set(want.values())) < 215
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(frame(spark, rows), percent).collect()}
    assert got == want


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k:k + n] in seen:
                gone[k:k + n] = b"\1" * n
            seen.add(b[k:k + n])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [2000, 3])
def test_repeats_against_all_windows(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)  # 3: hot anchor grams are compared one by one
    r = random.Random(2)
    shared = [" ".join(words(40, 900 + k)) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(words(r.randrange(5, 60), i))]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            parts.insert(r.randrange(len(parts) + 1), s[a:a + r.randrange(80, 200)])
        rows.append((i, r.choice([" ", "\n", "ß", ""]).join(parts)))
    rows += [(100, None), (101, ""), (102, "ab" * 300), (103, "a" * 5000), (104, rows[3][1]), (105, "ü" * 120),
             (106, "x" * 99), (107, "x" * 99), (108, shared[0] + "Q" + shared[0])]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)
           for x in repeats.without_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_null_and_repeated_ids(spark):
    t = " ".join(words(60, 3))
    rows = [(2, t), (2, t), (1, "short"), (None, t + "!")]
    got = sorted((x.doc_id or 9, x.n_removed > 0) for x in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == [(1, False), (2, False), (2, True), (9, True)]
    assert repeats.without_repeats(frame(spark, rows).limit(0)).count() == 0


def test_suffix_order_sorts_and_extends():
    import numpy as np
    texts = [b"banana", b"ban", b"", b"bandana", b"ban", b"zz", b"a\x00", b"a"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    order, ext = repeats.suffix_order(raw, start, size, np.zeros(len(texts), np.int64))
    assert [texts[k] for k in order] == sorted(texts)
    for k in range(1, len(texts)):
        a, b = texts[order[k - 1]], texts[order[k]]
        assert ext[k] == max(i for i in range(min(len(a), len(b)) + 1) if a[:i] == b[:i])


def filled(sizes, weights, total, most):
    """Targets by giving out and giving again, as the contract says it."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), total
    while left > 1e-9 and open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if target[s] + level * weights[s] >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] += level * weights[s]
            break
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over
        for s in open_:
            target[s] = 0.0
        left = total - sum(target[s] for s in sizes if s not in open_)
    return target


def test_mix_targets_and_bounds(spark):
    r = random.Random(8)
    rows = [(i, " ".join(words(r.choice([0, 1, 3, 40, 700]), i)), r.choice(["b", "a", "ä", "Z", None, "z"]))
            for i in range(400)]
    rows += [(1000, None, "empty"), (1001, "  ", "empty"), (1002, "one", "tiny"), (None, "two words", "a")]
    got = mixing.mixed_documents(frame(spark, rows)).toPandas()
    again = mixing.mixed_documents(frame(spark, rows).repartition(5)).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    assert got.sort_values(order)[order].fillna(-1).values.tolist() == again.sort_values(order)[order].fillna(-1).values.tolist()
    sizes, weights = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        weights[s] = (5, 2, 1)[k % 3]
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert len(got) == len(rows)
    for s, part in got.assign(source=got.source.where(got.source.notna(), None)).groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert part.source_size.iloc[0] == sizes[s] and abs(part.target.iloc[0] - want[s]) < 1e-6
        assert abs(part.taken.sum() - want[s]) <= 0.5
    assert (got.taken <= 2 * got["size"]).all()
    assert mixing.mixed_documents(frame(spark, rows).limit(0)).count() == 0


def test_mix_slots_are_a_permutation_and_blocks_are_full(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        assert sorted(r.p for r in got.collect()) == list(range(n))
    rows = [(i, " ".join(words(50 + i % 90, i)), f"s{i % 3}") for i in range(200)]
    (_, sources, _), pieces, slots = mixing.mix_sources(frame(spark, rows), block=64)
    p, s, src = pieces.toPandas(), slots.toPandas(), sources.toPandas().set_index("sno")
    fill = p.groupby(["sno", "block"]).words.sum()
    for sno, part in fill.groupby(level=0):
        assert (part.iloc[:-1] == 64).all() and part.sum() == src.source_size[sno]
    assert s.groupby(["sno", "block"]).size().max() <= 2
    whole = s.merge(fill.rename("words").reset_index(), on=["sno", "block"])
    assert (whole["take"] <= whole.words).all()
    assert s.shard.between(0, -(-len(s) // mixing.SHARD_SLOTS) - 1).all()


def test_registered_exact_and_repeats_on_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").toPandas()
    rows = [(int(i), t) for i, t in docs.sort_values("doc_id").itertuples(index=False)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)
           for x in queries.QUERIES["op9_repeats"](spark, SF01).collect()}
    assert got == brute_repeats(rows)
