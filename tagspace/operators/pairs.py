"""Labelled text pairs from tags.

For each common tag t:

* positives: up to ``k`` posts containing t, in md5(seed:pos:t:post) order (D1);
  all 2-combinations of that sample, of which ``n_samples`` in md5 order (D3);
* negatives: a fresh positive sample (salt ``pos2``) times up to ``k`` *clean*
  posts — posts sharing no tag with the co-occurrence set of t — of which
  ``n_samples`` in md5 order (D2, D4);
* the dataset is the union with labels 1 / 0 (D5), split 80/20 in md5 order (D6).

Clean negatives are "the first k clean posts in t's circular hash order"
(order by (h(post) - h(t)) mod 2^32, then post_id). They are found without the
T x N anti join (R7): posts are dealt into hash buckets; each open tag scans
its next range of buckets (the range doubles every round), dirty candidates
are removed by joining their tags to the co-occurrence edges, and a tag closes
once k clean posts lie in the part of its order already scanned completely.
A tag that co-occurs with the heaviest tags scans only the posts without them.
The result equals the full anti join followed by a per-tag top k.

Pairs of a tag are formed from one row that holds its two samples: a bound on the
hash, with room to spare, leaves little more than ``n_samples`` of them, and a tag
that it leaves too few takes all its pairs.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspace.functions.hashing import TWO32, hash32, hash_hex
from tagspace.functions.text import tags_of
from tagspace.operators import tags as TG
from tagspace.session import Scratch, cut_lineage

K_POSTS = 100       # posts sampled per side and tag
HEAVY = 62          # commonest tags that a post's bitmap tells
SAMPLE = 1024       # bitmaps that size the first ranges
CELL_BITS, MOST_BITS = 12, 26  # posts that a part of a cell holds, and buckets, as powers of two
GROUP_POSTS = 1 << 14  # posts of a tag that a task sorts at a time
LIST_TAGS = 1024    # tags whose pairs a task forms
N_SAMPLES = 230     # pairs per label and tag (function default; the command line used 320)
SPARE = 10.0        # standard deviations of pairs that the hash bound leaves beyond those asked for


def tagged_posts(posts: DataFrame, text: str = "text") -> DataFrame:
    """(post_id, grp, text, tags) of posts with at least one tag (S2's filter)."""
    return (posts.select("post_id", "grp", text, tags_of(text).alias("tags"))
            .filter(F.size("tags") > 0))


def tag_post(tp: DataFrame) -> DataFrame:
    """Distinct (tag, post_id): the posts containing each tag."""
    return tp.select(F.explode("tags").alias("tag"), "post_id").distinct()


def _sample_lists(tag_posts: DataFrame, common: DataFrame, seed: int, salts: tuple[str, ...],
                  k: int = K_POSTS) -> DataFrame:
    """(tag, *salts): the first k distinct posts of each tag in the md5 order of each salt, as lists.

    (tag, post_id) moves once for all salts. ``common`` may have the tags' mentions as ``n``; the
    posts of a tag of many (at most one in GROUP_POSTS rows of them) are dealt to several groups.
    """
    tp = TG.restrict_to(tag_posts, common)
    sizes = common if "n" in common.columns else tp.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    many = sizes.where(F.col("n") > GROUP_POSTS).select("tag", F.ceil(F.col("n") / GROUP_POSTS).cast("int").alias("groups"))
    part = F.pmod(F.xxhash64("post_id"), F.coalesce("groups", F.lit(1))).cast("int")
    dealt = tp.join(F.broadcast(many), "tag", "left").select("tag", "post_id", part.alias("part"))
    # a struct, so that a post without an id counts as before
    sets = dealt.repartition("tag", "part").groupBy("tag", "part").agg(F.collect_set(F.struct("post_id")).alias("set"))

    def first_of(salt: str):
        order = lambda x: F.unhex(hash_hex(F.lit(seed), F.lit(salt), F.col("tag"), x["post_id"])).alias("o")
        return F.slice(F.sort_array(F.transform("set", lambda x: F.struct(order(x), x["post_id"].alias("post_id")))), 1, k)

    firsts = sets.select("tag", *[first_of(s).alias(s) for s in salts]).groupBy("tag").agg(*[F.flatten(F.collect_list(s)).alias(s) for s in salts])
    return firsts.select("tag", *[F.transform(F.slice(F.sort_array(s), 1, k), lambda x: x["post_id"]).alias(s) for s in salts])


def _ranked(lists: DataFrame, of: str) -> DataFrame:
    """(tag, post_id, rank) of each tag's list."""
    return lists.select("tag", F.posexplode(of).alias("at", "post_id")).select("tag", "post_id", (F.col("at") + 1).alias("rank"))


def positive_sample(tag_posts: DataFrame, common: DataFrame, seed: int, salt: str = "pos",
                    k: int = K_POSTS) -> DataFrame:
    """(tag, post_id, rank) — up to k posts with the tag, md5 order."""
    return _ranked(_sample_lists(tag_posts, common, seed, (salt,), k), salt)


def _first_pairs(held: DataFrame, seed: int, salt: str, n_samples: int, triangle: bool,
                 partitions: int | None = None) -> DataFrame:
    """(tag, ids, first, second): the first ``n_samples`` pairs of each row (tag, a, b) in md5 order, of
    all of ``a`` with all of ``b``, or with ``triangle`` of each element of ``a`` with those after it;
    as places in ``ids``, the posts of both.

    A tag's pairs are formed, bounded and sorted in the task that has its row: no pair is shuffled.
    """
    after = lambda i: F.slice("a", i + 2, F.greatest(F.size("a") - i - 1, F.lit(0)))
    order = lambda x, y: hash_hex(F.lit(seed), F.lit(salt), F.col("tag"), x, y)
    place = (lambda i, j: i + 1 + j) if triangle else (lambda i, j: F.size("a") + j)
    pair = lambda o, i, j: F.struct(F.unhex(o).alias("o"), i.alias("i"), place(i, j).alias("j"))
    sides = ["a"] if triangle else ["a", "b"]
    size = F.size("a").cast("bigint")
    m = F.floor(size * (size - 1) / 2) if triangle else size * F.size("b")
    share = (n_samples + SPARE * math.sqrt(n_samples)) / F.greatest(F.col("m"), F.lit(1))
    edge = F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex((share * TWO32).cast("bigint")), 8, "0")))
    held = held.repartition("tag") if partitions is None else held.repartition(partitions, "tag")  # one row per tag
    held = held.withColumn("m", m).where("m > 0").withColumn("edge", edge)
    left = held.select("tag", "m", "edge", *sides, F.posexplode("a").alias("i", "id1"))
    left = left.select("*", F.posexplode(after(F.col("i")) if triangle else F.col("b")).alias("j", "id2"))
    # the lists themselves stay with one pair, whether it is near or not
    one, near = (F.col("i") == 0) & (F.col("j") == 0), F.col("o") < F.col("edge")
    left = left.withColumn("o", order(F.col("id1"), F.col("id2"))).where(near | one)
    left = left.select("tag", F.when(one, F.struct(*sides, "m")).alias("whole"), F.when(near, pair(F.col("o"), F.col("i"), F.col("j"))).alias("p"))
    near = left.groupBy("tag").agg(F.first("whole", ignorenulls=True).alias("whole"), F.collect_list("p").alias("near"))
    near = near.select("tag", "whole.*", "near")
    if triangle:
        every = F.transform("a", lambda x, i: F.transform(after(i), lambda y, j: pair(order(x, y), i, j)))
    else:
        every = F.transform("a", lambda x, i: F.transform("b", lambda y, j: pair(order(x, y), i, j)))
    enough = F.size("near") >= F.least(F.col("m"), F.lit(n_samples))
    chosen = F.when(enough, F.col("near")).otherwise(F.flatten(every))
    return (near.select("tag", F.concat(*sides).alias("ids"), F.slice(F.sort_array(chosen), 1, n_samples).alias("p"))
            .select("tag", "ids", F.transform("p", lambda p: p["i"]).alias("first"), F.transform("p", lambda p: p["j"]).alias("second")))


def _pair_ids(chosen: DataFrame) -> DataFrame:
    """(tag, id1, id2) of ``_first_pairs``' rows."""
    ids, second = F.col("ids"), F.col("second")
    pairs = F.transform("first", lambda i, n: F.struct(ids[i].alias("id1"), ids[second[n]].alias("id2")))
    return chosen.select("tag", F.inline(pairs))


def _held(sample: DataFrame, out: str) -> DataFrame:
    """(tag, out): the posts of each tag's sample (at most k) in the order of their rank."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "post_id")))
    return sample.groupBy("tag").agg(F.transform(ranked, lambda x: x["post_id"]).alias(out))


def positive_pairs(sample: DataFrame, seed: int, n_samples: int = N_SAMPLES) -> DataFrame:
    """(tag, id1, id2): n_samples 2-combinations of the sample, md5 order.

    id1 precedes id2 in the sample order. At most k(k-1)/2 pairs per tag are formed.
    """
    return _pair_ids(_first_pairs(_held(sample, "a"), seed, "pp", n_samples, True))


def heavy_tags(per_tag: DataFrame, cooc: DataFrame, most: int = HEAVY) -> list[str]:
    """The tags on the most posts (at most ``most``, so a bounded list), by the number of tags
    that co-occur with them: what most tags co-occur with comes first."""
    top = per_tag.orderBy(F.desc("np"), "other").limit(most)
    asked = cooc.join(F.broadcast(top), "other").groupBy("other").agg(F.count(F.lit(1)).alias("asked"))
    rows = top.join(asked, "other", "left").select("other", "np", F.coalesce("asked", F.lit(0)).alias("asked")).collect()
    return [r["other"] for r in sorted(rows, key=lambda r: (-r["asked"], -r["np"], r["other"]))]


def _depths(posts: DataFrame, n: int, heavy: int) -> list[tuple[int, int]]:
    """(depth, posts): numbers of first heavy tags, where the posts that have none of them are at
    most half as many as at the depth before; so all depths together hold at most 2n posts."""
    has = {r["clear"]: r["n"] for r in posts.groupBy("clear").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = [(0, n)]
    for depth in range(1, heavy + 1):
        left = sum(c for clear, c in has.items() if clear >= depth)
        if 2 * left <= out[-1][1] and out[-1][1]:
            out.append((depth, left))
    return out


def _scanned(open_tags: DataFrame, posts: DataFrame, nb: int, depths: list[tuple[int, int]]) -> DataFrame:
    """(tag, ht, post_id, rest, h) of the posts in each tag's range of buckets whose heavy tags
    are none of the tag's co-occurring ones. A range meets at most five cells of a power of two of
    buckets among the posts of its depth, each dealt to parts of bounded size: an equi-join on
    (depth, level, cell, part), with one AND of two bitmaps for each post that is met. Rows that
    leave the join are candidates."""
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("hi") - F.col("lo")) / 4.0))).cast("int")
    wide = cut_lineage(open_tags.withColumn("level", level))
    size = dict(depths)
    used = sorted((r["depth"], r["level"]) for r in wide.select("depth", "level").distinct().collect())  # at most 63 x 32
    # about 2 ** CELL_BITS posts in each part of a cell
    shapes = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(x).alias("level"), F.lit(max(
        1, ((size[d] << x) // nb) >> CELL_BITS)).alias("parts")) for d, x in used]) if used else None
    if not used:
        shapes = F.array().cast("array<struct<depth:int,level:int,parts:int>>")
    parts = F.element_at(F.filter(shapes, lambda s: (s["depth"] == F.col("depth")) & (s["level"] == F.col("level"))), 1)["parts"]
    cells = F.expr(f"greatest(1L, shiftright({nb}L, level))")
    first, last = (F.expr(f"shiftright(b0 + {x}, level)") for x in ("lo", "hi - 1"))
    asks = (wide.withColumn("at", F.explode(F.sequence(first, F.least(last, first + cells - 1))))
            .withColumn("cell", F.pmod("at", cells))
            .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))))
    held = posts.withColumn("s", F.explode(F.filter(shapes, lambda s: s["depth"] <= F.col("clear"))))
    bucket = F.shiftright("h", 32 - (nb.bit_length() - 1)).cast("bigint")
    held = (held.select("post_id", "rest", "mask", "h", "s.depth", "s.level", "s.parts")
            .withColumn("bucket", bucket).withColumn("cell", F.expr("shiftright(bucket, level)")).drop("bucket")
            .withColumn("part", F.pmod(F.xxhash64("post_id"), F.col("parts")).cast("int")).drop("parts"))
    return (asks.join(held, ["depth", "level", "cell", "part"])
            .where((F.col("mask").bitwiseAND(F.col("with")) == 0)
                   & F.pmod(bucket - F.col("b0"), F.lit(nb).cast("bigint")).between(F.col("lo"), F.col("hi") - 1))
            .select("tag", "ht", "post_id", "rest", "h"))


def clean_negatives(tp: DataFrame, common: DataFrame, cooc: DataFrame, seed: int,
                    k: int = K_POSTS, bucket_posts: int = 64,
                    first_buckets: int | None = None) -> DataFrame:
    """(tag, post_id, rank) — the first k clean posts in t's circular order.

    Posts carry a bitmap of the HEAVY commonest tags, and a tag has the bitmap of its co-occurring
    heavy tags: posts whose bitmaps meet are never candidates, and other tags alone are left to
    check. Each tag's first range is sized from its clean share of a sample of bitmaps and from the
    posts of its other co-occurring tags, as if these were spread independently, so most tags close
    in one round with about 2k candidates; a tag whose range held too few clean posts doubles its
    range. Samples and estimates size ranges only.
    ``first_buckets`` fixes the first range instead (tests use it to force rounds).
    """
    lists = _clean_lists(tp, common, cooc, seed, Scratch(tp.sparkSession), k, bucket_posts, first_buckets)
    return _ranked(lists, "b")


def _clean_lists(tp: DataFrame, common: DataFrame, cooc: DataFrame, seed: int, scratch: Scratch,
                 k: int = K_POSTS, bucket_posts: int = 64, first_buckets: int | None = None) -> DataFrame:
    """(tag, b): ``clean_negatives`` as one list per tag, kept in ``scratch``; what finds them is
    written compressed, step by step, and removed."""
    with Scratch(tp.sparkSession) as own:
        return scratch.keep(_found_clean(tp, common, cooc, seed, own, k, bucket_posts, first_buckets))


def _found_clean(tp: DataFrame, common: DataFrame, cooc: DataFrame, seed: int, own: Scratch, k: int,
                 bucket_posts: int, first_buckets: int | None) -> DataFrame:
    n = tp.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n) / bucket_posts))))
    nb, shift = 1 << bits, 32 - bits
    width = 1 << shift
    cooc = own.keep(cooc)  # (tag, other), read for the sizes and in every round
    per_tag = own.keep(tp.select(F.explode(F.array_distinct("tags")).alias("other"))
                          .groupBy("other").agg(F.count(F.lit(1)).alias("np")))
    heavy = heavy_tags(per_tag, cooc)
    bit = lambda at: F.lit(1 << at).cast("bigint")
    numbered = F.create_map(*[x for i, h in enumerate(heavy) for x in (F.lit(h), bit(i))]) if heavy else None
    zero = F.lit(0).cast("bigint")
    mask = F.aggregate("tags", zero, lambda acc, t: acc.bitwiseOR(F.coalesce(numbered[t], zero))) if heavy else zero
    told = F.array(*[F.lit(h) for h in heavy]).cast("array<string>")
    posts = tp.select("post_id", F.array_except("tags", told).alias("rest"), mask.alias("mask"),
                      hash32(F.lit(seed), F.col("post_id")).alias("h"))
    # the number of the first heavy tag that a post has
    lowest = F.col("mask").bitwiseAND(-F.col("mask"))
    clear = F.when(F.col("mask") == 0, len(heavy)).otherwise(F.round(F.log2(lowest.cast("double"))).cast("int"))
    posts = own.keep(posts.withColumn("clear", clear))
    depths = _depths(posts, n, len(heavy))
    # a bounded sample of bitmaps, for the sizes of ranges
    drawn = posts.select("mask", "h", "post_id").orderBy(F.xxhash64(F.lit(seed), "h"), "post_id").limit(SAMPLE).collect()
    held = Counter(r["mask"] for r in drawn)
    number = F.coalesce(numbered[F.col("other")], zero) if heavy else zero
    # share of posts without any of a tag's co-occurring tags that no bitmap tells, as a logarithm
    none = F.log1p(-F.least(F.col("np") / F.lit(float(max(1, n))), F.lit(0.999)))
    others = (cooc.join(per_tag, "other").groupBy("tag")
              .agg(F.sum(number).alias("with"), F.sum(F.when(number == 0, none).otherwise(0.0)).alias("none")))
    tags = common.select("tag", hash32(F.lit(seed), F.col("tag")).alias("ht")).join(others, "tag", "left")
    tags = tags.withColumn("b0", F.shiftright("ht", shift).cast("bigint")).withColumn("with", F.coalesce("with", F.lit(0).cast("bigint")))
    masks = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(c).cast("bigint").alias("c")) for m, c in sorted(held.items())])
    free = F.aggregate(masks, F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(
        x["m"].bitwiseAND(F.col("with")) == 0, x["c"]).otherwise(0)) if held else F.lit(0)
    if first_buckets is None:
        left = F.greatest(free, F.lit(0.25)) * (n / max(1, len(drawn)))
        clean = F.greatest(left * F.exp(F.coalesce("none", F.lit(0.0))), left / 20, F.lit(1.0))
        hi = F.ceil(F.lit(2.0 * k * nb) / clean)
    else:
        hi = F.lit(first_buckets)
    hi = F.least(F.lit(nb).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), hi.cast("bigint")))
    # the deepest depth whose heavy tags all co-occur with the tag
    depth = F.greatest(*[F.when(F.col("with").bitwiseAND(F.lit((1 << d) - 1).cast("bigint")) == (1 << d) - 1, d).otherwise(0)
                         for d, _ in depths], F.lit(0))
    open_tags = cut_lineage(tags.select("tag", "ht", "b0", "with", depth.alias("depth"), F.lit(0).cast("bigint").alias("lo"), hi.alias("hi")))
    edges = cooc.where(~F.col("other").isin(heavy)) if heavy else cooc
    found = None
    while True:
        with Scratch(tp.sparkSession) as of_round:
            cand = of_round.keep(_scanned(open_tags, posts, nb, depths).select(
                "tag", "post_id", F.pmod(F.col("h") - F.col("ht"), F.lit(TWO32)).alias("off"), "rest"))
            # a candidate (as often as its row is there) without any tag that co-occurs with the tag
            dirty = of_round.keep(cand.select("tag", "post_id", F.explode("rest").alias("other")).where(F.col("post_id").isNotNull())
                                  .join(edges, ["tag", "other"], "left_semi").select("tag", "post_id").distinct())
            clean = own.keep(cand.drop("rest").join(dirty, ["tag", "post_id"], "left_anti"))
        found = clean if found is None else found.unionByName(clean)
        # offsets below the end of each tag's scanned range are complete
        limit = (F.col("b0") + F.col("hi")) * F.lit(width) - F.col("ht")
        status = (open_tags.filter(F.col("hi") < nb).join(found, "tag", "left")
                  .groupBy("tag").agg(F.sum(F.when(F.col("off") < limit, 1).otherwise(0))
                                      .alias("_c")))
        still = own.keep(status.filter(F.col("_c") < k).select("tag"))
        if still.isEmpty():  # the usual case: every tag closed in this round
            break
        open_tags = cut_lineage(
            open_tags.join(still, "tag", "left_semi")
            .select("tag", "ht", "b0", "with", "depth", F.col("hi").alias("lo"),
                    F.least(F.col("hi") * 2, F.lit(nb).cast("bigint")).alias("hi")))
    # ranges hold about twice k clean posts of a tag
    firsts = found.groupBy("tag").agg(F.slice(F.sort_array(F.collect_list(F.struct("off", "post_id"))), 1, k).alias("firsts"))
    return firsts.select("tag", F.transform("firsts", lambda x: x["post_id"]).alias("b"))


def negative_pairs(pos2: DataFrame, neg: DataFrame, seed: int,
                   n_samples: int = N_SAMPLES) -> DataFrame:
    """(tag, id1, id2): n_samples of positive × clean negative, md5 order."""
    return _pair_ids(_first_pairs(_held(pos2, "a").join(_held(neg, "b"), "tag"), seed, "np", n_samples, False))


def _pair_lists(posts: DataFrame, num_groups: int, threshold: int, seed: int, n_samples: int, k: int,
                own: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tagged posts, positive pairs, negative pairs), the pairs as ``_first_pairs`` has them.

    The tagged posts are written once without their text (post_id, grp, tags):
    every step reads them, and texts are attached to the posts of the final pairs only.
    """
    tp = own.keep(tagged_posts(posts).drop("text"))
    ments = tp.select("post_id", "grp", F.posexplode("tags").alias("pos", "tag"))
    common = own.keep(TG.common_tags(ments, num_groups, threshold).select("tag", "n"))
    samples = own.keep(_sample_lists(tp.select(F.explode(F.array_distinct("tags")).alias("tag"), "post_id"),
                                     common, seed, ("pos", "pos2"), k))
    neg = _clean_lists(tp.select("post_id", "tags"), common, tag_cooccurrence_of_lists(tp, common), seed, own, k)
    least = int(tp.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    partitions = max(least, math.ceil(common.count() / LIST_TAGS))
    pos = _first_pairs(samples.select("tag", F.col("pos").alias("a")), seed, "pp", n_samples, True, partitions)
    both = samples.select("tag", F.col("pos2").alias("a")).join(neg, "tag")
    return tp, pos, _first_pairs(both, seed, "np", n_samples, False, partitions)


def pair_parts(posts: DataFrame, num_groups: int = 3, threshold: int = 50, seed: int = 42,
               n_samples: int = N_SAMPLES, k: int = K_POSTS):
    """(tagged posts, positive pairs, negative pairs) of the pair generator."""
    tp, pos, neg = _pair_lists(posts, num_groups, threshold, seed, n_samples, k, Scratch(posts.sparkSession))
    return tp, _pair_ids(pos), _pair_ids(neg)


def tag_cooccurrence_of_lists(tp: DataFrame, filter_tags: DataFrame) -> DataFrame:
    """A4 on posts whose tag lists are already extracted: distinct (tag, other)."""
    t = tp.select("tags", F.explode("tags").alias("tag"))
    t = TG.restrict_to(t, filter_tags)
    return t.select("tag", F.explode("tags").alias("other")).distinct()


def _with_text_lists(chosen: DataFrame, posts: DataFrame, text: str = "text") -> DataFrame:
    """Attach the texts of each row's posts, from the post table by post_id, as lists beside ``ids``:
    none for a post that the table lacks, several for one that it has several times.

    A text moves once per tag whose pairs it is in, not once per pair.
    """
    t = posts.select("post_id", F.struct(F.col(text).alias("text")).alias("t"))
    got = (chosen.select("tag", "label", F.posexplode("ids").alias("at", "post_id")).join(t, "post_id", "left")
           .groupBy("tag", "label").agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("got")))
    none = F.array().cast("array<string>")
    single = F.transform("got", lambda x: F.when(x["t"].isNotNull(), F.array(x["t"]["text"])).otherwise(none))
    several = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.transform(
        F.filter("got", lambda x: (x["at"] == i) & x["t"].isNotNull()), lambda x: x["t"]["text"]))
    texts = F.when(F.size("got") == F.size("ids"), single).otherwise(several)
    return chosen.join(got, ["tag", "label"]).select("tag", "label", "ids", "first", "second", texts.alias("texts"))


def _pair_rows(lists: DataFrame) -> DataFrame:
    """(tag, id1, id2, sent1, sent2, label): the pairs of ``_with_text_lists``' rows, formed as they are read."""
    ids, texts, second = F.col("ids"), F.col("texts"), F.col("second")
    pair = lambda i, j: F.flatten(F.transform(texts[i], lambda x: F.transform(texts[j], lambda y: F.struct(
        ids[i].alias("id1"), ids[j].alias("id2"), x.alias("sent1"), y.alias("sent2")))))
    pairs = F.flatten(F.transform("first", lambda i, n: pair(i, second[n])))
    return lists.select("tag", "label", F.inline(pairs)).select("tag", "id1", "id2", "sent1", "sent2", "label")


def pair_dataset(posts: DataFrame, num_groups: int = 3, threshold: int = 50, seed: int = 42,
                 n_samples: int = N_SAMPLES, k: int = K_POSTS, scratch: Scratch | None = None) -> DataFrame:
    """(tag, id1, id2, sent1, sent2, label); written once, as lists per tag, to ``scratch``, which
    the caller may clear when the pairs have been read."""
    spark = posts.sparkSession
    scratch = Scratch(spark) if scratch is None else scratch
    with Scratch(spark) as own:
        _, pos, neg = _pair_lists(posts, num_groups, threshold, seed, n_samples, k, own)
        chosen = own.keep(pos.withColumn("label", F.lit(1))).unionByName(own.keep(neg.withColumn("label", F.lit(0))))
        return _pair_rows(scratch.keep(_with_text_lists(chosen, posts)))


def split_dataset(pairs: DataFrame, seed: int = 42, train_share: float = 0.8,
                  prefix_bits: int = 16) -> DataFrame:
    """Adds ``split`` ('train' for the first floor(share·n) rows in md5 order).

    Exact without a window: histograms of 16 more bits of the hash at a time (at most 65,536
    counts each) find the hash at the boundary. The hashes are formed as the pairs are read, none is written.
    """
    order = hash_hex(F.lit(seed), F.lit("split"), F.col("tag"), F.col("id1"), F.col("id2"),
                     F.col("label"))
    ids = pairs.select(order.alias("_o"))
    need, digits, prefix = None, prefix_bits // 4, ""
    while True:  # the last training row's hash, 16 bits further in each round
        group = ids.filter(F.col("_o").startswith(prefix)) if prefix else ids
        hist = sorted((r["p"], r["count"]) for r in group.groupBy(
            F.substring("_o", 1, len(prefix) + digits).alias("p")).count().collect())
        if need is None:
            need = int(math.floor(train_share * sum(c for _, c in hist)))
        at = 0
        while at < len(hist) and hist[at][1] <= need:
            need -= hist[at][1]
            at += 1
        if at == len(hist) or need == 0 or len(hist[at][0]) >= 32:
            break
        prefix = hist[at][0]
    # rows whose hash begins before ``edge`` train; equal hashes are equal pairs and stay together
    edge = hist[at][0] if at < len(hist) else "g"
    return pairs.withColumn("split", F.when(order < F.lit(edge), "train").otherwise("val"))
