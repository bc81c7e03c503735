"""Mixing sources to target weights, in DataFrame operations only.

Every source is a stream of words, packed into blocks of ``block`` words. Sources get target
sizes by weight; a target above ``most`` times its source is cut there and the excess is shared
again. A source's slots are numbered; each slot draws an output shard, so the counts of a
source over the shards are multinomial while the totals stay at the targets. A slot's
number goes through a pseudorandom permutation of the source's block indices (swap-or-not,
another one for each pass over the source), and slots meet blocks in a join on the index.

The last block of a source is short and is last in every pass; the last slot of a source takes
as many words as its target still lacks. So each source gives its target, rounded to words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, written

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words, and the most passes over a source.
SHARE, MOST = 1.5, 2
BLOCK, SHARD_SLOTS, ROUNDS, SEED = 256, 4096, 24, 17
#: Rows of a source that one running sum handles, slots that one row unfolds into, slots of a task.
BUCKET_ROWS, SLOT_RUN, TASK_SLOTS = 1024, 4096, 65536


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row; a null text has size 0."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    return docs.select(F.col("doc_id"), F.col("source"), size.cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: int = MOST) -> DataFrame:
    """(source, sno, source_size, target): sources by code point, null last, numbered from 0.

    The level at which weights are served is found in closed form: sources in order of
    capacity per weight, those below the level capped. One row per source; a source table is
    a catalogue, small beside the documents, so its order is a single window.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.select("source", "source_size", (F.row_number().over(order) - 1).alias("sno"))
    per = per.select("*", kinds[F.pmod("sno", F.lit(len(weights)))].alias("w"),
                     (F.col("source_size") * F.lit(most)).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sno")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    per = per.select("*", level.alias("at"))
    # it rises up to the first source, in this order, that is not capped, and falls after it
    top = F.max("at").over(everything)
    return per.select("source", "sno", "source_size",
                      F.least(F.col("cap").cast("double"), top * F.col("w")).alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Pseudorandom permutation of 0..n-1 (swap-or-not): each round pairs index x with
    (k - x) mod n and swaps the pair or not by a hash of the larger one."""
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        flip = F.xxhash64(key, r, F.greatest(x, other), F.lit(1)) % 2 == 0
        return F.when(flip, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, step)


def placed(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows of positive size with ``start``, their first word's place in their source's
    stream. The order is that of a hash of doc_id; sums run over coarse hash ranges, over the
    ranges inside one, and over the rows of a range, so that no window holds a whole source."""
    n = sizes.count()
    bits = max(0, (n // BUCKET_ROWS).bit_length())
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    bucket = F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")
    same = F.col("sizes.source").eqNullSafe(F.col("sources.source"))
    rows = (sizes.where(F.col("size") > 0).alias("sizes").join(small(sources).alias("sources"), same)
            .select("doc_id", "sno", "size", h.alias("h"), bucket.alias("bucket")))
    sums = (rows.groupBy("sno", "bucket").agg(F.sum("size").alias("words"))
            .withColumn("upper", F.shiftrightunsigned("bucket", bits // 2)))

    def before(words: str, *key: str, order: str) -> Column:
        frame = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(words).over(frame), F.lit(0))

    uppers = (sums.groupBy("sno", "upper").agg(F.sum("words").alias("words"))
              .select("sno", "upper", before("words", "sno", order="upper").alias("low")))
    base = (sums.withColumn("base", before("words", "sno", "upper", order="bucket"))
            .join(uppers, ["sno", "upper"]).select("sno", "bucket", (F.col("base") + F.col("low")).alias("base")))
    inside = (Window.partitionBy("sno", "bucket").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(base, ["sno", "bucket"])
            .select("doc_id", "sno", "size",
                    (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start")))


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks' contents: (sno, block, offset, words, doc_id, start) per document piece;
    ``offset`` is the piece's first word in the block."""
    first = F.floor(F.col("start") / block)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = rows.select("*", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("sno", "block", (low - F.col("block") * block).alias("offset"),
                       (high - low).alias("words"), "doc_id", "start")


def drawn_slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS,
                seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """The mix: (sno, slot, shard, block, take). ``take``: words of the block that it uses."""
    words = F.round("target").cast("long")
    plan = sources.where(F.col("source_size") > 0).select(
        "sno", "source_size", words.alias("goal"),
        F.floor(words / F.col("source_size")).alias("passes"),
        F.ceil(F.col("source_size") / block).alias("blocks"))
    left = F.col("goal") - F.col("passes") * F.col("source_size")
    plan = plan.select("*", (F.col("passes") * F.col("blocks") + F.ceil(left / block)).alias("slots"))
    shards = F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots)
    plan = written(plan.select("*", shards.alias("shards")), "plan").where(F.col("slots") > 0)
    runs = plan.select("*", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_RUN))).alias("run"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    runs = runs.repartition(min(20_000, total // TASK_SLOTS + 1), F.col("sno"), F.col("run"))
    slots = runs.select("*", F.explode(F.sequence(
        F.col("run") * SLOT_RUN, F.least(F.col("slots"), (F.col("run") + 1) * SLOT_RUN) - 1)).alias("slot"))
    turn, index = F.floor(F.col("slot") / F.col("blocks")), F.pmod("slot", F.col("blocks"))
    full = F.col("blocks") - 1  # all but the short one, which is last in every pass
    key = F.xxhash64(F.lit(seed), F.col("sno"), turn)
    to = F.when(index == full, full).otherwise(
        permuted(index, F.greatest(full, F.lit(1).cast("long")), key, rounds))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("to") * block)
    lacks = F.col("goal") - F.col("turn") * F.col("source_size") - F.col("index") * block
    return (slots.select("*", turn.alias("turn"), index.alias("index"), to.alias("to"))
            .select("sno", "slot",
                    F.pmod(F.xxhash64(F.lit(seed + 1), F.col("sno"), F.col("slot")),
                           F.col("shards")).alias("shard"),
                    F.col("to").alias("block"), F.least(length, lacks).alias("take")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST,
                block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes with their sources' targets, block contents, and the mix's slots.

    The mixed corpus is the join of slots and pieces on (sno, block): shard by shard, slot by
    slot, the words ``offset``.. of a piece below ``take``. Defined cases: null texts and
    texts without words have size 0 and no piece; a null source is a source of its own, the
    last; repeated rows are rows of their own; no rows give empty tables; other columns are
    not read. Sources are counted over all rows.
    """
    sizes = written(word_counts(docs), "sizes")
    sources = written(source_targets(sizes, weights, share, most), "sources")
    rows = written(placed(sizes, sources, seed), "placed")
    slots = written(drawn_slots(sources, block, seed=seed), "slots")  # joins go by its true size
    return (sizes, sources, rows), packed(rows, block), slots


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken, source. ``taken`` counts the
    words of the row that the mix holds, repeats counted."""
    (sizes, sources, rows), pieces, slots = mix_sources(docs, **options)
    uses = pieces.join(slots.select("sno", "block", "take"), ["sno", "block"])
    used = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("take") - F.col("offset")))
    taken = uses.groupBy("sno", "start").agg(F.sum(used).alias("taken"))
    per = small(sources)
    some = (rows.join(taken, ["sno", "start"], "left").join(per, "sno")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"))
    none = (sizes.where(F.col("size") == 0).alias("d")
            .join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("doc_id", "size", "source_size", "target",
                    F.lit(0).cast("long").alias("taken"), "s.source"))
    return some.unionByName(none)
