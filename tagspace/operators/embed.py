"""Text embeddings.

* ``word_average`` (E2): mean of unit word vectors, as a join of the words of blocks of
  posts with a word-vector table (no per-row model call). Words missing from the table are
  skipped.
* ``hash_embed`` (built-in encoder): signed feature hashing of whitespace tokens
  into ``dim`` md5 buckets, L2-normalised — pure Spark expressions.
* ``encode_batches`` (E1/E3/E4): any encoder ``encode(list[str]) -> ndarray``
  applied with ``mapInPandas`` in Arrow batches of ``batch_size`` texts; the
  encoder is built once per task by a factory.
* ``encoder_for`` (E5): registry by name; ``legacy_dispatch`` applies the name
  rule (``fasttext`` → word average, else ``bert`` → batched, else sentence).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspace.functions.hashing import hash32
from tagspace.functions.text import flatten_newlines
from tagspace.functions.vectors import of_length
from tagspace.operators.distance import unit_embeddings

# whitespace as Java, RE2 and Python all read it (vertical tab included)
TOKEN_PATTERN = r"[^ \t\n\x0B\f\r]+"
ENCODE_BATCH = 64
#: Posts of a block of ``word_average``, and tokens whose vectors it holds at a time.
BLOCK_POSTS, BLOCK_TOKENS = 16384, 32768
#: Fewer posts make smaller blocks: so many of them, of at least so many posts, keep tasks busy.
LEAST_BLOCKS, LEAST_POSTS = 16, 1024
# names of the built-in encoder: hash-32 hashes into 32 dimensions
HASH_MODEL = r"hash[-/_](\d+)"


def tokens(text: str = "text") -> F.Column:
    """Whitespace tokens of the whole text (line breaks count as spaces)."""
    return F.regexp_extract_all(flatten_newlines(text), F.lit(TOKEN_PATTERN), 0)


def word_average(posts: DataFrame, words: DataFrame, text: str = "text",
                 dim: int | None = None) -> DataFrame:
    """(post_id, n_tokens, embedding): mean of the unit vectors of the known tokens.

    ``words`` is a table (word, vector) with one row per word; tokens that it lacks are
    skipped. Every post has a row: one without known tokens has n_tokens 0 and the zero
    vector (``dim`` long; without ``dim`` an empty one).

    Posts are dealt by their id into blocks of about ``BLOCK_POSTS``. A block gets the vector of
    each of its words once, as stored, and sums there: no vector moves per post and word.
    """
    n = posts.count()
    blocks = max(1, math.ceil(n / BLOCK_POSTS), min(LEAST_BLOCKS, math.ceil(n / LEAST_POSTS)))
    dealt = posts.select(F.pmod(F.xxhash64("post_id"), F.lit(blocks)).cast("int").alias("block"), "post_id",
                         F.col(text).alias("text")).repartition(blocks, "block")
    # posts without an id count no tokens
    needed = (dealt.select("block", "post_id", F.explode(tokens("text")).alias("word"))
              .groupBy("block", "word").agg(F.count("post_id").alias("n")).where("n > 0"))
    vectors = words.select("word", F.col("vector") if dim is None else of_length("vector", dim).alias("vector"))
    sent = needed.join(vectors, "word").select(F.col("block").alias("to"), "word", "vector").repartition(blocks, "to")
    kind = posts.schema["post_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_means(left, right, dim)

    return (dealt.select("block", "post_id", tokens("text").alias("tokens")).groupBy("block")
            .cogroup(sent.groupBy("to"))
            .applyInArrow(run, f"post_id {kind}, n_tokens bigint, embedding array<double>"))


def _block_means(posts: pa.Table, words: pa.Table, dim: int | None) -> pa.Table:
    """Means of a block's posts (post_id, tokens) by its words (word, vector)."""
    column = words["vector"].combine_chunks()
    length = pc.list_value_length(column)
    if len(words) and (column.null_count or pc.min(length) != pc.max(length)):
        raise ValueError("the word vectors have not all one length")
    wide = (dim or 0) if not len(words) else length[0].as_py()
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(words), wide)
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    norm[norm == 0] = 1.0
    words = words["word"].combine_chunks().dictionary_encode()
    known, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    times = np.bincount(codes, minlength=len(known))
    if len(known) < len(codes):  # a word of several rows counts with each
        unit = np.zeros((len(known), wide))
        np.add.at(unit, codes, vectors / norm[:, None])
        vectors, norm = unit, np.ones(len(known))
    ids = posts["post_id"].combine_chunks().dictionary_encode()
    of = ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False)
    n, sums = np.zeros(len(ids.dictionary) + 1, np.int64), np.zeros((len(ids.dictionary) + 1, wide))
    at = 0
    for chunk in posts["tokens"].chunks:
        sizes = pc.list_value_length(chunk).fill_null(0).to_numpy(zero_copy_only=False)
        found = pc.index_in(chunk.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.repeat(of[at:at + len(chunk)], sizes)[found >= 0]
        at, found = at + len(chunk), found[found >= 0]
        n += np.bincount(rows, times[found], len(n)).astype(np.int64)
        for i in range(0, len(found), BLOCK_TOKENS):
            r, w = rows[i:i + BLOCK_TOKENS], found[i:i + BLOCK_TOKENS]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            np.add.at(sums, r[first], np.add.reduceat(vectors[w].astype(np.float64) / norm[w, None], first))
    n[-1], sums[-1] = 0, 0.0  # posts without an id
    means = (sums / np.maximum(n, 1)[:, None])[of]
    sizes = np.where((n[of] > 0) | (dim is not None), wide, 0)
    return pa.table({"post_id": posts["post_id"], "n_tokens": pa.array(n[of], pa.int64()), "embedding": pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(means[sizes > 0].ravel(), pa.float64()))})


def hash_embed(posts: DataFrame, dim: int = 32, text: str = "text") -> DataFrame:
    """Signed feature hashing: (post_id, n_tokens, embedding array<double>[dim]), one row
    per post; a post without tokens has the zero vector."""
    # a post without tokens keeps a row, whose token is null and counts for nothing
    toks = posts.select("post_id", F.explode_outer(tokens(text)).alias("tok"))
    h = hash32(F.col("tok"))
    some = F.col("tok").isNotNull()
    toks = toks.select("post_id", F.when(some, F.pmod(h, F.lit(dim)).cast("int")).alias("b"),
                       F.when(some, F.when(F.shiftright(h, 31) == 0, 1.0).otherwise(-1.0)).alias("sg"))
    cells = toks.groupBy("post_id", "b").agg(F.sum("sg").alias("v"), F.count("sg").alias("c"))
    cell = F.when(F.col("b").isNotNull(), F.struct("b", "v"))  # collect_list leaves nulls out
    per = cells.groupBy("post_id").agg(F.sum("c").cast("bigint").alias("n_tokens"),
                                       F.map_from_entries(F.collect_list(cell)).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    raw = per.select("post_id", "n_tokens", vec.alias("embedding"))
    return unit_embeddings(raw).withColumnRenamed("u", "embedding").select("post_id", "n_tokens", "embedding")


def encode_batches(posts: DataFrame, make_encoder: Callable[[], Callable], dim: int,
                   text: str = "text", batch_size: int = ENCODE_BATCH,
                   out_type: str = "float") -> DataFrame:
    """(post_id, embedding) by an encoder over Arrow batches of texts.

    ``out_type`` is the stored element type (``float`` as encoders give, or ``double``).
    """
    np_type = "float32" if out_type == "float" else "float64"
    def run(batches):
        enc = make_encoder()  # built once per task
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i:i + batch_size]
                vecs = np.asarray(enc(part[text].fillna("").str.replace("\n", " ").tolist()),
                                  dtype=np_type)
                yield pd.DataFrame({"post_id": part["post_id"].to_numpy(),
                                    "embedding": list(vecs)})
    kind = posts.schema["post_id"].dataType.simpleString()
    return posts.select("post_id", text).mapInPandas(
        run, f"post_id {kind}, embedding array<{out_type}>")


ENCODERS: dict[str, Callable] = {}


def register_encoder(name: str, factory: Callable) -> None:
    ENCODERS[name] = factory


def encoder_for(model: str, legacy_dispatch: bool = False) -> str:
    """E5: which path a model name takes: 'registered', 'hash', 'word_average', 'batched' or
    'sentence'."""
    if not legacy_dispatch:
        if model in ENCODERS:
            return "registered"
        if re.fullmatch(HASH_MODEL, model):
            return "hash"
    if "fasttext" in model:
        return "word_average"
    if "bert" in model:
        return "batched"
    return "sentence"


def encode_posts(posts: DataFrame, model: str, dim: int | None = None,
                 words: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(post_id, embedding) by the encoder that ``model`` names (E1, E5); one row per post.

    Registered encoders and the built-in hashing run under their names; a word-average
    model needs its table ``words`` (word, vector). Any other name is refused: a vector is
    never stored under the name of a model that did not make it.
    """
    path = encoder_for(model)
    if path == "hash":
        return hash_embed(posts, int(re.fullmatch(HASH_MODEL, model)[1]), text).drop("n_tokens")
    if path == "registered":
        if dim is None:
            raise ValueError(f"the dimension of {model!r} is needed")
        return encode_batches(posts, ENCODERS[model], dim, text)
    if path == "word_average" and words is not None:
        return word_average(posts, words, text, dim).drop("n_tokens")
    raise ValueError(f"no encoder is registered for {model!r} ({path})"
                     + (": its word vectors are needed" if path == "word_average" else ""))
