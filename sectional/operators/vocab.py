"""Vocabularies and numericalisation.

Scale notes
- Counting is ``explode`` + ``groupBy(token).count()``: Spark's partial
  (map-side) hash aggregate collapses hot tokens before the shuffle, so a
  Zipf-heavy token costs one row per map task, not one per occurrence.
- The top-k drops tokens below the cut-off count and ranks the survivors
  partition by partition (``top_tokens``).
- The vocabulary goes to every task: it has at most ``max_size +
  len(specials)`` keys of at most ``KEY_BYTES`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectional.config import SPECIALS, UNK, VOCAB_SIZE
from sectional.session import cut_lineage, small_batches

# Longer tokens are looked up by their SHA-256, which bounds the vocabulary's bytes without leaving any token out.
KEY_BYTES = 256


def token_counts(df: DataFrame, token_cols: Sequence[str]) -> DataFrame:
    """(token, cnt) over every array column in ``token_cols`` (P7 + explode + count)."""
    cols = list(token_cols)
    if len(cols) == 1:
        exploded = df.select(F.explode(F.col(cols[0])).alias("token"))
    else:
        # One pass over the rows: concatenate the arrays, explode once.
        exploded = df.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>"))
                                                    for c in cols])).alias("token"))
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def count_floor(counts: DataFrame, max_size: int) -> int:
    """The count that the ``max_size``-th token in falling order has (1 if there are fewer).

    Read from the histogram of counts: a row per distinct count, of which there are at most the root of twice the corpus.
    """
    falling = Window.orderBy(F.col("cnt").desc())
    sizes = counts.groupBy("cnt").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(falling))
    return sizes.where(F.col("upto") >= max_size).agg(F.max("cnt")).first()[0] or 1


def in_order(rows: DataFrame, *order, name: str = "ranked") -> DataFrame:
    """``rows`` with ``rank`` from 0. A range-partitioned sort is written with each row's partition and place; the first rank
    of each partition comes from a table with a row per partition, so no task holds more than a partition."""
    placed = cut_lineage(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.withColumn("_part", part).join(F.broadcast(first), "_part") \
        .withColumn("rank", F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first", "_place")


def top_tokens(counts: DataFrame, max_size: int | None = VOCAB_SIZE, first_index: int = len(SPECIALS)) -> DataFrame:
    """K2: the ``max_size`` most frequent tokens (all, if None), ties by token, indexed from ``first_index``.

    The counts are written once. Tokens below the cut-off count go first; the survivors are sorted and ranked partition by
    partition, so neither the whole vocabulary nor a top of every task ever meets in one task.
    """
    counts = cut_lineage(counts.select("token", "cnt"), "token-counts")
    if max_size is not None:
        counts = counts.where(F.col("cnt") >= count_floor(counts, max_size))
    ranked = in_order(counts, F.col("cnt").desc(), F.col("token").asc(), name="token-ranks")
    if max_size is not None:
        ranked = ranked.where(F.col("rank") < max_size)
    return ranked.select("token", "cnt", (F.col("rank") + first_index).cast("int").alias("idx"))


def specials_frame(spark: SparkSession, specials: Sequence[str] = SPECIALS) -> DataFrame:
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("cnt", T.LongType()),
                           T.StructField("idx", T.IntegerType())])
    return spark.createDataFrame([(s, None, i) for i, s in enumerate(specials)], schema)


def build_vocab(df: DataFrame, token_cols: Sequence[str], max_size: int | None = VOCAB_SIZE,
                specials: Sequence[str] = SPECIALS) -> DataFrame:
    """A4/A5: vocabulary(token, cnt, idx) with the specials at 0..len-1.

    Specials are excluded from the counts, as tokens equal to a special are
    mapped to it anyway.
    """
    return vocab_from_counts(token_counts(df, token_cols), max_size, specials)


def vocab_from_counts(counts: DataFrame, max_size: int | None = VOCAB_SIZE,
                      specials: Sequence[str] = SPECIALS) -> DataFrame:
    """A4 from a (token, cnt) table, e.g. per-document counts summed by token."""
    counts = counts.filter(~F.col("token").isin(list(specials)))
    ranked = top_tokens(counts, max_size, first_index=len(specials))
    return specials_frame(counts.sparkSession, specials).unionByName(ranked)


def vocabulary_keys(vocab: DataFrame) -> pa.Table:
    """(key, idx) of a vocabulary, ordered by idx; bounded by its cap."""
    key = F.when(F.octet_length("token") > KEY_BYTES, F.concat(F.lit("\0"), F.sha2("token", 256))).otherwise(F.col("token"))
    return vocab.select(key.alias("key"), "idx").orderBy("idx").toArrow()


def look_up(lists: pa.Array, keys: pa.Array, index: pa.Array, unk_index: int = 0) -> pa.Array:
    """Index arrays of token arrays; null tokens are unknown, null arrays empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.string())
    long = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(flat), KEY_BYTES), False).to_numpy(zero_copy_only=False))
    if len(long):
        mask = np.zeros(len(flat), bool)
        mask[long] = True
        digests = ["\0" + hashlib.sha256(t.encode()).hexdigest() for t in flat.take(pa.array(long)).to_pylist()]
        flat = pc.replace_with_mask(flat, pa.array(mask), pa.array(digests, pa.string()))
    at = pc.fill_null(pc.index_in(flat, value_set=keys), len(keys))
    known = pa.concat_arrays([index.cast(pa.int32()), pa.array([unk_index], pa.int32())])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), known.take(at))


def numericalise(df: DataFrame, keys: Sequence[str], tokens_col: str, vocab: DataFrame, out_col: str = "ids", unk_index: int = 0) -> DataFrame:
    """Token array -> index array, unknown tokens -> ``unk_index``; null or empty arrays give empty ones.

    The vocabulary is bounded by its cap (and its keys by ``KEY_BYTES``), so it goes to every task as one Arrow array;
    each batch is looked up as a whole and rows stay rows: no explode, no shuffle, no regrouping.
    """
    small_batches(df.sparkSession)
    table = vocabulary_keys(vocab)
    words = df.sparkSession.sparkContext.broadcast(table.combine_chunks())
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{out_col}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = (pa.concat_arrays(words.value.column(c).chunks or [pa.array([], t)]) for c, t in (("key", pa.string()), ("idx", pa.int32())))
        for batch in batches:
            found = look_up(batch.column(tokens_col), known, index, unk_index)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], found], names=[*keys, out_col])

    return df.select(*keys, tokens_col).mapInArrow(run, schema)


def vector_coverage(vocab: DataFrame, vectors: DataFrame, dim: int, key: str = "idx",
                    vec_key: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vocabulary left-join vectors; misses get a zero vector (and ``hit`` = 0)."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = vocab.join(vectors.select(F.col(vec_key).alias(key), F.col(vec_col).alias("_vec")), on=key, how="left")
    return joined.select("*", F.col("_vec").isNotNull().cast("int").alias("hit")) \
                 .withColumn("vec", F.coalesce(F.col("_vec"), zeros)).drop("_vec")


__all__ = ["token_counts", "top_tokens", "build_vocab", "numericalise", "vector_coverage", "UNK"]
