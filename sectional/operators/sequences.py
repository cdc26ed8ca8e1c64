"""Sequence, split and batch operators.

Scale notes
- W1 and W4 are per-row projections (no shuffle).
- W2 hashes the key: deterministic, stable under repartitioning, no
  ``rand()``, no global sort.
- W3 numbers rows only inside (split, hash bucket) window partitions; the
  bucket count bounds every partition, so no single task sees a whole split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectional.config import BATCH_SIZE, PAD, SOS, SPLIT_RATIOS

SPLIT_NAMES = ("train", "valid", "test")
SPLIT_RESOLUTION = 10_000


def fixed_length(tokens: Column, length: int, sos: str | None = SOS, pad: str = PAD) -> Column:
    """``<SOS>`` + first ``length-1`` tokens, right-padded with ``<pad>`` to ``length``."""
    toks = F.coalesce(tokens, F.array().cast("array<string>"))
    room = length - (1 if sos is not None else 0)
    body = F.slice(toks, 1, room)
    padding = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(room) - F.size(body)))
    head = [F.array(F.lit(sos))] if sos is not None else []
    return F.concat(*head, body, padding)


def key_hash(col: str | Column, start: int = 1) -> Column:
    """32-bit value from 8 hex digits of md5(key) (same in Spark and DuckDB)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), start, 8), 16, 10).cast("bigint")


def split_label(key: str | Column, ratios: Sequence[float] = SPLIT_RATIOS,
                names: Sequence[str] = SPLIT_NAMES) -> Column:
    """Deterministic split name from the key hash and cumulative ratios."""
    bucket = key_hash(key) % F.lit(SPLIT_RESOLUTION)
    out = F.lit(names[-1])
    cum, bounds = 0.0, []
    for r in ratios[:-1]:
        cum += r
        bounds.append(int(round(cum * SPLIT_RESOLUTION)))
    for name, bound in reversed(list(zip(names[:-1], bounds))):
        out = F.when(bucket < F.lit(bound), F.lit(name)).otherwise(out)
    return out


def split_label_stratified(df: DataFrame, key: str, label: str, ratios: Sequence[float] = SPLIT_RATIOS,
                           names: Sequence[str] = SPLIT_NAMES, grid: int = 4096) -> DataFrame:
    """W2 stratified: exact per-label proportions, ranks by key hash inside each label.

    A window over a whole label would be one task per label (half the rows
    for a binary label). Instead rows are counted per (label, hash bucket) on a
    ``grid`` of buckets (a table of at most labels x grid rows), cumulative
    counts per label come from that small table, and rows are numbered only
    inside their (label, bucket). rank / n_label is then compared with the
    cumulative ratios, so every label is split exactly and deterministically.
    """
    h = key_hash(key)
    # Buckets are ranges of the 32-bit hash, so (bucket, hash) order is hash order.
    staged = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") * F.lit(grid) / F.lit(float(1 << 32))).cast("int"))
    counts = staged.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w_lab = Window.partitionBy(label).orderBy("_b")
    cum = counts.select(label, "_b", (F.sum("_c").over(w_lab) - F.col("_c")).alias("_before"),
                        F.sum("_c").over(Window.partitionBy(label)).alias("_n"))
    # labels x grid rows: AQE broadcasts it after measuring the materialised table (no assumed bound).
    ranked = staged.join(cum, [label, "_b"]) \
        .withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    # Integer comparison (rank - 1) / n < bound / RES, free of float rounding at the boundaries.
    scaled = (F.col("_rank") - 1) * F.lit(SPLIT_RESOLUTION)
    out = F.lit(names[-1])
    cum_r, bounds = 0.0, []
    for r in ratios[:-1]:
        cum_r += r
        bounds.append(int(round(cum_r * SPLIT_RESOLUTION)))
    for name, bound in reversed(list(zip(names[:-1], bounds))):
        out = F.when(scaled < F.lit(bound) * F.col("_n"), F.lit(name)).otherwise(out)
    return ranked.withColumn("split", out).drop("_h", "_b", "_before", "_n", "_rank")


BUCKET_BATCHES = 64


def assign_batches(df: DataFrame, key: str, split_col: str = "split", batch_size: int = BATCH_SIZE,
                   buckets: int | None = None) -> DataFrame:
    """(bucket, batch) per row; batches of ``batch_size`` inside (split, bucket).

    Order inside a bucket is by a second hash of the key, then the key, so
    batches are deterministic and shuffled relative to key order. ``buckets``
    defaults to one per ``BUCKET_BATCHES`` batches of the counted rows, so a
    window stays as small as that whatever the table's size.
    """
    if buckets is None:
        buckets = max(1, -(-df.count() // (BUCKET_BATCHES * batch_size)))
    h2 = key_hash(key, start=9)
    staged = df.withColumn("bucket", (key_hash(key, start=17) % F.lit(buckets)).cast("int")).withColumn("_h2", h2)
    w = Window.partitionBy(split_col, "bucket").orderBy("_h2", key)
    return staged.withColumn("batch", F.floor((F.row_number().over(w) - 1) / F.lit(batch_size)).cast("int")) \
                 .drop("_h2")


def last_step(seq: Column) -> Column:
    """Last element of a sequence (null for an empty one)."""
    return F.when(F.size(seq) > 0, F.element_at(seq, -1))


def last_non_pad(seq: Column, pad: str | int = PAD) -> Column:
    """W4 option: last element that is not padding (null if there is none)."""
    real = F.filter(seq, lambda x: x != F.lit(pad))
    return F.when(F.size(real) > 0, F.element_at(real, -1))
