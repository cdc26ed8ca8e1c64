"""Mergeable summaries per shard (A2, A9, K2): distinct tokens, quantiles of lengths, most frequent tokens.

A shard's tokens and rows become three sketches of fixed size (HyperLogLog, KLL, frequent items), which are stored as a
table. Later summaries merge stored sketches and never read the rows again; a new shard adds a row. Errors: distinct
counts have a relative standard error of ``1.04 / sqrt(2^lg_k)``; a quantile's rank is off by about ``2.3 / k`` (two sides of
99 %); a frequent item's count by at most ``n * 3.5 / items``, and no item above that is left out.

Null shards are a shard, null tokens and values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K, ITEMS = 14, 800, 20_000


def shard_sketches(rows: DataFrame, shard: str, tokens: str, value: str, lg_k: int = LG_K, kll_k: int = KLL_K, items: int = ITEMS) -> DataFrame:
    """(shard, distinct, frequent, quantiles, n_tokens, n_rows): sketches of the token arrays and of a whole number per row."""
    exploded = rows.select(shard, F.explode(tokens).alias("_t")).where(F.col("_t").isNotNull()).groupBy(shard).agg(
        F.hll_sketch_agg("_t", lg_k).alias("distinct"), F.expr(f"approx_top_k_accumulate(_t, {items})").alias("frequent"), F.count("*").alias("n_tokens"))
    values = rows.groupBy(F.col(shard).alias("_s")).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(kll_k)).alias("quantiles"), F.count(value).alias("n_rows"))
    return values.join(exploded, F.col("_s").eqNullSafe(F.col(shard)), "left").select(F.col("_s").alias(shard), "distinct", "frequent", "quantiles",
                                                                                     F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_rows")


def merged(sketches: DataFrame, items: int = ITEMS) -> DataFrame:
    """One row with the union of stored sketches."""
    return sketches.agg(F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(frequent, {items})").alias("frequent"),
                        F.kll_merge_agg_bigint("quantiles").alias("quantiles"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_rows").alias("n_rows"))


def distinct_of(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_of(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(q))


def top_of(sketch: str, k: int) -> Column:
    """array<struct<item, count>>, most frequent first."""
    return F.expr(f"approx_top_k_estimate({sketch}, {k})")


def distinct_bound(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    return deviations * 1.04 / 2 ** (lg_k / 2)


def rank_bound(kll_k: int = KLL_K) -> float:
    return 2.3 / kll_k


def count_bound(n: Column, items: int = ITEMS) -> Column:
    return n * F.lit(3.5 / items)


def quantile_holds(values: DataFrame, value: str, estimates: Sequence[tuple[float, int]], bound: float) -> DataFrame:
    """(q, within): whether the rank of each estimate over all values is within ``bound`` of q."""
    total = F.count(value)
    checks = [F.struct(F.lit(q).alias("q"), ((F.sum((F.col(value) < e).cast("long")) / total <= q + bound) & (F.sum((F.col(value) <= e).cast("long")) / total >= q - bound)).alias("within"))
              for q, e in estimates]
    return values.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*")
