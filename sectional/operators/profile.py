"""Corpus profiles: heading frequencies (A1-A3, K1) and length
distributions per section (A8 lengths, A9 box summary, A10 histogram + KDE).

Scale notes
- Lengths are counted once to (group, value, cnt), with a map-side combine, and that table is written; quartiles, whiskers,
  histogram and density all follow from it. What runs on the rows is one aggregation, and a group with a third of all rows
  is combined before the shuffle. The table grows with the number of distinct values, not with the rows.
- Statistics per group are joined to that small table, never to the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectional.session import cut_lineage

# A1 / A2 / A3 / K1 ----------------------------------------------------------------
def heading_counts(df: DataFrame, headings_col: str) -> DataFrame:
    """A1: (heading, cnt) from an array column of headings."""
    return df.select(F.explode(headings_col).alias("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("cnt"))


def top_headings(counts: DataFrame, k: int = 15) -> DataFrame:
    """K1: most frequent headings, ties by heading (TakeOrderedAndProject)."""
    return counts.orderBy(F.col("cnt").desc(), F.col("heading").asc()).limit(k)


def heading_mass(counts: DataFrame) -> DataFrame:
    """A2/A3: distinct headings, total mass, mass of headings seen more than once."""
    return counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("cnt").cast("bigint").alias("mass"),
                      F.coalesce(F.sum(F.when(F.col("cnt") > 1, F.col("cnt"))), F.lit(0)).cast("bigint")
                      .alias("repeated_mass"))


# A9 -------------------------------------------------------------------------
def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, v, cnt), v as double without nulls, written once; everything below works on it."""
    rows = df.select(group, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    return cut_lineage(rows.groupBy(group, "v").agg(F.count("*").alias("cnt")), "value-counts")


def group_stats(counts: DataFrame, group: str, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per group of a ``value_counts`` table: n, lo, hi, sd (of a sample; null for one row), q1, median, q3.

    ``approx`` uses a fixed-size sketch for the quartiles, for continuous values with very many distinct ones.
    """
    sums = counts.groupBy(group).agg(F.sum("cnt").alias("n"), (F.sum(F.col("cnt") * F.col("v")) / F.sum("cnt")).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    quartiles = F.percentile_approx("v", [0.25, 0.5, 0.75], accuracy) if approx else F.percentile("v", [0.25, 0.5, 0.75], F.col("cnt"))
    spread = counts.join(sums.select(group, "mean"), group).groupBy(group).agg(
        F.sum(F.col("cnt") * F.pow(F.col("v") - F.col("mean"), 2)).alias("squares"), quartiles.alias("q"))
    sd = F.sqrt(F.try_divide(F.col("squares"), F.col("n") - 1))
    return sums.join(spread, group).select(group, "n", "lo", "hi", sd.alias("sd"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def box_summary(df: DataFrame, group: str, value: str, whisker: float = 1.5, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences of 1.5 interquartile ranges), number of outliers."""
    counts = value_counts(df, group, value)
    stats = group_stats(counts, group, approx)
    reach = whisker * (F.col("q3") - F.col("q1"))
    low, high = F.col("v") >= F.col("q1") - reach, F.col("v") <= F.col("q3") + reach
    return counts.join(stats, group).groupBy(group, "n", "q1", "median", "q3").agg(
        F.min(F.when(low, F.col("v"))).alias("whisker_lo"), F.max(F.when(high, F.col("v"))).alias("whisker_hi"),
        F.sum(F.when(low & high, 0).otherwise(F.col("cnt"))).cast("bigint").alias("n_outliers"))


# A10 ------------------------------------------------------------------------
def histogram(df: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """A10: equal-width bins between the group's min and max; non-empty bins only."""
    counts = value_counts(df, group, value)
    ends = counts.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.floor(F.try_divide((F.col("v") - F.col("lo")) * F.lit(float(bins)), width)).cast("int")
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(place, F.lit(bins - 1)))
    out = counts.join(ends, group).groupBy(group, "lo", "hi", at.alias("bin")).agg(F.sum("cnt").cast("bigint").alias("cnt"))
    edge = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return out.select(group, "bin", F.round(edge, 6).alias("bin_lo"), "cnt")


def kde(df: DataFrame, group: str, value: str, grid: int = 32) -> DataFrame:
    """A10: Gaussian density (Scott's bandwidth) on a grid, exact: the kernel is summed over the distinct values with their
    counts. Groups without spread (one value, or one row) have no density: null.

    Rows: at most ``grid`` times the distinct values of a group. Continuous values should be rounded first, to an eighth
    of the bandwidth or less.
    """
    counts = value_counts(df, group, value)
    stats = group_stats(counts, group).withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1))
    points = stats.select(group, "n", "lo", "h", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g")) \
        .withColumn("x", F.col("lo") + F.col("g") * F.col("step"))
    z = F.try_divide(F.col("x") - F.col("v"), F.col("h"))
    kernel = F.col("cnt") * F.lit(1.0 / math.sqrt(2.0 * math.pi)) * F.exp(-0.5 * z * z)
    sums = points.join(counts, group).groupBy(group, "g", "x", "n", "h").agg(F.sum(kernel).alias("s"))
    return sums.select(group, "g", F.round("x", 6).alias("x"), F.round(F.try_divide(F.col("s"), F.col("n") * F.col("h")), 9).alias("density"))
