"""Mixing sources to target weights: floor(rate) copies of each document plus one seeded Bernoulli copy.

Sizes are word counts. Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share the total size by weight;
a source's target stops at ``max_rate`` times its size, and what it can't take is shared again by weight among the
others until none is above. Everything is DataFrame expressions: one map-side aggregated count per source, two windows
over the (one row per source) table of totals, one join, no Python.

Defined results. Null text: size 0. Null source: a source of its own, the last. Repeated rows: each is a document, and
rows with the same doc_id toss the same coin. Empty sources (size 0): target 0, nothing taken. An empty table: no rows.
``mix`` returns the input's columns whatever their names; ``plan_mix`` replaces columns that are called ``mix_...`` already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, stage

#: Rows of the source table up to which it is broadcast (about 60 bytes each, so 6 MB).
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: str) -> Column:
    """Uniform in [0, 1), from 52 bits of the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """``mix_source, source_size`` with one row per source -> the same with ``target``.

    Water filling in closed form: by rising cap/weight, a source is capped while its cap is below what the level over
    the rest would give it; the level at the first source that isn't capped holds for all the others.
    """
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int"))
    rows = sources.withColumn("mix_w", w.cast("long")).withColumn("mix_cap", F.col("source_size") * max_rate)
    rising = Window.orderBy(F.col("mix_cap") / F.col("mix_w"), F.col("mix_source").asc_nulls_last())
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("mix_cap").over(before), F.lit(0))
    rest_w = F.sum("mix_w").over(everything) - F.coalesce(F.sum("mix_w").over(before), F.lit(0))
    level = rest.cast("double") / rest_w.cast("double")
    rows = rows.withColumn("mix_level", level).withColumn("mix_open", F.col("mix_cap") >= F.col("mix_level") * F.col("mix_w"))
    final = F.min(F.when(F.col("mix_open"), F.struct(F.col("mix_cap") / F.col("mix_w"), "mix_level"))).over(everything)
    return rows.select("mix_source", "source_size",
                       F.least(F.col("mix_cap").cast("double"),
                               F.coalesce(final["mix_level"] * F.col("mix_w"), F.col("mix_cap").cast("double"))).alias("target"))


def plan_mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
             weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """Every row with ``mix_size, mix_source_size, mix_target, mix_copies``."""
    sized = docs.withColumn("mix_size", n_words(F.col(text)))
    totals = sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum("mix_size").alias("source_size"))
    rates = stage(targets(totals, weights, max_rate), "mix-targets")
    rates = rates.withColumnRenamed("source_size", "mix_source_size").withColumnRenamed("target", "mix_target")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.col("mix_target") / F.col("mix_source_size")
    whole = F.floor(rate)
    copies = F.when(F.col("mix_source_size") > 0,
                    F.least(F.lit(max_rate), whole + F.when(coin(F.col(doc_id), seed) < rate - whole, 1).otherwise(0))).otherwise(0)
    joined = sized.join(rates, sized[source].eqNullSafe(rates["mix_source"]), "left").drop("mix_source")
    return joined.withColumn("mix_copies", copies.cast("long"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: the input's columns, each row as often as it is taken."""
    own, names = aside(docs, source, text, doc_id)
    planned = plan_mix(own, source, text, doc_id, **options).where(F.col("mix_copies") > 0)
    each = planned.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return each.select(*[F.col(f"`{c}`") for c in own.columns]).toDF(*[names.get(c, c) for c in own.columns])
