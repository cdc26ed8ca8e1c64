"""Driver tables and the derived LaTeX view.

The driver's ``documents`` hold plain prose without LaTeX markers. The LaTeX
view puts a ``\\Section{H}`` line before every text line (H cycles through
four headings) and appends citation/reference spans to every fifth line, so
section extraction and reference removal have something real to work on. It
is a pure projection: no shuffle, one output row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectional.config import LATEX_HEADINGS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (Parquet: column pruning and filter pushdown apply)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread CPU-heavy per-row work over the cluster when the scan is too coarse.

    A Parquet row group is one task; text cleaning costs far more per byte
    than scanning, so a table stored as one large row group would run on one
    core. When the scan yields fewer partitions than the session's parallelism,
    hash-repartition by ``key`` to that count (an explicit count, which AQE
    does not coalesce back). Inputs that already have enough splits - the
    normal case on a cluster - are left as they are, with no extra shuffle.
    """
    spark = df.sparkSession
    target = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def latex_text(text: Column) -> Column:
    """Plain text -> LaTeX-like text with one section marker per line."""
    heads = F.array(*[F.lit(h) for h in LATEX_HEADINGS])
    n = len(LATEX_HEADINGS)

    def per_line(line: Column, i: Column) -> Column:
        cite = F.when(i % 5 == 0, F.concat(F.lit(" see~\\cite{ref"), i.cast("string"),
                                            F.lit("} and \\ref{fig"), i.cast("string"), F.lit("}."))
                      ).otherwise(F.lit(""))
        return F.concat(F.lit("\\Section{"), F.element_at(heads, (i % n + 1).cast("int")), F.lit("}\n"), line, cite)

    return F.array_join(F.transform(F.split(text, "\n"), per_line), "\n")


def latex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``text`` replaced by its LaTeX view."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")
    return docs.select("doc_id", latex_text(F.col("text")).alias("text"), "lang", "source", "n_chars")
