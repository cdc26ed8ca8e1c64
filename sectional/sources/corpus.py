"""Corpus sources and sinks.

S1  keyed-JSON corpus: one JSON object per file, paper id -> record.
S2  multi-part union by column name.
S3  record flatten, one level (nested values stay nested).
S4  size tier: first n rows in key order; negative n = all but the last |n|.
S5  prepared-corpus write, S6 prepared-corpus read (Parquet).
S7  pretrained vectors: text lines ``token v1 v2 ...``.

Scale note: a keyed-JSON file is cut by records, so one large file spreads over
tasks. Land it once as Parquet (S5) and read that afterwards (S6): Parquet
prunes columns and pushes filters down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectional.config import CORPUS_RENAMES
from sectional.operators.joins import bounded_broadcast
from sectional.sources import keyed_json

RECORD_SCHEMA = T.StructType([
    T.StructField("abstract", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("tex_data", T.ArrayType(T.StringType())),
])


def read_corpus(spark: SparkSession, paths: str | Sequence[str], record_schema: T.StructType = RECORD_SCHEMA,
                key_col: str = "paper_id") -> DataFrame:
    """S1 + S3: keyed-JSON files -> one row per record, the key kept as ``key_col``.

    Files are cut by records (``sources.keyed_json``) and each record is parsed against an explicit schema. What isn't a
    record fails the job, as losing it silently would be worse; ``corpus_rejects`` lists it.
    """
    found = keyed_json.records(spark, paths, record_schema, key_col)
    broken = F.raise_error(F.concat(F.lit("not a keyed-JSON file: "), F.col("_file"), F.lit(": "), F.col("_reason"))).cast("boolean")
    return found.where(F.when(F.col("_reason").isNotNull(), broken).otherwise(F.lit(True))).drop("_file", "_reason")


def corpus_rejects(spark: SparkSession, paths: str | Sequence[str], record_schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """``file, key, reason`` of what ``read_corpus`` would fail on."""
    found = keyed_json.records(spark, paths, record_schema, "key").where(F.col("_reason").isNotNull())
    return found.select(F.col("_file").alias("file"), "key", F.col("_reason").alias("reason"))


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns missing in a part become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def hash_bucket(col: str, buckets: int) -> F.Column:
    """Stable bucket from the md5 of a key (identical in Spark and DuckDB)."""
    h = F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return h % F.lit(buckets)


def hash_halves(df: DataFrame, key: str) -> list[DataFrame]:
    """Split a table into two parts by key hash (a stand-in for several input files)."""
    b = hash_bucket(key, 2)
    return [df.filter(b == 0), df.filter(b == 1)]


def size_tier(df: DataFrame, n: int | None, order_by: str, row_bytes: int = 16) -> DataFrame:
    """First ``n`` rows in ``order_by`` order; ``None`` = all; negative = all but last ``|n|``.

    Positive n is a TakeOrderedAndProject (bounded by n). Negative n finds the
    ``|n|`` largest keys with the same bounded top-k and removes them with an
    anti join, so the whole table is never ordered or windowed globally.
    """
    if n is None:
        return df
    if n >= 0:
        return df.orderBy(F.col(order_by).asc()).limit(n)
    last = df.select(order_by).orderBy(F.col(order_by).desc()).limit(-n)
    return df.join(bounded_broadcast(last, -n, row_bytes), on=order_by, how="left_anti")


def normalise_corpus(df: DataFrame, renames: dict[str, str] = CORPUS_RENAMES) -> DataFrame:
    """P1 + P3: rename fields; the raw ``tex_data`` lines are joined by newlines into ``text``."""
    out = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    if "tex_data" in out.columns:
        out = out.withColumn("text", F.array_join("tex_data", "\n")).drop("tex_data")
    return out


def write_prepared(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Land a prepared corpus as Parquet (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_prepared(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read a prepared corpus; selecting columns prunes the Parquet scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``token f1 f2 ...`` text lines -> (token, vec array<float>).

    With ``dim`` the last ``dim`` fields are the vector and all before is the token, which may hold spaces; a line with
    fewer fields fails the job. Without it the first field is the token. Empty lines are no vectors.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.col("value"), " ")
    first = F.lit(1) if dim is None else F.size(parts) - dim
    checked = F.when(first >= 1, first).otherwise(F.raise_error(F.concat(F.lit("not a vector line: "), F.substring("value", 1, 80))).cast("int"))
    return lines.select(parts.alias("_p"), checked.alias("_n")).select(
        F.array_join(F.slice("_p", 1, F.col("_n")), " ").alias("token"),
        F.transform(F.slice("_p", F.col("_n") + 1, F.size("_p")), lambda x: x.cast("float")).alias("vec"))


def write_keyed_json(df: DataFrame, path: str, key_col: str, record_cols: Sequence[str], per_file: int = 1000) -> None:
    """Sink for keyed-JSON corpora: one JSON object ``{key: record}`` of at most ``per_file`` records per line."""
    rec = F.struct(*[F.col(c) for c in record_cols])
    part = F.floor(F.monotonically_increasing_id() / per_file)  # partition and place in it
    grouped = df.select(part.alias("_part"), F.col(key_col).cast("string").alias("_k"), rec.alias("_r")) \
        .groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_r"))).alias("_m"))
    # the reader takes each file as one object
    grouped.select(F.to_json("_m").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_vectors(df: DataFrame, path: str, token_col: str, vec_col: str) -> None:
    """Sink for S7's format: ``token v1 v2 ...`` per line."""
    line = F.concat_ws(" ", F.col(token_col), F.array_join(F.transform(vec_col, lambda x: x.cast("string")), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
