"""Merkle fixity audit of two replicas of an archive.

A manifest has a row per record: its place in the archive's order (``rank``), file, offset, length and digest. Leaves
hash offset, length and digest; a node hashes its ``fanout`` children in order; the last level has one root. Both
replicas' trees are built level by level (each level is one aggregation of groups of at most ``fanout`` rows, written to
the shared folder). The comparison starts at the roots and follows only children of nodes that differ, so an intact
archive costs one comparison and a corrupt one a few rows per level. All of it is DataFrame expressions.

Defined results. Null url or html: empty. Repeated rows: copies of one record, counted in its leaf (``copies``), so a
third of all rows being equal is one row after map-side aggregation. Ties of page_id are ordered by digest, null ids
first. A record that one replica lacks is a difference. Empty archives have no levels and no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

RECORDS_PER_FILE = 1024
FANOUT = 32


def warc_record(url: Column, html: Column) -> Column:
    """A response record's bytes, as text."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def digest(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def in_order(rows: DataFrame, *keys: str, name: str = "ranked") -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of ``keys`` (which must be distinct), without a global sort task.

    A range-partitioned sort is written with each row's partition and place in it; the partitions' counts, a table with
    a row per partition, give each partition's first rank.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys]) \
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]) \
        .withColumn("place", F.monotonically_increasing_id())
    placed = stage(placed, name)
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # a row per partition of the sort, so it is small by construction
    return placed.withColumn("part", part).join(F.broadcast(first), "part") \
        .withColumn("rank", F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first", "place")


def lay_out(ranked: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """``file`` and ``offset`` of each run of equal records, from rank, length and copies; windows hold one file each."""
    before = Window.partitionBy("file").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("file", F.floor(F.col("rank") / per_file)) \
        .withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)))


def tree(manifest: DataFrame, fanout: int = FANOUT, name: str = "tree") -> list[DataFrame]:
    """The levels, leaves first; each has ``node`` and ``hash``. The last level has one row (none if there are no records)."""
    leaf = F.sha2(F.concat_ws(":", "file", "offset", "length", "copies", "digest"), 256)
    levels = [stage(manifest.select(F.col("rank").alias("node"), leaf.alias("hash")), f"{name}-0")]
    while levels[-1].count() > 1:
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))  # at most `fanout` of them
        up = levels[-1].groupBy(F.floor(F.col("node") / fanout).alias("up")).agg(children.alias("c")) \
            .select(F.col("up").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["hash"])), ","), 256).alias("hash"))
        levels.append(stage(up, f"{name}-{len(levels)}"))
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaves (``node``) that differ, found from the roots down. Trees of unequal height differ at each missing node."""
    top = max(len(a), len(b)) - 1
    bad = None
    for level in range(top, -1, -1):
        sides = []
        for side, levels in (("a", a), ("b", b)):
            nodes = levels[level] if level < len(levels) else levels[-1].where(F.lit(False))
            if bad is not None:
                nodes = nodes.withColumn("up", F.floor(F.col("node") / fanout)).join(bad, "up", "left_semi").drop("up")
            sides.append(nodes.withColumnRenamed("hash", side))
        both = sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        if level == 0:
            return both.select("node")
        bad = stage(both.select(F.col("node").alias("up")), f"bad-{level}")


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records of two manifests (rank, file, offset, length, copies, digest) that differ, with both digests."""
    found = differing(tree(a, fanout, "a"), tree(b, fanout, "b"), fanout).withColumnRenamed("node", "rank")
    left = a.join(found, "rank", "left_semi")
    right = b.join(found, "rank", "left_semi").select("rank", F.col("digest").alias("digest_b"), F.col("length").alias("length_b"))
    return left.withColumnRenamed("digest", "digest_a").join(right, "rank", "full_outer")
