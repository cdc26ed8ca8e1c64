"""Approximate nearest neighbours by cosine over balanced posting lists.

Equal vectors are one class with its k + 1 smallest ids (which is all that a search for k can need), so a vector that a
third of all rows share costs one posting. Centroids come from k-means on a bounded sample (``SAMPLE_BYTES``), large
clusters being split until none holds over twice its share. Every class goes to its nearest centroid's list and, near a
border, to further lists whose centroid is at most ``1 + spill`` times as far and not nearer to one already taken.
Nearest centroids are found by beam search over a neighbour graph of the centroids, held in each task. A query reads the
lists whose centroids are at most ``1 + ratio`` times as far as its nearest (at least ``min_lists``, and as many as hold
k + 1 vectors). Lists are cut into blocks of ``BLOCK`` postings, so no task holds a long list. Scores are exact
cosines in double precision on the original vectors.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components, or are of another than the
commonest width, take no part, nor do rows without an id. Rows with the query's id are not its candidates; an id that
occurs more than once counts once, with its best score. Ties go to the smaller id. Fewer candidates than k: all of them.
Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

SAMPLE_BYTES = 8 << 20
LIST_SIZE = 200
MAX_LISTS = 1024
BLOCK = 4096


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("vector")) \
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("vector", lambda x: x != 0))
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.where(F.size("vector") == (width[0] if width else 0))


def vector_key(vector: Column) -> Column:
    return F.concat_ws(":", F.xxhash64(vector), F.xxhash64(F.lit("second"), vector))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: key, vector, ids (the k + 1 smallest). The row limit of the window also runs before its shuffle."""
    keyed = rows.withColumn("key", vector_key(F.col("vector"))).distinct()
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return first.groupBy("key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T)


class Centroids:
    """Balanced k-means centroids and their neighbour graph; small enough to be shipped with each task."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, links: int = 24):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(8):
            c = self._means(x, c)
        share = 2 * max(1.0, len(x) / len(c))
        for _ in range(6):  # split what holds over twice its share
            own = self._nearest(x, c)
            size = np.bincount(own, minlength=len(c))
            large = np.flatnonzero(size > max(share, 2))
            if not len(large) or len(c) + len(large) > 2 * MAX_LISTS:
                break
            second = np.stack([x[rng.choice(np.flatnonzero(own == k))] for k in large])
            c = self._means(x, self._means(x, np.concatenate([c, second])))
        self.c = c
        d = distances(c, c)
        np.fill_diagonal(d, np.inf)
        n = len(c)
        near = np.argsort(d, axis=1)[:, :min(links, max(n - 1, 0))]
        far = rng.integers(0, n, (n, 4))  # a few long links keep the graph connected
        self.links = np.concatenate([near, far, np.roll(np.arange(n), 1)[:, None]], axis=1)
        self.entry = np.unique(rng.choice(n, min(n, 48), replace=False))

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([distances(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])

    def _means(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        own = self._nearest(x, c)
        order = np.argsort(own, kind="stable")
        used, start = np.unique(own[order], return_index=True)
        return np.add.reduceat(x[order], start, axis=0) / np.diff(np.append(start, len(x)))[:, None].astype(np.float32)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found for each row and their distances, nearest first; all rows step together."""
        n, m = len(x), len(self.c)
        beam = min(beam, m)
        sq = (self.c * self.c).sum(1)
        d0 = distances(x, self.c[self.entry])
        dist = np.full((n, m), np.inf, np.float32)  # also marks what was seen; m is bounded
        dist[:, self.entry] = d0
        expanded = np.zeros((n, m), bool)
        rows = np.arange(n)[:, None]
        for _ in range(m):
            best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            fresh = ~expanded[rows, best] & np.isfinite(dist[rows, best])
            if not fresh.any():
                break
            r, b = np.nonzero(fresh)
            node = best[r, b]
            expanded[r, node] = True
            to = self.links[node].ravel()
            r = np.repeat(r, self.links.shape[1])
            new = ~np.isfinite(dist[r, to])
            pair = np.unique(r[new] * m + to[new])
            r, to = pair // m, pair % m
            for i in range(0, len(r), 1 << 16):
                a, t = r[i:i + (1 << 16)], to[i:i + (1 << 16)]
                dist[a, t] = np.maximum(0, (x[a] * x[a]).sum(1) + sq[t] - 2 * np.einsum("ij,ij->i", x[a], self.c[t]))
        best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(dist[rows, best], axis=1, kind="stable"), axis=1)
        return best, np.sqrt(dist[rows, best])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", queries: Column | None = None, k: int = 5,
           spill: float = 0.12, copies: int = 4, ratio: float = 0.35, min_lists: int = 12, beam: int = 64, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for every row where ``queries`` holds (on vec_id)."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_column, vector), "vectors")
    distinct = stage(classes(rows, k), "vector-classes")
    n = distinct.count()
    width = (distinct.select(F.size("vector")).first() or [1])[0]
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    most = max(64, SAMPLE_BYTES // (4 * width))
    sample = distinct.select("vector") if n <= most else distinct.select("vector").sample(0.95 * most / n, seed)
    sample = np.array([r[0] for r in sample.collect()] or [distinct.first()["vector"]], np.float32)  # bounded by SAMPLE_BYTES
    book = spark.sparkContext.broadcast(Centroids(sample, int(min(MAX_LISTS, max(1, n // LIST_SIZE))), seed))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = book.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = unit(matrix(part.column("vector")))
                near, d = b.search(x, 8)
                src, lists, first = [], [], []
                for i in range(len(x)):
                    taken: list[int] = []
                    for c, far in zip(near[i], d[i]):
                        if taken and (far > (1 + spill) * d[i, 0] or len(taken) >= copies):
                            break
                        if all(((b.c[c] - b.c[t]) ** 2).sum() >= 0.25 * far * far for t in taken):
                            src.append(i)
                            lists.append(int(c))
                            first.append(not taken)
                            taken.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(first), *[part.column(c).take(pa.array(src)) for c in ("key", "vector", "ids")]],
                                                 names=["list", "home", "key", "vector", "ids"])

    kind = distinct.schema["vector"].dataType.simpleString()
    postings = stage(distinct.mapInArrow(post, f"list int, home boolean, key string, vector {kind}, ids array<long>"), "postings")
    # a row per list, so at most 2 * MAX_LISTS
    sizes = {r["list"]: (r["all"], r["ids"]) for r in postings.groupBy("list").agg(F.count("*").alias("all"), F.sum(F.when(F.col("home"), F.size("ids"))).alias("ids")).collect()}
    blocks = {c: -(-a // BLOCK) for c, (a, _) in sizes.items()}
    homes = {c: i or 0 for c, (_, i) in sizes.items()}
    enough = k + 1

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = book.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = unit(matrix(part.column("vector")))
                near, d = b.search(x, beam)
                src, lists, block = [], [], []
                for i in range(len(x)):
                    order, found = list(zip(near[i], d[i])), 0
                    if sum(homes.get(int(c), 0) for c, _ in order) < enough:  # little data: all lists, nearest first
                        far = np.sqrt(distances(x[i:i + 1], b.c)[0])
                        order = [(c, far[c]) for c in np.argsort(far, kind="stable")]
                    for place, (c, far) in enumerate(order):
                        if place >= min_lists and found >= enough and far > (1 + ratio) * order[0][1]:
                            break
                        found += homes.get(int(c), 0)
                        for s in range(blocks.get(int(c), 0)):
                            src.append(i)
                            lists.append(int(c))
                            block.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(block, pa.int32()), *[part.column(c).take(pa.array(src, pa.int64())) for c in ("key", "vector")]],
                                                 names=["list", "block", "key", "vector"])

    asked = rows if queries is None else rows.where(queries)
    asked = stage(asked.select("vec_id", vector_key(F.col("vector")).alias("key"), "vector").distinct(), "queries")
    wanted = asked.groupBy("key").agg(F.first("vector").alias("vector")).mapInArrow(choose, f"list int, block int, key string, vector {kind}")
    per = F.create_map(*[F.lit(v) for c in sorted(blocks) for v in (c, blocks[c])]) if len(blocks) and max(blocks.values()) > 1 else None
    block = F.lit(0) if per is None else F.pmod(F.xxhash64("key"), per[F.col("list")]).cast("int")
    stored = postings.select("list", block.cast("int").alias("block"), "key", "vector", "ids")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            c = np.stack(right["vector"].to_numpy()).astype(np.float64)
            length = np.sqrt(np.einsum("ij,ij->i", c, c))
            for at in range(0, len(left), 256):
                part = left.iloc[at:at + 256]
                q = np.stack(part["vector"].to_numpy()).astype(np.float64)
                rough = (q @ c.T) / length / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
                top = min(k + 1, len(c))
                bound = np.partition(rough, len(c) - top, axis=1)[:, len(c) - top] - 1e-9
                qi, ci = np.nonzero(rough >= bound[:, None])
                exact = np.einsum("ij,ij->i", q[qi], c[ci]) / (np.sqrt(np.einsum("ij,ij->i", q[qi], q[qi])) * length[ci])
                found.append(pd.DataFrame({"key": part["key"].to_numpy()[qi], "score": exact, "ids": right["ids"].to_numpy()[ci]}))
        return pd.concat(found) if found else pd.DataFrame({"key": pd.Series(dtype=str), "score": pd.Series(dtype=float), "ids": pd.Series(dtype=object)})

    hits = wanted.groupBy("list", "block").cogroup(stored.groupBy("list", "block")).applyInPandas(compare, "key string, score double, ids array<long>")
    best = hits.select("key", "score", F.explode("ids").alias("vec_id")).groupBy("key", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1) \
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best"))
    each = asked.select(F.col("vec_id").alias("query_id"), "key").distinct().join(best, "key") \
        .select("query_id", F.explode("best").alias("b")).where(F.col("b.vec_id") != F.col("query_id")) \
        .groupBy("query_id", "b.vec_id").agg(F.min("b.minus").alias("minus"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("minus", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score"))
