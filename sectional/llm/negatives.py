"""Hard negatives by an inverted multi-index over integer vectors, exact.

Vectors become integers, ``floor(scale * x)``. Equal vectors of one label are one class with its smallest ids (no more than
an answer can need), so a vector that a third of all rows share is one posting. Each half of the components has a
codebook (k-means on a sample of at most ``SAMPLE_BYTES``, its size grows with the square root of the classes); a pair of
half centroids is a cell. For an anchor a and a half centroid c whose farthest member is r away, no member's half scores
above ``a.c + |a| r``, so the sum over both halves bounds a cell. A heap over the two sorted sequences of bounds gives an
anchor its cells, best bound first. First the same-label rows are searched until no cell ahead can reach the last
positive found; the positives' scores then fix the windows, and the other labels are searched until each window either
has its rows, all above what the cells ahead can hold, or lies above every cell ahead. A round takes eight times as many
cells as all before, so there are few; anchors whose windows are certified leave.

Visited cells and anchors meet in a shuffle: a cell's postings are cut into blocks of about ``BLOCK``, its anchors into
chunks of about ``CHUNK``, and each pair of these is one group of a matrix product. Nothing else is held whole.

Defined results. No part take rows without an id or label, with a null or empty vector, a null or non-finite component, a
component whose products would pass a long (``floor(scale * x)`` above ``sqrt(2^63 / width)``), or another than the
commonest width. An id is one row: of several with one id that with the smallest label, then vector. Ties go to the
smaller id; fewer rows than asked for: all. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .neighbours import matrix, vector_key

SAMPLE_BYTES = 8 << 20
#: Classes that a cell holds on average.
CELL = 200
BLOCK, CHUNK = 2048, 1024
#: Cells of the first round; each later one goes on to eight times as many.
FIRST, GROWTH = 16, 8


def integers(rows: DataFrame, id_column: str, vector: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, vector`` (array of long) of the rows that take part."""
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("vector")).dropna()
    rows = rows.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = width[0] if width else 1
    most = float(np.sqrt(2.0**63 / width))
    rows = rows.where((F.size("vector") == width) & F.forall("vector", lambda x: F.abs(x * scale) < most - 1)) \
        .select("vec_id", "label", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector")


def classes(rows: DataFrame, most: int) -> DataFrame:
    """Distinct ``key, label, vector`` and their ``most`` smallest ids; the window's limit also runs before its shuffle."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= most)
    return first.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Book:
    """The half spaces' codebooks; radii are set once all classes are assigned."""

    def __init__(self, sample: np.ndarray, size: int, seed: int):
        self.half = (sample.shape[1] + 1) // 2
        rng = np.random.default_rng(seed)
        self.centroids = [self._means(np.unique(h, axis=0), size, rng) for h in self.halves(sample)]
        self.radii: list[np.ndarray] = []

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        sq = (c * c).sum(1)
        return np.concatenate([(sq - 2 * (x[i:i + 4096] @ c.T)).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def _means(self, x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
        c = x[rng.choice(len(x), min(size, len(x)), replace=False)]
        for _ in range(8):
            own = self.nearest(x, c)
            order = np.argsort(own, kind="stable")
            used, start = np.unique(own[order], return_index=True)
            c = np.add.reduceat(x[order], start, axis=0) / np.diff(np.append(start, len(x)))[:, None] if x.shape[1] else c
        return c

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Cells, and per half the centroid and its distance."""
        near, far = [], []
        for h, c in zip(self.halves(x), self.centroids):
            own = self.nearest(h, c)
            near.append(own)
            far.append(np.sqrt(((h - c[own]) ** 2).sum(1)))
        return near[0] * len(self.centroids[1]) + near[1], near, far

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Per half, no member of a centroid scores higher with the row; the margin covers rounding."""
        out = []
        for h, c, r in zip(self.halves(x), self.centroids, self.radii):
            size = np.sqrt((h * h).sum(1))[:, None]
            high = h @ c.T + size * r
            out.append(high + 1e-9 * size * (np.sqrt((c * c).sum(1)) + r) + 1e-6)
        return out


def visit(first: np.ndarray, second: np.ndarray, start: int, stop: int, need: float) -> list[tuple[int, int]]:
    """Cells ``start`` to ``stop`` by their bound (the sum of two half bounds), down to ``need``."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    up, down = first[a].tolist(), second[b].tolist()
    heap, out, seen = [(-(up[0] + down[0]), 0, 0)], [], 0
    while heap and seen < stop:
        minus, i, j = heapq.heappop(heap)
        if -minus < need:
            break
        if seen >= start:
            out.append((int(a[i]), int(b[j])))
        seen += 1
        if j + 1 < len(down):
            heapq.heappush(heap, (-(up[i] + down[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(up):
            heapq.heappush(heap, (-(up[i + 1] + down[0]), i + 1, 0))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of two integer matrices."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2.0**53 else a @ b.T


def best(score: np.ndarray, fits: np.ndarray, first_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's first ``k`` fitting columns, by score, ties by their id."""
    value = np.where(fits, score, np.iinfo(np.int64).min)
    if value.shape[1] > k:
        bound = np.partition(value, value.shape[1] - k, axis=1)[:, value.shape[1] - k]
        fits = fits & (score >= bound[:, None])
    r, c = np.nonzero(fits)
    order = np.lexsort((first_id[c], -score[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def _rounds(state: DataFrame, postings: DataFrame, shipped, compare, hit_schema: str, keep: int, group: list[str], merge, cells: int) -> DataFrame:
    """Search all cells that any of the states needs; ``state`` has key, label, vector, need, found.

    ``compare`` gives a group's hits, the first ``keep`` of each ``group`` are kept, ``merge`` gives them a new need.
    """
    sizes = postings.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    done, start, stop = None, 0, FIRST

    while True:
        def ask(batches: Iterator[pa.RecordBatch], start=start, stop=stop) -> Iterator[pa.RecordBatch]:
            book = shipped.value
            for batch in batches:
                one, two = book.bounds(matrix(batch.column("vector")).astype(np.float64)) if batch.num_rows else ([], [])
                for k, need in enumerate(batch.column("need").to_pylist()):
                    if need is None:
                        continue
                    asked = visit(one[k], two[k], start, stop, need)
                    if asked:
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([k] * len(asked))),
                                                          pa.array([i * len(book.centroids[1]) + j for i, j in asked], pa.int64())], names=["key", "cell"])

        asked = stage(state.select("key", "vector", "need").mapInArrow(ask, "key string, cell long"), "cells-asked")
        if not asked.take(1):
            return state if done is None else done.unionByName(state)
        live = state.join(asked.select("key").distinct(), "key", "left_semi")
        rest = state.join(asked.select("key").distinct(), "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        meets = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).join(sizes, "cell")
        left = asked.join(meets, "cell").join(state.drop("found", "need"), "key") \
            .withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = postings.join(meets, "cell").withColumn("block", F.pmod(F.xxhash64("key"), "blocks")) \
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        on = [F.col(c).cast("long").alias(c) for c in ("cell", "block", "chunk")]
        hits = left.select(*on, *[c for c in state.columns if c not in ("found", "need")]).groupBy("cell", "block", "chunk") \
            .cogroup(right.select(*on, "label", "vector", "ids").groupBy("cell", "block", "chunk")).applyInPandas(compare, hit_schema)
        hits = hits.select(*group, "score", F.explode("ids").alias("id"))
        before = live.select("key", F.explode("found").alias("f")).select("key", "f.*")
        every = hits.unionByName(before.select(hits.columns))
        nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id"))
        kept = every.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")
        found = kept.groupBy("key").agg(F.collect_list(F.struct(*[c for c in hits.columns if c != "key"])).alias("found"))
        state = stage(merge(live.drop("found", "need").join(found, "key", "left")), "anchors")
        if stop >= cells:
            return done.unionByName(state)
        start, stop = stop, stop * GROWTH


def _empty(schema: dict) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=t) for c, t in schema.items()})


def mine(vectors: DataFrame, anchors: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, seed: int = 7) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds (on vec_id).

    An anchor's positives are its best other rows of its label. For each, the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_column, vector, label, scale)
    rows = stage(rows.withColumn("key", F.concat_ws(":", "label", vector_key(F.col("vector")))), "integer-vectors")
    distinct = stage(classes(rows, max(positives + 1, negatives)), "vector-classes")
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = len(distinct.select("vector").first()[0])
    most = max(64, SAMPLE_BYTES // (8 * width))
    sample = distinct.select("vector") if n <= most else distinct.select("vector").sample(0.95 * most / n, seed)
    sample = matrix(sample.toArrow().column("vector").combine_chunks())  # bounded by SAMPLE_BYTES
    if not len(sample):
        sample = np.array([distinct.select("vector").first()[0]])
    book = Book(sample.astype(np.float64), max(1, round(np.sqrt(n / CELL))), seed)
    plain = spark.sparkContext.broadcast(book)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, near, far = plain.value.assign(matrix(batch.column("vector")).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *map(pa.array, near), *map(pa.array, far),
                                              *[batch.column(c) for c in ("key", "label", "vector", "ids")]],
                                             names=["cell", "i", "j", "di", "dj", "key", "label", "vector", "ids"])

    postings = stage(distinct.mapInArrow(post, "cell long, i long, j long, di double, dj double, key string, label long, vector array<long>, ids array<long>"), "postings")
    for side, far, c in (("i", "di", book.centroids[0]), ("j", "dj", book.centroids[1])):
        radius = np.full(len(c), -np.inf)  # a centroid without members is never a way to a row
        for r in postings.groupBy(side).agg(F.max(far).alias("r")).collect():  # a row per centroid
            radius[r[side]] = r["r"]
        book.radii.append(np.where(np.isfinite(radius), radius, 0.0))
    shipped = spark.sparkContext.broadcast(book)
    postings = postings.select("cell", "key", "label", "vector", "ids")
    cells = len(book.centroids[0]) * len(book.centroids[1])

    asked = stage(rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "key"), "anchor-rows")
    start = distinct.join(asked.select("key").distinct(), "key", "left_semi").select("key", "label", "vector")

    def same_label(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _empty({"key": str, "score": "int64", "ids": object})
        score = products(np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy()))
        fits = left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None]
        ids = right["ids"].to_numpy()
        r, c = best(score, fits, np.array([i[0] for i in ids]), positives + 1)
        return pd.DataFrame({"key": left["key"].to_numpy()[r], "score": score[r, c], "ids": ids[c]})

    def positive_need(state: DataFrame) -> DataFrame:
        last = F.array_min(F.transform("found", lambda f: f["score"])).cast("double")
        return state.withColumn("need", F.when(F.size("found") > positives, last).otherwise(float("-inf")))

    state = start.select("*", F.lit(float("-inf")).alias("need"), F.array().cast("array<struct<score:long,id:long>>").alias("found"))
    ranked = _rounds(state, postings, shipped, same_label, "key string, score long, ids array<long>", positives + 1, ["key"], positive_need, cells)
    ranked = stage(ranked.select("key", "label", "vector", F.array_sort(F.transform("found", lambda f: F.struct((-f["score"]).alias("minus"), f["id"].alias("id")))).alias("found")), "positives")

    # windows: distinct positive scores; those below 0 hold nothing (when low < high)
    scores = F.array_distinct(F.transform("found", lambda f: -f["minus"]))
    windows = ranked.select("key", "label", "vector", F.filter(scores, lambda s: low * s <= high * s).alias("windows"))
    floor_of = lambda s: F.ceil(F.lit(low) * s / F.lit(100))  # noqa: E731  only a bound for the search, the test itself is exact

    def window_need(state: DataFrame) -> DataFrame:
        mine_of = lambda w: F.filter("found", lambda f: f["window"] == w)
        need = F.transform("windows", lambda w: F.when(F.size(mine_of(w)) >= negatives, F.array_min(F.transform(mine_of(w), lambda f: f["score"])))
                           .otherwise(floor_of(w) - 1).cast("double"))
        return state.withColumn("need", F.array_min(need))

    def other_labels(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [_empty({"key": str, "window": "int64", "score": "int64", "ids": object})]
        if len(left) and len(right):
            score = products(np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy()))
            differs = left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None]
            ids, key = right["ids"].to_numpy(), left["key"].to_numpy()
            first = np.array([i[0] for i in ids])
            row = np.repeat(np.arange(len(left)), [len(w) for w in left["windows"]])
            edge = np.concatenate([np.asarray(w, np.int64) for w in left["windows"]]) if len(row) else np.zeros(0, np.int64)
            for at in range(0, len(row), 512):
                r0, e = row[at:at + 512], edge[at:at + 512]
                s = score[r0]
                least, top = np.array([-(-low * int(x) // 100) for x in e]), np.array([high * int(x) // 100 for x in e])
                r, c = best(s, differs[r0] & (s >= least[:, None]) & (s <= top[:, None]), first, negatives)
                found.append(pd.DataFrame({"key": key[r0[r]], "window": e[r], "score": s[r, c], "ids": ids[c]}))
        return pd.concat(found)

    state = window_need(windows.withColumn("found", F.array().cast("array<struct<window:long,score:long,id:long>>")))
    near = _rounds(state, postings, shipped, other_labels, "key string, window long, score long, ids array<long>", negatives, ["key", "window"], window_need, cells)
    near = near.select("key", F.explode("found").alias("f")).groupBy("key", F.col("f.window").alias("positive_score")) \
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("f.score")).alias("minus"), F.col("f.id").alias("id")))).alias("near"))

    pairs = asked.join(ranked.select("key", "found"), "key").select("anchor_id", "key", F.explode(F.slice(
        F.filter("found", lambda f: f["id"] != F.col("anchor_id")), 1, positives)).alias("p")) \
        .select("anchor_id", "key", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"))
    out = pairs.join(near, ["key", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("near").alias("at", "x"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
                      "positive_score", (-F.col("x.minus")).alias("negative_score"))
