"""Near duplicates by an LSH forest: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. Each text becomes its set of 64-bit shingle hashes, of which are kept: the size, a 128-bit digest of the set and a
   signature of TREES * DEPTH minima, ten bits of each; a tree's DEPTH minima are one number, its ``path``. Documents with
   equal sets are one class, named by its smallest doc_id.
2. The forest: per tree, classes in the order of their paths. A class that shares no MIN_DEPTH minima with a neighbour in
   the order is alone in that tree and goes no further there.
3. First, each class is compared with its neighbour in the sorted order when their longest common prefix is at least
   ``MIN_DEPTH``. Confirmed links make components, so that a group of thousands of near copies takes linear work.
4. Then regions: classes with a common prefix. A region starts at MIN_DEPTH; while it holds more than ``REGION`` classes
   it is cut by one more minimum. Within a region, pairs of different components whose signatures agree enough are
   candidates, each in the first tree whose region holds both. What is still too large at full depth is compared block by
   block, none left out.
5. Candidates are confirmed on the full sets, and all links together give the components.

Two texts of similarity 0.8 share all DEPTH minima of some tree with a probability of over 0.9999, so a pair meets as
surely in regions that are cut to the full depth; a pair is dropped by its signature if fewer than ``AGREE`` of its minima
agree, which is over 7 standard deviations off.

Defined results. Null or empty texts, or texts without words: an empty set, linked with nothing. Rows without an id are
linked with nothing and kept (component null). Rows that repeat a doc_id stand for one document, each with the component of its
own text. Repeated texts are one class.
Empty tables give no rows. Whole texts are read; extra columns are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_table, mapped, mix64, split_words, stage, text_slices, word_hashes
from .components import components

TREES, DEPTH, MIN_DEPTH = 32, 6, 3
REGION = 256
AGREE = 114
MINIMA = TREES * DEPTH
_FACTORS = np.random.default_rng(9).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of a minimum in a path.
BITS = 10
_SHIFTS = np.uint64(BITS) * np.arange(DEPTH - 1, -1, -1, dtype=np.uint64)
_CUT = BITS * (DEPTH - np.arange(DEPTH + 1))  # bits of a path below its first minima, by their number
#: Bits of the filter that keeps texts without a wanted id out of a shuffle: at most 2 ** 19 rows of 64 bits are broadcast.
SIEVE_BITS = 25
_PAIR, _ALONE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def shingle_sets(text: pa.Array, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted within the row, in one array, and the rows' offsets in it."""
    words, off = split_words(mapped(text, lower_table()))
    h = word_hashes(words)
    out, sizes = [], np.zeros(len(text) + 1, np.int64)
    if len(h):
        rolled = h.copy()
        for k in range(1, n):
            rolled = mix64(rolled * _PAIR + np.concatenate([h[k:], h[:k]]))
    for i in range(len(text)):
        a, b = off[i], off[i + 1]
        if b - a >= n:
            own = np.unique(rolled[a:b - n + 1])
        elif b > a:  # the whole sequence is the one shingle
            own = h[a:a + 1] * _ALONE
            for k in range(a + 1, b):
                own = mix64(own * _ALONE + h[k:k + 1])
        else:
            continue
        out.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def signatures(docs: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (the set's digest), paths (a number per tree; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text):
            sets, off = shingle_sets(texts, n)
            size = np.diff(off)
            full = size > 0
            at = off[:-1][full]
            d1, d2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            minima = np.zeros((len(texts), MINIMA), np.uint32)
            if len(sets):
                d1[full] = np.add.reduceat(mix64(sets), at)
                d2[full] = np.add.reduceat(mix64(sets ^ _PAIR), at)
                for k, factor in enumerate(_FACTORS):
                    minima[full, k] = np.minimum.reduceat((sets * factor) >> np.uint64(32), at)
            digits = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(-1, TREES, DEPTH)
            paths = (digits << _SHIFTS).sum(axis=2, dtype=np.uint64).view(np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.where(full, TREES, 0))]), pa.int32(), mask=np.append(~full, False))
            yield pa.RecordBatch.from_arrays([rows.column(doc_id).cast(pa.int64()), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                                              pa.ListArray.from_arrays(ends, pa.array(paths[full].ravel()))], names=["doc_id", "n_shingles", "d1", "d2", "paths"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias(doc_id), f"`{text}`").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, paths array<long>")


def digits_of(paths: np.ndarray) -> np.ndarray:
    """[row, minimum] from [row, tree]; the last byte of each digit, which is enough to see whether they agree, but for one in 256."""
    return ((paths.astype(np.uint64)[:, :, None] >> _SHIFTS) & np.uint64(255)).astype(np.uint8).reshape(len(paths), -1)


def prefix(path, depth: int):
    """The first ``depth`` minima of a path column."""
    return F.shiftright(path, BITS * (DEPTH - depth))


def forest(reps: DataFrame) -> DataFrame:
    """A row per tree and class: tree, path, node."""
    return reps.select("node", F.posexplode("paths").alias("tree", "path")).select(F.col("tree").cast("byte").alias("tree"), "path", "node")


def sorted_neighbours(trees: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that are next to each other in a tree's order and share at least MIN_DEPTH minima; and the rows (tree,
    path, node) that may share as many with any other row.

    The order is a range-partitioned sort; the first and last rows of the partitions are paired in a window over that
    small table, and are kept as rows that may share.
    """
    parts = max(trees.sparkSession.sparkContext.defaultParallelism, int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = trees.repartitionByRange(parts, "tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    cut = BITS * (DEPTH - MIN_DEPTH)
    kinds = "tree byte, path long, node long, next long, part int, head long, tail long, last long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that share with the row before or after them (``next``: the node after a row, where it shares); at last the ends."""
        from pyspark import TaskContext

        part, head, held = TaskContext.get().partitionId(), None, None

        def key(tree, path):
            return (tree.astype(np.int64) << (60 - cut)) | (path >> cut)

        def rows(tree, path, node, after, shown):
            n, nothing = int(shown.sum()), pa.nulls(int(shown.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(tree[shown], pa.int8()), pa.array(path[shown]), pa.array(node[shown]), pa.array(after[shown], pa.int64(), mask=after[shown] == NONE),
                                               pa.nulls(n, pa.int32()), nothing, nothing, nothing], names=names)

        names = ["tree", "path", "node", "next", "part", "head", "tail", "last"]
        for batch in batches:
            tree, path, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "path", "node"))
            if not len(tree):
                continue
            if held is not None:  # the last row of the batch before, and whether it shares with the one before it
                tree, path, node = (np.append(h, x) for h, x in zip(held, (tree, path, node)))
            k = key(tree, path)
            same = k[1:] == k[:-1]
            after = np.append(np.where(same & (node[1:] != node[:-1]), node[1:], NONE), NONE)
            shown = np.append(same, False) | np.append(held is not None and held[3], same)
            if head is None:
                head = (int(k[0]), int(node[0]))
                shown[0] = True
            held = (tree[-1:], path[-1:], node[-1:], bool(len(same) and same[-1]))
            yield rows(tree[:-1], path[:-1], node[:-1], after[:-1], shown[:-1])
        if held is not None:
            yield rows(held[0], held[1], held[2], np.array([NONE]), np.array([True]))
            ends = [pa.array([head[1]]), pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([head[0]]), pa.array([int(key(held[0], held[1])[0])]), pa.array([int(held[2][0])])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int8()), pa.nulls(1, pa.int64()), *ends], names=names)

    found = stage(ordered.mapInArrow(run, kinds), name)
    order = Window.orderBy("part")
    edges = found.where("part is not null").withColumn("pa", F.lag("last").over(order)).withColumn("pk", F.lag("tail").over(order)) \
        .where(F.col("pk") == F.col("head")).select(F.col("pa").alias("a"), F.col("node").alias("b"))
    pairs = found.where("part is null and next is not null").select(F.col("node").alias("a"), F.col("next").alias("b")).unionByName(edges)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), found.where("part is null").select("tree", "path", "node")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=1)


def by_signature(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow the similarity."""
    one = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("paths").alias("ma"))
    two = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("paths").alias("mb"))
    sized = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (digits_of(batch.column(c).flatten().to_numpy().reshape(-1, TREES)) for c in ("ma", "mb"))
            keep = pa.array(_agreement(x, y) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return sized.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long").distinct()


def sieved(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``rows`` whose node may be in ``nodes``: a bitmap of the nodes' hashes goes to all tasks, of a size that is bounded
    however many they are; rows that it lets through by chance are few and no others are lost."""
    place = lambda: F.pmod(F.xxhash64("node"), F.lit(1 << SIEVE_BITS))
    bit = lambda: F.expr("shiftleft(1L, cast(sieve_place & 63 as int))")
    bits = nodes.select("node").distinct().select(place().alias("sieve_place")).groupBy(F.shiftright("sieve_place", 6).alias("sieve_word")).agg(F.bit_or(bit()).alias("sieve_bits"))
    placed = rows.withColumn("sieve_place", place()).withColumn("sieve_word", F.shiftright("sieve_place", 6))
    return placed.join(F.broadcast(bits), "sieve_word").where(F.col("sieve_bits").bitwiseAND(bit()) != 0).select(*rows.columns)


def sets_of(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """node, set (its sorted shingle hashes) for the ids in ``nodes``; other documents aren't read into sets."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))
    # not a semi-join, which would be put below the sieve
    wanted = sieved(texts, nodes).join(nodes.select("node").distinct(), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            flat, off = shingle_sets(texts, n)
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([flat[off[i]:off[i + 1]].tobytes() for i in range(len(texts))], pa.binary())], names=["node", "set"])

    return wanted.mapInArrow(sets, "node long, set binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str, n: int, percent: int, name: str) -> DataFrame:
    """The pairs of ids whose full sets are similar enough."""
    pairs = stage(pairs, f"{name}-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    known = stage(sets_of(docs, nodes, text, doc_id, n), f"{name}-sets")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(known.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([similar(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("sa", "sb")), percent) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long").distinct()


def regions_at(sizes: DataFrame) -> DataFrame:
    """The prefixes with more than one component: tree, prefix, members and the largest component, from its rows' number in each."""
    return sizes.groupBy("tree", "prefix").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")) \
        .where("parts > 1").select("tree", "prefix", "members", "most")


def deeper_regions(rows: DataFrame) -> DataFrame:
    """The regions below MIN_DEPTH of rows in larger ones: tree, depth, prefix, members, most.

    They follow from counts alone, so no row is joined to a region that is cut further.
    """
    sizes = stage(rows.groupBy("tree", F.col("path").alias("prefix"), "component").agg(F.count("*").alias("n")), "region-sizes")
    found, cut = [], None
    for depth in range(MIN_DEPTH + 1, DEPTH + 1):
        own = sizes.groupBy("tree", prefix("prefix", depth).alias("prefix"), "component").agg(F.sum("n").alias("n"))
        regions = regions_at(own)
        if cut is not None:  # what is in a region that is small enough already is none of its own
            regions = regions.withColumn("above", F.shiftright("prefix", BITS)).join(cut, ["tree", "above"], "left_semi").drop("above")
        regions = stage(regions, f"regions-{depth}")
        cut = regions.where(F.col("members") > REGION).select("tree", F.col("prefix").alias("above"))
        found.append((regions if depth == DEPTH else regions.where(F.col("members") <= REGION)).withColumn("depth", F.lit(depth)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def regions_of(trees: DataFrame, joined: DataFrame) -> DataFrame:
    """Regions of adaptive depth with more than one component, dealt out in groups: tree, prefix, depth, kind, i, j, main, node,
    component.

    A region's largest component is cut into blocks of about REGION rows, and so are the rows of all its others. Each block
    of the others meets each block of the largest (kind 0) and each block of the others (kind 1): every pair of different
    components meets, rows of the largest don't meet each other.
    """
    rows = stage(trees.join(joined, "node", "left").select("tree", "path", "node", F.coalesce("component", "node").alias("component")), "forest")
    first = regions_at(rows.groupBy("tree", prefix("path", MIN_DEPTH).alias("prefix"), "component").agg(F.count("*").alias("n")))
    met = stage(rows.withColumn("prefix", prefix("path", MIN_DEPTH)).join(first, ["tree", "prefix"]), "regions-met")
    columns = ["tree", "prefix", "depth", "members", "most", "node", "component"]
    ready = met.where(F.col("members") <= REGION).withColumn("depth", F.lit(MIN_DEPTH)).select(columns)
    # a row of a larger region looks all deeper prefixes up at one time, of which one is its region's
    crowded = met.where(F.col("members") > REGION)
    deeper = crowded.select("tree", "path", "node", "component", F.explode(F.sequence(F.lit(MIN_DEPTH + 1), F.lit(DEPTH))).alias("depth")) \
        .withColumn("prefix", F.expr(f"shiftright(path, {BITS} * ({DEPTH} - depth))"))
    found = ready.unionByName(deeper.join(deeper_regions(crowded), ["tree", "depth", "prefix"]).select(columns))
    large, small = F.ceil(F.col("most.n") / REGION).cast("int"), F.ceil((F.col("members") - F.col("most.n")) / REGION).cast("int")
    found = found.withColumn("large", large).withColumn("small", small).withColumn("main", F.col("component") == F.col("most.component"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("large")).otherwise(F.col("small"))).cast("int")
    found = found.withColumn("own", own)
    every = lambda top: F.sequence(F.lit(0), F.col(top) - 1)
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    groups = F.when(F.col("main"), F.transform(every("small"), lambda j: group(0, F.col("own"), j))).otherwise(
        F.concat(F.transform(every("large"), lambda i: group(0, i, F.col("own"))),
                 F.transform(every("small"), lambda j: group(1, F.least(F.col("own"), j), F.greatest(F.col("own"), j)))))
    return found.withColumn("g", F.explode(groups)).select("tree", "prefix", "depth", "g.kind", "g.i", "g.j", "main", "node", "component")


NONE = np.iinfo(np.int64).min
GROUP = ("tree", "prefix", "kind", "i", "j")


def met_before(tree: int, paths: np.ndarray, depths: np.ndarray, own: int, others: np.ndarray) -> np.ndarray:
    """Whether the region of an earlier tree holds a row and each of others."""
    depth = depths[others, :tree]
    apart = (paths[others, :tree] ^ paths[own, :tree]) >> _CUT[depth]
    return ((depth > 0) & (depth == depths[own, :tree]) & (apart == 0)).any(axis=1)


def candidates(comp: np.ndarray, main: np.ndarray, size: np.ndarray, minima: np.ndarray, first: bool, tree: int, paths: np.ndarray, depths: np.ndarray,
               percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a group's rows, sorted by size: a row's number, and those of the later rows of other components that may be similar
    and that it meets here first."""
    n = len(comp)
    ends = np.searchsorted(size, size * 100 // percent, side="right")  # sets beyond are too large to be similar
    for k in range(n - 1):
        at = np.arange(k + 1, ends[k])
        at = at[(comp[at] != comp[k]) & ((main[at] != main[k]) | (not first))]
        if len(at):
            at = at[(minima[at] == minima[k]).sum(axis=1, dtype=np.int16) >= AGREE]
            if len(at) and tree:
                at = at[~met_before(tree, paths, depths, k, at)]
            if len(at):
                yield k, at


def each_group(bucket: pd.DataFrame) -> Iterator[tuple[np.ndarray, tuple]]:
    """The groups of a bucket: their rows' numbers by rising size, and what ``candidates`` takes."""
    code = bucket.groupby(list(GROUP), sort=False).ngroup().to_numpy()
    order = np.lexsort((bucket["n"].to_numpy(), code))
    comp, main, size, kind = (bucket[c].to_numpy()[order] for c in ("component", "main", "n", "kind"))
    paths = (np.stack(bucket["paths"].to_numpy()) if len(bucket) else np.zeros((0, TREES), np.int64))[order]
    minima = digits_of(paths)
    depths = np.zeros((len(bucket), TREES), np.int64)
    for own, held in zip(depths, bucket["depths"].to_numpy()[order]):
        own[np.asarray(held, np.int64) // (DEPTH + 1)] = np.asarray(held, np.int64) % (DEPTH + 1)
    code, tree = code[order], bucket["tree"].to_numpy()[order]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    for a, b in zip(start, np.append(start[1:], len(code))):
        if b - a > 1:
            yield order[a:b], (comp[a:b], main[a:b], size[a:b], minima[a:b], kind[a] == 0, int(tree[a]), paths[a:b], depths[a:b])


def in_buckets(rows: DataFrame, per_bucket: int) -> DataFrame:
    """``rows`` grouped so that each group of GROUP is in one bucket of about ``per_bucket`` rows."""
    buckets = max(1, -(-rows.count() // per_bucket))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*GROUP), F.lit(buckets)))


def region_links(trees: DataFrame, reps: DataFrame, joined: DataFrame, docs: DataFrame, text: str, doc_id: str, n: int, percent: int) -> DataFrame:
    """Confirmed links between different components inside regions, as many as join what a group of a region has to join.

    The groups are read twice: first with signatures only, which leaves the rows that have a candidate; then those meet
    again with their full sets. So what is written grows with the rows, however many pairs are near the bound.
    """
    met = stage(regions_of(trees, joined), "regions")
    # the depth of a class's region in each tree
    held = met.groupBy("node").agg(F.collect_set((F.col("tree") * (DEPTH + 1) + F.col("depth")).cast("int")).alias("depths"))
    short = stage(reps.select("node", "n", "paths").join(held, "node"), "region-classes")
    columns = [*GROUP, "main", "node", "component"]
    kinds = "tree byte, prefix long, kind int, i int, j int, main boolean, node long, component long"

    def keep(bucket: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(bucket), bool)
        for rows, group in each_group(bucket):
            for k, at in candidates(*group, percent):
                hit[rows[k]] = True
                hit[rows[at]] = True
        return bucket.loc[hit, columns]

    left = in_buckets(met.select(columns), 20_000).join(short, "node").groupBy("bucket").applyInPandas(keep, kinds)
    left = stage(left, "region-rows")
    sets = stage(sets_of(docs, left, text, doc_id, n), "region-sets")

    def link(bucket: pd.DataFrame) -> pd.DataFrame:
        node = bucket["node"].to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in bucket["set"]]
        a, b = [], []
        for rows, group in each_group(bucket):
            comp = group[0].copy()
            for k, at in candidates(*group, percent):
                for other in at:
                    x, y = rows[k], rows[other]
                    if comp[k] != comp[other] and similar(own[x], own[y], percent):
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
                        comp[comp == comp[other]] = comp[k]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return in_buckets(left, 4_000).join(short, "node").join(sets, "node").groupBy("bucket").applyInPandas(link, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable over links), kept."""
    found = stage(signatures(docs, text, doc_id, n), "signatures")
    reps = stage(found.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", F.col("n_shingles").alias("n"))
                 .agg(F.min("doc_id").alias("node"), F.first("paths").alias("paths")), "classes")
    near, trees = sorted_neighbours(forest(reps), "neighbours")
    first = stage(confirm(by_signature(near, reps, percent), docs, text, doc_id, n, percent, "first"), "first-links")
    joined = components(first, "first-components")
    more = stage(region_links(trees, reps, joined, docs, text, doc_id, n, percent), "more-links")
    joined = components(first.unionByName(more), "near-components")
    named = reps.join(joined, "node", "left").select("d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))
    out = found.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
