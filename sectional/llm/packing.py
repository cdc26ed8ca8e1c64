"""Packing documents into sequences: a configuration linear program over the length histogram, rounded.

Documents become token ids (and a closing id 0); longer ones are cut into pieces of ``capacity`` tokens, the first of
which takes the remainder. Only the histogram of piece lengths (at most ``capacity`` rows, whatever the input) reaches
the driver. There, patterns (multisets of lengths within the capacity) are priced by multiplicative weights: each length
has a price that falls as it gets covered, and a knapsack dynamic program finds the patterns of the largest price. The
fractional solution is rounded down; the pieces over go best fit decreasing, a class of equal lengths at a time. The
result is a table of patterns with counts, whose size depends on the capacity and the rounds only. Tasks then give the r-th piece of a length its slot by
arithmetic; r comes from per-partition counts, so a length that a third of all pieces has is spread over all tasks.

Defined results. Null text: empty, which is the closing id alone. Empty table: no pieces. Repeated rows and null ids: each
row is a document. The strings of ``added`` tokens in a text are those tokens. Extra columns that clash are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_slices

CAPACITY = 2048
ROUNDS = 100
#: Chunks of text whose ids a task remembers at most.
CACHE = 200_000
#: Fixed value: the byte-level vocabulary's pattern for cutting text before merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Chunks(dict):
    """What follows a single space and holds no space -> the ids of the space and it."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Together
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = ids = array("I", self.encode(" " + chunk)).tobytes()
        return ids


class _Together(Exception):
    """White space runs across a cut; the text has to be encoded as one."""


class Encoder:
    """Texts to little-endian uint32 ids.

    A single space between other characters always begins a piece of the pattern, and merges never cross pieces, so a
    text is cut at those spaces and each chunk's ids are made once. The rank file is the same vocabulary, and gives
    the same ids, as the tokenizers file (which a test compares on arbitrary text); it encodes short chunks faster.
    That file's ``added`` tokens are cut out of the text before and get their own ids.
    """

    def __init__(self, ranks_path: str, added: dict[str, int] | None = None):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.encode = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = _Chunks(self.encode)
        self.added = {t: array("I", [i]).tobytes() for t, i in (added or {}).items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __call__(self, text: str) -> bytes:
        if self.cuts is None or not self.cuts.search(text):
            return self._plain(text)
        return b"".join(self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(self.cuts.split(text)))

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            if head and head[-1].isspace():
                raise _Together
            return array("I", self.encode(head)).tobytes() + b"".join(map(self.chunks.__getitem__, rest))
        except _Together:
            return array("I", self.encode(text)).tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first takes what the others leave."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           capacity: int = CAPACITY, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """The columns ``keep``, piece, start, length, ids_crc32 (and the ids), ``part`` and ``nth``: the how manieth piece
    of its length in its partition."""
    names = [*keep, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "part", "nth"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + ["piece int, start long, length long, ids_crc32 long", *(["ids binary"] if with_ids else []), "part int, nth long"])
    end = np.array([0], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, seen, part = Encoder(ranks_path, added), Counter(), TaskContext.get().partitionId()
        for rows, texts in text_slices(batches, text, 1 << 20):
            src, cols = [], {n: [] for n in names[len(keep):]}
            for k, ids in enumerate(map(encode, texts.to_pylist())):
                ids += end
                for p, (s, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * s:4 * (s + length)]
                    src.append(k)
                    for n, v in (("piece", p), ("start", s), ("length", length), ("ids_crc32", zlib.crc32(own)), ("part", part), ("nth", seen[length])):
                        cols[n].append(v)
                    if with_ids:
                        cols["ids"].append(own)
                    seen[length] += 1
            kept = [rows.column(c).take(pa.array(src, pa.int64())) for c in keep]
            kinds = {"piece": pa.int32(), "part": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, kinds.get(n, pa.int64())) for n, v in cols.items()]], names=names)

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)


def knapsack(weight: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best weight for each room, and the last length taken (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        m = int(np.searchsorted(lengths, room, side="right"))
        value = weight[:m] + best[room - lengths[:m]]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], took[room] = value[k], k
        else:
            best[room] = best[room - 1]
    return best, took


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, eta: float = 1.0, slack: float = 0.05,
          step: float = 0.2) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with how many sequences each makes; they hold the histogram exactly.

    The program: fewest sequences over patterns, each length covered as often as it occurs. Its dual prices start at the
    lengths (optimal where volume is what binds) and fall by exp(-eta * share covered). A round prices all patterns by
    one knapsack table, and for each length takes the best pattern with it if its price is within ``slack`` of the
    best of all, as often as ``step`` of what its scarcest length still lacks. Rounded down, the rest is packed best fit.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    count = np.array([histogram[int(v)] for v in lengths], np.int64)
    need, covered = count.astype(float), np.zeros(len(lengths))
    x: dict[tuple, float] = Counter()
    for _ in range(rounds):
        price = lengths * np.exp(-eta * covered / need)
        best, took = knapsack(price, lengths, capacity)
        for k in np.flatnonzero(price + best[capacity - lengths] >= (1 - slack) * best[capacity])[::-1]:
            found, room = Counter([int(k)]), capacity - int(lengths[k])
            while room > 0:
                if took[room] < 0:
                    room -= 1
                    continue
                found[int(took[room])] += 1
                room -= int(lengths[took[room]])
            times = step * min((need[i] - covered[i]) / t for i, t in found.items())
            if times < 0.01:
                continue
            for i, t in found.items():
                covered[i] += times * t
            x[tuple(sorted(found.items()))] += times
    left = count.copy()
    out = []
    for pattern, times in x.items():
        at, each = np.array([i for i, _ in pattern]), np.array([t for _, t in pattern])
        n = min(int(times + 1e-9), int((left[at] // each).min()))
        if n > 0:
            out.append((tuple((int(lengths[i]), t) for i, t in pattern), n))
            left[at] -= n * each
    return out + best_fit({int(v): int(n) for v, n in zip(lengths, left) if n}, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing over a histogram, a class of equal sequences at a time."""
    left = dict(histogram)
    order = sorted(left, reverse=True)
    out: Counter = Counter()
    for big in order:
        while left.get(big, 0) > 0:
            room, pattern = capacity, Counter()
            for v in order:  # the largest that fits, as often as it fits
                if v > room or not left.get(v, 0):
                    continue
                t = min(room // v, left[v])
                if v == big and not pattern:
                    t = max(1, t)
                pattern[v] += t
                room -= t * v
            n = min(left[v] // t for v, t in pattern.items())
            for v, t in pattern.items():
                left[v] -= n * t
            out[tuple(sorted(pattern.items()))] += n
    return list(out.items())


class Slots:
    """Where the r-th piece of a length goes: (sequence, offset), by arithmetic over the pattern table."""

    def __init__(self, plan):
        by: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, times, first sequence, first offset)
        given: Counter = Counter()
        sequence = 0
        for pattern, n in plan:
            offset = 0
            for length, times in pattern:
                by.setdefault(length, []).append((given[length], times, sequence, offset))
                given[length] += n * times
                offset += length * times
            sequence += n
        self.by = {length: np.array(rows, np.int64) for length, rows in by.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for v in np.unique(length):
            at = np.flatnonzero(length == v)
            table = self.by[int(v)]
            row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
            inner = rank[at] - row[:, 0]
            seq[at] = row[:, 2] + inner // row[:, 1]
            off[at] = row[:, 3] + inner % row[:, 1] * v
        return seq, off


def pack(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, rounds: int = ROUNDS, **options) -> DataFrame:
    """The pieces with sequence_id and offset; each sequence holds at most ``capacity`` tokens without gaps."""
    cut_up = stage(pieces(docs, ranks_path, capacity=capacity, **options), "pieces")
    counts = stage(cut_up.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").sum("n").collect()}  # at most `capacity` rows
    slots = docs.sparkSession.sparkContext.broadcast(Slots(solve(histogram, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = cut_up.join(first, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("first")).drop("part", "first")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "nth") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = slots.value(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            kept = [n for n in batch.schema.names if n != "nth"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
