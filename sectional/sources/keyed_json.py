"""Keyed-JSON files read in parallel (S1): ``{key: record, ...}`` of any size, cut by records.

Spark's text reader cuts a file into splits at ``},`` (its line separator here; it stands between the records of what JSON
writers write, and where it doesn't, a split is larger), so no task reads a whole file and any store that Spark reads will
do. Where a split begins inside a string, or how deep, follows from the splits before
it: a first pass sums up each split for both cases (quotes, and change of depth), a window per file chains the sums, and
the second pass cuts each split at the commas between records. What lies across a border of splits comes as pieces,
which meet by file and record. A task holds one record at a time beside its batch.

A file may hold several such objects one after another. Entries that aren't ``"key": value``, values that don't parse as
the record, text around an object and a file that ends inside one are rejects, each with its file, place and reason. A
key that occurs twice gives two rows. Files without text give none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_KEY = re.compile(rb'\s*("(?:[^"\\]|\\.)*")\s*:\s*', re.DOTALL)
_PIECES = "fid long, block long, place int, opened string, closed string, text binary"
#: What the reader cuts at; it must not end in a backslash.
_SEPARATOR = b"},"
_QUOTE, _SLASH, _COMMA, _OPEN, _CLOSE = 34, 92, 44, 123, 125
#: Change of depth by byte, and the bytes that matter.
_STEP = np.zeros(256, np.int8)
_STEP[[_OPEN, 91]], _STEP[[_CLOSE, 93]] = 1, -1
_MATTERS = _STEP != 0
_MATTERS[[_QUOTE, _COMMA]] = True


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``fid, file, size`` of the files, from their listing."""
    listed = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))
    return listed.select(F.xxhash64("file").alias("fid"), "file", "size")


def _fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What lies between separators, in order inside each split (``fid``, ``block``)."""
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", _SEPARATOR.decode()).text(paths)
    return text.select(F.xxhash64(meta["file_path"]).alias("fid"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[bytes]]]:
    """Each split's fragments as runs of bytes, the separator after each put back, the split's last one alone."""
    def parts():
        for batch in batches:
            fid, block, values = (batch.column(c) for c in ("fid", "block", "value"))
            fid, block = fid.to_numpy(), block.to_numpy()
            ends = np.append(np.flatnonzero((fid[1:] != fid[:-1]) | (block[1:] != block[:-1])) + 1, len(fid))
            at = 0
            for end in ends.tolist():
                if end > at:
                    yield (int(fid[at]), int(block[at])), values.slice(at, end - at)
                at = end

    def runs(found):
        held = None
        for _, values in found:
            if held is not None:
                yield held + _SEPARATOR
            held = values[len(values) - 1].as_py()
            if len(values) > 1:
                values = values.slice(0, len(values) - 1)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.concat_arrays([values])), pa.scalar(_SEPARATOR, values.type))
                yield joined[0].as_py() + _SEPARATOR
        yield held + _SEPARATOR

    for key, found in groupby(parts(), key=lambda r: r[0]):
        yield key, runs(found)


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of the bytes that matter, those bytes, whether they lie in a string if the data begin outside of one (quotes
    count as inside), and whether the data then end in one. Data begin after a separator, so no backslash counts before them."""
    at = np.flatnonzero(_MATTERS[data])
    byte = data[at]
    quotes = np.flatnonzero(byte == _QUOTE)
    place, odd = at[quotes], np.zeros(len(quotes), bool)
    open_runs, back = np.arange(len(quotes)), 1
    while len(open_runs):
        open_runs = open_runs[place[open_runs] >= back]
        open_runs = open_runs[data[place[open_runs] - back] == _SLASH]
        odd[open_runs] ^= True
        back += 1
    real = np.zeros(len(at), bool)
    real[quotes[~odd]] = True
    after = np.cumsum(real) % 2 == 1
    return at, byte, after | real | (byte == _QUOTE), bool(after[-1]) if len(after) else False


def _outside(byte: np.ndarray, strings: np.ndarray, inside: bool) -> np.ndarray:
    """Which of the bytes are structure, if the data begin inside a string or not."""
    return (byte != _QUOTE) & (strings == inside)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: bytes, whether quotes flip it, and the change of depth if it begins outside or inside a string."""
    for (fid, block), runs in _blocks(batches):
        total, flipped, depth = 0, False, [0, 0]
        for run in runs:
            data = np.frombuffer(run, np.uint8)
            total += len(data)
            _, byte, strings, flips = _structure(data)
            for k in (0, 1):
                depth[k] += int(_STEP[byte[_outside(byte, strings, bool(k) ^ flipped)]].sum(dtype=np.int64))
            flipped ^= flips
        yield pa.RecordBatch.from_pydict({"fid": [fid], "block": [block], "bytes": [total], "flips": [int(flipped)], "out": [depth[0]], "in": [depth[1]]})


def _starts(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """``fid, block, inside, depth, end``: how each split begins; ``end`` is 1 for a file's last one, 2 if no separator follows it."""
    sums = fragments.mapInArrow(_sums, "fid long, block long, bytes long, flips long, `out` long, `in` long").join(files, "fid")
    before = Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("fid")
    chained = sums.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2) \
        .withColumn("delta", F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("in")))
    last = F.when(F.col("block") == F.max("block").over(whole), F.when(F.sum("bytes").over(whole) > F.col("size"), 2).otherwise(1)).otherwise(0)
    return chained.select("fid", "block", F.col("inside").cast("int").alias("inside"), F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"), last.alias("end"))


def _cut(starts) -> callable:
    """Cut splits at an object's opening brace, at the commas between its entries, and at its closing brace."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = starts.value
        out: list[tuple] = []
        for (fid, block), runs in _blocks(batches):
            inside, depth, end = table[fid, block]
            inside, place, opened, held = bool(inside), 0, "", []
            for data in _without_last_separator(runs, end == 2):
                at, byte, strings, flips = _structure(np.frombuffer(data, np.uint8))
                outside = _outside(byte, strings, inside)
                at, byte = at[outside], byte[outside]
                level = depth + np.cumsum(_STEP[byte], dtype=np.int64)
                cuts = at[((byte == _OPEN) & (level == 1)) | ((byte == _COMMA) & (level == 1)) | ((byte == _CLOSE) & (level == 0))]
                inside, depth, done = inside ^ flips, int(level[-1]) if len(level) else depth, 0
                for c in cuts.tolist():
                    held.append(data[done:c])
                    sign = chr(data[c])
                    out.append((fid, block, place, opened, sign, b"".join(held)))
                    place, opened, held, done = place + 1, sign, [], c + 1
                held.append(data[done:])
                if len(out) >= 200:
                    yield _batch(out)
                    out = []
            out.append((fid, block, place, opened, "end" if end else "", b"".join(held)))
        if out:
            yield _batch(out)
    return run


def _without_last_separator(runs: Iterator[bytes], drop: bool) -> Iterator[bytes]:
    last = None
    for run in runs:
        if last is not None:
            yield last
        last = run
    if last is not None:
        yield last[:-len(_SEPARATOR)] if drop else last


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["fid", "block", "place", "opened", "closed", "text"])


def _entry(opened: str, closed: str, text: bytes) -> tuple[str | None, str | None, str | None] | None:
    """(key, value, None) of an entry, (None, None, reason), or None for what is nothing."""
    blank = not text.strip()
    if opened not in ("{", ","):
        return None if blank else (None, None, "text outside an object")
    if closed == "end":
        return None, None, "ends inside an object"
    if blank:
        return None if opened == "{" and closed == "}" else (None, None, "empty entry")
    found = _KEY.match(text)
    if not found:
        return None, None, "not a key and a value"
    try:
        return json.loads(found[1]), text[found.end():].decode("utf-8"), None
    except ValueError:
        return None, None, "not a key and a value"


def _entries(names) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200).to_pylist()
                yield from _rows([(names.value[r["fid"]], r["block"], r["place"], *e) for r in rows if (e := _entry(r["opened"], r["closed"], r["text"]))])
    return run


def _rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["file", "block", "place", "key", "value", "reason"])


def entries(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, block, place, key, value`` (JSON text) of all entries, or ``reason`` for what is none; block and place tell the order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fragments, files = _fragments(spark, paths), _files(spark, paths)
    starts = {(r["fid"], r["block"]): (r["inside"], r["depth"], r["end"]) for r in _starts(fragments, files).collect()}  # a row per split
    pieces = fragments.mapInArrow(_cut(spark.sparkContext.broadcast(starts)), _PIECES)
    whole = pieces.where((F.col("opened") != "") & ~F.col("closed").isin("", "end"))
    # the others lie at a border: a chain is the last piece of a split, whole splits without a cut, and the first piece of one
    edge = pieces.where((F.col("opened") == "") | F.col("closed").isin("", "end"))
    order = Window.partitionBy("fid").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = edge.withColumn("chain", F.sum((F.col("opened") != "").cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "opened", "closed", "text")))
    joined = chained.groupBy("fid", "chain").agg(parts.alias("p")).select(
        "fid", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"), F.col("p")[0]["opened"].alias("opened"),
        F.element_at("p", -1)["closed"].alias("closed"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"])).alias("text"))
    names = spark.sparkContext.broadcast({r["fid"]: r["file"] for r in files.collect()})  # the listing, which the driver has anyway
    return whole.unionByName(joined).mapInArrow(_entries(names), "file string, block long, place int, key string, value string, reason string")


def records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, key: str) -> DataFrame:
    """``key``, the record's columns, ``_file`` and ``_reason`` (null for a good record)."""
    bad = "_bad"
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = entries(spark, paths).select("file", "key", "value", "reason", parsed.alias("r"))
    nothing = F.col("value").isNull() | (F.trim(F.translate("value", "\n\r\t", "   ")) == "null")
    wrong = F.when(~nothing & (F.col("r").isNull() | F.col(f"r.{bad}").isNotNull()), F.lit("not a record"))
    return rows.select(F.col("key").alias(key), *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields], F.col("file").alias("_file"),
                       F.coalesce("reason", wrong).alias("_reason"))
