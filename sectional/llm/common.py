"""Arrow and numpy helpers shared by the operators: whole texts as word arrays, batches bounded in bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sectional.session import cut_lineage

#: Text bytes that a task holds as words at one time (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: later steps survive lost executors."""
    return cut_lineage(df, f"llm-{name}")


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the used ones renamed, so that none clashes with what an operator adds; and the
    original name of each renamed column."""
    names = {f"aside_{k}": c for k, c in enumerate(docs.columns) if c not in used}
    back = {c: a for a, c in names.items()}
    return docs.toDF(*[back.get(c, c) for c in docs.columns]), names


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into runs of rows with about ``max_bytes`` of text; null texts become empty.

    Yields the rows and their text as a string array that starts at offset 0.
    """
    for batch in batches:
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        first, n = 0, batch.num_rows
        while first < n:
            base = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            part = text.slice(first, last - first)
            yield batch.slice(first, last - first), pa.concat_arrays([part])
            first = last


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array without nulls, and each row's offsets in them."""
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]] if len(off) else data, off - (off[0] if len(off) else 0)


def mapped(text: pa.Array, table: np.ndarray) -> pa.Array:
    """``text`` with every byte replaced through a 256-entry table (which must keep the UTF-8 valid)."""
    data, off = buffer_of(text)
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(np.ascontiguousarray(off)),
                                                                 pa.py_buffer(table[data])])


def lower_table() -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows in one array, and each row's offsets in it."""
    parts = pc.ascii_split_whitespace(text)
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    off = np.asarray(parts.offsets, dtype=np.int64)
    off = off - off[0] if len(off) else np.zeros(1, np.int64)
    before = np.concatenate([[0], np.cumsum(full)])
    return (flat if full.all() else flat.filter(pa.array(full))), before[off]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row (0 for rows without any)."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def arrow_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array)
                                       else columns[f.name].cast(f.type) for f in schema], schema=schema)


#: Multipliers of the 64-bit mixers below (odd constants).
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes; each distinct word is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()),
                        np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
