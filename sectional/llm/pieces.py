"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes words (runs of the space mark and what follows, which no piece crosses); each distinct word of a slice is
encoded once. All words to encode lie in one flat array of symbols. A round finds each word's least pair rank, merges all
its occurrences in every word at once, leftmost first where they overlap, and compacts the arrays; words without a
mergeable pair leave. One merge at a time, best rank first and leftmost among equals, gives the same: a merge that makes
a pair of no worse rank ends its word's round, so that this pair comes before later occurrences. Words are cut further
where two characters stand together in no piece. Characters that are no piece become their bytes' pieces.

The model file is read as it is (pieces, scores, kinds); the file must be a byte-pair model with byte fallback, identity
normalisation and the space mark in front, and anything else is refused.

Defined results. Null and empty texts: no ids, and the empty text decoded. Repeated rows and null ids: each row by itself.
Empty tables give no rows. ``encode`` and ``transcode`` keep all other columns; columns that clash with the added ones
are replaced. A text of any length is encoded whole; memory grows with the longest text. Decoding takes any list of ids
of the model: control ids are nothing, an invalid byte becomes U+FFFD, null lists and null ids decode as nothing.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

#: Distinct words (and their characters) whose ids a task remembers at most; they don't change results.
CACHE_WORDS, CACHE_CHARS = 300_000, 8 << 20
MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


def ragged(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a flat array one after another, and their ends."""
    size = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - size), size)
    return flat[place], ends


class Model:
    """Pieces of a model file and the tables for merging them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = list(_fields(f.read()))
        trainer = next((dict(_fields(v)) for k, v in raw if k == 2), {})
        normal = next((dict(_fields(v)) for k, v in raw if k == 3), {})
        pieces = [dict(_fields(v)) for k, v in raw if k == 1]
        names = [p[1].decode() for p in pieces]
        kinds = np.array([p.get(3, _NORMAL) for p in pieces])
        if (trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(2) or not normal.get(3, 1)
                or normal.get(4, 1) or not normal.get(5, 1) or not np.isin(kinds, (_NORMAL, _UNKNOWN, _CONTROL, _BYTE)).all()):
            raise ValueError(f"{path}: needs a byte-pair model with byte fallback, identity normalisation and a space mark in front")
        self.size = len(names)
        own = {names[i]: int(i) for i in np.flatnonzero(kinds == _NORMAL)}
        if any(c == MARK != b for name in own for b, c in zip(name, name[1:])):
            raise ValueError(f"{path}: a piece crosses words")
        score = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces])
        #: Equal scores have equal rank; the last entry stands for pairs that make no piece (-1).
        self.rank = np.append(np.unique(-score, return_inverse=True)[1].astype(np.int32), np.iinfo(np.int32).max)
        #: A character's symbol: its piece, or ``size`` + code point.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for name, i in own.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i

        def of(part: str) -> int | None:
            return own.get(part, self.size + ord(part) if len(part) == 1 else None)

        pairs, inside = {}, set()
        for name, i in own.items():
            for k in range(1, len(name)):
                a, b = of(name[:k]), of(name[k:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = i
                inside.add(int(self.symbol[ord(name[k - 1])]) << 21 | int(self.symbol[ord(name[k])]))
        self.pair_keys = np.array(sorted(pairs) + [1 << 62], np.int64)
        self.pair_piece = np.array([pairs[k] for k in sorted(pairs)] + [-1], np.int32)
        self.inside = np.array(sorted(inside) + [1 << 62], np.int64)
        self.byte_piece = np.zeros(256, np.int32)
        shown = [name.replace(MARK, " ").encode() for name in names]
        for i in np.flatnonzero(kinds == _BYTE):
            value = int(names[i][3:5], 16)
            self.byte_piece[value], shown[i] = i, bytes([value])
        for i in np.flatnonzero(kinds == _CONTROL):
            shown[i] = b""
        for i in np.flatnonzero(kinds == _UNKNOWN):
            shown[i] = trainer.get(44, b" \xe2\x81\x87 ")
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.control = kinds == _CONTROL
        self.spaced = np.array([k == _NORMAL and name.startswith(MARK) for name, k in zip(names, kinds)])

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = a.astype(np.int64) << 21 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_piece[at], -1)

    def _merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds of merges; returns the symbols left and their segments, in order."""
        none = self.rank[-1]
        made = np.full(len(sym), -1, np.int32)  # the piece of a symbol and the next one
        near = np.flatnonzero(seg[1:] == seg[:-1])
        made[near] = self.pair(sym[near], sym[near + 1])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = self.rank[made]
            start = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            width = np.diff(np.append(start, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, start), width)
            done = least == none
            if done.any():
                out.append((seg[done], sym[done]))
                sym, seg, made, rank, least = sym[~done], seg[~done], made[~done], rank[~done], least[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            nth = np.arange(len(hit))
            opens = np.append(True, hit[1:] != hit[:-1] + 1)  # a run of overlapping pairs starts
            at = hit[(nth - np.maximum.accumulate(np.where(opens, nth, 0))) % 2 == 0]
            new, worst, group = made[at], rank[at], seg[at]
            before = np.maximum(at - 1, 0)
            left = np.where(np.append(False, at[1:] == at[:-1] + 2), np.append(0, new[:-1]), sym[before])
            has_left = (at > 0) & (seg[before] == group)
            after = np.minimum(at + 2, len(sym) - 1)
            has_right = (at + 2 < len(sym)) & (seg[after] == group)
            stops = (has_left & (self.rank[self.pair(left, new)] <= worst)) | (has_right & (self.rank[self.pair(new, sym[after])] <= worst))
            if stops.any():
                earlier = np.cumsum(stops) - stops
                first = np.append(True, group[1:] != group[:-1])
                keep = earlier == np.repeat(earlier[first], np.diff(np.append(np.flatnonzero(first), len(at))))
                at, new = at[keep], new[keep]
            sym[at] = new
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            sym, seg, made = sym[stays], seg[stays], made[stays]
            moved = at - np.arange(len(at))
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            made[touched] = -1
            touched = touched[touched + 1 < len(sym)]
            touched = touched[seg[touched] == seg[touched + 1]]
            made[touched] = self.pair(sym[touched], sym[touched + 1])
        seg = np.concatenate([s for s, _ in out]) if out else np.zeros(0, np.int64)
        sym = np.concatenate([s for _, s in out]) if out else np.zeros(0, np.int32)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym = self.symbol[points]
        key = sym[:-1].astype(np.int64) << 21 | sym[1:]
        cut = (word[1:] != word[:-1]) | (self.inside[np.searchsorted(self.inside, key)] != key)
        seg = np.concatenate([[0], np.cumsum(cut)])
        owner = word[np.append(True, cut)]
        sym, seg = self._merge(sym, seg)
        word = owner[seg]
        other = sym >= self.size
        if other.any():
            raw = np.frombuffer("".join(map(chr, (sym[other] - self.size).tolist())).encode(), np.uint8)
            points = sym[other] - self.size
            size = np.ones(len(sym), np.int64)
            size[other] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            sym, word, other = np.repeat(sym, size), np.repeat(word, size), np.repeat(other, size)
            sym[other] = self.byte_piece[raw]
        return sym, np.bincount(word, minlength=len(words))

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each list of ids (``ends`` are the lists' ends)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id outside the model")
        raw, at = ragged(self.shown, self.shown_at, ids)
        at, raw = np.concatenate([[0], at]), raw.tobytes()
        control = self.control[ids]
        out, start = [], 0
        for end in ends.tolist():
            # control ids show nothing, but bytes on either side of one are no character together
            bounds = [start, end] if not control[start:end].any() else [start, *(np.flatnonzero(control[start:end]) + start).tolist(), end]
            text, opened = "", False
            for lo, hi in zip(bounds, bounds[1:]):
                lo += lo < hi and bool(control[lo])
                skip = not opened and lo < hi and bool(self.spaced[ids[lo]])  # the mark in front of the text
                opened |= lo < hi
                text += raw[int(at[lo]) + skip:int(at[hi])].decode("utf-8", "each_byte")
            out.append(text)
            start = end
        return out


class _Codes(dict):
    """Numbers words in order of appearance."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


class Encoder:
    """Encodes texts; remembers a bounded number of words."""

    _WORDS = re.compile(f"{MARK}+[^{MARK}]*")

    def __init__(self, path: str):
        self.model = Model(path)
        self._forget()

    def _forget(self) -> None:
        self.codes, self.chars = _Codes(), 0
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the ends of each text's ids."""
        if len(self.codes) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        codes, counts = [], []
        for text in texts:
            words = self._WORDS.findall(MARK + text.replace(" ", MARK)) if text else ()
            codes.extend(map(self.codes.__getitem__, words))
            counts.append(len(words))
        fresh, self.codes.fresh = self.codes.fresh, []
        if fresh:
            ids, sizes = self.model.encode_words(fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.chars += sum(map(len, fresh))
        flat, ends = ragged(self.ids, self.at, np.array(codes, np.int64))
        return flat, np.concatenate([[0], ends])[np.cumsum(counts, dtype=np.int64)]


def _out(docs: DataFrame, added: dict[str, T.DataType]) -> tuple[T.StructType, list[str]]:
    kept = [f for f in docs.schema.fields if f.name not in added]
    return T.StructType(kept + [T.StructField(n, t) for n, t in added.items()]), [f.name for f in kept]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def transcode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``docs`` with each whole text's ids (``ids``, array of int) and, unless None, the text that these decode to (``decoded``)."""
    added = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    schema, kept = _out(docs, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for rows, texts in text_slices(batches, text):
            flat, ends = encoder.encode(texts.to_pylist())
            columns = [rows.column(c) for c in kept] + [_lists(flat, ends)]
            if decoded:
                columns.append(pa.array(encoder.model.decode_lists(flat, ends), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with each whole text's ids."""
    return transcode(docs, path, text, ids, None)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text that each row's ids decode to."""
    schema, kept = _out(docs, {text: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(known)])[bounds][1:]
            got = model.decode_lists(flat.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(got, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
