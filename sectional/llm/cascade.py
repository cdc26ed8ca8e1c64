"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample.

Each rule measures one number of a text and rejects by it. A sample (``sample_rows``, spread over the table) runs every
rule on its own inside the tasks and returns only sums: rows, rows rejected, nanoseconds. Rules then run in falling
rejections per nanosecond, and a row that a rule rejects isn't measured by the later ones. A row's verdict is the same in
any order. ``fill`` measures afterwards, for the rejected rows only, what the cascade skipped (for a full report).

Defined results. Null text: no words. Empty texts fail the word count. Ties and repeated rows: each row is judged alone.
Null ids are carried. Empty tables give none. Columns of the input that clash with the report's are replaced by it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import buffer_of, per_row_sum, row_of, split_words, text_slices

#: Fixed values of the measures.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"


class Texts:
    """Some rows' texts; words and codes are made when a rule first asks for them and kept when rows are dropped."""

    def __init__(self, text: pa.Array):
        self.text = text
        self._words = self._codes = None

    def __len__(self) -> int:
        return len(self.text)

    @property
    def offsets(self) -> np.ndarray:
        if self._words is None:
            self._words = split_words(self.text)
        return self._words[1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def codes(self) -> np.ndarray:
        if self._codes is None:
            self._codes = self._codes_of(self.offsets)
        return self._codes

    def _codes_of(self, _) -> np.ndarray:
        coded = self._words[0].dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def keep(self, mask: np.ndarray) -> "Texts":
        out = Texts(pa.concat_arrays([self.text.filter(pa.array(mask))]))
        if self._words is not None:
            each = mask[row_of(self.offsets)]
            out._words = (self._words[0].filter(pa.array(each)), np.concatenate([[0], np.cumsum(self.n_words[mask])]))
            out._codes = None if self._codes is None else self._codes[each]
        return out

    def byte_counts(self, table: np.ndarray) -> np.ndarray:
        data, off = buffer_of(self.text)
        return per_row_sum(table[data], off)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


def count_words(t: Texts) -> np.ndarray:
    return t.n_words


def word_chars(t: Texts) -> np.ndarray:
    starts = np.ones(256, np.int64)
    starts[0x80:0xC0] = 0  # continuation bytes
    return t.byte_counts(starts - _table(WHITE))


def count_symbols(t: Texts) -> np.ndarray:
    return t.byte_counts(_table(SYMBOLS))


def dup_lines(t: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    parts = pc.split_pattern(t.text, "\n")
    lines, off = parts.flatten(), np.asarray(parts.offsets, dtype=np.int64)
    off = off - off[0] if len(off) else off
    full = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    row = row_of(off)[full]
    code = lines.filter(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seen = pd.Series(row * (int(code.max(initial=0)) + 1) + code).duplicated().to_numpy()
    return np.bincount(row[seen], minlength=len(t)).astype(np.int64)


def repeat_words(t: Texts) -> np.ndarray:
    """Words inside 3-word windows that the text holds twice or more, the first one included."""
    off, code = t.offsets, t.codes
    n = len(code)
    if n < 3:
        return np.zeros(len(t), np.int64)
    row = row_of(off)
    start = np.flatnonzero(row[2:] == row[:-2])
    wide = int(code.max()) + 1
    pair = pd.factorize(code[start] * wide + code[start + 1])[0].astype(np.int64)
    triple = pd.factorize(pair * wide + code[start + 2])[0].astype(np.int64)
    own = pd.factorize(triple * len(t) + row[start])[0]
    again = start[np.bincount(own, minlength=1)[own] > 1]
    hit = np.zeros(n, np.int64)
    for k in range(3):
        hit[again + k] = 1
    return per_row_sum(hit, off)


@dataclass(frozen=True)
class Rule:
    """``measure`` gives one number a text; ``reject(number, n_words, texts)`` is true for texts that go."""

    name: str
    measure: Callable[[Texts], np.ndarray]
    reject: Callable[[np.ndarray, np.ndarray, Texts], np.ndarray]
    base: bool = False


def n_lines(t: Texts) -> np.ndarray:
    return t.byte_counts(_table("\n")) + 1


#: The first two are the base rules; the others are mild bounds that clean prose stays well inside.
RULES = (
    Rule("n_words", count_words, lambda v, n, t: v < 50, base=True),
    Rule("n_repeat_words", repeat_words, lambda v, n, t: 100 * v > 50 * n, base=True),
    Rule("word_chars", word_chars, lambda v, n, t: (v < 2 * n) | (v > 20 * n)),
    Rule("n_symbols", count_symbols, lambda v, n, t: v > n),
    Rule("n_dup_lines", dup_lines, lambda v, n, t: 100 * v > 50 * n_lines(t)),
)


def spread_sample(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    total = docs.count()
    return docs if total <= rows else docs.sample(min(1.0, rows / total), seed)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000,
             seed: int = 5) -> list[dict]:
    """Per rule: sampled rows, rejected rows, nanoseconds. Only these sums reach the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, text):
            for k, rule in enumerate(rules):
                t = Texts(texts)
                words = t.n_words if k else None
                began = time.thread_time_ns()
                t = Texts(texts)
                value = rule.measure(t)
                cost = time.thread_time_ns() - began
                bad = rule.reject(value, t.n_words if words is None else words, t)
                yield pa.RecordBatch.from_pydict({"rule": pa.array([k], pa.int32()), "seen": pa.array([len(t)], pa.int64()),
                                                  "bad": pa.array([int(bad.sum())], pa.int64()), "ns": pa.array([cost], pa.int64())})

    sums = spread_sample(docs.select(text), sample_rows, seed).mapInArrow(measure, "rule int, seen long, bad long, ns long") \
        .groupBy("rule").sum("seen", "bad", "ns").collect()
    found = {r[0]: r for r in sums}
    return [{"rule": rule.name, "rows": found[k][1] if k in found else 0, "rejected": found[k][2] if k in found else 0,
             "ns": found[k][3] if k in found else 0} for k, rule in enumerate(rules)]


def order_rules(stats: list[dict], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejections per nanosecond first; rules that reject nothing in the sample follow, the cheapest first."""
    gain = {s["rule"]: (s["rejected"] / max(1, s["ns"]), -s["ns"]) for s in stats}
    return tuple(sorted(rules, key=lambda r: gain[r.name], reverse=True))


def _judge(whole: Texts, ordered: tuple[Rule, ...]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The cascade over a slice: the number of the rule that rejects each text (-1: none), the rules' numbers (-1: not
    measured), and the base rules' verdict (-1: not reached)."""
    n = len(whole)
    values = {r.name: np.full(n, -1, np.int64) for r in ordered}
    failed, base = np.full(n, -1), np.full(n, -1, np.int8)
    alive, t = np.arange(n), whole
    for k, rule in enumerate(ordered):
        value = rule.measure(t)
        bad = rule.reject(value, t.n_words, t)
        values[rule.name][alive] = value
        if rule.base:
            base[alive] = np.maximum(base[alive], bad)
        failed[alive[bad]] = k
        if bad.any():
            alive, t = alive[~bad], t.keep(~bad)
    return failed, values, base


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows that no rule rejects, as they are, whatever their other columns are called."""
    ordered = order_rules(estimate(docs, rules, text, sample_rows), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text):
            yield rows.filter(pa.array(_judge(Texts(texts), ordered)[0] < 0))

    return docs.mapInArrow(run, docs.schema)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] | None = None,
            sample_rows: int = 2000, fill: bool = False) -> DataFrame:
    """The columns ``keep`` (all by default), then each rule's number (null where the cascade had stopped, unless
    ``fill``), ``failed_rule`` (null for rows that pass), ``base_failed`` and ``kept``. One narrow pass over the texts.

    ``base_failed`` is the verdict of the base rules alone; without ``fill`` it is null where the cascade had stopped
    before they ran.
    """
    ordered = order_rules(estimate(docs, rules, text, sample_rows), rules)
    own = {r.name for r in rules} | {"failed_rule", "base_failed", "kept"}
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    need = list(dict.fromkeys([*carried, text]))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [f"`{r.name}` long" for r in rules]
                       + ["failed_rule string", "base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text):
            whole = Texts(texts)
            failed, values, base = _judge(whole, ordered)
            gone = failed >= 0
            if fill and gone.any():
                t, at = whole.keep(gone), np.flatnonzero(gone)
                for rule in rules:
                    lacks = values[rule.name][at] < 0
                    if lacks.any():
                        part = t.keep(lacks)
                        value = rule.measure(part)
                        values[rule.name][at[lacks]] = value
                        if rule.base:
                            base[at[lacks]] = np.maximum(base[at[lacks]], rule.reject(value, part.n_words, part))
            names = np.array([r.name for r in ordered], object)
            columns = [rows.column(c) for c in carried]
            columns += [pa.array(values[r.name], pa.int64(), mask=values[r.name] < 0) for r in rules]
            columns += [pa.array(np.where(gone, names[failed], None), pa.string()),
                        pa.array(base == 1, pa.bool_(), mask=base < 0), pa.array(~gone, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, *[r.name for r in rules], "failed_rule", "base_failed", "kept"])

    return docs.select(*[f"`{c}`" for c in need]).mapInArrow(run, schema)
