"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text, and every window of 2 to ``WINDOW`` consecutive lines (a notice is often wrapped). A block
matches a template when it holds at least ``threshold`` of the template's distinct words, all words that tell it from its
kin (``must``) and none that make it another one (``never``); a window of several lines has at most twice the template's
number of words. Words are ordered by how often they occur in the whole table, the rarest first. A template needs ``need = ceil(threshold * size)`` words, so
a matching block must hold one of its first ``size - need + 1`` words (prefix filter), must have ``need`` distinct words
(length filter), and from the place of the first common word on, template and block must both have ``need`` words left
(position filter). What passes is counted exactly. No filter loses a match.

A window can only match if one of its lines holds a prefix word, so only windows around such lines are looked at.

The table is read twice in narrow passes: once to count the templates' words, once to join. The templates are a
parameter, shipped with the tasks; ``MAX_TEMPLATE_BYTES`` is checked. Phrases are looked up as consecutive words in the
same pass, and their labels always stay.

Defined results. Null or empty text: no words, no labels, score 0. Ties and repeated rows: each row stands alone. Null
ids are carried. Lines of any length are whole blocks. Empty tables give no rows. Clashing extra columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import buffer_of, lower_table, mapped, per_row_sum, row_of, split_words, text_slices

MAX_TEMPLATE_BYTES = 4 << 20

#: The phrases of the contract, and the usual notices of public licenses.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: label, notice, words it must hold, words it never holds.
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache", "2"), ()),
    ("bsd", "Released under the BSD License", ("bsd",), ()),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary"), ()),
    ("cc-by", "Licensed under CC BY 4.0", ("cc", "by"), ("nc", "sa", "nd")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("commons", "attribution"), ("noncommercial", "sharealike", "noderivatives", "noderivs")),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("noncommercial",), ("sharealike", "noderivatives", "noderivs")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc", "nc"), ("sa", "nd")),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc", "sa"), ("nc",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("sharealike",), ("noncommercial",)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "3"), ("lesser", "affero", "library")),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu", "general", "3"), ("lesser", "affero", "library")),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("lesser", "3"), ()),
    ("mit", "Released under the MIT License", ("mit",), ()),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission", "hereby", "granted"), ()),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla",), ()),
)
#: Lines of the longest window.
WINDOW = 5


def word_table() -> np.ndarray:
    """Lower case; what belongs to no word becomes a space, but line ends stay (both end a word)."""
    table = lower_table()
    for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        table[[b for b in range(low, high + 1) if not 65 <= b <= 90 and b != 10]] = 32
    return table


def template_words(text: str) -> list[str]:
    data = bytes(word_table()[np.frombuffer(text.encode(), np.uint8)])
    return [w.decode() for w in data.split()]


def word_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often each word of the (bounded) vocabulary occurs in all texts."""
    table = word_table()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        values = pa.array(vocabulary, pa.large_string())
        for _, texts in text_slices(batches, text):
            found = pc.index_in(split_words(mapped(texts, table))[0], value_set=values).drop_null()
            total += np.bincount(found.to_numpy(zero_copy_only=False), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(len(vocabulary)), pa.int32()), "n": pa.array(total)})

    rows = docs.select(text).mapInArrow(count, "word int, n long").groupBy("word").sum("n").collect()
    return {vocabulary[r[0]]: r[1] for r in rows}


class Index:
    """Templates as codes that rise with the global word count, with the prefixes' inverted lists."""

    def __init__(self, templates, phrases, threshold: float, counts: dict[str, int]):
        templates = [(label, template_words(text), set(must), set(never)) for label, text, must, never in templates if template_words(text)]
        self.labels = [t[0] for t in templates]
        self.lengths = [len(t[1]) for t in templates]
        self.phrases = [(template_words(p), label) for p, label in phrases]
        words = sorted(set().union(*[{*t[1], *t[2], *t[3]} for t in templates], *[p for p, _ in self.phrases]), key=lambda w: (counts.get(w, 0), w))
        code = {w: k for k, w in enumerate(words)}
        of = lambda group: {code[w] for w in group}
        self.words = words
        self.sets = [sorted(of(t[1])) for t in templates]
        self.must, self.never = [of(t[2]) for t in templates], [of(t[3]) for t in templates]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (s, need) in enumerate(zip(self.sets, self.need)):
            for place in range(len(s) - need + 1):
                self.prefix[s[place]].append((t, place))
        self.phrase_codes = [([code[w] for w in p], label) for p, label in self.phrases]

    def matches(self, block: list[int], n_words: int, lines: int) -> list[tuple[int, float]]:
        """``block``: its distinct template codes, rising. All templates it matches, with the containment."""
        out, seen, own = [], set(), set(block)
        for at, c in enumerate(block):
            for t, place in self.prefix.get(c, ()):
                if t in seen:
                    continue
                seen.add(t)  # later common words leave even less
                need, size = self.need[t], len(self.sets[t])
                if n_words < need or min(size - place, len(block) - at) < need or lines > 1 and n_words > 2 * self.lengths[t]:
                    continue
                common = len(own.intersection(self.sets[t]))
                if common >= need and self.must[t] <= own and not self.never[t] & own:
                    out.append((t, common / size))
        return out


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, phrases=PHRASES,
         threshold: float = 0.8) -> DataFrame:
    """One row per document: the columns ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score and
    ``blocks`` (first line, label and containment of the matching blocks, a line's best for each label)."""
    if sum(len(t[1]) for t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError("the templates are shipped with each task; scan larger sets in parts")
    vocabulary = sorted({w for t in templates for w in (*template_words(t[1]), *t[2], *t[3])} | {w for p, _ in phrases for w in template_words(p)})
    index = Index(templates, phrases, threshold, word_counts(docs, vocabulary, text))
    carried = [c for c in keep]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]
                       + ["n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
                          "blocks array<struct<line:long,label:string,containment:double>>"])
    table = word_table()
    most = 2 * max(index.lengths, default=0)
    rare = np.zeros(len(index.words), bool)
    rare[list(index.prefix)] = True
    blocks_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(index.words, pa.large_string())
        for rows, texts in text_slices(batches, text):
            low = mapped(texts, table)
            words, off = split_words(low)
            n, row = len(texts), row_of(off)
            codes = pc.fill_null(pc.index_in(words, value_set=values), -1).to_numpy(zero_copy_only=False)
            # the phrases: consecutive codes inside one row
            n_base, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base = [set() for _ in range(n)]
            for phrase, label in index.phrase_codes:
                places = np.flatnonzero(codes[:max(0, len(codes) - len(phrase) + 1)] == phrase[0])
                for k in range(1, len(phrase)):
                    places = places[codes[places + k] == phrase[k]]
                places = places[row[places] == row[places + len(phrase) - 1]] if len(places) else places
                for p in places:
                    r = row[p]
                    at = int(p - off[r])
                    n_base[r] += 1
                    first[r] = at if first[r] < 0 else min(first[r], at)
                    last[r] = max(last[r], at)
                    base[r].add(label)
            # the join: lines that hold a prefix word, and windows around them
            blocks: list[list] = [[] for _ in range(n)]
            hot = np.flatnonzero((codes >= 0) & rare[np.maximum(codes, 0)])
            if len(hot):
                data, boff = buffer_of(low)
                is_word = (data != 32) & (data != 10)
                begins = is_word.copy()
                begins[1:] &= ~is_word[:-1]
                edge = boff[:-1][boff[:-1] < len(data)]
                begins[edge] |= is_word[edge]
                begin = np.flatnonzero(begins)
                line = np.searchsorted(np.flatnonzero(data == 10), begin)
                block = line + row  # rows without a line end between them are apart too
                head = np.searchsorted(np.flatnonzero(data == 10), boff[:-1])
                ends = np.append(head[1:], np.count_nonzero(data == 10)) if len(head) else head  # a row's last line
                looked, best = set(), {}
                for i in hot[np.append(True, block[hot][1:] != block[hot][:-1])].tolist():
                    r, at = int(row[i]), int(line[i])
                    for k in range(1, WINDOW + 1):
                        for s in range(max(at - k + 1, int(head[r])), min(at, int(ends[r]) - k + 1) + 1):
                            if (r, s, k) in looked:
                                continue
                            looked.add((r, s, k))
                            lo, hi = np.searchsorted(block, [s + r, s + k + r])
                            if hi - lo > most and k > 1:
                                continue
                            own = codes[lo:hi]
                            for t, share in index.matches(np.unique(own[own >= 0]).tolist(), int(hi - lo), k):
                                place = (r, s - int(head[r]), index.labels[t])
                                best[place] = max(best.get(place, 0.0), share)
                for (r, at, label), share in sorted(best.items()):
                    blocks[r].append({"line": at, "label": label, "containment": share})
            columns = [rows.column(c) for c in carried]
            missing = n_base == 0
            columns += [pa.array(np.diff(off), pa.int64()), pa.array(n_base), pa.array(first, mask=missing), pa.array(last, mask=missing),
                        pa.array([",".join(sorted(s)) for s in base], pa.string()),
                        pa.array([",".join(sorted(s | {x["label"] for x in m})) for s, m in zip(base, blocks)], pa.string()),
                        pa.array([1.0 if s else max((x["containment"] for x in m), default=0.0) for s, m in zip(base, blocks)], pa.float64()),
                        pa.array(blocks, blocks_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "n_words", "n_base", "first_word", "last_word", "base_labels",
                                                             "labels", "score", "blocks"])

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*carried, text])]).mapInArrow(run, schema)
