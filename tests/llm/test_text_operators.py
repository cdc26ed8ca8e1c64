"""Language model, packing, licence scan, quality rules, HTML: against brute force on whole small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sectional.llm import cascade, html_text, licenses, maxent, packing
from sectional.llm.common import text_slices
from sectional.llm.queries import added_tokens, ranks_path

from .corpus import documents, lower, nothing, rows, words


def test_language_model_base_and_probabilities(spark):
    got = Counter()
    out = maxent.score(documents(spark), head_words=40, rounds=2).collect()
    train = [r for r in rows() if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    count = Counter(w for r in train for w in words(lower(r[1])))
    n, v = sum(count.values()) + len(train), len(count) + 1
    want = Counter()
    for r in rows():
        own = words(lower(r[1]))
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1))
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
        want[(r[0], held, len(own) + 1, sum(w in count for w in own) + 1, n, round(base, 6))] += 1
    for r in out:
        got[(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))] += 1
        assert r["score"] < 0
    assert got == want
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert maxent.score(nothing(spark)).collect() == []


def test_language_model_factors_are_distributions():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    head = pa.array([f"w{k}" for k in range(150)], pa.large_string())
    model = maxent.Model(np.arange(400, 250, -1), 50, 300, rng.integers(0, 4, 150))
    model.w = [w + rng.normal(0, 0.3, w.shape).astype(np.float32) for w in model.w]
    for history in ("w3 w7 zz", "", "w1"):
        total = 0.0
        for last in [*[f" w{k}" for k in range(150)], " unseen", ""]:
            t = maxent.Tokens(pa.array([history + last], pa.large_string()), head)
            total += math.exp(model.log_p(t)[-2 if last else -1])
        assert total == pytest.approx(1, abs=1e-4)


def test_language_model_has_all_its_features():
    import pyarrow as pa

    head = pa.array([f"w{k}" for k in range(120)], pa.large_string())
    model = maxent.Model(np.full(120, 50), 50, 300, np.zeros(120, int))
    assert maxent.CLASSES == 64
    a, b = (model.features(maxent.Tokens(pa.array([f"{w} w5 w7 w9"], pa.large_string()), head))[3] for w in ("w1", "w60"))
    assert a.shape == (5,) and a[4] != b[4] and (a[[0, 1, 3]] == b[[0, 1, 3]]).all()  # the word three back counts as itself
    wide = maxent.Model(np.concatenate([np.full(64, 1), np.full(2, 10 ** 6)]), 5, 5, np.repeat([0, 1], [64, 2]))
    assert np.bincount(wide.klass[:64]).max() == 64 and wide.narrow[wide.klass[0]]  # a class of 64 words has features


def test_a_step_sums_the_tokens_of_each_row(monkeypatch):
    rng = np.random.default_rng(5)
    model = maxent.Model(np.full(20, 150), 1, 1, np.zeros(20, int))
    rows = np.concatenate([np.arange(900), rng.integers(900, 1100, 500), np.full(60, 1200)]).reshape(2, -1)
    wrong = rng.normal(0, 1, (rows.shape[1], maxent.CLASSES)).astype(np.float32)
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    which, at = np.unique(flat[order], return_index=True)
    grad = np.add.reduceat(wrong[order % len(wrong)], at, axis=0)
    want, moved = np.full(maxent.ROWS, 1.0, np.float32), np.zeros_like(model.w[0])
    want[which] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
    moved[which] += grad * (0.3 / np.sqrt(want[which]))[:, None]
    one_by_one = []

    class Add:
        def reduceat(self, x, *a, **k):
            one_by_one.append(len(x))
            return add.reduceat(x, *a, **k)

        def __getattr__(self, name):
            return getattr(add, name)

    add = np.add
    monkeypatch.setattr(maxent.np, "add", Add())
    seen = np.full(maxent.ROWS, 1.0, np.float32)
    model._step(0, rows, wrong, seen, 0.3)
    assert (seen == want).all() and (model.w[0] == moved).all()
    assert sum(one_by_one) < 200  # only the rows of many tokens; all 1,460 before


def test_word_counts_are_summed_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FLUSH", 40)
    monkeypatch.setattr(maxent, "text_slices", lambda batches: text_slices(batches, max_bytes=60))
    texts = [" ".join(f"w{(i * j) % (31 + i)}" for j in range(12)) for i in range(200)] + [None, "", "A a"]
    sent, sums, concat = {}, [], pa.concat_arrays

    class Docs:  # takes the task's function, which runs here
        groupBy = agg = lambda self, *a: self
        select = lambda self, *a: self

        def mapInArrow(self, function, schema):
            sent["run"] = function
            return self

    monkeypatch.setattr(maxent, "pa", SimpleNamespace(**{**vars(pa), "concat_arrays": lambda held: sums.append(len(held)) or concat(held)}))
    maxent.word_counts(Docs())
    got = list(sent["run"](iter(pa.RecordBatch.from_pydict({"text": pa.array(texts[a:a + 10], pa.string())}) for a in range(0, len(texts), 10))))
    want, found = Counter(w for t in texts for w in (t or "").lower().split()), Counter()
    for b in got:
        found.update(dict(zip(b.column("word").to_pylist(), b.column("c").to_pylist())))
    assert found == want and all(b.num_rows > 40 for b in got[:-1])
    assert 0 < len(sums) < len(texts) / 4  # before, each slice was summed with those before it


def test_other_words_are_counted_by_row(spark):
    rows = [["b", "a", "b"], [], ["b", "c" * 70, "b", "b"], []]
    out = maxent.counted_by_row(pa.array([w for r in rows for w in r], pa.large_string()), np.cumsum([0, *map(len, rows)]))
    assert [{x["word"]: x["n"] for x in r} for r in out.to_pylist()] == [Counter(r) for r in rows]
    assert maxent.counted_by_row(pa.array([], pa.large_string()), np.array([0, 0])).to_pylist() == [[]]
    # only a row's own words are put together; no shuffle by row and word
    scored = maxent.score(documents(spark), head_words=40, rounds=1)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate [row" in plan and not re.search(r"Aggregate \[row#\d+L?, word#", plan)


def test_slices_share_a_lookup(monkeypatch):
    texts = [" ".join(f"w{(i * j) % (31 + i)}" for j in range(12)) for i in range(200)] + [None, "", "A a", " ", "w1"]
    head = pa.array([f"w{k}" for k in range(60)] + ["a"], pa.large_string())
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[a:a + 10], pa.string())}) for a in range(0, len(texts), 10)]
    monkeypatch.setattr(maxent, "text_slices", lambda batches: text_slices(batches, max_bytes=60))
    lookups, pc = [], maxent.pc
    monkeypatch.setattr(maxent, "pc", SimpleNamespace(**{**vars(pc), "index_in": lambda *a, **k: lookups.append(1) or pc.index_in(*a, **k)}))
    sent = {}

    class Docs:  # takes the task's function, which runs here
        groupBy = applyInPandas = select = lambda self, *a: self
        toLocalIterator = lambda self: []

        def mapInArrow(self, function, schema):
            sent["run"] = function
            return self

    maxent.company(Docs(), SimpleNamespace(value=head))
    wide, size = maxent.COMPANY, len(head) + 3
    got = np.zeros((maxent.BLOCKS, -(-size // maxent.BLOCKS) * wide))
    for b in sent["run"](iter(batches)):
        for block, at, n in zip(*(b.column(c).to_pylist() for c in ("block", "at", "n"))):
            got[block, np.frombuffer(at, "<u4")] += np.frombuffer(n, "<f4")
    place, want = {w: k for k, w in enumerate(head.to_pylist())}, np.zeros((size, wide))
    for t in texts:
        ids = [size - 1] * 4 + [place.get(w, len(head) + 1) for w in lower(t).split()] + [len(head)]
        for i in range(4, len(ids)):
            for k in range(1, 5):
                for a, b in ((ids[i - k], ids[i]), (ids[i], ids[i - k])):
                    if b < wide:
                        want[a, b] += 1
    assert (got.reshape(-1, wide)[:size] == want).all()
    assert len(lookups) == 1  # before, the head was hashed again for each slice
    monkeypatch.setattr(maxent, "LOOKED_UP", 200)
    slices = list(maxent.Tokens.slices(iter(batches), head))
    assert 1 < len(lookups) - 1 < len(slices)
    for rows, t in slices:
        alone = maxent.Tokens(pa.array([x or "" for x in rows.column("text").to_pylist()], pa.large_string()), head)
        assert t.words.equals(alone.words) and (t.ids == alone.ids).all() and (t.off == alone.off).all()
        assert (t.at == alone.at).all() and (t.word_off == alone.word_off).all()


def test_learning_raises_the_likelihood():
    import pyarrow as pa

    head = pa.array([f"w{k}" for k in range(20)], pa.large_string())
    text = pa.array([" ".join(f"w{k % 20}" for k in range(3000))], pa.large_string())
    model = maxent.Model(np.full(20, 150), 1, 1, np.zeros(20, int))
    t = maxent.Tokens(text, head)
    before = model.log_p(t).sum()
    for _ in range(5):
        model.learn(t, np.ones((2, maxent.ROWS), np.float32), 0.3)
    assert model.log_p(t).sum() > 0.5 * before


def test_encoder_equals_the_tokenizers_file():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    encode = packing.Encoder(ranks_path())
    rng = random.Random(2)
    for _ in range(600):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "The", "'s", "12", "é", "　", "\x1c", "!?", "<|endoftext|>", chr(rng.randint(32, 0x2FFF))]) for _ in range(25))
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packing_gives_added_tokens_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["end <|endoftext|> begin", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b", " <|endoftext|> \n", "<|endoftext| >", "plain text", "x<|endoftext|>y <|endoftext"]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks_path(), added=added_tokens(), with_ids=True).collect()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out}
    assert got == {k: [*reference.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert got[0][:-1] == [437, 220, 50256, 2221]


def test_packing_round_trip(spark):
    out = packing.pack(documents(spark), ranks_path(), capacity=256, with_ids=True).collect()
    encode, end = packing.Encoder(ranks_path()), np.array([0], "<u4").tobytes()
    want = Counter((r[0], encode(r[1] or "") + end) for r in rows())
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4 * 256
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], bytes(r["ids"])))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    for doc, ids in want:  # repeated rows and null ids interleave; each document's pieces are there as often as it is
        pieces = Counter(by_doc[doc])
        for k, (s, n) in enumerate(packing.cut(len(ids) // 4, 256)):
            assert pieces[(k, s, ids[4 * s:4 * (s + n)])] >= want[doc, ids]
            assert k == 0 or n == 256
    assert len(sequences) <= math.ceil(sum(r["length"] for r in out) / 256) + 2
    assert packing.pack(nothing(spark), ranks_path()).collect() == []


def test_configuration_program_holds_any_histogram():
    rng = np.random.default_rng(5)
    for _ in range(5):
        histogram = {int(k): int(rng.integers(1, 4000)) for k in rng.choice(np.arange(1, 129), 30, replace=False)}
        got = Counter()
        for pattern, n in packing.solve(histogram, 128, rounds=30):
            assert n > 0 and sum(v * t for v, t in pattern) <= 128
            for v, t in pattern:
                got[v] += n * t
        assert got == histogram


def brute_licences(text):
    low = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels, score = [], set(), 0.0
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        hits = [k for k in range(len(low) - len(own) + 1) if low[k:k + len(own)] == own]
        places += hits
        labels |= {label} if hits else set()
    base = set(labels)
    lines = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(line)) for line in (text or "").split("\n")]
    for k in range(1, licenses.WINDOW + 1):
        for i in range(len(lines) - k + 1):
            block = sum(lines[i:i + k], [])
            have = set(block)
            for label, template, must, never in licenses.TEMPLATES:
                t = set(licenses.template_words(template))
                share = len(t & have) / len(t)
                if share >= 0.8 - 1e-12 and set(must) <= have and not set(never) & have and (k == 1 or len(block) <= 2 * len(licenses.template_words(template))):
                    labels.add(label)
                    score = max(score, share)
    return (len(low), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else score)


def test_licence_scan(spark):
    notes = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "x CC-BY-NC y cc by nc",
             "Licensed under the Apache License, Version 2.0.\nunder the\nMIT license", "work licensed under GNU General Public License version", "éa under the mit licensé"]
    table = [(i, f"{r[1]}\n{notes[i % 6]}\n{r[1]}" if r[1] and i % 2 else r[1]) for i, r in enumerate(rows())] + [(900 + k, t) for k, t in enumerate(notes)] + [(None, None), (1, "")]
    out = licenses.scan(spark.createDataFrame(table, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in out.collect())
    assert got == Counter((i, *brute_licences(t)[:-1], round(brute_licences(t)[-1], 9)) for i, t in table)
    assert licenses.scan(nothing(spark)).collect() == []


NOTICES = {
    "Released under the BSD License": "bsd", "Licensed under CC BY-SA 4.0": "cc-by-sa", "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY 4.0": "cc-by",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This library is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "lgpl-3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software": "mit",
    " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
    " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.": "gpl-3",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "bsd-3",
    "Licensed under the Apache License,\nVersion 2.0 (the \"License\")": "apache-2", "Licensed under the Apache License, Version 1.1": "", "Released under the license of the town": "",
    "Released under the MIT License": "mit", "This work is licensed\n\nunder the GNU General Public\nLicense, version 3": "gpl-3", "the license\n" * 40: "",
}


def test_licence_notices(spark):
    """One label each, for notices on a line, wrapped or in a longer text; near names don't share a label."""
    around = "Some words stand before it.\n{}\nAnd others after it, on and on."
    table = [(f"{k}{n}", f.format(text)) for n, text in enumerate(NOTICES) for k, f in (("own", "{}"), ("around", around))]
    out = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(table, "doc_id string, text string")).collect()}
    assert out == {f"{k}{n}": label for n, label in enumerate(NOTICES.values()) for k in ("own", "around")}


def test_licence_blocks_name_their_lines(spark):
    text = "a\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\nb"
    row = licenses.scan(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).where("doc_id = 2").first()
    assert {(b["line"], b["label"]) for b in row["blocks"]} >= {(2, "bsd-3")} and all(b["label"] == "bsd-3" for b in row["blocks"]) and row["score"] == 1.0


def brute_quality(text):
    t = text or ""
    own = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = defaultdict(list)
    for k in range(len(own) - 2):
        at[tuple(own[k:k + 3])].append(k)
    repeat = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
    chars, symbols, dup = sum(map(len, own)), sum(c in cascade.SYMBOLS for c in t), len(lines) - len(set(lines))
    base = len(own) < 50 or 100 * repeat > 50 * len(own)
    kept = not (base or chars < 2 * len(own) or chars > 20 * len(own) or symbols > len(own) or 100 * dup > 50 * (t.count("\n") + 1))
    return len(own), chars, symbols, dup, repeat, base, kept


def test_quality_cascade(spark):
    table = [(r[0], (r[1] or "") + ("\n#a <b>| same line\n" * (k % 5) if r[1] else "")) for k, r in enumerate(rows())] + [(7, "%%% ### *** " * 40), (8, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string").selectExpr("doc_id", "text", "1 as kept", "'x' as failed_rule")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = Counter(tuple(r[n] for n in names) for r in cascade.cascade(docs, fill=True).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in table)
    stays = Counter((r["doc_id"], r["text"], r["failed_rule"]) for r in cascade.passing(docs).collect())
    assert stays == Counter((i, t, "x") for i, t in table if brute_quality(t)[-1])
    assert cascade.cascade(nothing(spark)).collect() == cascade.passing(nothing(spark)).collect() == []


def test_rules_run_by_rejections_per_cost():
    stats = [{"rule": r.name, "rejected": n, "ns": ns} for r, n, ns in zip(cascade.RULES, (5, 50, 0, 9, 0), (10, 1000, 7, 1, 3))]
    assert [r.name for r in cascade.order_rules(stats)] == ["n_symbols", "n_words", "n_repeat_words", "n_dup_lines", "word_chars"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x="</p>";</script></head><body>
<header><h1>Site</h1><p>The site of all the things that are on the site and in the world and more.</p></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and the site is to be used with the cookies on it.</div>
<article><h1>A title &amp; more</h1><p><b>Bold &lt;start&gt;<br>of the text, which is a paragraph of the article and it is long enough.<p>Short.
<p>Another   paragraph\nof the article, with the <a href=x>link in it</a> and some more of the words that are common.</p>
<aside>The aside is not a part of the article, and it is in the page for the adverts.</aside><!-- <p>no</p> --><form><p>Your name</p></form>
<p>Tail.</p><section class="comments"><p>I think that this is the best of all the articles that I have read in the year.</p></section></article>
<div id="sidebar"><p>Related: the other things that are on the site and that you may like to read.</p></div><footer>&copy; The end of the page and of the site</footer>"""


def test_html_main_text(spark):
    text = ("A title & more\n\nBold <start> of the text, which is a paragraph of the article and it is long enough.\n\nShort.\n\n"
            "Another paragraph of the article, with the link in it and some more of the words that are common.\n\nTail.")
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>Only this.</p>"), (4, "u", "< broken <p"), (1, "u", PAGE), (5, "u", "<nav>menu</nav>")]
    out = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert Counter((r["page_id"], r["url"], r["text"]) for r in out) == Counter(
        [(1, "u", text)] * 2 + [(2, None, ""), (3, "u", ""), (None, "u", "Only this."), (4, "u", "< broken <p"), (5, "u", "")])
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_open_blocks_inherit_from_the_nearest():
    good = "the text of the article is long and it has all of the words that are in it"
    page = f"<div><p>{good}</p><p>Near.</p></div><div class=menu><p>x</p></div><div><p>y <a href=1>all of this is a link</a></p><p>Off.</p></div>"
    assert html_text.main_text(page) == f"{good}\n\nNear."
