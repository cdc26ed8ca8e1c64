"""Phrase collocations against a brute-force count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sectional.llm import phrases

from .corpus import documents, lower, nothing, rows


def brute(texts, least, top, share):
    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                if not any(len(q) > len(p) and c >= least and 100 * c >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                           for q, c in counts.items() if len(q) == 3):
                    found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in phrases.mine(df, **kw).collect())


@pytest.mark.parametrize("top, share, ship", [(5, 50, 2_000_000), (5, 50, 7), (40, 80, 50), (10_000, 50, 2_000_000), (1, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, top, share, ship):
    monkeypatch.setattr(phrases, "SHIP", ship)
    rng = random.Random(top)
    vocab = ["the", "of", "a", "new", "york", "city", "state", "bank", "Ünder", "x\x00y", " ", "É", "$1"]
    weights = [9, 7, 5, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1]
    table = []
    for i in range(120):
        w = rng.choices(vocab, weights, k=rng.choice([0, 1, 2, 12, 40]))
        for at in range(0, len(w) - 3, 7):
            w[at:at + 3] = rng.choice([["New", "York", "city"], ["bank", "of", "york"]])
        table.append((rng.choice(["en", "en", "en", "de", None, "", "und"]), rng.choice([" ", "  ", "\t"]).join(w).replace("$1", rng.choice(["$1", ".", "!\n", "\r"]))))
    table += [("en", None), (None, None), ("xx", "only once"), ("fr", "a b. a b; b a")] + [("hot", "same words again and again")] * 20
    df = spark.createDataFrame(table, "lang string, text string").selectExpr("*", "'z' as w1", "1L as a", "2 as rank")
    assert mined(df, least=2, top=top, share=share) == brute(table, 2, top, share)


def test_corpus_and_slices(spark, monkeypatch):
    table = [(r[2], r[1]) for r in rows()]
    want = brute(table, 3, 50, 50)
    assert mined(documents(spark), least=3, top=50) == want
    monkeypatch.setattr(phrases, "SLICE", 300)
    assert mined(documents(spark), least=3, top=50) == want
    assert mined(nothing(spark)) == []


def test_products_beyond_64_bits(spark):
    big = 10**12
    df = spark.createDataFrame([(big, big + 3, big + 1), (big, 10 * big, 7)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.cut_score("a", "l", "r")).collect()]
    assert got == [10**6 * big * big // ((big + 3) * (big + 1)), 10**6 * big * big // (70 * big)]
