"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectional.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cell long, score long"


def brute(table, every, k=5, low=80):
    usable = {}
    for i, v, label in table:
        if i is not None and label is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v):
            row = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
            usable[i] = min(row, usable.get(i, row))
    out = []
    for a, (label, x) in usable.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in usable.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:k]:
            ps = -minus
            near = [(i, -m) for m, i, other in scored if other != label and low * ps <= 100 * -m <= 100 * ps][:k]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(near)]
    return sorted(out)


def mined(df, every, **kw):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect())


def frame(spark, table):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in table], SCHEMA)


@pytest.mark.parametrize("cell, first, block, chunk", [(200, 16, 2048, 1024), (4, 2, 8, 4)])
def test_equals_brute_force(spark, monkeypatch, cell, first, block, chunk):
    for name, value in (("CELL", cell), ("FIRST", first), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(cell)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 0.3 + (i % 6) / 4], int(rng.integers(4))) for i in range(400)]
    table += [(1000 + i, table[20][1], i % 2) for i in range(60)]  # one vector, many rows, two labels
    table += [(2000 + i, [1.0] * 8, 7) for i in range(3)] + [(2010, [2.0] * 8, 8), (2020, [-1.0] * 8, 9), (2030, [-1.0] * 8, 9)]
    table += [table[0], table[0], (1, [0.5] * 8, 0), (3000, None, 1), (3010, [0.0] * 8, 1), (3020, [1.0] * 8, None), (None, [1.0] * 8, 1), (3030, [float("nan")] * 8, 1),
              (3040, [None] + [1.0] * 7, 1), (3050, [], 1), (3060, [1.0] * 3, 1), (3070, [float("inf")] * 8, 1), (3080, [1e30] * 8, 1), (3090, [0.0] * 8, 2)]
    got = mined(frame(spark, table), 10)
    assert got == brute(table, 10)
    assert {a for a, *_ in got} >= {20, 1000}


def test_small_and_empty_tables(spark):
    assert mined(frame(spark, []), 1) == []
    assert mined(frame(spark, [(1, None, 1)]), 1) == []
    one = [(0, [1.0] * 8, 1)]
    assert mined(frame(spark, one), 1) == []
    few = one + [(1, [1.0] * 8, 1), (2, [0.9] * 8, 2), (3, [1.1] * 8, 2)]
    assert mined(frame(spark, few), 1) == brute(few, 1)
    odd = spark.createDataFrame([(i, [float(random.Random(i).random())], i % 2) for i in range(30)], "vec_id long, embedding array<double>, label long")
    assert len(mined(odd, 3)) > 0  # one component: the second half is empty


def test_cells_come_by_their_bound():
    rng = np.random.default_rng(0)
    one, two = rng.normal(size=7), rng.normal(size=5)
    order = negatives.visit(one, two, 0, 100, -np.inf)
    sums = [one[i] + two[j] for i, j in order]
    assert len(set(order)) == 35 and all(x >= y for x, y in zip(sums, sums[1:]))
    assert negatives.visit(one, two, 4, 9, -np.inf) == order[4:9]
    assert negatives.visit(one, two, 0, 100, sums[10]) == [c for c, s in zip(order, sums) if s >= sums[10]]


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**29, 3, -(2**29)], [1, 2, 3]])
    b = np.array([[2**29 + 1, 5, 1], [7, 2**29, -1]])
    assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
