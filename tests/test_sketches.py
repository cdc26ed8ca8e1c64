"""Stored sketches merge to answers within their bounds (A2, A9, K2); mean pooling by a join equals the broadcast form."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectional.operators import pooling as PL
from sectional.operators import sketches as SK
from sectional.operators import vocab as V
from sectional.session import cut_lineage, discard


def test_merged_sketches_stay_within_their_bounds(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{i % 3}" if i % 7 else None, [f"t{int(rng.paretovariate(1))}" for _ in range(rng.randrange(40))] + [None], rng.randrange(1000) if i % 9 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "shard string, tokens array<string>, n int")
    for part in ("shard = 's0'", "shard = 's1' OR shard = 's2'", "shard IS NULL"):  # a later shard is added to the table
        SK.shard_sketches(df.where(part), "shard", "tokens", "n", kll_k=200, items=2000).write.mode("append").parquet(str(tmp_path / "s"))
    union = SK.merged(spark.read.parquet(str(tmp_path / "s")), 2000)
    got = union.select(SK.distinct_of(F.col("distinct")), SK.quantile_of(F.col("quantiles"), 0.5), SK.top_of("frequent", 5), "n_tokens", "n_rows").first()
    counts = Counter(t for _, ts, _ in rows for t in ts if t is not None)
    values = sorted(n for _, _, n in rows if n is not None)
    assert abs(got[0] / len(counts) - 1) <= SK.distinct_bound() and got["n_tokens"] == sum(counts.values()) and got["n_rows"] == len(values)
    assert abs(sum(v <= got[1] for v in values) / len(values) - 0.5) <= SK.rank_bound(200) + 0.001
    assert [r["item"] for r in got[2]][:3] == [t for t, _ in counts.most_common(3)]
    held = SK.quantile_holds(df, "n", [(0.5, got[1]), (0.5, 990)], SK.rank_bound(200)).collect()
    assert [r["within"] for r in held] == [True, False]


def test_empty_shards(spark):
    df = spark.createDataFrame([("a", [], None), ("a", None, None)], "shard string, tokens array<string>, n int")
    row = SK.shard_sketches(df, "shard", "tokens", "n").first()
    assert (row["n_tokens"], row["n_rows"]) == (0, 0)
    assert SK.shard_sketches(df.limit(0), "shard", "tokens", "n").count() == 0


@pytest.mark.parametrize("hot", [0, 5, 4096])
def test_join_equals_the_broadcast_form(spark, hot):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["x" * 300]
    rows = [(i, rng.choices(words, [1 / (k + 1) for k in range(61)], k=rng.randrange(50))) for i in range(80)] + [(100, None), (101, []), (102, [None, "w0"]), (103, ["x" * 300] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vocab = V.build_vocab(df.where("doc_id < 40 OR doc_id = 103"), ["tokens"], None)
    assert vocab.where("token = '" + "x" * 300 + "'").count() == 1
    vectors = spark.createDataFrame([(i, [float(i), -1.0, i * 0.5]) for i in range(0, 70, 2)], "idx int, vec array<double>")
    matrix = PL.vector_matrix(PL.vectors_by_index(vocab, vectors, 3, "idx", "vec"), 80, 3)
    ids = V.numericalise(df, ["doc_id"], "tokens", vocab)
    want = {r["doc_id"]: r["pooled"] for r in PL.pool_rows(ids, ["doc_id"], "ids", matrix, 3, PL.mean_rows).collect()}
    got = {r["doc_id"]: r["pooled"] for r in PL.mean_by_join(df, ["doc_id"], "tokens", vocab, vectors, 3, hot=hot).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_a_vector_travels_once_per_slice(spark, monkeypatch):
    """Rows that share their tokens list them once; slices, parts and lists of any size give the same means."""
    rows = [(i % 150, [f"w{(i + 7 * k) % 40}" for k in range(30)] * 300) for i in range(200)] + [(None, ["w1", "w2"]), (None, ["w3", None]), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(1)
    vocab = V.build_vocab(df.where("doc_id is not null"), ["tokens"], None)
    vectors = spark.createDataFrame([(i, [float(i), -1.0, i * 0.5]) for i in range(0, 40, 3)], "idx int, vec array<double>")
    written = {}

    def kept(table, name, *how):
        written[name] = cut_lineage(table, name, *how)
        return written[name]

    def means(hot):
        return {r["doc_id"]: r["pooled"] for r in PL.mean_by_join(df, ["doc_id"], "tokens", vocab, vectors, 3, hot=hot).collect()}

    want = means(4096)  # all vectors in the tasks
    monkeypatch.setattr(PL, "cut_lineage", kept)
    got = means(0)
    assert written["token-parts"].where("token is not null").count() <= 42
    none = spark.createDataFrame([(1, []), (2, None)], "doc_id long, tokens array<string>")
    assert sorted(map(tuple, PL.mean_by_join(none, ["doc_id"], "tokens", vocab, vectors, 3).collect())) == [(1, [0.0] * 3), (2, [0.0] * 3)]
    for name, value in (("SLICE_ROWS", 10), ("SLICE_TOKENS", 7), ("PART_ROWS", 3)):
        monkeypatch.setattr(PL, name, value, raising=False)
        small = means(0)
        assert got.keys() == small.keys() == want.keys() and all(np.allclose(got[k], want[k]) and np.allclose(small[k], want[k]) for k in want)


def test_a_discarded_table_goes_alone(spark, tmp_path):
    one, other = (cut_lineage(spark.range(5), name) for name in ("going", "staying"))
    files = one.inputFiles()
    assert files
    discard(one)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in files) and other.count() == 5
    spark.range(3).write.parquet(str(tmp_path / "own"))  # not one of those tables
    discard(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_long_tokens_have_their_index(spark):
    """A token of any length is looked up; one that only shares its beginning isn't."""
    long = "y" * 1000
    df = spark.createDataFrame([(1, [long, long + "z", "a", None])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("<unk>", 0), ("a", 1), (long, 2)], "token string, idx int")
    assert V.numericalise(df, ["doc_id"], "tokens", vocab).first()["ids"] == [2, 0, 1, 0]


def test_pooling_a_long_document_needs_no_row_per_token():
    table = np.random.default_rng(0).normal(size=(7, 4))
    ids = np.arange(3_000_000) % 7
    assert np.allclose(PL.mean_rows(ids, table), table[ids[:7 * 428571]].mean(axis=0), atol=1e-6)
    scores = table[:, 0]
    w = np.exp(scores[ids])
    assert np.allclose(PL.attention_rows(scores)(ids, table), (w[:, None] * table[ids]).sum(axis=0) / w.sum())
