"""Goldens and properties for vocabulary, sequences, pooling, profiles, metrics (FIXTURES §3, SURVEY §5)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectional.operators import metrics as M
from sectional.operators import pooling as PL
from sectional.operators import profile as P
from sectional.operators import sequences as Q
from sectional.operators import vocab as V
from sectional.sources import corpus as C


def test_a4_vocab_and_j1(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b", "c"])], "doc_id long, tokens array<string>")
    vocab = V.build_vocab(df, ["tokens"], max_size=2)
    got = {r["token"]: r["idx"] for r in vocab.collect()}
    assert got == {"<unk>": 0, "<pad>": 1, "<SOS>": 2, "a": 3, "b": 4}
    ids = V.numericalise(df, ["doc_id"], "tokens", vocab).first()["ids"]
    assert ids == [3, 3, 4, 0]


def test_a3_heading_mass(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],)], "h array<string>")
    r = P.heading_mass(P.heading_counts(df, "h")).first()
    assert (r["n_distinct"], r["mass"], r["repeated_mass"]) == (2, 4, 3)


def test_w1_fixed_length(spark):
    df = spark.createDataFrame([(["x", "y", "z"],), ([f"t{i}" for i in range(20)],), (None,)], "t array<string>")
    rows = [r["s"] for r in df.select(Q.fixed_length(F.col("t"), 16).alias("s")).collect()]
    assert rows[0] == ["<SOS>", "x", "y", "z"] + ["<pad>"] * 12
    assert rows[1] == ["<SOS>"] + [f"t{i}" for i in range(15)]
    assert all(len(r) == 16 and r[0] == "<SOS>" for r in rows)


def test_w2_split_is_a_stable_partition(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"]: r["s"] for r in df.select("doc_id", Q.split_label("doc_id").alias("s")).collect()}
    b = {r["doc_id"]: r["s"] for r in df.repartition(7).select("doc_id", Q.split_label("doc_id").alias("s")).collect()}
    assert a == b and set(a.values()) == {"train", "valid", "test"}
    share = sum(v == "train" for v in a.values()) / len(a)
    assert 0.55 < share < 0.65


def test_w3_batches_bounded(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id").withColumn("split", F.lit("train"))
    b = Q.assign_batches(df, "doc_id", "split", batch_size=48, buckets=4)
    sizes = [r["count"] for r in b.groupBy("bucket", "batch").count().collect()]
    assert max(sizes) <= 48 and sum(sizes) == 500


def pooled(spark, rows, table, width, pool):
    df = spark.createDataFrame(rows, "doc long, ids array<int>")
    return {r["doc"]: r["pooled"] for r in PL.pool_rows(df, ["doc"], "ids", np.asarray(table, float), width, pool).collect()}


def test_pooling_of_index_rows(spark):
    vectors = [[0.0], [1.0], [-3.0], [2.0], [5.0], [-1.0]]
    rows = [(1, [1, 2, 3]), (2, [1, 3, 5]), (3, [4]), (4, []), (5, None)]
    dots = PL.conv_dots(np.asarray(vectors), [[[1.0], [1.0]]])
    assert pooled(spark, rows, dots, 1, PL.convolution_rows([0.0])) == {1: [0.0], 2: [3.0], 3: [0.0], 4: [0.0], 5: [0.0]}
    assert pooled(spark, rows, vectors, 1, PL.last_row) == {1: [2.0], 2: [-1.0], 3: [5.0], 4: [0.0], 5: [0.0]}
    assert pooled(spark, rows, vectors, 1, PL.mean_rows) == {1: [0.0], 2: [pytest.approx(2 / 3)], 3: [5.0], 4: [0.0], 5: [0.0]}
    scores = np.array([0, 0.0, 0, 900 + math.log(3), 0, 900.0])  # large scores need the row's own shift
    got = pooled(spark, [(1, [5, 3]), (2, [])], vectors, 1, PL.attention_rows(scores))
    assert got == {1: [pytest.approx(0.25 * -1 + 0.75 * 2)], 2: [0.0]}


def test_top_tokens_cut_ties_by_token(spark):
    counts = spark.createDataFrame([(f"t{i:03}", 5 if i < 3 else 2) for i in range(200)] + [("z", 9)], "token string, cnt long")
    got = [(r["token"], r["idx"]) for r in V.top_tokens(counts, 10, first_index=3).orderBy("idx").collect()]
    assert got == [(t, k + 3) for k, t in enumerate(["z", *[f"t{i:03}" for i in range(9)]])]
    assert V.top_tokens(counts, 500).count() == V.top_tokens(counts, None).count() == 201


def test_broken_corpus_files_fail_and_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"p1": {"title": "x"}, "p2": {"title": "y"}}')
    assert {r["paper_id"] for r in C.read_corpus(spark, str(tmp_path)).collect()} == {"p1", "p2"}
    (tmp_path / "b.json").write_text('{"p3": {"title": "x"}, "p4": {"ti')
    with pytest.raises(Exception, match="keyed-JSON"):
        C.read_corpus(spark, str(tmp_path)).collect()
    assert [r["file"][-6:] for r in C.corpus_rejects(spark, str(tmp_path)).collect()] == ["b.json"]


def test_vector_tokens_may_hold_spaces(spark, tmp_path):
    (tmp_path / "v.txt").write_text(". . 4 5 6\n\na 1 2 3\n")
    got = {r["token"]: r["vec"] for r in C.read_vectors(spark, str(tmp_path / "v.txt"), dim=3).collect()}
    assert got == {". .": [4.0, 5.0, 6.0], "a": [1.0, 2.0, 3.0]}
    with pytest.raises(Exception, match="not a vector line"):
        C.read_vectors(spark, str(tmp_path / "v.txt"), dim=5).collect()


def test_a6_nll_and_mean_of_batch_means(spark):
    df = spark.createDataFrame([([1.0, 3.0], 1)], "z array<double>, y int")
    assert df.select(M.nll_from_logits(F.col("z"), F.col("y")).alias("l")).first()["l"] == pytest.approx(0.126928, abs=1e-6)
    losses = spark.createDataFrame([("s", 0, 0.1), ("s", 0, 0.3), ("s", 1, 0.5)], "g string, b int, l double")
    assert M.batch_mean_loss(losses, ["g"], ["b"], "l").first()["loss"] == pytest.approx(0.35)


def test_a7_accuracy(spark):
    df = spark.createDataFrame([("s", 0, 1, 1), ("s", 0, 0, 0), ("s", 1, 1, 0)], "g string, b int, p int, y int")
    r = M.accuracy(df, ["g"], "p", "y", ["b"], batch_size=2).first()
    assert r["accuracy"] == pytest.approx(2 / 3) and r["accuracy_compat"] == pytest.approx(0.5)


def test_m5_predict_first_max(spark):
    df = spark.createDataFrame([([0.1, 0.9],), ([0.5, 0.5],)], "z array<double>")
    assert [r["p"] for r in df.select(M.predict(F.col("z")).alias("p")).collect()] == [1, 0]


def test_a9_box_summary(spark):
    df = spark.createDataFrame([("s", v) for v in [1, 2, 3, 4, 100]], "g string, v int")
    r = P.box_summary(df, "g", "v").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"], r["n_outliers"]) == (2, 3, 4, 1, 4, 1)


def test_s4_size_tier(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(r["id"] for r in C.size_tier(df, -1, "id").collect()) == [1, 2]
    assert sorted(r["id"] for r in C.size_tier(df, 2, "id").collect()) == [1, 2]
    assert C.size_tier(df, None, "id").count() == 3


def test_s1_keyed_json(spark, tmp_path):
    p = tmp_path / "data1"
    p.write_text('{"p1": {"abstract": "We rate papers.", "title": "Rating", "authors": "A B,C D", "category": "cs.CL", '
                 '"venue": "CoRR", "tex_data": ["\\\\Section{Introduction}\\n", "We rate $x$ papers.\\n"]}, '
                 '"p2": {"abstract": "b", "title": null, "authors": "E F", "category": "cs.LG", "venue": "ACL", "tex_data": []}}')
    df = C.normalise_corpus(C.read_corpus(spark, str(p))).orderBy("paper_id").collect()
    assert [r["paper_id"] for r in df] == ["p1", "p2"]
    assert df[0]["abstr"] == "We rate papers." and df[0]["autho"] == "A B,C D" and df[1]["title"] is None


def test_k2_uncapped_vocabulary_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i, [f"t{j}" for j in range(i % 7)]) for i in range(60)], "doc_id long, tokens array<string>")
    capped = {r["token"]: r["idx"] for r in V.build_vocab(df, ["tokens"], max_size=1000).collect()}
    uncapped = {r["token"]: r["idx"] for r in V.build_vocab(df, ["tokens"], max_size=None).collect()}
    assert capped == uncapped and sorted(uncapped.values()) == list(range(len(uncapped)))


def test_w4_last_and_last_non_pad(spark):
    df = spark.createDataFrame([(["<SOS>", "a", "b", "<pad>", "<pad>"],), (["<pad>"],)], "s array<string>")
    rows = df.select(Q.last_step(F.col("s")).alias("l"), Q.last_non_pad(F.col("s")).alias("r")).collect()
    assert [(r["l"], r["r"]) for r in rows] == [("<pad>", "b"), ("<pad>", None)]


def test_a9_approx_quartiles_close_to_exact(spark):
    df = spark.createDataFrame([("s", v) for v in range(1, 1001)], "g string, v int")
    exact = P.box_summary(df, "g", "v").first()
    approx = P.box_summary(df, "g", "v", approx=True).first()
    assert abs(exact["median"] - approx["median"]) <= 2 and approx["n_outliers"] == 0


def test_w2_stratified_split_is_exact_per_label(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn(
        "label", F.when(F.col("doc_id") % 10 < 8, 1).otherwise(0))  # one label holds 80 % of rows
    out = Q.split_label_stratified(df, "doc_id", "label", grid=64)
    got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(1, "train"): 1440, (1, "valid"): 480, (1, "test"): 480,
                   (0, "train"): 360, (0, "valid"): 120, (0, "test"): 120}
    again = {r["doc_id"]: r["split"] for r in Q.split_label_stratified(df.repartition(5), "doc_id", "label", grid=64).collect()}
    assert again == {r["doc_id"]: r["split"] for r in out.collect()}


def test_density_is_exact_and_null_without_spread(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.exponential(60, 3000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7)] * 5 + [("c", 3), ("d", None)], "section string, v int")
    got = {}
    for r in P.kde(df, "section", "v").collect():
        got.setdefault(r["section"], []).append((r["x"], r["density"]))
    v = np.array(values, float)
    h = v.std(ddof=1) * len(v) ** -0.2
    for x, density in got["a"]:
        assert abs(density - np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))) < 1e-8
    assert all(d is None for g in "bc" for _, d in got[g]) and "d" not in got
