"""Registered queries vs their DuckDB oracle on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from sectional.sources.tables import TABLES

from .conftest import SF_SMALL

CHEAP = ["vocab_top", "clean_text", "label_map", "corpus_trim", "list_split", "section_clean", "section_compat",
         "section_prefix", "residual", "heading_top", "heading_mass", "length_box", "length_hist", "split_assign", "split_stratified",
         "batch_assign", "author_vocab", "vector_coverage", "pool_last", "cross_entropy", "accuracy", "early_stop", "early_stop_stream",
         "head_scores", "head_train", "gru_scores", "lstm_scores", "pool_attention", "author_features", "prepared_tokens", "read_keyed_json",
         "embed_join", "sketch_summary"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        return repr(round(x, 6)) if isinstance(x, float) and not math.isnan(x) else repr(x)

    return sorted("|".join(v(r[i]) for i in order) for r in rows)


def test_every_query_has_a_key_and_sql_is_a_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(res.fetchall(), dcols)


def test_shuffle_partitions_do_not_change_results(spark, con):
    q = E.queries()["length_hist"]
    out = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = q(spark, SF_SMALL)
        out.append(canon([tuple(r) for r in df.collect()], df.columns))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["split"] for r in rows} <= {"train", "valid", "test"} and len(rows) >= 1
