"""Scale helpers: spread, bounded broadcast, lineage cuts."""

from pyspark.sql import functions as F

from sectional.operators.joins import bounded_broadcast
from sectional.session import cut_lineage, ensure_checkpoint_dir
from sectional.sources.tables import spread


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_spread_repartitions_only_coarse_inputs(spark):
    coarse = spark.range(100).coalesce(1)
    fine = spark.range(100).repartition(64)
    assert spread(coarse, "id").rdd.getNumPartitions() > 1
    assert spread(fine, "id") is fine  # enough splits already: no extra shuffle


def test_bounded_broadcast_hints_only_within_the_bound(spark):
    small = spark.range(10)
    assert "broadcast" in plan(bounded_broadcast(small, 40_003, 96)).lower()
    assert "broadcast" not in plan(bounded_broadcast(small, 10**9, 1024)).lower()


def test_cut_lineage_writes_under_the_checkpoint_folder(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    out = cut_lineage(df, "test-stage")
    assert sorted(r["x"] for r in out.collect()) == [0, 2, 4, 6, 8]
    folder = ensure_checkpoint_dir(spark)
    assert any(f.startswith(folder.rstrip("/")) or folder.split(":", 1)[-1] in f for f in out.inputFiles())


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    """The files of its computation go, the table stays, and the session's setting is as before."""
    import os

    from pyspark.sql import functions as F

    from sectional.session import _CLEANUP, cut_lineage

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(1 for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle"))
    before = files()
    out = cut_lineage(spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n"), "cleanup")
    assert files() <= before and out.count() == 1000
    assert spark.conf.get(_CLEANUP, None) is None


def test_batches_of_sequences_are_small(spark):
    """Rows that hold whole texts come to Python workers a bounded number at a time."""
    from sectional.operators import vocab as V
    from sectional.session import ARROW_ROWS, small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        vocab = spark.createDataFrame([("a", 3)], "token string, idx int")
        V.numericalise(spark.createDataFrame([(1, ["a"])], "doc_id long, tokens array<string>"), ["doc_id"], "tokens", vocab)
        assert spark.conf.get(name) == str(ARROW_ROWS)
        for given, kept in (("0", str(ARROW_ROWS)), ("7", "7")):
            spark.conf.set(name, given)
            small_batches(spark)
            assert spark.conf.get(name) == kept
    finally:
        spark.conf.set(name, before)
