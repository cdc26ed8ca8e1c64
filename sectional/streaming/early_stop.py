"""Early stopping over an unbounded metric log, on Spark's state store (U4).

A run's rows come in any order within ``delay``. Spark keeps the watermark, the state, its versions and the timers. Runs are
dealt over ``SHARDS`` keys by hash, and a key's state is two tables of its runs, read and written as a whole: a run's
state is its progress over the steps that the watermark has passed (folded in event order, then forgotten) and the rows
that are still waiting. Whenever rows of a run come, or a timer says that waiting ones are due, the run's line goes to a
change log: what it would be if no other row came (``n_steps``, ``stop_step``, ``best_index``, ``best_metric``), and how many of its
steps are settled. The log's last line of each run is the answer so far, and equals the batch operator's over all rows
that came in time. A query that is started again on the same checkpoint goes on from its state.

Rows behind the watermark are dropped by Spark and counted in the query's progress (``Drained.late``). Rows without a run
or an event time are no steps. State holds what lies within ``delay`` for the
runs of a shard, so that bounds a task's memory; ``with_late`` says how many rows each run lost.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sectional.operators.stopping import LONG_MAX, Progress, Rules, advance_all
from sectional.session import settings

CHANGES = "run_id long, change long, n_steps long, n_settled long, stop_step int, best_index int, best_metric double"
#: Keys of the state: a key costs calls and files whatever it holds, so that many runs share one.
SHARDS = 512
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Drained(NamedTuple):
    runs: DataFrame
    late: int


RUNS = pa.schema([("run_id", pa.int64()), ("step", pa.int64()), ("best", pa.float64()), ("best_step", pa.int64()), ("stop_step", pa.int64()), ("change", pa.int64())])
WAITING = pa.schema([("run_id", pa.int64()), ("at", pa.int64()), ("event_id", pa.int64()), ("value", pa.float64())])


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


class Watch(StatefulProcessor):
    """A shard of runs: their settled progress, and waiting rows (event time in microseconds, event id, metric), a table each."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "runs binary")
        self.waiting = handle.getValueState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[WAITING.names] for pdf in rows])
        yield self._fold(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._fold(None, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _read(state, schema: pa.Schema) -> pa.Table:
        return pa.ipc.open_stream(bytes(state.get()[0])).read_all() if state.exists() else schema.empty_table()

    def _fold(self, new: pd.DataFrame | None, watermark: int) -> pd.DataFrame:
        """Progress of the runs that got rows or whose waiting rows are due."""
        held = self._read(self.waiting, WAITING).to_pandas()
        rows = held if new is None else pd.concat([held, new.astype(held.dtypes.to_dict())])
        rows = rows.sort_values(["run_id", "at", "event_id"], kind="stable")
        due = rows["at"].to_numpy() <= watermark * 1000
        run, value = rows["run_id"].to_numpy(), rows["value"].to_numpy()
        touched = run[due] if new is None else np.concatenate([run[due], new["run_id"].to_numpy(np.int64)])
        touched = np.unique(touched)
        columns = [c.to_pylist() for c in self._read(self.settled, RUNS).columns]
        known = {r: (Progress(*was), change) for r, *was, change in zip(*columns)}
        starts, ends = np.searchsorted(run, touched), np.searchsorted(run, touched, side="right")
        lines = []
        for one, lo, hi in zip(touched.tolist(), starts, ends):
            progress, change = known.get(one, (Progress(), 0))
            at = lo + int(due[lo:hi].sum())  # in order of time, so the due rows come first
            progress = advance_all(progress, value[lo:at], self.rules)
            known[one] = progress, change + 1
            now = advance_all(progress, value[at:hi], self.rules)
            lines.append((one, change + 1, now.step, progress.step, now.stop_step, now.best_step, now.best))
        if lines:
            table = zip(*[(r, *progress, change) for r, (progress, change) in known.items()])
            self.settled.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(table, RUNS)], schema=RUNS)),))
        rest = rows[~due]
        if len(rest):
            self.waiting.update((_packed(pa.table([pa.array(rest[f.name].to_numpy(), f.type) for f in WAITING], schema=WAITING)),))
            self.handle.registerTimer(-(-int(rest["at"].min()) // 1000) - 1)  # comes once the watermark is above it
        elif len(held):
            self.waiting.clear()
        out = pd.DataFrame(lines, columns=[c.split()[0] for c in CHANGES.split(", ")])
        return out.astype({"run_id": "int64", "change": "int64", "n_steps": "int64", "n_settled": "int64", "stop_step": "Int32", "best_index": "int32", "best_metric": "float64"})


def changes(stream: DataFrame, run: str = "user_id", time: str = "ts", event: str = "event_id", metric: str = "value",
            delay: dt.timedelta = dt.timedelta(0), rules: Rules = Rules(), shards: int = SHARDS) -> DataFrame:
    """The change log (streaming) of a streaming metric log; a checkpoint keeps its ``shards``. Rows without an event id come last of their time."""
    rows = stream.select(F.col(run).cast("long").alias("run_id"), F.col(time).cast("timestamp").alias("ts"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"),
                         F.coalesce(F.col(event).cast("long"), F.lit(LONG_MAX)).alias("event_id"), F.col(metric).cast("double").alias("value"))
    timed = rows.where(F.col("run_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", f"{delay // dt.timedelta(milliseconds=1)} milliseconds")
    dealt = timed.withColumn("shard", F.pmod(F.xxhash64("run_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").transformWithStateInPandas(Watch(rules), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def latest(log: DataFrame) -> DataFrame:
    """Each run's last line of a change log."""
    last = log.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), "change").alias("r"))
    return last.select("run_id", "r.n_steps", "r.stop_step", "r.best_index", "r.best_metric")


def with_late(runs: DataFrame, log: DataFrame, run: str = "user_id", time: str = "ts") -> DataFrame:
    """``runs`` with ``n_late``: rows of ``log`` (all that the stream has read) that came too late to be a step."""
    rows = log.where(F.col(run).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(run).cast("long").alias("run_id")).agg(F.count("*").alias("_rows"))
    return runs.join(rows, "run_id").withColumn("n_late", F.col("_rows") - F.col("n_steps")).drop("_rows")


def run_available(spark: SparkSession, source: str, schema, out_dir: str, ckpt_dir: str, run: str = "user_id",
                  max_files: int | None = None, delay: dt.timedelta = dt.timedelta(0), **knobs) -> Drained:
    """Drain what a Parquet folder holds (and an earlier call on the same checkpoint hasn't read) as a stream.

    The change log is appended to ``out_dir``. Returns every run's answer so far and the rows this call dropped as late.
    ``max_files`` cuts the folder into micro-batches.
    """
    reader = spark.readStream.schema(schema)
    if any(c in source for c in "*?["):
        reader = reader.option("basePath", os.path.dirname(source))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    with settings(spark, **{"spark.sql.streaming.stateStore.providerClass": PROVIDER}):
        query = changes(reader.parquet(source), run, delay=delay, rules=Rules(**knobs)).writeStream.format("parquet").outputMode("append") \
            .option("path", out_dir).option("checkpointLocation", ckpt_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    return Drained(latest(spark.read.schema(CHANGES).parquet(out_dir)), late)
