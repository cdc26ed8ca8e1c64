"""Registered metric, early-stopping, model and source queries."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectional.config import BATCH_SIZE, PATIENCE
from sectional.operators import metrics as M
from sectional.operators import sequences as Q
from sectional.operators import stopping as W
from sectional.plans import sqlgen as g
from sectional.plans.catalog import register
from sectional.session import cut_lineage, ensure_checkpoint_dir
from sectional.sources.tables import table
from sectional.streaming import early_stop as U

# Fixed linear score: logits (0, ln(n_chars + 1) - 7).
SCORE_OFFSET = 7.0


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels (J4) with logits, prediction, split and batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    z1 = F.log(F.col("n_chars").cast("double") + F.lit(1.0)) - F.lit(SCORE_OFFSET)
    s = docs.join(labels, "doc_id").select("doc_id", "label", F.array(F.lit(0.0), z1).alias("logits"),
                                           Q.split_label("doc_id").alias("split"))
    s = s.withColumn("nll", M.nll_from_logits(F.col("logits"), F.col("label"))) \
         .withColumn("pred", M.predict(F.col("logits")))
    return Q.assign_batches(s, "doc_id", "split", BATCH_SIZE)


_SCORED_SQL = f"""WITH s AS (
  SELECT d.doc_id, l.quality AS label, ln(d.n_chars + 1.0) - {SCORE_OFFSET!r} AS z1, {g.split_label("d.doc_id")} AS split,
         {g.key_hash("d.doc_id", 17)} AS h1, {g.key_hash("d.doc_id", 9)} AS h2
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
s2 AS (SELECT *, CAST(h1 % {g.batch_buckets("s", BATCH_SIZE)} AS INTEGER) AS bucket FROM s),
b AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY split, bucket ORDER BY h2, doc_id) - 1) / {BATCH_SIZE}) AS INTEGER) AS batch,
         greatest(0.0, z1) AS m
  FROM s2
),
r AS (
  SELECT *, ln(exp(0.0 - m) + exp(z1 - m)) + m - (CASE WHEN label = 1 THEN z1 ELSE 0.0 END) AS nll,
         CASE WHEN z1 > 0.0 THEN 1 ELSE 0 END AS pred
  FROM b
)"""


# cross_entropy: A6 J4 W3 --------------------------------------------------------------
@register("cross_entropy", sql=_SCORED_SQL + """,
pb AS (SELECT split, bucket, batch, avg(nll) AS bl FROM r GROUP BY split, bucket, batch)
SELECT split, count(*) AS n_batches, round(avg(bl), 6) AS loss FROM pb GROUP BY split
""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.batch_mean_loss(scored_documents(spark, sf_dir), ["split"], ["bucket", "batch"], "nll")
    return out.select("split", "n_batches", F.round("loss", 6).alias("loss"))


# accuracy: A7 M5 ----------------------------------------------------------------------
@register("accuracy", sql=_SCORED_SQL + f"""
SELECT split, count(*) AS n, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) / (count(DISTINCT (bucket, batch)) * {BATCH_SIZE}.0), 6) AS accuracy_compat,
       round(greatest(avg(label::DOUBLE), 1 - avg(label::DOUBLE)), 6) AS majority_rate
FROM r GROUP BY split
""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.accuracy(scored_documents(spark, sf_dir), ["split"], "pred", "label", ["bucket", "batch"], BATCH_SIZE)
    return out.select("split", "n", "correct", F.round("accuracy", 6).alias("accuracy"),
                      F.round("accuracy_compat", 6).alias("accuracy_compat"),
                      F.round("majority_rate", 6).alias("majority_rate"))


# early_stop: W7 over events (run = user_id, step by ts, event_id; metric = value) -----------------
_EARLY_STOP_SQL = f"""
WITH steps AS (
  SELECT user_id AS run_id, CASE WHEN NOT isnan(value::DOUBLE) THEN value::DOUBLE END AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
  FROM events
),
ev AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS seq,
         greatest(coalesce(max(m) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS prev_best
  FROM steps
),
ev2 AS (SELECT *, coalesce(m > prev_best, false) AS improved FROM ev),
ev3 AS (
  SELECT *, seq - coalesce(max(CASE WHEN improved THEN seq END) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS bad
  FROM ev2
),
stops AS (SELECT run_id, count(*) AS n_steps, min(CASE WHEN bad > {PATIENCE} THEN step END) AS stop_step FROM ev3 GROUP BY run_id),
best AS (
  SELECT e.run_id, max(e.step) FILTER (WHERE e.improved AND (s.stop_step IS NULL OR e.step <= s.stop_step)) AS best_index,
         arg_max(e.m, e.step) FILTER (WHERE e.improved AND (s.stop_step IS NULL OR e.step <= s.stop_step)) AS best_metric
  FROM ev3 e JOIN stops s ON e.run_id = s.run_id GROUP BY e.run_id
)
SELECT s.run_id, s.n_steps, CAST(s.stop_step AS INTEGER) AS stop_step, CAST(coalesce(b.best_index, 0) AS INTEGER) AS best_index,
       b.best_metric
FROM stops s JOIN best b ON s.run_id = b.run_id
"""


@register("early_stop", sql=_EARLY_STOP_SQL)
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "value")
    return W.early_stop(ev, "run_id", ["ts", "event_id"], "value", patience=PATIENCE)


# early_stop_stream: U4 (same answer as W7, so the same oracle) -------------------------------
STREAM_PARTS = 6


@register("early_stop_stream", sql=_EARLY_STOP_SQL.replace("b.best_metric\nFROM stops", "b.best_metric, 0::BIGINT AS n_late\nFROM stops"))
def early_stop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a folder that grows: files by time, but every eighth row comes a file later than its time says."""
    run_dir = os.path.join(ensure_checkpoint_dir(spark), f"early-stop-{uuid.uuid4().hex}")
    ev = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = ev.agg(F.min(at), F.max(at)).first()
    width = ((high or 0) - (low or 0)) // STREAM_PARTS + 1
    part = F.floor((at - F.lit(low or 0)) / F.lit(width)) + (F.abs(F.xxhash64("event_id")) % 8 == 0).cast("int")
    landed = cut_lineage(ev.withColumn("part", part), "events-by-time")
    source = os.path.join(run_dir, "events")
    for k in range(STREAM_PARTS + 1):
        landed.where(F.col("part") == k).drop("part").write.mode("append").parquet(source)
    files = landed.rdd.getNumPartitions()
    found = U.run_available(spark, source, ev.schema, os.path.join(run_dir, "changes"), os.path.join(run_dir, "ckpt"), run="user_id",
                            max_files=files, delay=dt.timedelta(microseconds=3 * width), patience=PATIENCE)
    return U.with_late(found.runs, spark.read.schema(ev.schema).parquet(source))


# ----------------------------------------------------------------------------------
# Fused features and heads (M1, M3).
# ----------------------------------------------------------------------------------
import math  # noqa: E402

import numpy as np  # noqa: E402

from sectional.config import VOCAB_SIZE  # noqa: E402
from sectional.functions import sections as S  # noqa: E402
from sectional.functions import text as X  # noqa: E402
from sectional.operators import heads as H  # noqa: E402
from sectional.operators import vocab as V  # noqa: E402
from sectional.plans import model as MD  # noqa: E402
from sectional.plans import queries_vectors as QV  # noqa: E402
from sectional.plans.queries_vectors import EMB_DIM, frozen_vectors  # noqa: E402
from sectional.sources.tables import latex_documents  # noqa: E402


# fused_features: M1 over the mean-pooled sections; head_scores: M3 with weights from a rule ---------------------
def _fused_sql() -> str:
    sections = ", ".join(f"('{s}', {k})" for k, s in enumerate(S.SECTIONS))
    return QV.section_tokens_sql() + f""",
vecs AS (
  SELECT fv.idx, CAST(coalesce(e.embedding, list_transform(range({EMB_DIM}), lambda x: CAST(0 AS FLOAT))) AS DOUBLE[]) AS vec
  FROM full_vocab fv LEFT JOIN embeddings e ON e.vec_id = fv.idx
),
tk AS (SELECT doc_id, section, unnest(toks) AS token FROM long),
ti AS (SELECT tk.doc_id, tk.section, coalesce(fv.idx, 0) AS idx, count(*) AS c FROM tk LEFT JOIN full_vocab fv ON tk.token = fv.token GROUP BY ALL),
flat AS (SELECT doc_id, section, c, generate_subscripts(vec, 1) - 1 AS d, unnest(vec) AS x FROM ti JOIN vecs ON ti.idx = vecs.idx),
pm AS (SELECT doc_id, section, d, sum(c * x) / sum(c) AS x FROM flat GROUP BY doc_id, section, d),
fused AS (
  SELECT g.doc_id, CAST(g.k * {EMB_DIM} + g.d AS INTEGER) AS i, coalesce(pm.x, 0.0) AS x
  FROM (SELECT doc_id, section, k, d FROM documents, (VALUES {sections}) AS v(section, k), (SELECT unnest(range({EMB_DIM})) AS d) dims) g
  LEFT JOIN pm ON pm.doc_id = g.doc_id AND pm.section = g.section AND pm.d = g.d
)"""


def fused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = cut_lineage(QV.section_sequences(spark, sf_dir).select("doc_id", "split", "section", "tokens"), "section-tokens")
    vocab = cut_lineage(V.build_vocab(tokens.filter(F.col("split") == "train"), ["tokens"], VOCAB_SIZE), "section-vocab")
    pooled = MD.section_features(tokens, vocab, frozen_vectors(spark, sf_dir, vocab))
    return MD.fuse_sections(pooled, S.SECTIONS, EMB_DIM)


@register("fused_features", sql=_fused_sql() + """
SELECT doc_id, i, round(x, 6) + 0.0 AS value FROM fused
""")
def fused_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fused_documents(spark, sf_dir).select("doc_id", F.posexplode("fused").alias("i", "x"))
    return rows.select("doc_id", "i", (F.round("x", 6) + F.lit(0.0)).alias("value"))


HEAD_UNITS = 8


def head_weights(inputs: int, units: int, scale: float, phase: float) -> tuple[list, list]:
    """(weights, bias) of a layer from a rule."""
    return [[scale * math.sin(phase + i * units + j) for i in range(inputs)] for j in range(units)], [0.01 * j for j in range(units)]


@register("head_scores", sql=_fused_sql() + f""",
u AS (SELECT doc_id, j, sum(x * 0.3 * sin(1.0 + i * {HEAD_UNITS} + j)) + 0.01 * j AS h
      FROM fused, (SELECT unnest(range({HEAD_UNITS})) AS j) units GROUP BY doc_id, j),
z AS (SELECT doc_id, c, sum(greatest(0.0, h) * 0.5 * sin(2.0 + j * 2 + c)) + 0.01 * c AS r, sum(h * 0.5 * sin(2.0 + j * 2 + c)) + 0.01 * c AS l
      FROM u, (SELECT unnest(range(2)) AS c) classes GROUP BY doc_id, c)
SELECT doc_id, CAST(c AS INTEGER) AS class, round(r, 5) + 0.0 AS relu, round(l, 5) + 0.0 AS linear FROM z
""")
def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = H.Head(*[np.array(w) for w in (*head_weights(EMB_DIM * len(S.SECTIONS), HEAD_UNITS, 0.3, 1.0), *head_weights(HEAD_UNITS, 2, 0.5, 2.0))])
    both = F.arrays_zip(H.head_logits(spark, "fused", head).alias("relu"), H.head_logits(spark, "fused", head, "linear").alias("linear"))
    rows = fused_documents(spark, sf_dir).select("doc_id", F.posexplode(both).alias("class", "z"))
    return rows.select("doc_id", "class", (F.round("z.relu", 5) + F.lit(0.0)).alias("relu"), (F.round("z.linear", 5) + F.lit(0.0)).alias("linear"))


# ----------------------------------------------------------------------------------
# Sources: keyed-JSON corpus round trip (S1 S3 S5 S6 P1) and vector text files.
# Files go to the session's shared checkpoint folder, never a machine-local path.
# ----------------------------------------------------------------------------------
from sectional.sources import corpus as C  # noqa: E402


@register("read_keyed_json", sql=f"""
WITH {g.latex_cte()}
SELECT CAST(doc_id AS VARCHAR) AS paper_id, source AS venue, lang AS categ,
       CAST(CASE WHEN source IN ('CoRR', 'No') THEN 0 ELSE 1 END AS INTEGER) AS label,
       CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines,
       CAST(length(text) AS INTEGER) AS text_len, lang || ',' || source AS autho
FROM latex
""")
def read_keyed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = os.path.join(ensure_checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs = latex_documents(spark, sf_dir).select(
        "doc_id", F.element_at(F.split("text", "\n"), 1).alias("abstract"), F.col("lang").alias("title"),
        F.concat(F.col("lang"), F.lit(","), F.col("source")).alias("authors"), F.col("lang").alias("category"),
        F.col("source").alias("venue"), F.split("text", "\n").alias("tex_data"))
    C.write_keyed_json(docs, os.path.join(base, "json"), "doc_id",
                       ["abstract", "title", "authors", "category", "venue", "tex_data"])
    corpus = C.normalise_corpus(C.read_corpus(spark, os.path.join(base, "json")))
    C.write_prepared(corpus, os.path.join(base, "prepared"))
    prepared = C.read_prepared(spark, os.path.join(base, "prepared"), ["paper_id", "venue", "categ", "autho", "text"])
    return prepared.select("paper_id", "venue", "categ", X.venue_label("venue").alias("label"),
                           F.size(F.split("text", "\n")).alias("n_lines"), F.length("text").alias("text_len"), "autho")


@register("read_vectors", sql="""
SELECT 'tok' || CAST(vec_id AS VARCHAR) AS token, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0.0 AS vec_sum
FROM embeddings
""")
def read_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(ensure_checkpoint_dir(spark), f"vectors-{uuid.uuid4().hex}")
    emb = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("tok"), F.col("vec_id").cast("string")).alias("token"),
                                                    "embedding")
    C.write_vectors(emb, path, "token", "embedding")
    vec = C.read_vectors(spark, path)
    return vec.select("token", F.size("vec").alias("dim"),
                      (F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 5) + F.lit(0.0)).alias("vec_sum"))
