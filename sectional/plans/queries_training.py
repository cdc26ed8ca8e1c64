"""Registered queries on training, saving and applying rating models."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectional.functions import sections as S
from sectional.functions import text as X
from sectional.operators import heads as H
from sectional.operators import sequences as Q
from sectional.operators import training as T
from sectional.plans import model as MD
from sectional.plans import queries_model as QM
from sectional.plans import queries_vectors as QV
from sectional.plans import sqlgen as g
from sectional.plans.catalog import register
from sectional.plans.queries_recurrent import rule_head
from sectional.plans.queries_vectors import CONV_BIAS, EMB_DIM, conv_weights, frozen_vectors
from sectional.session import cut_lineage
from sectional.sources.tables import latex_documents, spread, table

FLAGSHIP_VARIANT = "SharedAGRU"

# head_train: three full-batch Adam steps from a fixed start ------------------------------------------
STEPS, UNITS = 3, 8
RULE = T.Adam(rate=0.01)


def _train_sql() -> str:
    """The steps written out: u, h, z of every row, the summed gradients, moments and weights."""
    r = RULE
    parts = {"w1": ("i, j", f"0.3 * sin(1.0 + i * {UNITS} + j)", f"(SELECT unnest(range({EMB_DIM * len(S.SECTIONS)})) AS i) ii, (SELECT unnest(range({UNITS})) AS j) jj"),
             "b1": ("j", "0.01 * j", f"(SELECT unnest(range({UNITS})) AS j) jj"),
             "w2": ("j, c", "0.5 * sin(2.0 + j * 2 + c)", f"(SELECT unnest(range({UNITS})) AS j) jj, (SELECT unnest(range(2)) AS c) cc"),
             "b2": ("c", "0.01 * c", "(SELECT unnest(range(2)) AS c) cc")}
    out = [f""",
px AS MATERIALIZED (SELECT f.doc_id, f.i, f.x FROM fused f JOIN labels l ON l.doc_id = f.doc_id WHERE {g.split_label("f.doc_id")} = 'train' AND l.quality IS NOT NULL),
py AS MATERIALIZED (SELECT doc_id, quality AS y FROM labels WHERE doc_id IN (SELECT doc_id FROM px)),
pn AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM py)"""]
    out += [f"{p}0 AS MATERIALIZED (SELECT {keys}, {start} AS v, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM {grid})" for p, (keys, start, grid) in parts.items()]
    for t in range(STEPS):
        out.append(f"""u{t} AS MATERIALIZED (SELECT doc_id, px.* EXCLUDE (doc_id, i, x), w.j, sum(x * w.v) + max(b.v) AS u FROM px JOIN w1{t} w ON w.i = px.i JOIN b1{t} b ON b.j = w.j GROUP BY ALL),
z{t} AS MATERIALIZED (SELECT doc_id, w.c, sum(greatest(0.0, u) * w.v) + max(b.v) AS z FROM u{t} u JOIN w2{t} w ON w.j = u.j JOIN b2{t} b ON b.c = w.c GROUP BY doc_id, w.c),
p{t} AS MATERIALIZED (SELECT z.doc_id, c, exp(z - mx) / sum(exp(z - mx)) OVER (PARTITION BY z.doc_id) - CASE WHEN c = y THEN 1 ELSE 0 END AS d,
       CASE WHEN c = y THEN ln(sum(exp(z - mx)) OVER (PARTITION BY z.doc_id)) - (z - mx) END AS loss
     FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS mx FROM z{t}) z JOIN py ON py.doc_id = z.doc_id),
e{t} AS MATERIALIZED (SELECT p.doc_id, w.j, CASE WHEN max(u.u) > 0 THEN sum(p.d * w.v) ELSE 0 END AS d FROM p{t} p JOIN w2{t} w ON w.c = p.c JOIN u{t} u ON u.doc_id = p.doc_id AND u.j = w.j GROUP BY p.doc_id, w.j)""")
        grads = {"w1": f"SELECT px.i, e.j, sum(e.d * x) AS g FROM e{t} e JOIN px ON px.doc_id = e.doc_id GROUP BY px.i, e.j", "b1": f"SELECT j, sum(d) AS g FROM e{t} GROUP BY j",
                 "w2": f"SELECT u.j, p.c, sum(p.d * greatest(0.0, u.u)) AS g FROM p{t} p JOIN u{t} u ON u.doc_id = p.doc_id GROUP BY u.j, p.c", "b2": f"SELECT c, sum(d) AS g FROM p{t} GROUP BY c"}
        for p, (keys, _, _) in parts.items():
            k = t + 1
            out.append(f"""{p}{k} AS MATERIALIZED (SELECT {keys}, v - {r.rate} * (m / (1 - pow({r.beta1}, {k}))) / (sqrt(s / (1 - pow({r.beta2}, {k}))) + {r.epsilon}) AS v, m, s
  FROM (SELECT {keys}, v, {r.beta1} * m + {1 - r.beta1} * g / n AS m, {r.beta2} * s + {1 - r.beta2} * (g / n) * (g / n) AS s FROM {p}{t} JOIN ({grads[p]}) USING ({keys}), pn))""")
    last = STEPS
    losses = "\nUNION ALL ".join(f"SELECT 'loss' AS name, {t} AS unit, 0 AS input, round(sum(loss) / max(n), 6) AS value FROM p{t}, pn" for t in range(STEPS))
    return ",\n".join(out) + f"""
SELECT 'w1' AS name, CAST(j AS INTEGER) AS unit, CAST(i AS INTEGER) AS input, round(v, 6) + 0.0 AS value FROM w1{last}
UNION ALL SELECT 'b1', CAST(j AS INTEGER), 0, round(v, 6) + 0.0 FROM b1{last}
UNION ALL SELECT 'w2', CAST(c AS INTEGER), CAST(j AS INTEGER), round(v, 6) + 0.0 FROM w2{last}
UNION ALL SELECT 'b2', CAST(c AS INTEGER), 0, round(v, 6) + 0.0 FROM b2{last}
UNION ALL {losses}
"""


@register("head_train", sql=QM._fused_sql() + _train_sql())
def head_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: Adam on the mean cross-entropy of all labelled training documents, from a start by rule; the weights and losses."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(F.col("label").isNotNull() & (Q.split_label("doc_id") == "train"))
    rows = cut_lineage(QM.fused_documents(spark, sf_dir).join(labels, "doc_id").select("label", F.col("fused").alias("features")), "head-rows")
    state, out = T.State.start(rule_head(EMB_DIM * len(S.SECTIONS), UNITS)), []
    for t in range(STEPS):
        state, loss = T.step(rows, state, "relu", RULE)
        out.append(("loss", t, 0, loss))
    for name, w in zip(H.Head._fields, state.head):
        out += [(name, int(at[0]), int(at[1]) if w.ndim > 1 else 0, float(v)) for at, v in np.ndenumerate(w)]
    found = spark.createDataFrame(out, "name string, unit int, input int, value double")
    return found.select("name", "unit", "input", (F.round("value", 6) + 0.0).alias("value"))


# rate_documents, rate_saved --------------------------------------------------------------------
def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a paper: doc_id, text (LaTeX view), its first line as abstract, language as title, language and
    source as authors, split, and label (null without one)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = latex_documents(spark, sf_dir).join(labels, "doc_id", "left")
    return docs.select("doc_id", "text", F.element_at(F.split("text", "\n"), 2).alias("abstr"), F.col("lang").alias("title"),
                       F.concat(F.col("lang"), F.lit(","), F.col("source")).alias("autho"), Q.split_label("doc_id").alias("split"), "label", F.col("source").alias("venue"))


# prepared_tokens: S5 P5 T1-T12 over the whole corpus, landed and read back --------------------------
@register("prepared_tokens", sql=QV._seq_sql() + f""",
plain AS (SELECT doc_id, string_split(text, chr(10))[2] AS abstr, lang AS title, lang || ',' || source AS autho, source AS venue FROM latex),
f AS (
  SELECT doc_id, section AS field, toks FROM long
  UNION ALL SELECT doc_id, 'abstr', {g.lower_tokens("abstr")} FROM plain
  UNION ALL SELECT doc_id, 'title', {g.lower_tokens("title")} FROM plain
  UNION ALL SELECT doc_id, 'autho', list_transform(string_split(autho, ','), lambda a: lower(a)) FROM plain
)
SELECT f.doc_id, field, CASE WHEN venue IN ('CoRR', 'No') THEN 0 ELSE 1 END AS label, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM f JOIN plain ON plain.doc_id = f.doc_id
""")
def prepared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).drop("label").withColumn("label", X.venue_label("venue"))
    tier = MD.prepare(rows, MD.model_dir_for(spark, "prepared"), ("doc_id", "label"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"tokens_{f}").alias("t")) for f in MD.FIELDS])
    return tier.select("doc_id", "label", F.explode(fields).alias("f")).select("doc_id", "f.field", "label", F.size("f.t").alias("n_tokens"), F.array_join("f.t", " ").alias("tokens"))


def rate(spark: SparkSession, sf_dir: str, variant: str = FLAGSHIP_VARIANT, epochs: int = 20, folder: str | None = None) -> tuple[DataFrame, T.Run, PipelineModel, str]:
    """Train on the labelled papers, save, load, and score the labelled papers' raw texts with what was loaded (M6)."""
    folder = folder or MD.model_dir_for(spark, "rate")
    rows = spread(papers(spark, sf_dir).where(F.col("label").isNotNull()), "doc_id")
    model, run = MD.train(rows, MD.VARIANTS[variant], lambda vocab: frozen_vectors(spark, sf_dir, vocab), folder, epochs=epochs, filters=MD.filter_table(conv_weights(), CONV_BIAS))
    loaded = PipelineModel.load(f"{folder}/model")
    return MD.apply(loaded, rows), run, model, folder


@register("rate_documents")
def rate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, run, _, _ = rate(spark, sf_dir)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    out = scored.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"),
                                      F.round(F.greatest(F.avg("label"), 1 - F.avg("label")), 6).alias("majority_rate"))
    return out.withColumn("best_round", F.lit(run.best_round)).withColumn("rounds", F.lit(run.rounds))


@register("rate_saved")
def rate_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's raw text scored by the saved model, beside the score by the model in memory."""
    _, _, model, folder = rate(spark, sf_dir, epochs=3)
    every = papers(spark, sf_dir).drop("label")
    two = lambda p: [F.round(F.col("logits")[c], 6).alias(f"{p}{n}") for c, n in enumerate(("negative", "positive"))]
    saved = MD.apply(PipelineModel.load(f"{folder}/model"), every).select("doc_id", "prediction", *two(""))
    memory = MD.apply(model, every).select("doc_id", F.col("prediction").alias("memory_prediction"), *two("memory_"))
    return saved.join(memory, "doc_id")
