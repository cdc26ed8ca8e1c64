"""Registered queries on recurrent encoders: scores of the GRU and LSTM models (M8), position attention (W6), authors (M2).

Sequences are the whole fixed-length ones (W1). Weights come from a rule, are saved as a table and read back, so that SQL
can state them; the encoders have fewer units than the model's default (``config.HIDDEN_SIZES``), which the oracle's
recursion would take minutes for.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectional.config import AUTHOR_VOCAB_SIZE, AUTHOR_WIDTH, SEQ_LENS, VOCAB_SIZE
from sectional.functions import sections as S
from sectional.functions import text as X
from sectional.operators import heads as H
from sectional.operators import pooling as PL
from sectional.operators import recurrent as R
from sectional.operators import sequences as Q
from sectional.operators import vocab as V
from sectional.plans import queries_vectors as QV
from sectional.plans import sqlgen as g
from sectional.plans.catalog import register
from sectional.session import cut_lineage, ensure_checkpoint_dir
from sectional.sources import corpus as C
from sectional.sources.tables import spread, table

UNITS = {"intro": 16, "relat": 12, "metho": 16, "concl": 8}
AUTHOR_UNITS = 8
LAYERS = 2
HEAD_UNITS = 32
FIELDS = [*S.SECTIONS, "autho"]
_PHASE = {"w": 0.0, "u": 1.5, "bw": 3.0, "bu": 4.5, "score.w": 0.5, "score.b": 2.0, "combine.w": 2.5, "combine.b": 4.0}


def phase(field: str, layer: int, name: str) -> float:
    return 1.0 + 31 * FIELDS.index(field) + 7 * layer + _PHASE[name]


def ruled(field: str, kind: str, inputs: int, units: int, attention: bool) -> dict:
    """An encoder's weights from a rule: sines over the matrix, scaled as a start would be."""
    shapes = R.sizes(kind, inputs, units, LAYERS, SEQ_LENS[field] if attention else None)
    return {(k, n): np.sin(phase(field, k, n) + np.arange(a * b).reshape(a, b)) / math.sqrt(units) for (k, n), (a, b) in shapes.items()}


def saved_encoders(spark: SparkSession, kind: str, fields: dict[str, int], inputs: int, attention: bool = False) -> dict[str, R.Encoder]:
    """Write the weights as a table, and read the encoders from it."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"encoder-{kind}-{uuid.uuid4().hex}")
    C.write_prepared(R.weight_table(spark, {f: ruled(f, kind, inputs, n, attention) for f, n in fields.items()}), path, ["field"])
    return R.encoders(C.read_prepared(spark, path), kind)


def indexed(tokens: DataFrame, vocab: DataFrame, keys: list[str], length) -> DataFrame:
    """(keys, ids) of the fixed-length sequences (W1) of token arrays: ``<SOS>``, the tokens, padding."""
    kept = tokens.select(*keys, F.slice("tokens", 1, length - 1).alias("tokens"), length.alias("_n"))
    ids = V.numericalise(kept, [*keys, "_n"], "tokens", vocab)
    padding = F.array_repeat(F.lit(1), F.col("_n") - 1 - F.size("ids"))
    return ids.select(*keys, F.concat(F.array(F.lit(QV.SOS_INDEX)), "ids", padding).alias("ids"))


def indexed_sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, section, ids) of every document's sections, and the frozen vectors."""
    tokens = cut_lineage(QV.section_sequences(spark, sf_dir).select("doc_id", "split", "section", "tokens"), "section-tokens")
    vocab = cut_lineage(V.build_vocab(tokens.where(F.col("split") == "train"), ["tokens"], VOCAB_SIZE), "section-vocab")
    length = F.element_at(F.create_map(*[F.lit(x) for s in S.SECTIONS for x in (s, SEQ_LENS[s])]), F.col("section"))
    return indexed(tokens, vocab, ["doc_id", "section"], length), QV.frozen_vectors(spark, sf_dir, vocab)


def encoded_sections(spark: SparkSession, sf_dir: str, kind: str, attention: bool = False) -> DataFrame:
    ids, vectors = indexed_sections(spark, sf_dir)
    fields = saved_encoders(spark, kind, UNITS, QV.EMB_DIM, attention)
    return R.encode(ids, fields, dict.fromkeys(UNITS, vectors), QV.SOS_INDEX if attention else None)


def fused(pooled: DataFrame, widths: dict[str, int], field: str = "section") -> DataFrame:
    """M1 over fields of different widths: one array per document, missing fields are zeros."""
    each = pooled.groupBy("doc_id").agg(*[F.first(F.when(F.col(field) == f, F.col("pooled")), ignorenulls=True).alias(f"_{f}") for f in widths])
    return each.select("doc_id", F.concat(*[F.coalesce(f"_{f}", F.array_repeat(F.lit(0.0), n)) for f, n in widths.items()]).alias("fused"))


def rule_head(inputs: int, units: int, scale: float = 0.3) -> H.Head:
    """Head weights from a rule (the biases too)."""
    w1 = scale * np.sin(1.0 + np.arange(inputs)[None] * units + np.arange(units)[:, None])
    w2 = 0.5 * np.sin(2.0 + np.arange(units)[None] * 2 + np.arange(2)[:, None])
    return H.Head(w1, 0.01 * np.arange(units), w2, 0.01 * np.arange(2))


# ---------------------------------------------------------------------------------- oracle SQL
def _matrix_sql(field: str, layer: int, name: str, rows: int, cols: int, units: int) -> str:
    cell = f"sin({phase(field, layer, name)!r} + j * {cols} + i) / sqrt({units}.0)"
    if name.split(".")[-1].startswith("b"):
        return f"list_transform(range({rows}), lambda j: sin({phase(field, layer, name)!r} + j) / sqrt({units}.0))"
    return f"list_transform(range({rows}), lambda j: list_transform(range({cols}), lambda i: {cell}))"


def _weights_sql(kind: str, fields: dict[str, int], inputs: int, attention: bool) -> str:
    """wt: a row per field with its matrices as lists."""
    rows = []
    for f, n in fields.items():
        shapes = R.sizes(kind, inputs, n, LAYERS, SEQ_LENS[f] if attention else None)
        cols = ", ".join(f"{_matrix_sql(f, k, name, a, b, n)} AS {name.replace('.', '_')}{k + 1}" for (k, name), (a, b) in shapes.items())
        rows.append(f"SELECT '{f}' AS section, {n} AS n, {SEQ_LENS[f]} AS len, {cols}")
    return "wt AS MATERIALIZED (" + "\n  UNION ALL ".join(rows) + ")"


_SIGMOID = "(1 / (1 + exp(-({}))))"


def _cell_sql(kind: str, layer: int) -> tuple[str, list[str]]:
    """The expressions for a layer's new state list(s), from gx, gh, n and the old state."""
    s, h, c = _SIGMOID.format, f"h{layer}", f"c{layer}"
    if kind == "gru":
        z = s("gx[n + i] + gh[n + i]")
        return (f"list_transform(range(1, n + 1), lambda i: (1 - {z}) * tanh(gx[2 * n + i] + {s('gx[i] + gh[i]')} * gh[2 * n + i]) + {z} * {h}[i])", [])
    new = f"list_transform(range(1, n + 1), lambda i: {s('gx[n + i] + gh[n + i]')} * {c}[i] + {s('gx[i] + gh[i]')} * tanh(gx[2 * n + i] + gh[2 * n + i]))"
    return f"list_transform(range(1, n + 1), lambda i: {s('gx[3 * n + i] + gh[3 * n + i]')} * tanh({c}[i]))", [new]


def _recursion_sql(kind: str) -> str:
    """rec: sid, t and the layers' states after t steps over the sequences ``sq`` (sid, section, ids), inputs ``gx0``."""
    states = [x for k in (1, 2) for x in ([f"h{k}"] if kind == "gru" else [f"h{k}", f"c{k}"])]
    zero = "list_transform(range(n), lambda i: 0.0::DOUBLE)"
    own = lambda k: f"list_transform(range(1, len(bu{k}) + 1), lambda j: list_dot_product(u{k}[j], h{k}) + bu{k}[j])"
    carry = "sid, section, t, n, w2, bw2, u2, bu2"
    s = ", ".join(states)
    first = f"""SELECT rec.sid, rec.section, rec.t, wt.n, wt.w2, wt.bw2, wt.u2, wt.bu2, {s}, coalesce(gx0.gx, wt.bw1) AS gx, {own(1)} AS gh
      FROM rec JOIN sq ON sq.sid = rec.sid JOIN wt ON wt.section = rec.section LEFT JOIN gx0 ON gx0.section = rec.section AND gx0.idx = sq.ids[rec.t + 1]
      WHERE rec.t < wt.len"""

    def update(source: str, layer: int, columns: str) -> str:
        h, c = _cell_sql(kind, layer)
        if c:
            source = f"SELECT * REPLACE ({c[0]} AS c{layer}) FROM ({source})"
        return f"SELECT {columns}, {h} AS h{layer} FROM ({source})"

    rest1 = ", ".join(x for x in states if x != "h1")
    after1 = update(first, 1, f"{carry}, {rest1}")
    second = f"SELECT *, list_transform(range(1, len(bw2) + 1), lambda j: list_dot_product(w2[j], h1) + bw2[j]) AS gx, {own(2)} AS gh FROM ({after1})"
    rest2 = ", ".join(x for x in states if x != "h2")
    after2 = update(second, 2, f"sid, section, t + 1 AS t, {rest2}")
    return f"""rec AS (
  SELECT sid, sq.section, 0 AS t, {", ".join(f"{zero} AS {x}" for x in states)} FROM sq JOIN wt ON wt.section = sq.section
  UNION ALL
  SELECT sid, section, t, {s} FROM ({after2})
)"""


def _sequences_sql() -> str:
    return QV.section_tokens_sql().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
pos AS (SELECT doc_id, section, unnest(seq) AS token, generate_subscripts(seq, 1) AS p FROM fixed),
sqd AS MATERIALIZED (SELECT doc_id, section, list(coalesce(v.idx, 0) ORDER BY p) AS ids FROM pos LEFT JOIN full_vocab v ON pos.token = v.token GROUP BY doc_id, section),
vecs AS MATERIALIZED (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id < {VOCAB_SIZE + 3} AND vec_id IN (SELECT idx FROM full_vocab)),
qv AS MATERIALIZED (SELECT coalesce((SELECT vec FROM vecs WHERE idx = {QV.SOS_INDEX}), list_transform(range({QV.EMB_DIM}), lambda i: 0.0::DOUBLE)) AS q)"""


def _encode_sql(kind: str, fields: dict[str, int], inputs: int, attention: bool = False) -> str:
    """From ``sqd`` and ``vecs``: last (sid, h1, h2) of the distinct sequences, and sids of the documents (``dsid``)."""
    return f""",
{_weights_sql(kind, fields, inputs, attention)},
sq AS MATERIALIZED (SELECT section, ids, row_number() OVER () AS sid FROM (SELECT DISTINCT section, ids FROM sqd)),
gx0 AS MATERIALIZED (SELECT section, idx, list_transform(range(1, len(bw1) + 1), lambda j: list_dot_product(w1[j], vec) + bw1[j]) AS gx FROM vecs, wt),
{_recursion_sql(kind)},
last AS MATERIALIZED (SELECT rec.sid, rec.section, h1, h2 FROM rec JOIN wt ON wt.section = rec.section WHERE t = len),
dsid AS (SELECT sqd.doc_id, sqd.section, sq.sid FROM sqd JOIN sq ON sq.section = sqd.section AND sq.ids = sqd.ids)"""


def _scores_sql(kind: str) -> str:
    at, starts = 0, []
    for f, n in UNITS.items():
        starts.append(f"('{f}', {at})")
        at += n
    return _sequences_sql() + _encode_sql(kind, UNITS, QV.EMB_DIM) + f""",
x AS (SELECT doc_id, v.a + generate_subscripts(h2, 1) - 1 AS i, unnest(h2) AS x FROM dsid JOIN last ON last.sid = dsid.sid JOIN (VALUES {", ".join(starts)}) AS v(section, a) ON v.section = dsid.section),
u AS (SELECT doc_id, j, greatest(0.0, sum(x * 0.3 * sin(1.0 + i * {HEAD_UNITS} + j)) + 0.01 * j) AS h FROM x, (SELECT unnest(range({HEAD_UNITS})) AS j) GROUP BY doc_id, j),
z AS (SELECT doc_id, c, sum(h * 0.5 * sin(2.0 + j * 2 + c)) + 0.01 * c AS z FROM u, (SELECT unnest(range(2)) AS c) GROUP BY doc_id, c)
SELECT doc_id, round(max(z) FILTER (WHERE c = 0), 6) + 0.0 AS negative, round(max(z) FILTER (WHERE c = 1), 6) + 0.0 AS positive FROM z GROUP BY doc_id
"""


def _scores(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    x = fused(encoded_sections(spark, sf_dir, kind), UNITS)
    z = H.head_logits(spark, F.col("fused"), rule_head(sum(UNITS.values()), HEAD_UNITS))
    return x.select("doc_id", z.alias("z")).select("doc_id", (F.round(F.col("z")[0], 6) + 0.0).alias("negative"), (F.round(F.col("z")[1], 6) + 0.0).alias("positive"))


@register("gru_scores", sql=_scores_sql("gru"))
def gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, M1, M3: a stacked GRU per section over its whole sequence, last states, ReLU head."""
    return _scores(spark, sf_dir, "gru")


@register("lstm_scores", sql=_scores_sql("lstm"))
def lstm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "lstm")


def _exploded(pooled: DataFrame, keys: list[str]) -> DataFrame:
    return PL.explode_vector(pooled, keys)


@register("pool_attention", sql=_sequences_sql() + _encode_sql("gru", UNITS, QV.EMB_DIM, attention=True) + """,
sc AS (SELECT sid, last.section, n, combine_w0, combine_b0, q, list_transform(range(1, len + 1), lambda p: list_dot_product(score_w0[p], list_concat(q, h1)) + score_b0[p]) AS s
       FROM last JOIN wt ON wt.section = last.section, qv),
e AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS w FROM sc),
m AS (SELECT rec.sid, generate_subscripts(rec.h2, 1) AS d, unnest(rec.h2) AS x, e.w[rec.t] / list_sum(e.w) AS w FROM rec JOIN e ON e.sid = rec.sid WHERE rec.t > 0),
c AS (SELECT sid, list(x ORDER BY d) AS mean FROM (SELECT sid, d, sum(w * x) AS x FROM m GROUP BY sid, d) GROUP BY sid),
o AS (SELECT e.sid, list_transform(range(1, n + 1), lambda j: greatest(0.0, list_dot_product(combine_w0[j], list_concat(q, mean)) + combine_b0[j])) AS o FROM e JOIN c ON c.sid = e.sid)
SELECT doc_id, section, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS d, round(unnest(o), 6) + 0.0 AS value FROM dsid JOIN o ON o.sid = dsid.sid
""")
def pool_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention over the positions of a section's GRU states, scored from the ``<SOS>`` vector and the first layer's last state."""
    return _exploded(encoded_sections(spark, sf_dir, "gru", attention=True), ["doc_id", "section"])


# author_features: M2, T10, A5 ------------------------------------------------------------------
def author_vectors() -> np.ndarray:
    """The authors' own embedding table, from a rule."""
    return 0.5 * np.sin(np.arange((AUTHOR_VOCAB_SIZE + 3) * AUTHOR_WIDTH).reshape(-1, AUTHOR_WIDTH))


def indexed_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, section, ids) of every document's author sequence; the vocabulary is fitted on the train split."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    tokens = docs.select("doc_id", Q.split_label("doc_id").alias("split"),
                         X.lower_tokens(X.split_authors(F.concat(F.col("lang"), F.lit(","), F.col("source")))).alias("tokens"))
    vocab = cut_lineage(V.build_vocab(tokens.where(F.col("split") == "train"), ["tokens"], AUTHOR_VOCAB_SIZE), "author-vocab")
    ids = indexed(tokens, vocab, ["doc_id"], F.lit(SEQ_LENS["autho"]))
    return ids.select("doc_id", F.lit("autho").alias("section"), "ids")


@register("author_features", sql=f"""WITH RECURSIVE au AS (
  SELECT doc_id, {g.split_label("doc_id")} AS split, list_transform(string_split(lang || ',' || source, ','), lambda a: lower(a)) AS toks FROM documents
),
vocab AS ({g.top_vocab("SELECT unnest(toks) AS token FROM au WHERE split = 'train'", AUTHOR_VOCAB_SIZE)}),
full_vocab AS (SELECT token, idx FROM vocab UNION ALL SELECT '<unk>', 0 UNION ALL SELECT '<pad>', 1 UNION ALL SELECT '<SOS>', 2),
fixed AS (SELECT doc_id, {g.fixed_length("coalesce(toks, [])", str(SEQ_LENS["autho"]))} AS seq FROM au),
pos AS (SELECT doc_id, unnest(seq) AS token, generate_subscripts(seq, 1) AS p FROM fixed),
sqd AS MATERIALIZED (SELECT doc_id, 'autho' AS section, list(coalesce(v.idx, 0) ORDER BY p) AS ids FROM pos LEFT JOIN full_vocab v ON pos.token = v.token GROUP BY doc_id),
vecs AS MATERIALIZED (SELECT idx, list_transform(range({AUTHOR_WIDTH}), lambda d: 0.5 * sin(idx * {AUTHOR_WIDTH} + d)) AS vec FROM full_vocab)"""
          + _encode_sql("gru", {"autho": AUTHOR_UNITS}, AUTHOR_WIDTH) + """
SELECT doc_id, CAST(generate_subscripts(h2, 1) - 1 AS INTEGER) AS d, round(unnest(h2), 6) + 0.0 AS value FROM dsid JOIN last ON last.sid = dsid.sid
""")
def author_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the author sequence through its own vocabulary, embedding table and GRU."""
    fields = saved_encoders(spark, "gru", {"autho": AUTHOR_UNITS}, AUTHOR_WIDTH)
    pooled = R.encode(indexed_authors(spark, sf_dir), fields, {"autho": author_vectors()})
    return _exploded(pooled.drop("section"), ["doc_id"])
