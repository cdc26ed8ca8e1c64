"""Registered sequence, split, vocabulary and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectional.config import AUTHOR_VOCAB_SIZE, BATCH_SIZE, SEQ_LENS, VOCAB_SIZE
from sectional.functions import sections as S
from sectional.functions import text as X
from sectional.operators import sequences as Q
from sectional.operators import sketches as SK
from sectional.operators import vocab as V
from sectional.plans import sqlgen as g
from sectional.plans.catalog import register
from sectional.session import cut_lineage, discard
from sectional.sources.tables import latex_documents, spread, table



def section_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, split, section, tokens, seq): cleaned section tokens and their W1 form.

    One narrow pass: extract, clean, tokenise and pad every section column,
    then ``explode`` an array of four structs to go long (no union re-scan).
    """
    wide = S.extract_sections(latex_documents(spark, sf_dir))
    cleaned = S.clean_sections(wide, sep=" ")
    toks = cleaned.select("doc_id", *[X.lower_tokens(X.tokenize(s)).alias(s) for s in S.SECTIONS])
    entries = [F.struct(F.lit(s).alias("section"), F.col(s).alias("tokens"),
                        Q.fixed_length(F.col(s), SEQ_LENS[s]).alias("seq")) for s in S.SECTIONS]
    long = toks.select("doc_id", F.explode(F.array(*entries)).alias("e"))
    return long.select("doc_id", Q.split_label("doc_id").alias("split"), "e.section", "e.tokens", "e.seq")


def _seq_sql() -> str:
    longs = "\n  UNION ALL ".join(
        f"SELECT doc_id, {g.split_label('doc_id')} AS split, '{s}' AS section, {g.lower_tokens(s)} AS toks FROM cleaned"
        for s in S.SECTIONS)
    lens = " ".join(f"WHEN '{s}' THEN {SEQ_LENS[s]}" for s in S.SECTIONS)
    return f"""WITH {g.latex_cte()},
{g.clean_sections_ctes("latex")},
cleaned AS (
  SELECT doc_id, {", ".join(f"{g.process_text(s, ' ')} AS {s}" for s in S.SECTIONS)} FROM wide
),
long AS (
  {longs}
),
fixed AS (
  SELECT doc_id, split, section, toks, {g.fixed_length("toks", f"(CASE section {lens} END)")} AS seq FROM long
)"""


# fixed_seq: W1 -----------------------------------------------------------------
@register("fixed_seq", sql=_seq_sql() + """
SELECT doc_id, section, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(seq, ' ') AS seq FROM fixed
""")
def fixed_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = section_sequences(spark, sf_dir)
    return s.select("doc_id", "section", F.size("tokens").alias("n_tokens"), F.array_join("seq", " ").alias("seq"))


def section_tokens_sql() -> str:
    """CTEs up to ``long`` (doc_id, split, section, toks) and ``full_vocab``, fitted on the train split."""
    return _seq_sql() + f""",
vocab AS (
  {g.top_vocab("SELECT unnest(toks) AS token FROM long WHERE split = 'train'", VOCAB_SIZE)}
),
full_vocab AS (
  SELECT token, idx FROM vocab
  UNION ALL SELECT '<unk>', 0 UNION ALL SELECT '<pad>', 1 UNION ALL SELECT '<SOS>', 2
)"""


# numericalise: A4 (fit on train) K2 J1 --------------------------------------------------
@register("numericalise", sql=section_tokens_sql() + """,
pos AS (SELECT doc_id, section, unnest(seq) AS token, generate_subscripts(seq, 1) AS p FROM fixed)
SELECT doc_id, section, string_agg(CAST(coalesce(v.idx, 0) AS VARCHAR), ' ' ORDER BY p) AS ids,
       CAST(count(*) FILTER (WHERE v.idx IS NULL) AS INTEGER) AS n_unk
FROM pos LEFT JOIN full_vocab v ON pos.token = v.token
GROUP BY doc_id, section
""")
def numericalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The token table feeds both the train vocabulary and the lookup: write it once (tokens only,
    # not the padded sequences) so the extract-clean-tokenise pipeline runs a single time.
    s = cut_lineage(section_sequences(spark, sf_dir).select("doc_id", "split", "section", "tokens"), "section-tokens")
    vocab = V.build_vocab(s.filter(F.col("split") == "train"), ["tokens"], VOCAB_SIZE)
    # Only the real tokens kept by W1 are looked up; <SOS> and <pad> have fixed indices.
    lens = F.element_at(F.create_map(*[x for sec in S.SECTIONS for x in (F.lit(sec), F.lit(SEQ_LENS[sec]))]),
                        F.col("section"))
    kept = s.select("doc_id", "section", lens.alias("L"), F.slice("tokens", 1, lens - 1).alias("kept"))
    ids = V.numericalise(kept, ["doc_id", "section", "L"], "kept", vocab)
    full = F.concat(F.array(F.lit(2)), F.col("ids"), F.array_repeat(F.lit(1), F.col("L") - 1 - F.size("ids")))
    return ids.select("doc_id", "section", F.array_join(F.transform(full, lambda x: x.cast("string")), " ").alias("ids"),
                      F.size(F.filter("ids", lambda x: x == 0)).alias("n_unk"))


# split_assign: W2 J4 -------------------------------------------------------------------
@register("split_assign", sql=f"""
SELECT d.doc_id, l.quality, {g.split_label("d.doc_id")} AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select("doc_id", "quality", Q.split_label("doc_id").alias("split"))


# batch_assign: W2 W3 -----------------------------------------------------------------
@register("batch_assign", sql=f"""
WITH s AS (
  SELECT d.doc_id, {g.split_label("d.doc_id")} AS split, {g.key_hash("d.doc_id", 17)} AS h1, {g.key_hash("d.doc_id", 9)} AS h2
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
s2 AS (SELECT *, CAST(h1 % {g.batch_buckets("s", BATCH_SIZE)} AS INTEGER) AS bucket FROM s)
SELECT doc_id, split, bucket,
       CAST(floor((row_number() OVER (PARTITION BY split, bucket ORDER BY h2, doc_id) - 1) / {BATCH_SIZE}) AS INTEGER) AS batch
FROM s2
""")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    s = docs.join(labels, "doc_id").select("doc_id", Q.split_label("doc_id").alias("split"))
    return Q.assign_batches(s, "doc_id", "split", BATCH_SIZE).select("doc_id", "split", "bucket", "batch")


# author_vocab: A5 T10 (train split only, cap 1600) ---------------------------------------
@register("author_vocab", sql=f"""
WITH train AS (
  SELECT d.lang, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {g.split_label("d.doc_id")} = 'train'
)
{g.top_vocab("SELECT unnest(list_transform(string_split(lang || ',' || source, ','), lambda a: lower(a))) AS token FROM train", AUTHOR_VOCAB_SIZE)}
""")
def author_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    train = docs.join(labels, "doc_id").filter(Q.split_label("doc_id") == "train")
    authors = train.select(X.lower_tokens(X.split_authors(F.concat(F.col("lang"), F.lit(","), F.col("source")))).alias("a"))
    counts = V.token_counts(authors, ["a"]).filter(~F.col("token").isin(["<unk>", "<pad>", "<SOS>"]))
    return V.top_tokens(counts, AUTHOR_VOCAB_SIZE, first_index=3)


# ----------------------------------------------------------------------------------
# Vectors: J2 J3 M9 W4 W5 W6 over whole-document token sequences.
# Vocabulary index = embeddings.vec_id (the driver's stand-in for pretrained vectors).
# ----------------------------------------------------------------------------------
import math  # noqa: E402

import numpy as np  # noqa: E402

from sectional.operators import pooling as PL  # noqa: E402

EMB_DIM = 64
CONV_FILTERS, CONV_HEIGHT = 4, 3
CONV_BIAS = [-0.01 * j for j in range(CONV_FILTERS)]
SOS_INDEX = 2


def conv_weights(n_filters: int = CONV_FILTERS, height: int = CONV_HEIGHT, dim: int = EMB_DIM) -> list:
    """Deterministic filter weights from a rule: 0.2 * sin(1 + j*height*dim + k*dim + d)."""
    return [[[0.2 * math.sin(1 + j * height * dim + k * dim + d) for d in range(dim)] for k in range(height)]
            for j in range(n_filters)]


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", X.lower_tokens(X.tokenize("text")).alias("tokens"))


def frozen_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> np.ndarray:
    """M9: the vocabulary's vectors as a matrix; entries without one (J2) are zero."""
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < VOCAB_SIZE + 3)
    return PL.vector_matrix(PL.vectors_by_index(vocab, vectors, EMB_DIM), VOCAB_SIZE + 3, EMB_DIM)


def doc_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, ids) of every document, and the frozen vectors of the vocabulary (M9).

    The texts are tokenised once: the token table that is written feeds the vocabulary and the lookup.
    """
    tokens = cut_lineage(doc_tokens(spark, sf_dir), "doc-tokens")
    vocab = cut_lineage(V.build_vocab(tokens, ["tokens"], VOCAB_SIZE), "text-vocab")
    return V.numericalise(tokens, ["doc_id"], "tokens", vocab), frozen_vectors(spark, sf_dir, vocab)


_VEC_SQL = f"""WITH toks AS (SELECT doc_id, {g.lower_tokens("text")} AS t FROM documents),
tok AS (SELECT doc_id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM toks),
vocab AS (
  {g.top_vocab("SELECT token FROM tok", VOCAB_SIZE)}
),
full_vocab AS (
  SELECT token, cnt, idx FROM vocab
  UNION ALL SELECT '<unk>', NULL, 0 UNION ALL SELECT '<pad>', NULL, 1 UNION ALL SELECT '<SOS>', NULL, 2
),
vecs AS (
  SELECT fv.idx, CAST(coalesce(e.embedding, list_transform(range({EMB_DIM}), lambda x: CAST(0 AS FLOAT))) AS DOUBLE[]) AS vec
  FROM full_vocab fv LEFT JOIN embeddings e ON e.vec_id = fv.idx
),
tv AS (SELECT tok.doc_id, tok.pos, coalesce(fv.idx, 0) AS idx FROM tok LEFT JOIN full_vocab fv ON tok.token = fv.token),
tvv AS (SELECT tv.doc_id, tv.pos, vecs.vec FROM tv JOIN vecs ON tv.idx = vecs.idx)"""


def _explode_sql(src: str, value: str) -> str:
    return f"""SELECT doc_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS d, unnest(v) AS x FROM (SELECT doc_id, {value} AS v FROM {src})"""


# embed_lookup: J1 J3 M9 + mean pooling; documents without tokens have the zero vector (J2) ----------------
_GRID_SQL = f"""grid AS (SELECT doc_id, d FROM documents, (SELECT CAST(unnest(range({EMB_DIM})) AS INTEGER) AS d) dims)"""


@register("embed_lookup", sql=_VEC_SQL + f""",
flat AS (SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS d, unnest(vec) AS x FROM tvv),
p AS (SELECT doc_id, d, avg(x) AS x FROM flat GROUP BY doc_id, d),
{_GRID_SQL}
SELECT doc_id, d, round(coalesce(x, 0.0), 6) + 0.0 AS value FROM grid LEFT JOIN p USING (doc_id, d)
""")
def embed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, vectors = doc_index(spark, sf_dir)
    return PL.explode_vector(PL.pool_rows(ids, ["doc_id"], "ids", vectors, EMB_DIM, PL.mean_rows), ["doc_id"])


# embed_join: J1 J2 J3 with a vocabulary without a cap, mean pooling by a shuffle join -----------------------
@register("embed_join", sql=_VEC_SQL.replace(f"LIMIT {VOCAB_SIZE}", "") + f""",
flat AS (SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS d, unnest(vec) AS x FROM tvv),
p AS (SELECT doc_id, d, avg(x) AS x FROM flat GROUP BY doc_id, d),
{_GRID_SQL}
SELECT doc_id, d, round(coalesce(x, 0.0), 6) + 0.0 AS value FROM grid LEFT JOIN p USING (doc_id, d)
""")
def embed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = cut_lineage(doc_tokens(spark, sf_dir), "doc-tokens", "zstd")
    vocab = cut_lineage(V.build_vocab(tokens, ["tokens"], None), "whole-vocab")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    pooled = PL.mean_by_join(tokens, ["doc_id"], "tokens", vocab, vectors, EMB_DIM)
    discard(tokens)  # what the mean needs of them is written by now
    return PL.explode_vector(pooled, ["doc_id"])


# sketch_summary: A2 A9 K2 from stored, merged sketches, each held against the exact value -----------------
SKETCH_TOP = 20


@register("sketch_summary", sql=f"""
WITH t AS (SELECT source, {g.lower_tokens("text")} AS t FROM documents),
c AS (SELECT token, count(*) AS c FROM (SELECT unnest(t) AS token FROM t) GROUP BY token),
top AS (SELECT c, row_number() OVER (ORDER BY c DESC, token) AS r FROM c QUALIFY r <= {SKETCH_TOP})
SELECT 'distinct tokens' AS measure, count(*)::DOUBLE AS exact, TRUE AS within FROM c
UNION ALL SELECT 'length q1', quantile_disc(len(t), 0.25)::DOUBLE, TRUE FROM t
UNION ALL SELECT 'length median', quantile_disc(len(t), 0.5)::DOUBLE, TRUE FROM t
UNION ALL SELECT 'length q3', quantile_disc(len(t), 0.75)::DOUBLE, TRUE FROM t
UNION ALL SELECT 'top ' || r, c::DOUBLE, TRUE FROM top
""")
def sketch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    rows = cut_lineage(docs.select("source", X.lower_tokens(X.tokenize("text")).alias("tokens")).withColumn("n", F.size("tokens")), "source-tokens")
    stored = cut_lineage(SK.shard_sketches(rows, "source", "tokens", "n"), "sketches")
    union = cut_lineage(SK.merged(stored), "sketch-union")
    found = union.select(SK.distinct_of(F.col("distinct")).alias("distinct"), F.array(*[SK.quantile_of(F.col("quantiles"), q) for q in (0.25, 0.5, 0.75)]).alias("q"),
                         F.col("n_tokens"), SK.top_of("frequent", SKETCH_TOP).alias("top")).first()  # one row
    counts = V.token_counts(rows, ["tokens"])
    counts = cut_lineage(counts, "sketch-exact")
    distinct = counts.agg(F.count("*").alias("k")).select(F.lit("distinct tokens").alias("measure"), F.col("k").cast("double").alias("exact"),
                                                         (F.abs(F.lit(found["distinct"]) / F.col("k") - 1) <= SK.distinct_bound()).alias("within"))
    held = SK.quantile_holds(rows, "n", list(zip((0.25, 0.5, 0.75), found["q"])), SK.rank_bound())
    exact = rows.agg(F.array(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)") for q in (0.25, 0.5, 0.75)]).alias("p"))
    names = F.array(*[F.lit(f"length {n}") for n in ("q1", "median", "q3")])
    lengths = exact.select(F.posexplode("p").alias("i", "exact")).withColumn("q", F.element_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("i") + 1)).join(held, "q") \
        .select(F.element_at(names, F.col("i") + 1).alias("measure"), F.col("exact").cast("double").alias("exact"), "within")
    top = counts.orderBy(F.desc("cnt"), "token").limit(SKETCH_TOP).withColumn("r", F.row_number().over(Window.orderBy(F.desc("cnt"), "token")))
    estimates = spark.createDataFrame([(i + 1, t["item"], t["count"]) for i, t in enumerate(found["top"])], "er int, token string, e long")
    ranked = top.join(estimates.select("token", "e"), "token", "left")
    tops = ranked.select(F.concat(F.lit("top "), F.col("r")).alias("measure"), F.col("cnt").cast("double").alias("exact"),
                         (F.coalesce(F.abs(F.col("e") - F.col("cnt")), F.lit(0)) <= SK.count_bound(F.lit(found["n_tokens"]))).alias("within"))
    return distinct.unionByName(lengths).unionByName(tops)


# vector_coverage: J2 ---------------------------------------------------------------------
@register("vector_coverage", sql=_VEC_SQL + """,
hits AS (SELECT fv.*, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS hit FROM full_vocab fv LEFT JOIN embeddings e ON e.vec_id = fv.idx)
SELECT count(*) AS n_vocab, CAST(sum(hit) AS BIGINT) AS n_hit, round(avg(hit), 6) AS hit_rate,
       round(CAST(sum(cnt) FILTER (WHERE hit = 1) AS DOUBLE) / sum(cnt), 6) AS mass_hit_rate
FROM hits
""")
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = V.build_vocab(doc_tokens(spark, sf_dir), ["tokens"], VOCAB_SIZE)
    cov = V.vector_coverage(vocab, table(spark, sf_dir, "embeddings").where(F.col("vec_id") < VOCAB_SIZE + 3), EMB_DIM)
    return cov.agg(F.count(F.lit(1)).alias("n_vocab"), F.sum("hit").cast("bigint").alias("n_hit"),
                   F.round(F.avg("hit"), 6).alias("hit_rate"),
                   F.round(F.sum(F.when(F.col("hit") == 1, F.col("cnt"))).cast("double") / F.sum("cnt"), 6)
                   .alias("mass_hit_rate"))


# pool_last: W4 -----------------------------------------------------------------------------
@register("pool_last", sql=_VEC_SQL + f""",
last AS (SELECT doc_id, vec FROM tvv WHERE (doc_id, pos) IN (SELECT doc_id, max(pos) FROM tvv GROUP BY doc_id)),
p AS (SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS d, unnest(vec) AS x FROM last),
{_GRID_SQL}
SELECT doc_id, d, round(coalesce(x, 0.0), 6) + 0.0 AS value FROM grid LEFT JOIN p USING (doc_id, d)
""")
def pool_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, vectors = doc_index(spark, sf_dir)
    return PL.explode_vector(PL.pool_rows(ids, ["doc_id"], "ids", vectors, EMB_DIM, PL.last_row), ["doc_id"])


# pool_token_attention: attention with a score per vocabulary entry, its dot product with the <SOS> vector -------------
@register("pool_token_attention", sql=_VEC_SQL + f""",
qv AS (SELECT vec AS q FROM vecs WHERE idx = {SOS_INDEX}),
sc AS (SELECT doc_id, pos, vec, list_dot_product(vec, q) AS s FROM tvv, qv),
mx AS (SELECT doc_id, max(s) AS m FROM sc GROUP BY doc_id),
w AS (SELECT sc.doc_id, sc.vec, exp(sc.s - mx.m) AS w FROM sc JOIN mx ON sc.doc_id = mx.doc_id),
flat AS (SELECT doc_id, w, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS d, unnest(vec) AS x FROM w),
p AS (SELECT doc_id, d, sum(w * x) / sum(w) AS x FROM flat GROUP BY doc_id, d),
{_GRID_SQL}
SELECT doc_id, d, round(coalesce(x, 0.0), 6) + 0.0 AS value FROM grid LEFT JOIN p USING (doc_id, d)
""")
def pool_token_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, vectors = doc_index(spark, sf_dir)
    pool = PL.attention_rows(vectors @ vectors[SOS_INDEX])
    return PL.explode_vector(PL.pool_rows(ids, ["doc_id"], "ids", vectors, EMB_DIM, pool), ["doc_id"])


# pool_conv: W5 ---------------------------------------------------------------------------
def _conv_sql() -> str:
    n, dim, h = CONV_FILTERS, EMB_DIM, CONV_HEIGHT
    bias = "[" + ", ".join(repr(b) for b in CONV_BIAS) + "]"
    return _VEC_SQL + f""",
w AS (
  SELECT j, k, list_transform(range({dim}), lambda d: 0.2 * sin(1 + j * {h * dim} + k * {dim} + d)) AS wv
  FROM (SELECT unnest(range({n})) AS j) fj, (SELECT unnest(range({h})) AS k) fk
),
contrib AS (SELECT doc_id, pos - k AS start, j, list_dot_product(vec, wv) AS c FROM tvv, w),
win AS (SELECT doc_id, start, j, sum(c) AS s FROM contrib GROUP BY doc_id, start, j HAVING count(*) = {h}),
act AS (SELECT doc_id, j, max(greatest(0.0, s + ({bias})[j + 1])) AS a FROM win GROUP BY doc_id, j),
grid AS (SELECT doc_id, j FROM documents, (SELECT unnest(range({n})) AS j) fj)
SELECT grid.doc_id, CAST(grid.j AS INTEGER) AS j, round(coalesce(act.a, 0.0), 6) AS value
FROM grid LEFT JOIN act ON grid.doc_id = act.doc_id AND grid.j = act.j
"""


@register("pool_conv", sql=_conv_sql())
def pool_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, vectors = doc_index(spark, sf_dir)
    # A token's share of a window depends on its vocabulary entry only.
    dots = PL.conv_dots(vectors, conv_weights())
    out = PL.pool_rows(ids, ["doc_id"], "ids", dots, CONV_FILTERS, PL.convolution_rows(CONV_BIAS))
    return out.select("doc_id", F.posexplode("pooled").alias("j", "value")).select("doc_id", "j", F.round("value", 6).alias("value"))


# split_stratified: W2 stratified variant (exact per-label proportions) -----------------------
@register("split_stratified", sql=f"""
WITH s AS (
  SELECT d.doc_id, l.quality, {g.key_hash("d.doc_id")} AS h
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rnk, count(*) OVER (PARTITION BY quality) AS n
  FROM s
)
SELECT doc_id, quality,
       CASE WHEN (rnk - 1) * 10000 < 6000 * n THEN 'train' WHEN (rnk - 1) * 10000 < 8000 * n THEN 'valid' ELSE 'test' END AS split
FROM r
""")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return Q.split_label_stratified(docs.join(labels, "doc_id"), "doc_id", "quality").select("doc_id", "quality", "split")
