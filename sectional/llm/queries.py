"""The operators' registered queries, each over its whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade, fixity, html_text, licenses, maxent, mixing, neardup, negatives, neighbours, packing, phrases, pieces, repeats
from .common import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rows in one Arrow batch; with very long texts a batch stays within a task's memory.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@query("op1_maxent_lm")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read(spark, sf_dir, "documents"))


#: Every 89th page's second copy has one character changed; the audit has to find exactly these.
DAMAGED = "page_id % 89 = 7"

_OP2_SQL = r"""
WITH rec AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h,
         CASE WHEN page_id % 89 = 7 AND length(html) > 0
              THEN substr(html, 1, length(html) // 2) || chr(164) || substr(html, length(html) // 2 + 2) ELSE coalesce(html, '') END AS g
  FROM pages),
dig AS (
  SELECT page_id, octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
           || 'Content-Length: ' || octet_length(encode(h)) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10)))::BIGINT AS length,
         sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
           || 'Content-Length: ' || octet_length(encode(h)) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10)) AS digest_a,
         sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
           || 'Content-Length: ' || octet_length(encode(g)) || chr(13) || chr(10) || chr(13) || chr(10) || g || chr(13) || chr(10) || chr(13) || chr(10)) AS digest_b
  FROM rec),
runs AS (SELECT page_id, length, digest_a, digest_b, count(*) AS copies FROM dig GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, digest_a) - 1 AS rank FROM runs),
placed AS (SELECT *, rank // 1024 AS file, coalesce(sum(length * copies) OVER (PARTITION BY rank // 1024 ORDER BY rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ranked)
SELECT page_id, rank, file, "offset", length, copies, digest_a, digest_b FROM placed WHERE digest_a <> digest_b
"""


@query("op2_warc_fixity", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the pages' archive, the second one damaged; one row per damaged record."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    half = F.floor(F.length("html") / 2).cast("int") + 1
    damaged = F.when(F.expr(DAMAGED) & (F.length("html") > 0), F.overlay("html", F.lit("¤"), half, F.lit(1))).otherwise(F.col("html"))
    a, b = fixity.warc_record(F.col("url"), F.col("html")), fixity.warc_record(F.col("url"), damaged)
    runs = pages.select("page_id", F.octet_length(a).cast("long").alias("length"), fixity.digest(a).alias("digest"),
                        F.octet_length(b).cast("long").alias("length_b"), fixity.digest(b).alias("digest_b")) \
        .groupBy("page_id", "length", "digest", "length_b", "digest_b").agg(F.count("*").alias("copies"))
    ranked = stage(fixity.lay_out(fixity.in_order(runs, "page_id", "digest", "digest_b", "length", "length_b")), "records")
    keep = ("rank", "file", "offset", "copies")
    first = ranked.select(*keep, "page_id", "length", "digest")
    second = ranked.select(*keep, "length", F.col("digest_b").alias("digest"))  # a replica names records by the same ranges
    found = fixity.audit(first, second)
    return found.select("page_id", "rank", "file", "offset", "length", "copies", "digest_a", "digest_b")


def ranks_path() -> str:
    """The public byte-level vocabulary, as ranks (the same ids as its tokenizers file)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The tokenizers file's added tokens, which are cut out of a text before anything else."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), ranks_path(), added=added_tokens())


def _op4_sql() -> str:
    array = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({array(licenses.template_words(p))}, '{label}')" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({array(sorted(set(licenses.template_words(t))))}, {len(licenses.template_words(t))}, {array(must)}, {array(never)}::VARCHAR[], '{label}')"
                          for label, t, must, never in licenses.TEMPLATES)
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, {word}) AS w FROM t),
p AS (SELECT * FROM (VALUES {phrases}) AS v(ph, label)),
h AS (SELECT r, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(ph) - 1] = ph)) AS i FROM w, p),
b AS (SELECT r, count(*)::BIGINT AS n_base, (min(i) - 1)::BIGINT AS first_word, (max(i) - 1)::BIGINT AS last_word FROM h GROUP BY r),
l AS (SELECT r, list_transform(string_split(x, chr(10)), lambda line: regexp_extract_all(line, {word})) AS ws FROM t),
g AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM l, (SELECT unnest(range(1, {licenses.WINDOW + 1})) AS k) WHERE len(ws) >= k),
e AS (SELECT r, k, flatten(ws[i:i + k - 1]) AS f FROM g),
d AS (SELECT r, k, len(f) AS n, list_distinct(f) AS s FROM e WHERE len(f) > 0),
q AS (SELECT * FROM (VALUES {templates}) AS v(tw, tn, must, never, label)),
m AS (SELECT r, label, max(len(list_intersect(s, tw))::DOUBLE / len(tw)) AS share FROM d, q
      WHERE len(list_intersect(s, tw)) >= ceil(0.8 * len(tw) - 1e-9) AND (k = 1 OR n <= 2 * tn) AND list_has_all(s, must) AND NOT list_has_any(s, never) GROUP BY r, label),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM h UNION SELECT r, label FROM m) GROUP BY r),
c AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY r),
s AS (SELECT r, max(share) AS share FROM m GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word, b.last_word,
       coalesce(c.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""


@query("op4_license_scan", _op4_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("blocks")


_OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
m AS (
  SELECT *, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         (length(x) - length(replace(x, chr(10), '')) + 1)::BIGINT AS n_lines, row_number() OVER () AS r FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
s AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY r),
f AS (SELECT m.*, coalesce(s.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols > n_words
            OR 100 * n_dup_lines > 50 * n_lines) AS kept FROM b
"""


@query("op5_quality_rules", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = cascade.cascade(read(spark, sf_dir, "documents"), keep=("doc_id",), fill=True)
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query("op7_vector_search")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS wt, source_size * 3 AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
             / (sum(wt) OVER () - coalesce(sum(wt) OVER o, 0))::DOUBLE AS level FROM w
      WINDOW o AS (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap::DOUBLE / wt) AS level FROM v WHERE cap >= level * wt),
t AS (SELECT v.source, source_size, least(cap::DOUBLE, coalesce(f.level * wt, cap::DOUBLE)) AS target FROM v, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(3, floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query("op8_source_mix", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                          F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


@query("op9_minhash_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), n=2)


@query("op10_bwt_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def piece_model() -> str:
    """The public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_merge_rounds")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.transcode(read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_OP12_SQL = r"""
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a, v b
      WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b))::INTEGER AS rank, s.b AS negative_id,
       p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) <= 5
"""


@query("op12_multi_index_negatives", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), anchors=F.col("vec_id") % 100 == 0)


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS x FROM d),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f1 AS (SELECT lang, w[i] AS a, count(*) AS f FROM o GROUP BY 1, 2),
f2 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS f FROM o WHERE i + 1 <= len(w) GROUP BY 1, 2, 3),
f3 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f FROM o WHERE i + 2 <= len(w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1),
s2 AS (SELECT f2.lang, f2.a, f2.b, f2.f, x.f AS l, y.f AS r, (1000000::HUGEINT * f2.f * f2.f // (x.f::HUGEINT * y.f)) AS score
       FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b WHERE f2.f >= 10),
s3 AS (SELECT f3.*, x.f AS l1, v.f AS r1, u.f AS l2, y.f AS r2, (1000000::HUGEINT * f3.f * f3.f // (x.f::HUGEINT * v.f)) AS k1,
              (1000000::HUGEINT * f3.f * f3.f // (u.f::HUGEINT * y.f)) AS k2
       FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c
       JOIN f2 u ON u.lang = f3.lang AND u.a = f3.a AND u.b = f3.b JOIN f2 v ON v.lang = f3.lang AND v.a = f3.b AND v.b = f3.c),
g AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY 1, 2, 3),
c AS (SELECT s2.lang, s2.a || ' ' || s2.b AS phrase, s2.f AS a, l, r, score FROM s2 LEFT JOIN g ON g.lang = s2.lang AND g.a = s2.a AND g.b = s2.b
      WHERE g.f IS NULL OR 100 * g.f < 50 * s2.f
      UNION ALL SELECT lang, a || ' ' || b || ' ' || c, f, CASE WHEN k1 <= k2 THEN l1 ELSE l2 END, CASE WHEN k1 <= k2 THEN r1 ELSE r2 END, least(k1, k2) FROM s3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM c)
SELECT k.lang, k.rank::INTEGER AS rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, n.n, k.score::BIGINT AS score
FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""


@query("op13_phrase_growth", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))
