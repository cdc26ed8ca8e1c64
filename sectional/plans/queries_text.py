"""Registered text, section and profile queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectional.config import CONCL_FLAGS, INTRO_FLAGS, PREFIX_HEADINGS, RELAT_FLAGS, VOCAB_SIZE
from sectional.functions import sections as S
from sectional.functions import text as X
from sectional.operators import profile as P
from sectional.operators import vocab as V
from sectional.plans import sqlgen as g
from sectional.plans.catalog import register
from sectional.sources import corpus as C
from sectional.sources.tables import latex_documents, spread, table

TOP_TOKENS = VOCAB_SIZE


# vocab_top: T3 T4 A4 K2 --------------------------------------------------------
@register("vocab_top", sql=f"""
WITH toks AS (
  SELECT unnest({g.lower_tokens("text")}) AS token FROM documents
),
counts AS (
  SELECT token, count(*) AS cnt FROM toks WHERE token NOT IN ('<unk>', '<pad>', '<SOS>') GROUP BY token
)
SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 2 AS INTEGER) AS idx
FROM counts ORDER BY cnt DESC, token LIMIT {TOP_TOKENS}
""")
def vocab_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id") \
        .select(X.lower_tokens(X.tokenize("text")).alias("tokens"))
    counts = V.token_counts(docs, ["tokens"]).filter(~F.col("token").isin(["<unk>", "<pad>", "<SOS>"]))
    return V.top_tokens(counts, TOP_TOKENS, first_index=3)


# clean_text: P6 T1 T2 T5-T9 T16 U1 ------------------------------------------------
@register("clean_text", sql=f"""
WITH {g.latex_cte()}
SELECT doc_id, {g.process_text("text", " ")} AS clean_sp, {g.process_text("text", "")} AS clean_cat
FROM latex
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latex_documents(spark, sf_dir)
    lines = X.text_to_lines("text")
    # Staged so the line array is built once and both separators reuse it.
    staged = docs.select("doc_id", X.filter_lines(lines).alias("_lines"))
    cleaned = staged.select("doc_id", F.transform("_lines", lambda l: X.clean_str(l)).alias("_clean"))
    return cleaned.select("doc_id", F.array_join("_clean", " ").alias("clean_sp"),
                          F.array_join("_clean", "").alias("clean_cat"))


# label_map: P5 U2 ---------------------------------------------------------------
LABEL_NEGATIVES = ["src0", "src1"]


@register("label_map", sql=f"""
SELECT doc_id, source,
       CAST(CASE WHEN source IS NOT NULL AND source IN ({", ".join(g.q(v) for v in LABEL_NEGATIVES)}) THEN 0 ELSE 1 END AS INTEGER) AS label
FROM documents
""")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", X.venue_label("source", LABEL_NEGATIVES).alias("label"))


# corpus_trim: S2 S4 P1-P3 --------------------------------------------------------
@register("corpus_trim", sql="""
WITH halves AS (
  SELECT * FROM documents WHERE ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 2 = 0
  UNION ALL BY NAME
  SELECT * FROM documents WHERE ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 2 = 1
),
trimmed AS (
  SELECT * FROM halves WHERE doc_id NOT IN (SELECT doc_id FROM halves ORDER BY doc_id DESC LIMIT 1)
)
SELECT doc_id, lang AS categ, source AS venue, n_chars,
       CAST(CASE WHEN source IN ('CoRR', 'No') THEN 0 ELSE 1 END AS INTEGER) AS label,
       CAST(NULL AS VARCHAR) AS intro
FROM trimmed
""")
def corpus_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = C.hash_halves(docs, "doc_id")
    union = C.union_parts(parts)
    trimmed = C.size_tier(union, n=-1, order_by="doc_id")
    renamed = trimmed.withColumnsRenamed({"lang": "categ", "source": "venue"})
    return renamed.select("doc_id", "categ", "venue", "n_chars", X.venue_label("venue").alias("label"),
                          F.lit(None).cast("string").alias("intro"))


# list_split: T10 T11 --------------------------------------------------------------
@register("list_split", sql="""
SELECT doc_id,
       CAST(len(string_split(lang || ',' || source, ',')) AS INTEGER) AS n_authors,
       array_to_string(string_split(lang || ',' || source, ','), '|') AS authors,
       CAST(len(string_split(source || ', ' || lang || ',', ',')) AS INTEGER) AS n_categs,
       array_to_string(string_split(source || ', ' || lang || ',', ','), '|') AS categs
FROM documents
""")
def list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    authors = X.split_authors(F.concat(F.col("lang"), F.lit(","), F.col("source")))
    categs = X.split_categories(F.concat(F.col("source"), F.lit(", "), F.col("lang"), F.lit(",")))
    return docs.select("doc_id", F.size(authors).alias("n_authors"), F.array_join(authors, "|").alias("authors"),
                       F.size(categs).alias("n_categs"), F.array_join(categs, "|").alias("categs"))


# section_clean: T12 clean, T14 clean (metho = unmatched), P2 ---------------------------
@register("section_clean", sql=f"""
WITH {g.latex_cte()},
{g.clean_sections_ctes("latex")}
SELECT doc_id, pre, intro, relat, metho, concl FROM wide
""")
def section_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extract_sections(latex_documents(spark, sf_dir))


# section_prefix: T13 (prefix headings), cleaned with the line-fusing separator ---------------
def _prefix_sql() -> str:
    spans = {p.lower()[:5]: g.prefix_span("text", p) for p in PREFIX_HEADINGS}
    return f"""
WITH {g.latex_cte()},
raw AS (
  SELECT doc_id, text, {spans["intro"]} AS intro, {spans["relat"]} AS relat, {spans["concl"]} AS concl FROM latex
),
spans AS (
  SELECT doc_id, intro, relat, {g.residual("text", ["intro", "relat", "concl"])} AS metho, concl FROM raw
)
SELECT doc_id, {g.process_text("intro", "")} AS intro, {g.process_text("relat", "")} AS relat,
       {g.process_text("metho", "")} AS metho, {g.process_text("concl", "")} AS concl
FROM spans
"""


@register("section_prefix", sql=_prefix_sql())
def section_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.extract_prefix_raw(latex_documents(spark, sf_dir))
    return S.clean_sections(raw, sep="")


# section_compat: T12 compat spans, cleaned with the line-fusing separator ---------------------
def _compat_raw_sql() -> str:
    return f"""
WITH {g.latex_cte()},
raw AS (
  SELECT doc_id, text, {g.compat_section("text", INTRO_FLAGS)} AS intro, {g.compat_section("text", RELAT_FLAGS)} AS relat,
         {g.compat_section("text", CONCL_FLAGS)} AS concl
  FROM latex
),
spans AS (
  SELECT doc_id, intro, relat, {g.residual("text", ["intro", "relat", "concl"])} AS metho, concl FROM raw
)"""


@register("section_compat", sql=_compat_raw_sql() + f"""
SELECT doc_id, {g.process_text("intro", "")} AS intro, {g.process_text("relat", "")} AS relat,
       {g.process_text("metho", "")} AS metho, {g.process_text("concl", "")} AS concl
FROM spans
""")
def section_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.extract_compat_raw(latex_documents(spark, sf_dir))
    return S.clean_sections(raw, sep="")


# residual: T14 compat (raw residual, before cleaning) --------------------------------------
@register("residual", sql=_compat_raw_sql() + """
SELECT doc_id, CAST(length(intro) AS INTEGER) AS intro_len, CAST(length(relat) AS INTEGER) AS relat_len,
       CAST(length(concl) AS INTEGER) AS concl_len, metho
FROM spans
""")
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.extract_compat_raw(latex_documents(spark, sf_dir))
    return raw.select("doc_id", F.length("intro").alias("intro_len"), F.length("relat").alias("relat_len"),
                      F.length("concl").alias("concl_len"), "metho")


# heading_top / heading_mass: T15 A1 A2 A3 K1 --------------------------------------------
H1_PATTERN = r"(?is)<h1[^>]*>(.*?)</h1>"

_HEADINGS_SQL = f"""
WITH {g.latex_cte()},
heads AS (
  SELECT unnest(list_transform(regexp_extract_all(text, {g.q(S.HEADING_PATTERN)}, 1), lambda h: lower(h))) AS heading FROM latex
  UNION ALL
  SELECT unnest(list_transform(regexp_extract_all(html, {g.q(H1_PATTERN)}, 1), lambda h: lower(h))) AS heading FROM pages
),
counts AS (SELECT heading, count(*) AS cnt FROM heads GROUP BY heading)"""


def _heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latex = latex_documents(spark, sf_dir).select(S.headings("text").alias("hs"))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select(
        F.transform(F.regexp_extract_all("html", F.lit(H1_PATTERN), 1), F.lower).alias("hs"))
    return P.heading_counts(latex.unionByName(pages), "hs")


@register("heading_top", sql=_HEADINGS_SQL + """
SELECT heading, cnt FROM counts ORDER BY cnt DESC, heading LIMIT 15
""")
def heading_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_headings(_heading_counts(spark, sf_dir), 15)


@register("heading_mass", sql=_HEADINGS_SQL + """
SELECT count(*) AS n_distinct, sum(cnt)::BIGINT AS mass, coalesce(sum(cnt) FILTER (WHERE cnt > 1), 0)::BIGINT AS repeated_mass
FROM counts
""")
def heading_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.heading_mass(_heading_counts(spark, sf_dir))


# length_box / length_hist / length_kde: A8 A9 A10 P4 U3 ---------------------------------
HIST_BINS = 20
KDE_GRID = 32
_NORM = 1.0 / math.sqrt(2.0 * math.pi)


def section_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, len): token counts of the LaTeX-view sections and of conversation turns by role."""
    wide = S.extract_sections(latex_documents(spark, sf_dir))
    # P4 + U3: subset the section columns and map each to its token length in one projection.
    lens = wide.select("doc_id", *X.map_columns(S.SECTIONS, X.token_length))
    docs = S.to_long(lens, ["doc_id"], S.SECTIONS, "section", "len").select("section", "len")
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "role", "text"), "conv_id").select(
        F.concat(F.lit("role:"), F.col("role")).alias("section"), X.token_length("text").alias("len"))
    return docs.unionByName(conv)


def _lengths_sql() -> str:
    tok = lambda c: f"CAST(len({g.tokens(c)}) AS INTEGER)"
    secs = "\n  UNION ALL ".join(f"SELECT '{s}' AS section, {tok(s)} AS len FROM wide" for s in S.SECTIONS)
    return f"""WITH {g.latex_cte()},
{g.clean_sections_ctes("latex")},
lens AS (
  {secs}
  UNION ALL SELECT 'role:' || role AS section, {tok("text")} AS len FROM conversations
)"""


@register("length_box", sql=_lengths_sql() + """,
stats AS (
  SELECT section, count(*) AS n, quantile_cont(len::DOUBLE, 0.25) AS q1, quantile_cont(len::DOUBLE, 0.5) AS median,
         quantile_cont(len::DOUBLE, 0.75) AS q3
  FROM lens GROUP BY section
)
SELECT s.section, s.n, s.q1, s.median, s.q3,
       min(l.len::DOUBLE) FILTER (WHERE l.len >= s.q1 - 1.5 * (s.q3 - s.q1)) AS whisker_lo,
       max(l.len::DOUBLE) FILTER (WHERE l.len <= s.q3 + 1.5 * (s.q3 - s.q1)) AS whisker_hi,
       count(*) FILTER (WHERE l.len < s.q1 - 1.5 * (s.q3 - s.q1) OR l.len > s.q3 + 1.5 * (s.q3 - s.q1)) AS n_outliers
FROM lens l JOIN stats s ON l.section = s.section
GROUP BY s.section, s.n, s.q1, s.median, s.q3
""")
def length_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.box_summary(section_lengths(spark, sf_dir), "section", "len")


@register("length_hist", sql=_lengths_sql() + f""",
mm AS (SELECT section, min(len)::DOUBLE AS lo, max(len)::DOUBLE AS hi FROM lens GROUP BY section),
b AS (
  SELECT l.section, lo, hi,
         CASE WHEN hi - lo = 0 THEN 0 ELSE least(CAST(floor((l.len - lo) * {float(HIST_BINS)!r} / (hi - lo)) AS INTEGER), {HIST_BINS - 1}) END AS bin
  FROM lens l JOIN mm ON l.section = mm.section
)
SELECT section, bin, round(lo + bin * (hi - lo) / {float(HIST_BINS)!r}, 6) AS bin_lo, count(*) AS cnt
FROM b GROUP BY section, lo, hi, bin
""")
def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(section_lengths(spark, sf_dir), "section", "len", bins=HIST_BINS)


@register("length_kde", sql=_lengths_sql() + f""",
st AS (
  SELECT section, count(*) AS n, min(len)::DOUBLE AS lo, max(len)::DOUBLE AS hi,
         stddev_samp(len::DOUBLE) * pow(count(*)::DOUBLE, -0.2) AS h FROM lens GROUP BY section
),
gx AS (SELECT *, lo + g * ((hi - lo) / {float(KDE_GRID - 1)!r}) AS x FROM (SELECT *, CAST(unnest(range(0, {KDE_GRID})) AS INTEGER) AS g FROM st))
SELECT gx.section, g, round(x, 6) AS x,
       round(CASE WHEN h > 0 THEN sum({_NORM!r} * exp(-0.5 * ((x - l.len) / h) * ((x - l.len) / h))) / (n * h) END, 9) AS density
FROM gx JOIN lens l ON l.section = gx.section
GROUP BY gx.section, g, x, n, h
""")
def length_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kde(section_lengths(spark, sf_dir), "section", "len", grid=KDE_GRID)
