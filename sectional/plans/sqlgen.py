"""DuckDB SQL fragments for the oracle statements.

These build the *oracle* side of the correctness check: plain SQL text over
the driver's views, written per operator so each Spark query has an
independent statement to be compared with. Nothing here runs on Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from sectional.config import (CONCL_FLAGS, DELETE_CHARS, INTRO_FLAGS, LATEX_HEADINGS, RELAT_FLAGS,
                              STOP_WORDS, TOKEN_PATTERN)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items: Sequence[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean_math(x: str) -> str:
    removed = f"regexp_replace({x}, '\\$[^$]*\\$', '', 'g')"
    return f"(CASE WHEN regexp_matches({x}, '\\$[^$]*\\$') THEN {strip(removed)} ELSE {x} END)"


def drop_refs(x: str) -> str:
    for pat in [r"~(.*)\}", r"\\cite(.*)\}", r"\\newcite(.*)\}", r"\\ref(.*)\}"]:
        x = f"regexp_replace({x}, {q(pat)}, '', 'g')"
    return x


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(TOKEN_PATTERN)}, 0)"


def lower_tokens(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda t: lower(t))"


def clean_str(x: str, stop_words: Sequence[str] = STOP_WORDS) -> str:
    kept = f"list_filter({lower_tokens(drop_refs(clean_math(x)))}, lambda t: NOT list_contains({str_list(stop_words)}, t))"
    return f"translate(array_to_string({kept}, ' '), {q(DELETE_CHARS)}, '')"


def keep_line(x: str) -> str:
    return (f"NOT (starts_with({x}, '%') OR starts_with({x}, '\\') OR {x} = '' "
            f"OR regexp_matches({x}, '^\\p{{Nd}}'))")


def process_text(x: str, sep: str = " ") -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: {keep_line('l')})"
    return f"array_to_string(list_transform({lines}, lambda l: {clean_str('l')}), {q(sep)})"


def latex_cte(source: str = "documents") -> str:
    heads = str_list(LATEX_HEADINGS)
    n = len(LATEX_HEADINGS)
    return f"""latex AS (
  SELECT doc_id, lang, source, n_chars,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
           '\\Section{{' || ({heads})[((i - 1) % {n}) + 1] || '}}' || chr(10) || l ||
           CASE WHEN (i - 1) % 5 = 0 THEN ' see~\\cite{{ref' || (i - 1)::VARCHAR || '}} and \\ref{{fig' || (i - 1)::VARCHAR || '}}.' ELSE '' END),
           chr(10)) AS text
  FROM {source}
)"""


def ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def locate(needle: str, hay: str, pos: str) -> str:
    """1-based position of literal ``needle`` in ``hay`` at or after ``pos`` (0 if absent)."""
    sub = f"strpos(substring({hay}, {pos}), {q(needle)})"
    return f"(CASE WHEN ({pos}) >= 1 AND {sub} > 0 THEN {sub} + ({pos}) - 1 ELSE 0 END)"


def flag_span(text: str, flag: str) -> str:
    low = ascii_lower(text)
    s = locate("\\section{", low, "1")
    brace = f"({s} + 8)"
    fpos = locate(flag, low, f"{brace} + 1")
    close = locate("}", low, f"{fpos} + {len(flag)}")
    nxt = locate("\\section", low, f"{close} + 1")
    end_excl = f"(CASE WHEN {nxt} > 0 THEN {nxt} ELSE length({text}) + 1 - (CASE WHEN ends_with({text}, chr(10)) THEN 1 ELSE 0 END) END)"
    return (f"(CASE WHEN {s} > 0 AND {fpos} > 0 AND {close} > 0 "
            f"THEN substring({text}, {brace}, {end_excl} - {brace}) ELSE NULL END)")


def compat_section(text: str, flags: Sequence[str]) -> str:
    return "(" + " || ".join(f"coalesce({flag_span(text, f)} || ' ', '')" for f in flags) + ")"


def residual(text: str, parts: Sequence[str]) -> str:
    out = text
    for p in parts:
        out = f"(CASE WHEN {p} = '' THEN {out} ELSE replace({out}, {p}, '') END)"
    return out


def prefix_span(text: str, prefix: str) -> str:
    low = ascii_lower(text)
    s = locate("\\section{" + prefix.lower(), low, "1")
    brace = f"({s} + 8)"
    nxt = locate("\\section", low, f"{brace} + 1 + {len(prefix)}")
    return f"(CASE WHEN {s} > 0 AND {nxt} > 0 THEN substring({text}, {brace}, {nxt} - {brace}) ELSE '' END)"


def classify(heading: str) -> str:
    def any_of(flags):
        return " OR ".join(f"contains({heading}, {q(f)})" for f in flags)
    return (f"(CASE WHEN {any_of(INTRO_FLAGS)} THEN 'intro' WHEN {any_of(RELAT_FLAGS)} THEN 'relat' "
            f"WHEN {any_of(CONCL_FLAGS)} THEN 'concl' ELSE 'metho' END)")


SECTION_SPLIT = r"(?i)\\section\{"


def clean_sections_ctes(src: str = "latex") -> str:
    """CTEs ``parts`` (doc_id, pos, part) and ``secs`` (doc_id, sec, body) over ``src``."""
    return f"""parts AS (
  SELECT doc_id, unnest(string_split_regex(text, {q(SECTION_SPLIT)})) AS part,
         generate_subscripts(string_split_regex(text, {q(SECTION_SPLIT)}), 1) AS pos
  FROM {src}
),
headed AS (
  SELECT doc_id, pos, lower(regexp_extract(part, '^([^}}]*)\\}}', 1)) AS heading,
         regexp_replace(part, '^[^}}]*\\}}', '') AS body
  FROM parts WHERE pos > 1
),
classified AS (
  SELECT doc_id, pos, {classify("heading")} AS sec, body FROM headed
),
secs AS (
  SELECT doc_id, sec, string_agg(body, chr(10) ORDER BY pos) AS body FROM classified GROUP BY doc_id, sec
),
wide AS (
  SELECT l.doc_id,
         string_split_regex(l.text, {q(SECTION_SPLIT)})[1] AS pre,
         coalesce(max(s.body) FILTER (WHERE s.sec = 'intro'), '') AS intro,
         coalesce(max(s.body) FILTER (WHERE s.sec = 'relat'), '') AS relat,
         coalesce(max(s.body) FILTER (WHERE s.sec = 'metho'), '') AS metho,
         coalesce(max(s.body) FILTER (WHERE s.sec = 'concl'), '') AS concl
  FROM {src} l LEFT JOIN secs s ON l.doc_id = s.doc_id
  GROUP BY l.doc_id, l.text
)"""


__all__ = ["q", "str_list", "clean_str", "process_text", "latex_cte", "compat_section", "residual",
           "prefix_span", "clean_sections_ctes", "INTRO_FLAGS", "RELAT_FLAGS", "CONCL_FLAGS"]


def key_hash(col: str, start: int = 1) -> str:
    return f"(('0x' || substr(md5(CAST({col} AS VARCHAR)), {start}, 8))::BIGINT)"


def split_label(col: str, bounds: Sequence[int] = (6000, 8000), names: Sequence[str] = ("train", "valid", "test")) -> str:
    b = f"({key_hash(col)} % 10000)"
    whens = " ".join(f"WHEN {b} < {x} THEN {q(n)}" for x, n in zip(bounds, names))
    return f"(CASE {whens} ELSE {q(names[-1])} END)"


def fixed_length(toks: str, length: str) -> str:
    return f"list_resize(list_concat(['<SOS>'], ({toks})[1:({length}) - 1]), {length}, '<pad>')"


def top_vocab(src: str, cap: int, first: int = 3) -> str:
    """SELECT token, cnt, idx over a (token) relation: the ``cap`` most frequent, ties by token."""
    return f"""SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) + {first - 1} AS INTEGER) AS idx
  FROM (SELECT token, count(*) AS cnt FROM ({src}) WHERE token NOT IN ('<unk>', '<pad>', '<SOS>') GROUP BY token)
  ORDER BY cnt DESC, token LIMIT {cap}"""


def batch_buckets(rows: str, batch_size: int) -> str:
    """Number of batch buckets: one per 64 batches of the counted rows."""
    return f"(SELECT greatest(1, CAST(ceil(count(*) / {64.0 * batch_size}) AS BIGINT)) FROM {rows})"
