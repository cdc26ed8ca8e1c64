"""Section extraction over LaTeX-like text, as Column expressions.

All extraction is per document and therefore a narrow projection: no
``posexplode`` + regroup, no shuffle. Higher-order functions
(``transform``/``filter``) walk the parts of one document inside the row.

IDs: T12 (clean and compat), T13 prefix extraction, T14 residual,
T15 headings, P7 wide -> long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectional.config import CONCL_FLAGS, INTRO_FLAGS, PREFIX_HEADINGS, RELAT_FLAGS
from sectional.functions.text import _c, process_text

SECTION_SPLIT = r"(?i)\\section\{"
HEADING_PATTERN = r"(?i)\\section\{([^}]*)\}"
SECTION_FLAGS = {"intro": INTRO_FLAGS, "relat": RELAT_FLAGS, "concl": CONCL_FLAGS}
SECTIONS = ["intro", "relat", "metho", "concl"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def locate_from(sub: str, c: Column, pos: Column | int = 1) -> Column:
    """1-based position of ``sub`` in ``c`` at or after ``pos`` (0 if absent)."""
    return F.call_function("locate", F.lit(sub), c, pos if isinstance(pos, Column) else F.lit(pos))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; keeps string length, so positions stay valid."""
    return F.translate(c, _UPPER, _LOWER)


# T15 -------------------------------------------------------------------------
def headings(text: Column | str) -> Column:
    """Lower-cased text between ``\\section{`` and the next ``}``, all occurrences."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(HEADING_PATTERN), 1), F.lower)


# T12 clean ---------------------------------------------------------------------
def classify_heading(heading: Column, flags: dict[str, Sequence[str]] = SECTION_FLAGS) -> Column:
    """First section (intro, relat, concl) whose flag occurs in the heading, else metho."""
    out = F.lit("metho")
    for sec in reversed(list(flags)):
        hit = None
        for f in flags[sec]:
            cond = heading.contains(f)
            hit = cond if hit is None else (hit | cond)
        out = F.when(hit, F.lit(sec)).otherwise(out)
    return out


def section_parts(text: Column | str) -> Column:
    """Array of struct(pos, sec, heading, body) for every part after a marker."""
    parts = F.split(_c(text), SECTION_SPLIT)

    def part(p: Column, i: Column) -> Column:
        head = F.lower(F.regexp_extract(p, r"^([^}]*)\}", 1))
        return F.struct(i.alias("pos"), classify_heading(head).alias("sec"), head.alias("heading"),
                        F.regexp_replace(p, r"^[^}]*\}", "").alias("body"))

    return F.filter(F.transform(parts, part), lambda s: s["pos"] > 0)


def preamble(text: Column | str) -> Column:
    """Text before the first marker (part 0)."""
    return F.element_at(F.split(_c(text), SECTION_SPLIT), 1)


def section_body(parts: Column, section: str, sep: str = "\n") -> Column:
    """Bodies of one section joined in position order (empty string if none)."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["sec"] == section), lambda s: s["body"]), sep)


def extract_sections(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Wide form: keep columns + pre, intro, relat, metho, concl (raw bodies)."""
    staged = df.select(*keep, preamble(text_col).alias("pre"), section_parts(text_col).alias("_parts"))
    return staged.select(*keep, "pre", *[section_body(F.col("_parts"), s).alias(s) for s in SECTIONS])


# T12 compat ----------------------------------------------------------------------
def _flag_span(text: Column, low: Column, flag: str) -> Column:
    """Span matched for one flag, from the first marker's ``{`` (null if none).

    Closed form of a lazy, case-insensitive search: the span starts at the
    first ``\\section{``, needs ``flag`` after that brace and a ``}`` after the
    flag, and ends before the next ``\\section`` after that ``}`` or at the
    end of text (less one trailing newline).
    """
    s = locate_from("\\section{", low)
    brace = s + 8
    fpos = locate_from(flag, low, brace + 1)
    close = locate_from("}", low, fpos + len(flag))
    nxt = locate_from("\\section", low, close + 1)
    end_excl = F.when(nxt > 0, nxt).otherwise(F.length(text) + 1 - F.when(text.endswith("\n"), 1).otherwise(0))
    ok = (s > 0) & (fpos > 0) & (close > 0)
    return F.when(ok, F.substring(text, brace, end_excl - brace))


def compat_section(text: Column | str, flags: Sequence[str]) -> Column:
    """Concatenate span + ' ' for every flag that matches, in list order."""
    text = _c(text)
    low = ascii_lower(text)
    pieces = [F.coalesce(F.concat(_flag_span(text, low, f), F.lit(" ")), F.lit("")) for f in flags]
    return F.concat(*pieces)


def compat_residual(text: Column, intro: Column, relat: Column, concl: Column) -> Column:
    """Text with the intro, relat, concl spans removed by literal replace, in that order."""
    out = text
    for part in (intro, relat, concl):
        out = F.when(part == "", out).otherwise(F.replace(out, part, F.lit("")))
    return out


def extract_compat_raw(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Raw compat spans: intro, relat, concl and the residual metho (before cleaning)."""
    t = F.col(text_col)
    staged = df.select(*keep, t.alias("_t"),
                       compat_section(t, INTRO_FLAGS).alias("intro"),
                       compat_section(t, RELAT_FLAGS).alias("relat"),
                       compat_section(t, CONCL_FLAGS).alias("concl"))
    return staged.select(*keep, "intro", "relat",
                         compat_residual(F.col("_t"), F.col("intro"), F.col("relat"), F.col("concl")).alias("metho"),
                         "concl")


# T13 -------------------------------------------------------------------------
def prefix_section(text: Column | str, prefix: str) -> Column:
    """From the first ``\\section{<prefix>`` up to (not incl.) the next ``\\section``.

    Heading included, starting at the brace; empty when no later marker exists.
    """
    text = _c(text)
    low = ascii_lower(text)
    s = locate_from("\\section{" + prefix.lower(), low)
    brace = s + 8
    nxt = locate_from("\\section", low, brace + 1 + len(prefix))
    return F.when((s > 0) & (nxt > 0), F.substring(text, brace, nxt - brace)).otherwise(F.lit(""))


def extract_prefix_raw(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    t = F.col(text_col)
    names = {"Intro": "intro", "Relat": "relat", "Concl": "concl"}
    staged = df.select(*keep, t.alias("_t"), *[prefix_section(t, p).alias(names[p]) for p in PREFIX_HEADINGS])
    return staged.select(*keep, "intro", "relat",
                         compat_residual(F.col("_t"), F.col("intro"), F.col("relat"), F.col("concl")).alias("metho"),
                         "concl")


def clean_sections(df: DataFrame, keep: Sequence[str] = ("doc_id",), sep: str = " ") -> DataFrame:
    """T9 over each of the four section columns."""
    return df.select(*keep, *[process_text(F.col(s), sep=sep).alias(s) for s in SECTIONS])


# P7 --------------------------------------------------------------------------
def to_long(df: DataFrame, ids: Sequence[str], sections: Sequence[str], name: str = "section",
            value: str = "text") -> DataFrame:
    """Wide section columns -> (ids..., section, text) rows (narrow ``stack``)."""
    return df.unpivot(list(ids), list(sections), name, value)
