"""Text scalar functions as Column expressions (no Python UDF on the hot path).

Each function maps ``Column -> Column`` so callers compose them into one
projection; Catalyst keeps the whole chain inside a single stage.

IDs: P5 label map, P6 line filter, T1-T11 cleaning and splitting, T16 lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sectional.config import DELETE_CHARS, NEGATIVE_VENUES, STOP_WORDS, TOKEN_PATTERN

ColFn = Callable[[Column], Column]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


# T1 ------------------------------------------------------------------------
_MATH_PAIR = r"\$[^$]*\$"


def clean_math(c: Column | str) -> Column:
    """Remove ``$...$`` pairs left to right; strip when at least one pair was removed."""
    c = _c(c)
    return F.when(c.rlike(_MATH_PAIR), strip(F.regexp_replace(c, _MATH_PAIR, ""))).otherwise(c)


# T2 ------------------------------------------------------------------------
# Greedy spans removed from a line, in this order.
REF_PATTERNS = [r"~(.*)\}", r"\\cite(.*)\}", r"\\newcite(.*)\}", r"\\ref(.*)\}"]


def drop_refs(c: Column | str, lazy: bool = False) -> Column:
    """Remove reference spans; greedy by default (to the last ``}`` on the line)."""
    c = _c(c)
    for pat in REF_PATTERNS:
        # (?d): '.' stops at '\n' only, as in Python without DOTALL.
        c = F.regexp_replace(c, "(?d)" + (pat.replace("(.*)", "(.*?)") if lazy else pat), "")
    return c


# T3 / T4 / T5 / T6 / T7 ---------------------------------------------------------
def tokenize(c: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Words: runs of letters, digits or ``_``; any other non-space char is a token."""
    return F.regexp_extract_all(_c(c), F.lit(pattern), 0)


def pandas_tokenizer(fn: Callable[[str], list[str]]) -> ColFn:
    """U1 opt-in: wrap a Python ``str -> list[str]`` tokeniser as an Arrow-batched pandas UDF.

    The result plugs in wherever a ``tokenizer`` Column function is accepted
    (e.g. ``clean_str(col, tokenizer=...)``). It runs in Python workers, so the
    built-in ``tokenize`` stays the default on the hot path.
    """
    @F.pandas_udf(ArrayType(StringType()))
    def _tok(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(fn(t)))

    return lambda c: _tok(_c(c))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def remove_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Drop stop words. ``isin`` over a long literal list becomes a hash set (InSet)."""
    words = list(stop_words)
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def join_tokens(tokens: Column, sep: str = " ") -> Column:
    return F.array_join(tokens, sep)


def delete_chars(c: Column | str, chars: str = DELETE_CHARS) -> Column:
    """Delete every listed character (one ``translate``)."""
    return F.translate(_c(c), chars, "")


# T8 ------------------------------------------------------------------------
def clean_str(c: Column | str, tokenizer: ColFn = tokenize, stop_words: Sequence[str] = STOP_WORDS,
              lazy_refs: bool = False) -> Column:
    """One line -> cleaned line: math, references, tokens, lower, stop words, join, delete."""
    line = drop_refs(clean_math(_c(c)), lazy=lazy_refs)
    tokens = remove_stop_words(lower_tokens(tokenizer(line)), stop_words)
    return delete_chars(join_tokens(tokens, " "))


# P6 ------------------------------------------------------------------------
def keep_line(stripped: Column) -> Column:
    """A stripped line is kept unless empty, a comment/command, or starting with a digit."""
    return ~(stripped.startswith("%") | stripped.startswith("\\") | (stripped == "")
             | stripped.rlike(r"^\p{Nd}"))


def filter_lines(lines: Column) -> Column:
    """P6 over an array of lines: strip each, keep those passing ``keep_line``."""
    return F.filter(F.transform(lines, strip), keep_line)


# T16 -----------------------------------------------------------------------
def text_to_lines(text: Column | str) -> Column:
    return F.split(_c(text), "\n")


def lines_to_text(lines: Column, sep: str = " ") -> Column:
    return F.array_join(lines, sep)


# T9 ------------------------------------------------------------------------
def process_lines(lines: Column, sep: str = " ", **clean_kw) -> Column:
    """Filter lines (P6), clean each (T8), concatenate with ``sep``.

    ``sep=''`` reproduces the original concatenation that fuses words across
    lines; the default keeps a space between lines.
    """
    return F.array_join(F.transform(filter_lines(lines), lambda l: clean_str(l, **clean_kw)), sep)


def process_text(text: Column | str, sep: str = " ", **clean_kw) -> Column:
    """T9 over a text value: split on newlines, then ``process_lines``."""
    return process_lines(text_to_lines(text), sep=sep, **clean_kw)


# T10 / T11 -------------------------------------------------------------------
def split_authors(c: Column | str) -> Column:
    """Author list: split on ',' (pieces are not trimmed)."""
    return F.split(_c(c), ",")


def split_categories(c: Column | str) -> Column:
    return F.split(_c(c), ",")


# P5 / U2 ---------------------------------------------------------------------
def venue_label(c: Column | str, negatives: Sequence[str] = NEGATIVE_VENUES) -> Column:
    """0 for the negative venues (case-sensitive), 1 for anything else, null included."""
    c = _c(c)
    return F.when(c.isNotNull() & c.isin(list(negatives)), F.lit(0)).otherwise(F.lit(1))


# U3 --------------------------------------------------------------------------
def map_columns(cols: Sequence[str], fn: ColFn, suffix: str = "") -> list[Column]:
    """Element-wise map over several columns, as one projection."""
    return [fn(F.col(c)).alias(c + suffix) for c in cols]


def token_length(c: Column | str) -> Column:
    """Number of tokens (null text -> 0)."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(tokenize(c)))
