"""Goldens for section extraction (FIXTURES §3: T12 clean/compat, T13, T14, T15)."""

from pyspark.sql import functions as F

from sectional.functions import sections as S

TEXT = "X \\Section{Intro} a \\Section{Related Work} b \\Section{Conclusion} c"


def frame(spark, text=TEXT):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_t12_clean(spark):
    r = S.extract_sections(frame(spark)).first()
    assert (r["pre"], r["intro"], r["relat"], r["metho"], r["concl"]) == ("X ", " a ", " b ", "", " c")


def test_t12_clean_joins_repeated_sections_in_order(spark):
    r = S.extract_sections(frame(spark, "\\section{Method}\nA\n\\section{Intro}x\\section{Model}B")).first()
    assert r["metho"] == "\nA\n\nB" and r["intro"] == "x"


def test_t12_compat_spans(spark):
    r = S.extract_compat_raw(frame(spark)).first()
    assert r["intro"] == "{Intro} a  "
    assert r["relat"] == "{Intro} a \\Section{Related Work} b  "
    assert r["concl"] == TEXT[TEXT.index("{Intro}"):] + " "
    assert r["metho"] == TEXT  # T14 compat: the spans' trailing space keeps them from matching


def test_t12_compat_trailing_newline(spark):
    r = S.extract_compat_raw(frame(spark, "\\section{Conclusion} c\n")).first()
    assert r["concl"] == "{Conclusion} c "


def test_t13_prefix(spark):
    r = S.extract_prefix_raw(frame(spark)).first()
    assert (r["intro"], r["relat"], r["concl"]) == ("{Intro} a ", "{Related Work} b ", "")


def test_t15_headings(spark):
    r = frame(spark).select(S.headings("text").alias("h")).first()
    assert r["h"] == ["intro", "related work", "conclusion"]


def test_p7_to_long(spark):
    wide = S.extract_sections(frame(spark))
    long = S.to_long(wide, ["doc_id"], S.SECTIONS).orderBy("section").collect()
    assert [r["section"] for r in long] == sorted(S.SECTIONS)
