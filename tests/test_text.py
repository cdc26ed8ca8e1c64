"""Goldens for the text functions (FIXTURES §3: P5, P6, T1, T2, T7, T8, T9, T10)."""

from pyspark.sql import functions as F

from sectional.config import DELETE_CHARS
from sectional.functions import text as X


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col.alias("r")).first()["r"]


def col_values(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["r"] for r in df.select("i", fn(F.col("s")).alias("r")).orderBy("i").collect()]


def test_p5_venue_label(spark):
    assert col_values(spark, ["CoRR", "No", "ACL", None, "corr"], X.venue_label) == [0, 0, 1, 1, 1]


def test_p6_line_filter(spark):
    df = spark.createDataFrame([(["% c", "\\begin{x}", "", "3 cats", "  ok"],)], "l array<string>")
    assert df.select(X.filter_lines(F.col("l")).alias("r")).first()["r"] == ["ok"]


def test_t1_clean_math(spark):
    assert one(spark, X.clean_math(F.col("s")), "a $x$ b $$y$$ c $z") == "a  b y c $z"
    assert one(spark, X.clean_math(F.col("s")), " $a$ x") == "x"
    assert one(spark, X.clean_math(F.col("s")), "  x ") == "  x "


def test_t2_drop_refs(spark):
    assert one(spark, X.drop_refs(F.col("s")), "\\cite{a} text {b} tail") == " tail"
    assert one(spark, X.drop_refs(F.col("s")), "in~\\cite{a} the model, see \\ref{b}!") == "in!"
    assert one(spark, X.drop_refs(F.col("s"), lazy=True), "\\cite{a} text {b} tail") == " text {b} tail"


def test_t7_delete_chars(spark):
    assert one(spark, X.delete_chars(F.col("s")), "a-b (c) [d] 50% x:y_z") == "ab c d 50 x:y_z"


def test_t8_clean_str(spark):
    line = "We use $x^2$ in~\\cite{a} the model, see \\ref{b}!"
    assert one(spark, X.clean_str(F.col("s"), stop_words=["we", "in"]), line) == "use "


def test_t8_output_has_no_deleted_chars(spark):
    out = one(spark, X.clean_str(F.col("s")), "x, y. (z) [w] {v} a+b=c #1 @2 %3 ^4 *5 -6 /7 \\8 ~9 $10 & ? !")
    assert not any(ch in out for ch in DELETE_CHARS)


def test_t9_process_lines(spark):
    df = spark.createDataFrame([(["cat dog", "fox"],)], "l array<string>")
    assert df.select(X.process_lines(F.col("l"), sep=" ").alias("r")).first()["r"] == "cat dog fox"
    assert df.select(X.process_lines(F.col("l"), sep="").alias("r")).first()["r"] == "cat dogfox"


def test_t10_split_authors(spark):
    assert one(spark, X.split_authors(F.col("s")), "A B, C") == ["A B", " C"]


def test_tokenizer(spark):
    assert one(spark, X.tokenize(F.col("s")), "Hello, world_1 x-y") == ["Hello", ",", "world_1", "x", "-", "y"]


def test_u1_pandas_tokenizer_plugs_into_clean_str(spark):
    tok = X.pandas_tokenizer(lambda t: t.split())
    assert one(spark, tok(F.col("s")), "a-b c") == ["a-b", "c"]
    # Whitespace tokens keep "a-b" whole; deletion then removes the hyphen.
    assert one(spark, X.clean_str(F.col("s"), tokenizer=tok, stop_words=[]), "A-b C") == "ab c"
