"""Text rules on worked examples."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("name", "title"),
    [('a<b>:c"d/e\\f|g?h*', "a_b__c_d_e_f_g_h_"), (" .Book. ", "Book"), ("", "unnamed_book"), ("...", "unnamed_book"), ("x\x01y", "x_y")],
)
def test_book_title(spark, name, title):
    assert one(spark, name, X.book_title) == title


def test_fences(spark):
    assert one(spark, "<think>hm\nhm</think>\n```markdown\n# T\n```", X.strip_fences) == "# T"
    assert one(spark, "left over</think> body", X.strip_fences) == "body"
    assert one(spark, "```\nx\n```", X.strip_fences) == "x"


def test_stub_loop_is_cut():
    stub = "<!-- MUSIC_STUB_ID: P0001_S01_staff -->"
    assert X.loops_cut("\n".join([stub] * 12)).count(stub) == 2


def test_paragraphs_with_blank_lines():
    text = "\n\n".join(["The same paragraph comes again."] * 8)
    assert X.loops_cut(text).count("paragraph") == 2


def test_blocks_and_phrases():
    assert X.loops_cut("\n".join(["a one", "b two", "c three"] * 5)) == "\n".join(["a one", "b two", "c three"] * 2)
    assert X.loops_cut("twelve chars " * 6).count("twelve") == 2
    clean = "one\ntwo\n\nthree\ntwo"
    assert X.loops_cut(clean) == clean and X.loops_cut("") == "" and X.loops_cut(None) is None


def test_native_and_python_phrase_cut_agree(spark):
    for text in ("twelve chars " * 5 + "end", "no loop here", "abcdefghijklm" * 3):
        assert one(spark, text, X.cut_inline_loops) == __import__("re").sub(r"([^\n]{12,120}?)\1{2,}", r"\1\1", text)


@pytest.mark.parametrize(
    ("tail", "loops"),
    [("word " * 10, True), ("word " * 5, False), ("a longer phrase; " * 4, True), ("line one\nline two\n" * 3, True), ("l1\nl2\n" * 3, False), ("short", False), ("all of these lines are different\nso no loop\nis found here", False), ("same line\n" * 3, True)],
)
def test_streaming_loop(spark, tail, loops):
    assert one(spark, tail, X.streaming_loop) is loops


def test_escape_and_stubs(spark):
    assert one(spark, "<a & 'b'>", X.html_escape) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, "P0001_S01_grand_staff", X.stub_class) == "grand_staff"
    assert spark.range(1).select(X.stub_id(F.lit(1), F.lit(1), F.lit("staff"))).first()[0] == "P0001_S01_staff"
