"""Goldens of the text functions, composed and decomposed."""

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.functions.html import grid, is_layout, pipe_table, to_markdown  # noqa: F401


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def nfd(s):
    return unicodedata.normalize("NFD", s)


def test_normal_forms_compose(spark):
    assert one(spark, text.nfc, nfd("việc"), "việc", "abc", None) == ["việc", "việc", "abc", None]
    assert one(spark, text.nfkc, "ﬁn ①", nfd("Điều")) == ["fin 1", "Điều"]


def test_keyword_slug(spark):
    got = one(spark, text.keyword_slug, "15/2020/NĐ-CP", "  Lao động ", nfd("Lao động"), "...", "ＡＢ ﬁ", None)
    assert got == ["15_2020_nd_cp", "lao_dong", "lao_dong", None, "ab_fi", None]


def test_node_slug(spark):
    assert one(spark, text.node_slug, "15/2020/NĐ-CP", "đ", None) == ["15-2020-n-cp", "none", "none"]


def test_dates(spark):
    got = one(spark, lambda c: text.parse_date(c).cast("date").cast("string"), "1/2/2020", "2020-1-2", "31/02/2020", "...", " 2-1-2020 ")
    assert got == ["2020-02-01", "2020-01-02", None, None, "2020-01-02"]


def test_point_id_is_uuid5(spark):
    names = ["hybrid_v1:a", "v:Điều"]
    assert one(spark, text.name_uuid, *names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_boundary_spaces(spark):
    assert one(spark, text.boundary_spaces, "Điều5a", "aB", "AB") == ["Điều 5 a", "a B", "AB"]


def test_tokens(spark):
    assert one(spark, text.lexical_tokens, "Theo 15/2020/NĐ-CP, việc A.", nfd("việc"), None) == [["theo", "15/2020/nđ-cp", "việc", "a"], ["việc"], None]


def test_cleaners(spark):
    assert one(spark, text.clean_optional, " x ", "NaN", " ", None) == ["x", None, None, None]
    assert one(spark, text.clean_blank, "nan", " ") == ["nan", None]
    assert one(spark, text.reference_key, " 0012\t", "000", "None", "a 1") == ["12", None, None, "a 1"]


def test_json_text_object(spark):
    assert one(spark, text.json_text_object, '```json\n{"a": 1}\n```', 'x {"b": 2} y', "[1]", None) == ['{"a": 1}', '{"b": 2}', None, None]


def test_uppercase_ratio(spark):
    assert one(spark, text.uppercase_ratio, "ĐIỀu", "12", None) == [0.75, 0.0, None] or one(spark, text.uppercase_ratio, "ĐIỀu", "12") == [0.75, 0.0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        (" \n ", ""),
        ("<p>Điều5a</p>", "Điều 5 a"),
        ("<p>x<p>y", "x\n\ny"),
        ("<p>a&amp;lt;b&nbsp;c</p><!-- note -->", "a<b c\n\nnote"),
        ("<div>out</div><div id='content'>in</div>", "in"),
        ("<table class='DetailContent'><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", "a\n\nb\n\nc\n\nd"),
        ("<table><tr><td>only</td></tr></table>", "only"),
        ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>x<br>y</td></tr></table>", "| a | b\\|c |\n| --- | --- |\n| 1 | x / y |"),
        ("<script>x()</script><b>bold</b> text", "bold text"),
        ("30%&lt;Fe", "30% < Fe"),
    ],
)
def test_markdown(html, want):
    assert to_markdown(html) == want


def test_a_header_alone_gets_a_blank_row():
    assert pipe_table([["a", "b"]]).split("\n") == ["| a | b |", "| --- | --- |", "|  |  |"]


def test_deep_nesting_does_not_fail():
    assert to_markdown("<div>" * 5000 + "x") == "x"
