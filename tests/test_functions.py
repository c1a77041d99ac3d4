"""Text functions, classifiers and nested functions on their reference cases."""

import pytest
from pyspark.sql import functions as F

from inkweave.functions import classify as C
from inkweave.functions import nested as N
from inkweave.functions import python as P
from inkweave.functions import text as T


def one(spark, column, **values):
    fields = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], fields).select(column).first()[0]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("eﬃ-\ncient  text\n\nnext", "efficient text next"),
        ("a\n, b\n) c", "a, b) c"),
        ("\x02 item", "• item"),
        ("A\x02B", "A → B"),
        ("", ""),
        ("soft­hyphen", "softhyphen"),
    ],
)
def test_normalize_prose(spark, given, expected):
    assert one(spark, T.normalize_prose(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("图 3 - 12   对话框", "图 3-12 对话框"), ("表 1：名称", "表 1 名称"), ("正文", "正文"), (None, None)],
)
def test_captions(spark, given, expected):
    assert one(spark, T.normalize_zh_caption(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    "left, right, expected",
    [("shazzam-", "tool.com", ""), ("ordinary", "words", " "), ("中文", "续", ""), ("中文", "`code`", " "), ("", "x", "")],
)
def test_continuation_separator(spark, left, right, expected):
    assert one(spark, T.continuation_separator(F.col("a"), F.col("b")), a=left, b=right) == expected


def test_protected_tokens(spark):
    text = "See https://a.example/x. Use Grid.Flush and OpenAsync with XML, 5 ms [3, 4] and XML again."
    got = one(spark, T.protected_tokens(F.col("t")), t=text)
    assert got == ["https://a.example/x", "a.example", "Grid.Flush", "OpenAsync", "XML", "5 ms", "[3, 4]"]


def test_number_tokens_split_as_documented(spark):
    assert one(spark, T.matches(F.col("t"), T.NUMBER), t="v4.5 and 1,000,000 and 4.5.6") == ["5", "1,000", "000", "4.5", "6"]


def test_scaled_numbers_compare_equal(spark):
    a, b = P.comparison_text("2 million particles"), P.comparison_text("200 万个粒子")
    assert a.split()[0] == b.split("个")[0].strip() == "2000000"
    assert "10^-5 s" in P.comparison_text(r"10^{-5}\,\mathrm{s}")


@pytest.mark.parametrize(
    "text, flat",
    [
        (r"\frac{a_{1}}{\mathrm{b}}", "(a1)/(b)"), (r"\lambda x_2 \times 3", "λ x2 × 3"), (r"$\alpha_{i}^{2}$", "alphai^2"), ("a 3-D and 二维 box", "a dimension-3 and dimension-2 box"),
        ("x² y₁", "x^2 y1"), ("1.5 million", "1500000"), ("0.00001 万", "0.1"), (r"\frac{a", "fraca"), ("{" * 3000 + "a", "a"), ("", ""), (None, None), ("a − b", "a - b"),
    ],
)
def test_comparison_text(text, flat):
    assert P.comparison_text(text) == flat


def test_fences_and_escapes(spark):
    assert one(spark, T.fenced_code(F.col("t"), F.col("l")), t="a ```` b", l="sql").startswith("`````sql\n")
    assert one(spark, T.escape_prose(F.col("t")), t="a<b>&c") == "a&lt;b&gt;&amp;c"


def test_lists_and_notes(spark):
    assert one(spark, T.list_ordinal(F.col("t")), t=" 12) x") == 12
    assert one(spark, T.list_body(F.col("t")), t="- x") == "x"
    assert one(spark, T.note_body(F.col("t")), t="Note: take care") == "take care"
    assert one(spark, T.note_variant(F.col("t"), F.lit(None).cast("string")), t="What’s new here") == "whats-new"


def test_names(spark):
    assert one(spark, T.slugify(F.col("t")), t="Größe & Maß") == "gr-e-ma"
    assert one(spark, T.slugify(F.col("t")), t="漢") == "document"
    assert one(spark, T.safe_name(F.col("t")), t="../a b") == "a-b"
    assert one(spark, T.batch_series(F.col("t")), t="p1-p9-b003") == "p1-p9"
    assert one(spark, T.batch_series(F.col("t")), t="p1") is None


@pytest.mark.parametrize(
    "code, language",
    [("<Grid xmlns:x='a'>", "xaml"), ("<a>1</a>", "xml"), ("public void A() { }", "csharp"), ("def f():\n    pass", "python"), ("select 1", "sql"), ("$x = 1", "powershell"), ('{"a": 1}', "json"), ("plain", "text")],
)
def test_code_language(spark, code, language):
    assert one(spark, C.code_language(F.col("t")), t=code) == language


def test_classifiers(spark):
    assert one(spark, C.is_caption(F.col("t")), t="Figure 2-1 A box") is True
    assert one(spark, C.is_caption(F.col("t")), t="Figure 2 shows a box") is False
    assert one(spark, C.looks_like_continuation(F.col("a"), F.col("b")), a="It goes", b="and on") is True
    assert one(spark, C.looks_like_continuation(F.col("a"), F.col("b")), a="It ends.", b="and on") is False
    assert one(spark, C.target_structure_error(F.col("k"), F.col("t")), k="heading", t="## x") == "heading-marker"


@pytest.mark.parametrize(
    "text, code",
    [
        ("var g = new Grid();\ng.Measure(1);", True), ("The grid is new; it works.", False), ("public sealed class Node", True), ("xmlns:x='a'", True),
        ("g.Show(1) }", True), ("class Node, 12, method Add, 14-15", False), ("<p and text", False), ("<a href='x'>", True), ("", False), (None, False),
        ("Use new Grid(1); because it is the best way.", False),
    ],
)
def test_program_code(spark, text, code):
    assert one(spark, C.is_program_code(F.col("t")), t=text) is code


def test_tables(spark):
    d = spark.sql("select array(array('a', null), array('', ''), array('b', 'c', 'd')) r").select(N.rectangular(F.col("r")))
    assert d.first()[0] == [["a", "", ""], ["b", "c", "d"]]
    t = spark.sql("select named_struct('row_cells', array(array('h|', 'i'), array('1', '<2')), 'header_rows', 1, 'column_count', 2) t")
    assert t.select(N.table_markdown(F.col("t"))).first()[0] == "| h\\| | i |\n| --- | --- |\n| 1 | &lt;2 |"
    halves = spark.sql("select array(array('x', '')) a, array(array('', 'y'), array('p', 'q')) b").select(N.merge_half_rows(F.col("a"), F.col("b")))
    assert halves.first()[0] == [["x", "y"], ["p", "q"]]


def test_boxes_and_shares(spark):
    d = spark.sql("select named_struct('x0',0D,'y0',0D,'x1',10D,'y1',10D) a, named_struct('x0',5D,'y0',0D,'x1',15D,'y1',10D) b")
    assert d.select(N.overlap(F.col("a"), F.col("b"))).first()[0] == 0.5
    shares = spark.range(3).select(N.equal_share(F.lit(10), F.lit(3), F.col("id"))).collect()
    assert [r[0] for r in shares] == [4, 3, 3]


def test_indel_ratio():
    assert P.indel_ratio("", "") == 100.0
    assert P.indel_ratio("abcd", "abed") == pytest.approx(75.0)


@pytest.mark.parametrize(
    "text, html",
    [("a *b", "a *b"), ("``a`b``", "<code>a`b</code>"), (r"\*a* b", r"\*a* b"), ("**a**", "**a**"), ("$$", "$$"), ("a\n&", "a &amp;"), (None, None), ("` a `", "<code>a</code>")],
)
def test_inline_marks(text, html):
    assert P.inline_html(text) == html


def test_inline_html():
    assert P.inline_html("*set `a<b`* & $x^2$") == '<em>set <code>a&lt;b</code></em> &amp; <span class="math inline"><code class="math-fallback">x^2</code></span>'
    assert P.math_to_latex("x² ≤ y₁₀") == r"x^{2} \le y_{10}"
