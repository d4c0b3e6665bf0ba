from random import Random
from time import monotonic

import pytest
from pyspark.sql import functions as F

from docpipe.functions import html as FH
from docpipe.operators import html as H
from docpipe.queries import fixtures as D

MARKDOWN = [
    ("<h1>Hello</h1><p>World</p>", "# Hello\n\nWorld"),
    ("", ""),
    ("<html><head><title>t</title></head><body></body></html>", ""),
    ('<p>See <a href="https://example.com">Example</a></p>', "See [Example](https://example.com)"),
    ("<p>a <b>bold </b>and <i>it</i> <a href='x?a=1&amp;b=2' title=T>li*nk</a></p>", 'a **bold** and _it_ [li\\*nk](x?a=1&b=2 "T")'),
    ("<ul><li>one<ul><li>two</li><li>three<br>x</li></ul></li><li><p>four</p><p>five</p></li></ul>",
     "*   one\n    *   two\n    *   three  \n        x\n*   four\n\n    five"),
    ("<ol start=3><li>a<li>b</ol>tail<ol><li>c</ol>", "3.  a\n4.  b\n\ntail\n\n1.  c"),
    ("<blockquote>q1<p>q2<br>l2</p><blockquote>deep</blockquote></blockquote>x", "> q1\n> \n> q2  \n> l2\n> \n> > deep\n\nx"),
    ("a<hr>after", "a\n\n* * *\n\nafter"),
    ("<pre><code class='language-py'>\nx = *1*\n  y</code></pre>", "```py\nx = *1*\n  y\n```"),
    ("<p><b>open<br><p>next *x* - y", "**open**\n\nnext \\*x\\* - y"),
    ("<p>- item</p><p>1. num</p><p># h</p><p>+ p</p><p>=x</p><p>~~~</p><p>&gt; q</p>",
     "\\- item\n\n1\\. num\n\n\\# h\n\n\\+ p\n\n\\=x\n\n\\~~~\n\n\\> q"),
    ("a < b &lt;c&gt; &amp;lt; &copy &#8212;&#x41;&#150; &bogus; &#0; &#x110000;", "a < b <c> &lt; © —A– &bogus; � �"),
    ("<img src=i.png alt='a &amp; b' title=t><img alt=none>", '![a & b](i.png "t")'),
    ("<abbr>x</abbr> <a name=q>n</a> <a href=''>e</a><a href='/e'></a>", "x n e"),
    ("<a href=/t><h2>Title</h2><p>para</p></a> z", "## [Title](/t)\n\n[para](/t)\n\nz"),
    ('<p title="a>b">x</p><!-- c --><p>y<scr', "x\n\ny"),
    ("<p>in <code>co_de*</code> <b><i>bi</i></b> <b></b> </b></p>", "in `co_de*` **_bi_**"),
    ("<p>x</p><script>var t='</p>';</script><style>p{}</style><p>y</p>", "x\n\ny"),
    ("<p>a\n\t b</p>  <div>c</div>", "a b\n\nc"),
    ("<p title=it's>x</p><p>y's</p>", "x\n\ny's"),
    ("<header>top</header>", "top"),
    ("<p><b><b><b><b><b>x</b></b></b></b></b></b></b> y</p>", "**********x********** y"),
    ("<p><i><b>a</i></b></i></b> c</b><p>d</i>e", "_**a_** c\n\nde"),
    ("<p>a<b><i><code><b><i></i></b></code></i></b>b <code><b></b></code></p>", "ab"),
    ("<p><b>open<p>in</b> <b>next", "**open**\n\nin **next**"),
    ("a<hr><b>x</b> y</b>", "a\n\n* * *\n\n**x** y"),
    ("<pre>x</b><b>y</pre><p></b>z", "```\nxy\n```\n\nz"),
    ("<p>one\x0btwo \x01\x02&#5;<b>\x10A</b></p><pre>\x0f</pre>", "one\x0btwo \x01\x02\x05**\x10A**\n\n```\n\x0f\n```"),
    ("<a href='/\x07&#6;'>l</a><img src=i alt='\x0e'>", "[l](/\x07\x06)![\x0e](i)"),
]


def test_markdown(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKDOWN)], "page_id long, html string")
    got = {r.page_id: r.markdown for r in H.html_to_markdown(df).collect()}
    assert got == {i: md for i, (_, md) in enumerate(MARKDOWN)}


@pytest.mark.parametrize("html", [h for h, _ in MARKDOWN] + ["<<p>>", "<p a='", "x <3 y", "<a href=\"x"])
def test_tokens_lose_nothing(spark, html):
    df = spark.createDataFrame([(0, html)], "page_id long, html string")
    body = H.html_body(df).first().body
    tokens = [r.token for r in H.html_tokens(df).orderBy("pos").collect()]
    assert "".join(tokens) == body


def test_entities(apply):
    values = ["&eacute;&Eacute;&yuml;", "&nbsp", "&euro;&hellip;", "a&b", "&amp;amp;", "&#x1F600;", "&#xD800;", "&#99999999999999999999999;"]
    got = apply(values, F.expr(FH.decode_entities("v")))
    assert got == ["éÉÿ", " ", "€…", "a&b", "&amp;", "😀", "�", "�"]


SECTIONS = [
    (
        "pre text<h2>One &amp; x</h2><p>p1</p>t &lt;<b>bo<i>l</i>d</b> u<div><h2>no</h2>in</div><h3></h3><p>z</p><h1>empty</h1><h2>last</h2>q",
        [
            ("content", "content", "pre text"),
            ("one_x", "One & x", "p1\nt <\nbo<i>l</i>d\n u\n<h2>no</h2>in"),
            ("section", "section", "z"),
            ("last", "last", "q"),
        ],
    ),
    ("<h1>only</h1>", [("content", "content", "<h1>only</h1>")]),
    ("<h1>a</h1> &nbsp; <h2>b</h2>", [("content", "content", "<h1>a</h1> &nbsp; <h2>b</h2>")]),
    ("<p>No headings</p>", [("content", "content", "No headings")]),
    ("<div></div>", [("content", "content", "<div></div>")]),
    ("", [("content", "content", "")]),
    ("<h1>A</h1><p>1</p><h2>B</h2><p>2</p><h3>C</h3><p>3</p>", [("a", "A", "1"), ("b", "B", "2"), ("c", "C", "3")]),
    ("<h1>A\x01</h1>\x02p&#3;<p>\x04q</p><h2>\x10</h2>\x03", [("a", "A\x01", "\x02p\x03\n\x04q"), ("section", "\x10", "\x03")]),
    ("<h1>\x02\x10B</h1>", [("content", "content", "<h1>\x02\x10B</h1>")]),
    ("<article><h1>T</h1>x</article></div><h2>U</h2>y", [("content", "content", "<h1>T</h1>x"), ("u", "U", "y")]),
]


def test_sections(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(SECTIONS)], "page_id long, html string")
    got = {}
    for r in H.html_sections(df).orderBy("page_id", "chunk_index").collect():
        got.setdefault(r.page_id, []).append((r.key, r.title, r.content))
    assert got == {i: s for i, (_, s) in enumerate(SECTIONS)}


def test_section_markdown(spark):
    df = spark.createDataFrame([(0, "<h2>S</h2><p>a</p><p>b <b>c</b></p><div><h3>x</h3></div>")], "page_id long, html string")
    (row,) = H.html_section_markdown(df).collect()
    # Paragraphs on top level run together: their tags are not part of the content.
    assert (row.key, row.content) == ("s", "a b **c**\n\n### x")


def test_links(spark):
    df = spark.createDataFrame([(0, "<a href='/x'>a <b>b</b></a> c <a name=n>d</a><a href=\"/y?a&amp;b\">e")], "page_id long, html string")
    got = [(r.link_no, r.href, r.text) for r in H.html_links(df).orderBy("link_no").collect()]
    assert got == [(1, "/x", "a b"), (2, "/y?a&b", "e")]


def test_unclosed_tags_take_linear_time(table):
    html = "<a " * 200_000
    assert [r.markdown for r in H.html_to_markdown(table([html], "html"), ["doc_id"]).collect()] == [""]


def nested(marks):
    """Markdown of one block of marks and words, by a stack per kind."""
    out, open_marks = [], {"b": 0, "i": 0}
    for mark in marks:
        if mark in ("<b>", "<i>"):
            open_marks[mark[1]] += 1
        elif mark in ("</b>", "</i>"):
            if not open_marks[mark[2]]:
                continue
            open_marks[mark[2]] -= 1
        out.append(mark)
    text = "".join(out)
    while (shorter := text.replace("<b></b>", "").replace("<i></i>", "")) != text:
        text = shorter
    while text.endswith(("<b>", "<i>")):
        text = text[:-3]
    still = {kind: text.count(f"<{kind}>") - text.count(f"</{kind}>") for kind in "bi"}
    text += "_" * still["i"] + "**" * still["b"]
    return text.replace("<b>", "**").replace("</b>", "**").replace("<i>", "_").replace("</i>", "_")


def test_marks_against_a_stack(table):
    random = Random(5)
    blocks = [["w", *random.choices(["<b>", "</b>", "<i>", "</i>", "w"], k=random.randint(0, 40))] for _ in range(300)]
    html = "".join(f"<p>{''.join(block)}</p>" for block in blocks)
    (one,) = H.html_to_markdown(table([html], "html"), ["doc_id"]).collect()
    assert one.markdown.split("\n\n") == [nested(block) for block in blocks]
    each = H.html_to_markdown(table([f"<p>{''.join(block)}</p>" for block in blocks], "html"), ["doc_id"])
    assert {r.doc_id: r.markdown for r in each.collect()} == {i: nested(block) for i, block in enumerate(blocks)}


def test_deep_marks_take_linear_time(table):
    html = "<p>" + "<b>" * 50_000 + "x" + "</b>" * 60_000
    (row,) = H.html_to_markdown(table([html], "html"), ["doc_id"]).collect()
    assert row.markdown == "**" * 50_000 + "x" + "**" * 50_000


def test_all_names_and_long_numbers(table):
    html = "<p>&alpha; &Omega; &sum; &check; &bsol; &nosuch;</p><ol start='12345678901'><li>x</li></ol>"
    text = H.html_to_markdown(table([html], "html"), ["doc_id"]).first().markdown
    assert text.startswith("α Ω ∑ ✓") and "12345678901." in text and "&nosuch;" in text


def test_words_between_marks_are_not_gone_through_level_by_level(table):
    def markdown(words, levels):
        html = f"<p>{words}" + "<b>" * levels + "</b>" * levels + f"{words}<i>x</i>"
        return H.html_to_markdown(table([html], "html"), ["doc_id"]).first().markdown

    assert markdown("word ", 2) == "word word _x_"
    words = "word " * 40_000
    start = monotonic()
    text = markdown(words, 6_000)
    assert monotonic() - start < 60
    assert text == words + words + "_x_"


def test_hidden_marks_come_back(apply):
    values = ["", "plain", FH.MARKS + FH.HIDDEN, "\x10A\x01\x10\x10Bé\x02😀\x10P", "\x10", "\x10\x10", "a\x10Zb\x0b\x0bc", None]
    hidden = apply(values, F.expr(FH.hide_marks("v")))
    assert hidden[1] == "plain" and not any(set(FH.MARKS) & set(text) for text in hidden[:-1])
    assert apply(hidden, FH.shown_marks(F.col("v"))) == values
    # An escape that none of them wrote stays.
    assert apply(["\x10", "\x10\x10B", "a\x10Zb"], FH.shown_marks(F.col("v"))) == ["\x10", "\x10\x02", "a\x10Zb"]


def test_nested_marks_input_keeps_letters_and_digits(spark, tmp_path):
    texts = ["Aé9 — zZ0\n\t[x]_y", "", None, "…", "ªß²Ω٣a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.html for r in D.html_nested_marks(spark, str(tmp_path)).collect()}
    for i, words in enumerate(["A 9 zZ0 x y", "", "", "", "a"]):
        assert f"a\x02 {words} \x10B</b>" in got[i]
