import os
import random
import re
import time
from html import unescape

import pytest

from tallyspark.llm.htmltext import attributes, extract, page_text

CASES = [
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>after", "* a\n* b\n  3. x\n  4. y\n* c\n\nafter"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>wide<tr><td rowspan=2>r<td>2<tr><td>3</table>tail", "Name       N\nlong name  1\nwide\nr          2\n           3\n\ntail"),
    ("a<p>b<p>c<div>d<b>e</div> f<br>g", "a\n\nb\n\nc\n\nde\nf\ng"),
    ("<p hidden>no</p><p style='display:none'>no</p><div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<style>.n{display:none}</style><p class='q n'>no</p><p>yes", "yes"),
    ("<pre>x\n  y\n\n z</pre>", "x\n  y\n\n z"),
    ("x &lt; y &amp z < w <i", "x < y & z < w"),
    ("<blockquote>q</blockquote>z", "    q\n\nz"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes", "S\nT\nyes"),
    ("<table>foster<tr><td>c</table>", "foster\n\nc"),
    ("</p>hi<dl><dt>T<dd>D<dt>U</dl>", "hi\n\nT\n    D\nU"),
    ("<script>if (a < b) x = '</p>'</script>seen<!-- <p>no -->", "seen"),
    ("<title>no</title><h1>A</h1>text", "A\n\ntext"),
    ("<textarea>&lt;kept></textarea> <input value=v> <input type=hidden value=no>", "<kept> v"),
    ("<div>" * 5000 + "deep", "deep"), ("plain   text", "plain text"), ("", ""), (None, ""), ("<", "<"), ("<!-- open", ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_pages(html, text):
    assert page_text(html) == text


SHEETS = [
    ("<style>@media print { .side, nav { display: none } }</style><nav>n</nav><p class=side>s", "n\n\ns"),
    ("<style>.a , .b{display:none}</style><p class=a>no<p class=b>no<p>yes", "yes"),
    ("<style media=print>p{display:none}</style><p>yes", "yes"),
    ("<style>@media (max-width:600px){p{display:none}} @media screen and (min-width:40em){div{display:none}}</style><p>yes<div>no</div>", "yes"),
    ("<style>.tab{display:none}.tab.active{display:block}</style><p class=tab>no<p class='tab active'>yes", "yes"),
    ("<style>p{display:none}main > p{display:block}</style><main><p>yes</p><div><p>no</p></div></main>", "yes"),
    ("<style>.n{display:none}div .n.b:nth-child(1){display:flex}</style><p class='n b'>no</p><div><p class='n b'>yes</div>", "yes"),
    ("<style>.n{display:block}.n{display:none}.m{display:none}.m{display:block}</style><p class=n>no<p class=m>yes", "yes"),
    ("<style>.n{display:none!important}#i{display:block}</style><p class=n id=i style='display:block'>no</p>yes", "yes"),
    ("<style>ul ul{display:none}li:hover ul{display:block}</style><ul><li>yes<ul><li>no</ul></ul>", "* yes"),
    ("<style>@keyframes k{from{display:none}p{display:none}} @import 'x{';b{visibility:hidden}b i{visibility:visible}</style><p>a<b>no<i>yes</i></b>", "ayes"),
    ("<style>@supports (x:y){p{display:none}}@layer a{.x.x.x{display:none}} .x{display:block} .md\\:n{display:none}</style><p class=x>yes<p class=md:n>no", "yes"),
]


@pytest.mark.parametrize("html,text", SHEETS)
def test_sheets(html, text):
    assert page_text(html) == text


def slow_attributes(text):
    """Attribute by attribute, character by character."""
    out, at = {}, 0
    while True:
        while at < len(text) and text[at] in " \n/":
            at += 1
        if at == len(text):
            return out, -1
        if text[at] == ">":
            return out, at + 1
        name = text[at] if text[at] == "=" else ""
        at += len(name)
        while at < len(text) and text[at] not in " \n/>=":
            name, at = name + text[at], at + 1
        on = at
        while on < len(text) and text[on] in " \n":
            on += 1
        value = ""
        if on < len(text) and text[on] == "=":
            at = on + 1
            while at < len(text) and text[at] in " \n":
                at += 1
            if at < len(text) and text[at] in "\"'" and text[at] in text[at + 1 :]:
                end = text.index(text[at], at + 1)
                value, at = text[at + 1 : end], end + 1
            else:
                while at < len(text) and text[at] not in " \n>":
                    value, at = value + text[at], at + 1
        out.setdefault(name.lower(), unescape(value))


def test_attributes_against_a_slow_reading():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "B", "=", '"', "'", " ", "\n", "/", "&lt;", ">"]) for _ in range(rng.randrange(14)))
        assert attributes(text, 0, set()) == slow_attributes(text), text


HARD = ["<a " + 'x="y" ' * 10_000, "<div>" * 100_000 + "deep", "<ul><li>" * 30_000 + "x", "<b>x<p>" * 30_000, "<table><tr><td>" * 10_000 + "x", "<p x='" * 50_000, "<i>" * 50_000 + "</b>" * 50_000, "<table>a" * 20_000, "<a " + "=\"'" * 50_000 + ">"]


@pytest.mark.parametrize("k", range(len(HARD)))
def test_hard_pages_take_time_by_their_length(k):
    start = time.time()
    page_text(HARD[k])
    assert time.time() - start < 10


#: Small pages that once took seconds or wrote thousands of times their length.
SHORT = [
    "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 200, "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 400, "<table><tr><td>" + "word " * 10_000 + "<td>a" + "<tr><td>b<td>c" * 800,
    '<p style="display:a' + " " * 40_000 + 'b">x', "<style>a" + " " * 20_000 + "b{display:none}</style>x", "<style>[a=b" + " " * 20_000 + "{display:none}</style>x", "<style>a" + " ," * 20_000 + "{display:none}</style>x",
    "<style media='screen" + " " * 20_000 + "x'>a{}</style>x", "<style>@media screen" + " " * 20_000 + "x{a{}}</style>x" + "<style media='" + "/*" * 10_000 + "'></style>", "<table><tr>" + "<td rowspan=65534>y" * 300 + "<tr><td>x" * 2000,
    "<blockquote>" * 100 + "x<br>" * 5000, "<table><tr>" + "<td>" * 300 + "z" + "<tr><td colspan=299><td>q" * 500, ("<table><tr><td>" + "w" * 50 + "<td>") * 30 + "v",
]


@pytest.mark.parametrize("k", range(len(SHORT)))
def test_short_pages_are_quick_and_write_little(k):
    start = time.time()
    text = page_text(SHORT[k])
    assert time.time() - start < 0.5 and len(text) < 10 * len(SHORT[k])


def slow_table(rows):
    """Lines of a plain table (one line to a cell, no spans) by the rule of the docstring, column by column."""
    columns = [[r[c] for r in rows if c < len(r)] for c in range(max(map(len, rows)))]
    widths = [max((len(x) for x in col if len(x) <= 4 * (sum(map(len, col)) / len(col) + 4)), default=0) + 2 for col in columns]
    padded = sum(sum(widths[: len(r) - 1]) for r in rows)
    aligned = padded <= 4 * sum(len(x.replace(" ", "")) + 2 for r in rows for x in r)
    out = []
    for r in rows:
        line = ""
        for c, x in enumerate(r):
            if aligned:
                line = line.ljust(sum(widths[:c]))
                line += "  " if line and line[-1] != " " and x else ""
            else:
                line += "  " if c else ""
            line += x
        out.append(line.rstrip())
    return out


def test_tables_against_a_slow_renderer():
    rng = random.Random(3)
    for _ in range(300):
        rows = [["x" * rng.choice([1, 2, 3, 5, 8, 40, 300]) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 12))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows)
        assert page_text(html).split("\n") == slow_table(rows)


def test_a_cut_off_tag_is_dropped():
    assert page_text("seen<a " + 'x="y" ' * 40) == "seen"
    assert page_text("seen<a href='x>lost</a>") == "seenlost"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_every_visible_word_is_there_in_order(spark):
    for r in extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect():
        body = re.sub(r"(?is)<head.*?</head>|<!--.*?-->|</?(?:b|a)\b[^>]*>", "", r.html)
        body = unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", body)).split()
        assert [w for w in r.text.split() if w != "*"] == [w for w in body if w != "*"]


def test_clashing_and_empty(spark):
    df = spark.createDataFrame([(1, "<p>a", "clash"), (1, "<p>a", "clash"), (None, None, None)], "page_id long, html string, text string")
    assert sorted(r.text for r in extract(df).collect()) == ["", "a", "a"]
    assert extract(df.filter("page_id = 9")).count() == 0
