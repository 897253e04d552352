"""Rendering of HTML: blocks, lists, tables, visibility and broken markup."""

import pytest
from hypothesis import given, settings, strategies as st

from clickloom.llm.layout_text import extract, render

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b <b>c</b></div>d", "a\nb c\nd"),
    ("a<br>b<br><br>c", "a\nb\nc"),
    ("<h1>x</h1>y", "x\n\ny"),
    ("x &amp; y&nbsp;&lt;z&gt; &#233; &copy", "x & y <z> é ©"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<br>b<li>c</ol>", "9. a\n   b\n10. c"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<pre>\n a\n  b </pre>c", " a\n  b\n\nc"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><caption>t</caption><tr><th>a<td>b<tr><td colspan=2>wide one<td>z</table>", "t\na  b\nwide one  z"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<td>loose", "loose"),
    ("<table><td>no row<td>x</table>", "no row  x"),
    ("<table><tr><td>o<table><tr><td>i<td>j</table><td>p</table>", "o     p\ni  j"),
    ("<head><title>t</title><style>s</style></head><body>b", "b"),
    ("<script>if (a<b) '</p>'</script>x<noscript>n</noscript>", "x"),
    ("a<span hidden>b</span><i style='display : none'>c</i><div style='visibility:hidden'>d</div>e", "ae"),
    ("a<!-- <p>b --> c<!-- open", "a c"),
    ('<a href="x>y" title=\'>\'>l</a>', "l"),
    ("a</p></div></b>b</br>c", "ab\nc"),
    ("<p>a <b>b<p>c</b> d", "a b\n\nc d"),
    ("a <b", "a"),
    ("a < b", "a < b"),
    ("<nav><a>n</a></nav><footer>f</footer>", "n\nf"),
    (None, ""), ("", ""), ("  \n ", ""), ("plain\n text", "plain text"),
    ("<select><option>a</select><textarea>b</textarea><button>c</button>", "c"),
    ("日本<table><tr><td>日本<td>a<tr><td>xyz<td>b</table>", "日本\n\n日本  a\nxyz   b"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_render(page, text):
    assert render(page)[0] == text


ATTRIBUTES = [
    ("<p data-x=don't>one</p><p>two</p><p data-y=it's>three</p>", "one\n\ntwo\n\nthree"),
    ('<div class="a"">Hello <b class="x">you</b> <i title="q"">z</i> end', "Hello you z end"),
    ('<i title=a"b>x</i><i "stray" \'>y</i><i title = "p>q" /alt=\'>\'>z</i>', "xyz"),
    ('<i title="open>a</i> b <i alt=\'>c</i>', "a b c"),
    ('<a title="The hidden cost of X">a</a>', "a"),
    ('<section aria-label="Hidden gems"><p>b</section>', "b"),
    ('<div class="hidden md:block">c</div>', "c"),
    ("<div data-state='hidden '>d</div>", "d"),
    ("<p onclick=\"this.style='display:none'\" data-css='visibility: hidden'>e", "e"),
    ("<p data-hidden=1 hidden-by=x>f", "f"),
    ("a<i title='x'hidden>b</i><i HIDDEN=until-found>c</i><i a=b/c hidden/>d</i>e", "ae"),
    ("a<i style='color:red; DISPLAY:none!important;display:block'>b</i><i style=display:none>c</i>d", "ad"),
    ("a<i style='--x-display:none'>b</i><i style='display:none;display:block'>c</i><i style='/*display:none*/'>d</i>", "abcd"),
    ("<i style='background:url(x;display:none)'>a</i><i style='content:\"; display:none\"'>b</i>", "ab"),
    ("<dialog title='now open '>a</dialog><dialog open>b</dialog>", "b"),
    ("<ol title='start=7'><li>a</ol>", "1. a"),
    ("<table><tr><td title='colspan=2'>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  b  c\n   d  e\nf  g  h"),
    ("<table><tr><td>1<td>2<td>3<td>4<tr><td>a<td rowspan=2 colspan=2>b<td>cc<tr><td>d<td>e</table>", "1  2  3  4\na  b     cc\nd        e"),
    ("<table><tr><td rowspan=2>a<tr><td rowspan=2>bb<tr><td>c<td>d</table>", "a\n   bb\nc      d"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><thead><tr><td rowspan=9>a<td>b</thead><tr><td>c<td>d</table>", "a  b\nc  d"),
]


@pytest.mark.parametrize("page,text", ATTRIBUTES)
def test_attributes_count_by_name(page, text):
    assert render(page)[0] == text


def test_long_attributes_and_spans():
    assert render("<p style='" + "(" * 300_000 + "'>a")[0] == "a"
    assert render("<p " + "a=' " * 300_000 + "'>a")[0] == "a"
    assert render("<table>" + "<tr><td rowspan=65534 colspan=1000>a" * 1000 + "</table>")[1] == 1000


def test_depth_and_length():
    assert render("<div>" * 50_000 + "x")[0] == "x"
    assert render("<table><tr><td>" * 2000 + "x")[0] == "x"
    assert render("<ul><li>" * 300 + "x")[0].endswith("- x")
    assert len(render("<p>word</p>" * 50_000)[0].split()) == 50_000


TAGS = st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<b>", "</b>", "<pre>", "</pre>", "<div hidden>", "</div>", "<", ">", '"', "<!--", "-->", "<script>", "</script>", "<h1>", "<dd>", "\n", " "])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(TAGS, st.sampled_from(["w1", "w2", "w3"])), max_size=30))
def test_never_fails_and_invents_nothing(parts):
    text, lines, tables = render("".join(parts))
    assert text.count("w1") <= parts.count("w1")
    assert lines == sum(1 for x in text.split("\n") if x.strip())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</table>", "<h2>", "<br>", " w1 ", " w2 "]), max_size=30))
def test_all_visible_words_stay(parts):
    text = render("".join(parts))[0]
    assert [text.count(w) for w in ("w1", "w2")] == ["".join(parts).count(w) for w in ("w1", "w2")]


def test_query(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b"), (2, None, None), (None, "u", ""), (1, "u", "<p>a<p>b")], "page_id bigint, text string, html string")
    got = sorted(map(str, (tuple(r) for r in extract(pages).collect())))
    assert got == sorted(map(str, [(1, "a\n\nb", 2, 0), (2, "", 0, 0), (None, "", 0, 0), (1, "a\n\nb", 2, 0)]))
    assert extract(pages.limit(0)).count() == 0
