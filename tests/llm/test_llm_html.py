import pytest
from orrery.llm import html_text
from orrery.llm.catalogue import QUERIES
from conftest import SMALL

CASES = [
    ("", ""), ("plain  text\n here", "plain text here"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>", "a\nb"), ("<b>a</b><i>b</i> c", "ab c"), ("a <b> b</b>", "a b"),
    ("<head><title>t</title></head><script>x<y</script><style>p{}</style>seen<!-- no -->", "seen"),
    ("<p hidden>a</p><p style='display: none'>b</p><span style=\"VISIBILITY:hidden\">c</span>d", "d"),
    ("<style>.ad, #x {display:none} b{visibility:hidden}</style><p class='m ad'>a<p id=x>b<b>c</b><p>d", "d"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n\n  b"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"),
    ("<table><thead><tr><td colspan=2>x<td>y</thead><tbody><tr><td>1<td>2<td>3</table>z", "x     y\n1  2  3\n\nz"),
    ("<table><caption>cap</caption><tr><td>a<table><tr><td>in</table><td>b</table>", "cap\na in  b"),
    ("<pre>  a\n   b</pre>", "  a\n   b"), ("&lt;b&gt; &amp;amp; &eacute;&nbsp;x", "<b> &amp; é\xa0x"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<select><option>a<option>b</select>", "a\nb"), ("</p></div>a</b>", "a"), ("a < b and <3", "a < b and <3"),
    ("<a title='>'>x</a>", "x"), ("<textarea><b>raw</b></textarea>", "<b>raw</b>"), ("<SCRIPT>x</Script>y", "y"), ("<script>never ends", ""),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\nv\nl\nw"), ("<p>a<div>b</div>c", "a\n\nb\nc"), ("<input type=submit value=Go> <img alt=x>", "Go"),
]
MEDIA_CASES = [
    ("@media print{.n{display:none}}", "a b"), ("@media (max-width:600px){.n{display:none}}", "a b"), ("@media screen{.n{display:none}}", "b"),
    ("@media only screen and (min-width: 48em){.n{display:none}}", "b"), ("@media print, (width >= 1000px){.n{display:none}}", "b"),
    ("@media not print{.n{display:none}}", "b"), ("@media not all and (min-width:600px){.n{display:none}}", "a b"),
    ("@media (400px<=width<=900px){.n{display:none}}", "a b"), ("@media (orientation:portrait) or (hover:none){.n{display:none}}", "a b"),
    ("@media (unheard-of:1){.n{display:none}}", "a b"), ("@media screen{@media print{.n{display:none}}}", "a b"),
    ("@media print{.x{color:red}.n{display:none}}.n{color:red}", "a b"), ("@media print{.x{color:red}}.n{display:none}", "b"),
    ("@supports (display:grid){@media all{.n{display:none}}}", "b"), ("@keyframes k{from{top:0}}.n{display:none}", "b"),
    (".n{display:none}.n{display:block}", "a\nb"), (".n{display:block}.n{display:none}", "b"), ("#i{display:block}.n{display:none}", "a b"),
    (".n{display:none!important}#i{display:block}", "b"), (".n{display:none}@media print{.n{display:block}}", "b"),
    (".n{display:none}@media (min-width:600px){.n{display:block}}", "a b"), (".n.m{display:block}.n{display:none}", "a b"),
    (".n{visibility:hidden}.n{visibility:visible}", "a b"), (".n{display:none;display:nonsense}", "b"), ("/* .n{display:none} */", "a b"),
    (".x::after{content:'}.n{display:none}'}", "a b"), ("@import 'x.css';.n{display:none", "b"), (".x{.n{display:none}}", "a b"),
    (".n{@media print{display:none}}", "a b"), ("@layer u{.n{display:none}}p{margin:0}b{display:block}", "a b"), (":not(.q, .n, .r){display:none}", "a b"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert html_text.render(page)[0] == text


@pytest.mark.parametrize("sheet, text", MEDIA_CASES)
def test_style_sheets(sheet, text):
    page = f"<style>{sheet}</style><b class='n m' id=i>a</b> <i>b</i>"
    assert html_text.render(page)[0].replace("\n", " ") == text.replace("\n", " ")


def test_where_styles_stand():
    body = "<p class=n>a</p><p hidden class=s>b</p><p class=n style='display:block'>c"
    assert html_text.render("<style>.n{display:none}.s{display:block}</style>" + body)[0] == "b\n\nc"
    assert html_text.render("<style media=print>.n{display:none}</style>" + body)[0] == "a\n\nc"
    assert html_text.render("<noscript><style>.n{display:none}</style></noscript>" + body)[0] == "a\n\nc"
    assert html_text.render("<style>" + "@media screen{" * 20_000 + ".n{display:none}</style>" + body)[0] == "c"


def test_depth_and_length():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert html_text.render(deep)[0] == "x"
    assert html_text.render("<b>y</b> " * 50_000)[0].count("y") == 50_000
    assert html_text.render("<a href=\"x>" + "<p>z" * 2000)[0].count("z") <= 2000


def test_against_a_plain_parser(spark):
    """All visible words in order, as the standard library's parser meets them."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.found = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head", "title", "noscript", "template")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head", "title", "noscript", "template")

        def handle_data(self, data):
            if not self.skip:
                self.found.append(data)

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()
    found = {r.page_id: r for r in QUERIES["op10_html_text"](spark, SMALL).collect()}
    assert len(found) == len(pages)
    for p in pages:
        plain = Plain()
        plain.feed(p.html or "")
        plain.close()
        want = "".join("".join(plain.found).split())
        text = "".join("".join(w for w in line.split() if w != "-") for line in found[p.page_id].text.split("\n"))
        assert text == want.replace("-", "") or text.replace("-", "") == want.replace("-", "")
        assert found[p.page_id].n_chars == len(found[p.page_id].text)


def test_awkward_rows(spark):
    rows = [(1, None, "t"), (None, "<p>a", "t"), (1, "<p>b", "t"), (1, "<p>b", "t"), (2, "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = html_text.extract(pages)
    assert sorted((str(r.page_id), r.text) for r in out.collect()) == [("1", ""), ("1", "b"), ("1", "b"), ("2", ""), ("None", "a")]
    assert html_text.extract(pages.limit(0)).count() == 0
