from __future__ import annotations

from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from vitaline.llm import html_text
from vitaline.llm.html_text import visible_text
from vitaline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

CASES = {
    "": "",
    "a<p>b<p>c": "a\n\nb\n\nc",
    "<ul><li>a<li>b<ol start=3><li>x<br>y<li>z</ol><li>c</ul>d": "- a\n- b\n  3. x\n     y\n  4. z\n- c\n\nd",
    "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>": "Name       Qty\napple pie  3",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td>a<td colspan=2>wide one<td>z<tr><td>bb<td>1<td>2<td>y</table>": "a   wide one  z\nbb  1  2  y",
    "<table>lost<tr><td>x</table>": "lost\n\nx",
    "a  b\n c<b> d</b>e": "a b c de",
    "<pre>\n a\n  b</pre>": " a\n  b",
    "<style>.x, p.y{color:red} .z{display:none}</style><p class='q z'>no</p>yes": "yes",
    "<p style='Display : none'>no</p><p hidden>no<p>yes<script>'</p>'</script>": "yes",
    "<title>t</title><details><summary>s</summary>no</details><details open>yes</details>": "s\nyes",
    "x &lt;y&gt; &amp;amp; &eacute;<!-- no --> z<!DOCTYPE q>": "x <y> &amp; é z",
    "a<textarea>b <i></textarea>c": "ab <i>c",
    "a<b": "a",
    "<dl><dt>t<dd>d</dl><blockquote>q</blockquote>": "t\n  d\n\n  q",
    "</p></div>a</td></table>b": "ab",
    "<h1>a</h2>b": "a\n\nb",
    # rules for other media, widths and blocks
    "<style>@media print{.x{display:none}} @page{margin:0}</style><p class=x>yes": "yes",
    "<style>@media screen and (min-width:600px){.x{display:none}}.y{display:none</style><p class=x>no<p class=y>no<p>yes": "yes",
    "<style>@media (max-width: 40em){.x{display:none}} @media not print{.y{display:none}}</style><p class=x>yes<p class=y>no": "yes",
    "<style>@supports (x:y){@layer a{.x{display:none}}} @keyframes k{to{display:none}}</style><p class=x>no</p><to>yes</to>": "yes",
    "<style>/* .a{display:none} */ .q{content:'}.a{display:none}'} .b{display:none}</style><p class=a>yes<p class=b>no": "yes",
    # visibility is inherited, display is not undone inside
    "<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>yes": "yes\n\nyes",
    "<ul><li style='visibility:hidden'>no<li>yes</ul>": "- yes",
    "<div style='display:none'>no<p style='display:block;visibility:visible'>no</div>yes": "yes",
    # the weightiest rule counts
    "<style>.x{display:none} p.x{display:block} #y{display:none} .z{display:none!important}</style>"
    "<p class=x>yes<p class=x id=y>no<p class=z style='display:block'>no</p><b hidden style='display:inline'>yes</b>": "yes\n\nyes",
    "<style>.x{display:none} .x{display:block}</style><p class=x>yes": "yes",
    # selectors by descendance, as children, of several names, and ones that are left aside
    "<style>div .z, ul>li.a{display:none}</style><p class=z>yes</p><div><b><i class=z>no</i></b>yes</div><ul><li class=a>no<li>yes</ul>": "yes\n\nyes\n\n- yes",
    "<style>div>.z{display:none}</style><div><b><i class=z>yes</i></b><i class=z>no</i></div>": "yes",
    "<style>body i>b u{display:none} a:hover,p[x='1']{display:none}</style><a>yes<p x=1>yes<i><u>yes</u><b><s><u>no": "yes\n\nyesyes",
    # drawings and formulas
    "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> <svg><title>no</title><path/><desc>no</desc>no"
    "<text>one <tspan>two</tspan></text><text/><g>no</g><foreignObject><p>three</foreignObject></svg>four": "x=2\none two\n\nthree\n\nfour",
}


def test_wide_cells():
    page = f"<table><tr><td>{'w' * 70}<td>a<tr><td>x<td>b</table>"
    assert visible_text(page) == f"{'w' * 70}  a\nx  b"
    assert visible_text(page, None) == f"{'w' * 70}  a\nx{' ' * 71}b"


def test_many_rules_on_deep_pages():
    assert visible_text("<style>b b i{display:none} @media{" + "@media{" * 5000 + "</style>" + "<b>" * 20_000 + "<i>no</i>x") == "x"


def test_cases():
    for page, text in CASES.items():
        assert visible_text(page) == text, page


class Words(HTMLParser):
    """All words outside scripts, by another parser."""

    def __init__(self, page):
        super().__init__()
        self.found, self.skip = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.found += data.split()


def test_whole_table_has_every_visible_word(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op1_html_layout"](spark, SF).collect()
    assert {r.page_id for r in out} == set(pages)
    for r in out:
        words = [w for w in r.text.split() if w not in ("-",)]
        assert "".join(words) == "".join(Words(pages[r.page_id]).found)


tags = st.sampled_from("p div li ul ol table tr td th b pre h1 br select option dd dl form caption tbody span hr".split())
bits = st.one_of(tags.map("<{}>".format), tags.map("</{}>".format), st.sampled_from(["w ", "x", " y", "&amp;", "<", ">", '<a "']))


@settings(max_examples=300, deadline=None)
@given(st.lists(bits, max_size=60))
def test_any_page_gives_its_words(parts):
    page = "".join(parts)
    if "<a" not in page and "<<" not in page and "< " not in page:
        letters = sorted(c for p in parts for c in p if p in ("w ", "x", " y"))
        assert sorted(c for c in visible_text(page) if c in "wxy" ) == sorted(c for c in letters if c != " ") or "<" in parts
    visible_text(page)


def test_deep_pages_and_odd_rows(spark):
    assert visible_text("<b>" * 50_000 + "x") == "x"
    assert visible_text("<div>" * 20_000 + "x") == "x"
    assert visible_text("<table><tr><td>" * 300 + "x") == "x"
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>a", "t"), (3, "<p>a", "t"), (None, "b", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect())
    assert out == [(0, "b"), (1, None), (2, ""), (3, "a"), (3, "a")]
    assert html_text.extract(pages.limit(0)).count() == 0
