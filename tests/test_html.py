import pytest
from pyspark.sql import functions as F

from postlake.functions.html import compile_selector, find, inner_html, parse_html, select_html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<div id="main" class="a b"><h1> One &amp; two </h1><ul><li><a href="/x?a=1&amp;b=2">x</a><li><a>no href</a></ul>
<div><p>first<p data-qa='job'>second <i>it</i><br>end</div><div class="b c">third "q" 'r' &lt;</div></div>
<section class='wide page'>s</section></body></html>"""

SELECT = {
    "h1": [" One & two "],
    "#main > h1": [" One & two "],
    ".a.b h1": [" One & two "],
    "div > .b": ['third "q" \'r\' <'],
    "p": ["first", "second itend"],
    "[data-qa='job']": ["second itend"],
    '[class="wide page"]': ["s"],
    "[class='wide']": [],
    "#main > div:nth-child(4)": ['third "q" \'r\' <'],
    "div > p:nth-child(2) i": ["it"],
    "li a": ["x", "no href"],
    "ul > li > a": ["x", "no href"],
    "body > p": [],
    "*.c": ['third "q" \'r\' <'],
}


@pytest.mark.parametrize("selector", SELECT)
def test_selectors(selector):
    assert [n.text() for n in find(parse_html(PAGE), selector)] == SELECT[selector]


@pytest.mark.parametrize("bad", ["", "a, b", "a:hover", "a + b", "> a", "a[href]", "a[href^='x']"])
def test_other_selectors_are_refused(bad):
    with pytest.raises(ValueError):
        compile_selector(bad)


def test_inner_html():
    root = parse_html(PAGE)
    node = next(find(root, "div > p:nth-child(2)"))
    assert inner_html(node) == "second <i>it</i><br/>end"
    node = next(find(root, ".c"))
    assert inner_html(node) == "third &#34;q&#34; &#39;r&#39; &lt;"
    assert inner_html(next(find(root, "li"))) == '<a href="/x?a=1&amp;b=2">x</a>'
    assert inner_html(next(find(root, "script"))) == 'var t="</p>";'


def test_open_style_tags_go_on():
    root = parse_html("<article><p><b>one<p>two</p></article><footer>f</footer>")
    assert [inner_html(n) for n in find(root, "article > p")] == ["<b>one</b>", "<b>two</b>"]
    assert [inner_html(n) for n in find(root, "footer")] == ["<b>f</b>"]


def test_as_column(spark):
    rows = [(1, PAGE, "h1"), (2, "<p>", "h1"), (3, None, "p"), (4, "<p>x", None)]
    df = spark.createDataFrame(rows, "id int, html string, sel string")
    found = select_html("html", {"t": (F.col("sel"), "text"), "links": ("a", "attr:href")})
    got = {r["id"]: (r["f"]["t"], list(r["f"]["links"])) for r in df.select("id", found.alias("f")).collect()}
    assert got == {1: (" One & two ", ["/x?a=1&b=2"]), 2: ("", []), 3: ("", []), 4: ("", [])}
