"""Main text: given pages against a parse of their article by the standard library, and pages of other shapes."""

from html.parser import HTMLParser

import pytest

from foliant.llm import maintext, queries


class Article(HTMLParser):
    """Texts of the article, cut at every p and heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def brute(html):
    parser = Article()
    parser.feed(html or "")
    parser.close()
    return "\n".join(t for b in parser.blocks if (t := " ".join(b.split())))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_marked_article(spark, sf):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op12_main_text(spark, f"/root/testdata/{sf}").collect()}
    want = {r.page_id: (r.url, brute(r.html), len(brute(r.html))) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    assert got == want


LONG = "This sentence belongs to the article and says a good deal about its subject, as articles do. " * 3
JUNK = '<div class="cookie-notice">We use cookies.</div><div id="topMenu"><a href="/">Home</a> <a href="/a">About</a></div>'
SHAPES = {
    "divs without names": (
        f'<body><div><a href="/">Home</a> | <a href="/x">News</a></div><div>Site of the day</div><div><a href="/y">All</a></div><div><a>More</a></div><div><h1>Title here</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>The end.</p></div><div><a href="/z">Next page</a></div><div>(c) 2020 Company</div></body>',
        ["Title here", LONG, "Short.", LONG, "The end."],
    ),
    "main with an aside": (f"<main><h1>T</h1><p>{LONG}</p><aside><p>{LONG}</p></aside><p>a &amp; b&nbsp;c<br>d</p></main><p>{LONG}</p>", ["T", LONG, "a & b c d"]),
    "comments in the article": (f'<article><p>Text</p><section id="comments"><article class="comment"><p>{LONG}{LONG}</p></article></section></article>', ["Text"]),
    "comments beside the article": (f'<article><p>Text of it</p></article><ol class="comment-list"><li><article class="comment"><p>{LONG}</p></article></li></ol>', ["Text of it"]),
    "form and sidebar by class": (f'{JUNK}<div class="content has-sidebar"><div class="entry-header"><h1>T</h1></div><p>{LONG}</p><form><p>{LONG}</p></form></div><div class="sidebar"><p>{LONG}</p></div>', ["T", LONG]),
    "a form around the page": (f"<form><div><h1>T</h1><p>{LONG}</p></div></form>", ["T", LONG]),
    "open elements": ("<article><p>one<p><b>two<ul><li>three<li><a href=x>four</a></ul>five", ["one", "two", "three", "four", "five"]),
    "script, style, comment": ('<article><script>if (a<b) "</p>"</script>x<!-- <p>no --> y<style>p{}</style><p hidden>no</p><p style="display: none">no</p></article>', ["x y"]),
    "cut off in a tag": ('<article><p>kept</p><div class="a', ["kept"]),
    "no markup": ("just a line &lt;here", ["just a line <here"]),
    "only a menu": ('<nav><a href="/">Home</a></nav>', []),
    "header of the page and of the article": (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{LONG}</p><footer>tags</footer></article><footer>f</footer>", ["T", LONG]),
    "article with teasers": (f"<main><p>{LONG}</p><p>{LONG}{LONG}</p><article><p>Teaser</p></article></main>", [LONG, LONG + LONG]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    html, want = SHAPES[name]
    assert maintext.main_text(html) == "\n".join(" ".join(w.split()) for w in want)


def test_spans_of_weights():
    assert maintext.spans([0, 3, 0, 0, 0, 90, 0, 20, 70, 0, 0, 0, 5], 80) == [(5, 9)]
    assert maintext.spans([0, 0, 1, 0, 0, 0, 0, 2], 1) == [(2, 3), (7, 8)]
    assert maintext.spans([], 1) == []


def test_null_empty_repeated_and_clashing(spark):
    rows = [(1, None, "a", "z"), (1, "", "a", "z"), (None, "<p>x</p>", None, "z"), (2, "<p>x</p>", "b", "z"), (2, "<p>x</p>", "b", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, _row string, _html string").withColumnRenamed("_html", "_text")
    got = maintext.extract(df)
    assert got.columns == ["page_id", "html", "_row", "_text", "main_text"]
    assert sorted((str(r.page_id), str(r._row), r._text, r.main_text) for r in got.collect()) == [("1", "a", "z", ""), ("1", "a", "z", ""), ("2", "b", "z", "x"), ("2", "b", "z", "x"), ("None", "None", "z", "x")]
    assert maintext.extract(df.limit(0)).count() == 0


def test_long_page():
    html = "<article>" + "<p>word <b>more</b></p>" * 60_000 + "</article>"
    assert maintext.main_text(html).count("\n") == 59_999
