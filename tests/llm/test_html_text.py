from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from veilspark.llm.html_text import extract, main_text, surges

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><p>Site name</p></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- x --><article><h1>Head &amp; line</h1><p><b>First
  para.<br>more<p>A.</p><div class="ad">Buy</div><aside>Side</aside><p>Last&nbsp;one &lt;ok&gt;</p><form><input><p>Mail</p></form></article>
<div id="comments"><p>Reader says a lot of things in this comment, and then some more.</p></div><footer>&copy; me</footer>"""


def test_article():
    assert main_text(PAGE) == "Head & line\nFirst para. more\nA.\nLast one <ok>"


def test_without_article_element():
    page = "<body><div class='menu'><a>x</a></div><div><p>" + "word " * 60 + "</p><p>short</p></div><p></p><p></p><p></p><div class='sidebar'>z</div><p><a>only a link here</a></p></body>"
    assert main_text(page) == ("word " * 60).strip() + "\nshort"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("a < b & c") == "a < b & c"
    assert main_text("<nav><p>menu<article><p>Text") == "Text"
    assert main_text("<article><p title='a > b'>x</p></article>") == "x"
    assert main_text("<article>" + "<p>n</p>" * 3000 + "</article>").count("n") == 3000


def test_surges_and_dives():
    weights = [0, 5, 0, 0, 0, 7, 3, 0, 2]
    assert surges(weights, 5, width=2) == [(0, 3), (4, 7)]
    assert surges(weights, 10, width=2) == [(5, 7)]
    assert surges(weights, 10, width=3) == [(4, 8)]
    assert surges(weights, 13, width=3) == []
    assert surges([0, 0], 0, width=1) == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>A</p><p class="ad">Buy<p>B<p>C</article>', "A\nB\nC"),
        ('<div class="overflow-hidden">text</div>', "text"),
        ('<div class="review-widget"><p>body text here</p></div>', "body text here"),
        ('<div class="search-results-analysis"><p>body</p></div>', "body"),
        ('<p data-x="hidden">par</p><p hidden>no</p><p aria-hidden="true">no</p><p style="color:red; display:none">no</p>', "par"),
        ("<ul><li class=ad>x<ul><li>in</ul>y<li>z</ul>", "z"),
        ("<table><tr><td class=ad>x<table><tr><td>in</table>y<td>cell</table>", "cell"),
        ("<dl><dt class=ad>x<dd>y<dt>z</dl>", "y\nz"),
        ("<div class='comment-list'><p>says</p></div><div id='siteFooter'>c</div><p>t</p>", "t"),
    ],
)
def test_markup(page, text):
    assert main_text(page) == text


def test_width_and_share_decide():
    """No element or name tells the notices from the text here: only their length does."""
    notice = "<div>We use cookies on this site.</div>"
    items = "".join(f"<p>item number {i}</p>" for i in range(40))
    page = f"<body>{notice}<div>{'<p>' + 'plain words ' * 9 + '</p>'}{'<p>' + 'more of them ' * 8 + '</p>'}</div><div>{items}</div>{notice}</body>"
    lines = main_text(page).split("\n")
    assert len(lines) == 2 and "We use" not in main_text(page)
    assert len(main_text(page, width=8).split("\n")) == 42  # eight items weigh as much as half of the paragraphs
    assert len(main_text(page, share=0.02).split("\n")) == 44
    assert len(main_text(page, width=1, share=0.96).split("\n")) == 2


class Article(HTMLParser):
    """The text of the article element by a plain parser: a new block at each paragraph and heading, nothing of adverts."""

    def __init__(self):
        super().__init__()
        self.blocks, self.on, self.skip = [""], False, 0

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        if tag in ("p", "h1", "li"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.on = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def by_parser(page):
    parser = Article()
    parser.feed(page or "")
    return "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)


def test_same_as_a_plain_parser_on_all_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert [main_text(p) for p in pages] == [by_parser(p) for p in pages]


def test_length_alone_finds_most_pages():
    """With every element and class that names furniture or the article renamed, nine pages of ten still give their text."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()

    def bare(p):
        for tag in ("article", "nav", "footer"):
            p = p.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
        return p.replace('class="ad"', 'class="x"')

    same = [main_text(bare(p)) == by_parser(p) for p in pages]
    assert sum(same) > 0.9 * len(same)
    other = [main_text(bare(p), share=0.01) == by_parser(p) for p in pages]
    assert sum(other) < 0.2 * len(same)


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, PAGE, 5, "x"), (1, PAGE, 5, "x"), (None, PAGE, None, None), (3, " ", 1, "")], "page_id int, html string, n_chars int, url string")
    got = extract(df).collect()
    assert len(got) == 4 and sorted(r.text for r in got) == sorted([main_text(PAGE)] * 3 + [""])


LONG = "<p>" + "long body " * 40 + "</p>"


def test_short_articles_beside_a_long_body():
    page = f"<body><div>{LONG}<p>End.</p></div><article><h3>Card</h3><p>Teaser one</p></article><article><p>Teaser two</p></article></body>"
    assert main_text(page) == ("long body " * 40).strip() + "\nEnd."


def test_articles_in_closed_furniture():
    page = f"<body><div id='comments'><article><p>{'A reader says. ' * 30}</p></article></div><aside><article><p>Card</p></article></aside><article>{LONG}</article></body>"
    assert main_text(page) == ("long body " * 40).strip()
    assert main_text("<div class='with-sidebar'><article><p>Text</p></article></div>") == "Text"
    assert main_text("<div class='sidebar'><main><p>Text</p></main></div>") == "Text"


def test_furniture_in_a_row_and_lists_of_links():
    furniture = "<div class='ad'>a</div><div class='share'>b</div><div class='related'>c</div><div class='promo'>d</div>"
    page = f"<body><div>{LONG}{furniture}<p>Closing.</p><ul><li><a>First link</a></li><li><a>Second link</a></li></ul></div><div><a>Elsewhere</a></div></body>"
    assert main_text(page) == ("long body " * 40).strip() + "\nClosing.\nFirst link\nSecond link"


def test_column(spark):
    df = spark.createDataFrame([(1, PAGE, "old"), (2, None, "old")], "page_id int, html string, text string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {1: main_text(PAGE), 2: ""}
    assert extract(df.limit(0)).count() == 0
