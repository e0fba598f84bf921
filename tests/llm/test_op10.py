import html
import re

import duckdb
import pytest

from gradelake.llm.html_extract import extract, extract_pages, op10_html_extraction, second_pass

SF = "/root/testdata/sf0.01"
CASES = [
    (None, ""),
    ("", ""),
    ("<article><h1>A &amp; B</h1><p>one  <b>two</b>,\n three<br>four<p>five</article>", "A & B\n\none two, three four\n\nfive"),
    ("<nav><a href=x>Home</a></nav><header><h1>Site</h1></header><article><header><h1>T</h1></header><p>x</p></article><aside>s</aside><footer>f</footer>", "T\n\nx"),
    ("<body><div class='cookie-notice'>We use cookies and the rest of it is for you to see in this notice here now</div><article><p>Text</p><div class=\"ad\">Buy</div><form>q<input></form><script>a<b</script><style>p{}</style><!-- <p>no</p> --><p>More</p></article><section id=comments><p>nice</p></section>", "Text\n\nMore"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut <a href=\"x", "cut"),
    ("<article>a < b &lt;p&gt; &#233;&nbsp;c</article>", "a < b <p> é c"),
    ("<div><p>" + "the cat and the dog are in the house with a lot of the other animals " * 2 + "</p><p>Short one</p></div><div><a href=x>Next</a> <a href=y>Previous</a></div>", ("the cat and the dog are in the house with a lot of the other animals " * 2).strip() + "\n\nShort one"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ("<main><p>m</p><ul><li>item one</li><li>item two</li></ul></main>", "m\n\nitem one\n\nitem two"),
    ("<article><p>" + "x" * 2_000_000 + "</p></article>", "x" * 2_000_000),
    ("<p>" * 50_000, ""),
    ("<article><p data-x=it's>One</p><p>It's two</p><p>three</p></article>", "One\n\nIt's two\n\nthree"),
    ("<article><p title='a > b' alt=\"c > d\" x = 'e>' y=>One</p><p \"q\" it's>two</p><img alt=x\"y>three</article>", "One\n\ntwo\n\nthree"),
    ("<article><p>one</p><a href='x>two</a><p>three</p></article>", "one\n\ntwo\n\nthree"),
    ("<body><h1>Title only</h1><p>Short text here.</p></body>", "Title only\n\nShort text here."),
    ("<div class='entry-content'><p>Hola mundo, este es un texto corto.</p></div>", "Hola mundo, este es un texto corto."),
    ("<nav>Home</nav><p>Short</p><footer>f</footer>", "Short"),
    ("<article><p>One</p><p hidden>no</p><p class=ad>buy</p><h2 aria-hidden=true>no</h2><p class='lead'>two</p>three</article>", "One\n\ntwo\n\nthree"),
    ("<p " + "a" * 200_000 + "=", ""),
    ("<p " + "='" * 100_000 + ">x", "x"),
    ("<div class='has-sidebar'><div class=page-header>Site</div><article class='post with-comments'><div class='article-header'>T</div><p>x</p></article><article class=comment><p>hi</p></article></div>", "T\n\nx"),
]


@pytest.mark.parametrize(("page", "text"), CASES, ids=range(len(CASES)))
def test_cases(page, text):
    assert extract(page) == text


def test_neighbours():
    assert second_pass([None, True, None, None, False, None]) == [True, True, True, False, False, False]
    assert second_pass([True, None, False]) == [True, True, False]
    assert second_pass([None, None]) == [True, True] and second_pass([False, None]) == [False, True]
    assert second_pass([]) == []


def test_table(spark):
    rows = duckdb.connect().execute(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {x.page_id: (x.text, x.n_chars) for x in op10_html_extraction(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, page in rows:  # these pages hold their text in one plain article
        inside = page.split("<article>", 1)[1].split("</article>")[0]
        inside = re.sub(r"<[^>]*\Z", "", inside)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " " if False else "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        text = "\n\n".join(x for x in parts if x)
        assert got[i] == (text, len(text)), i


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<article>x", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, extract_pages(df).collect()), key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)], key=str)
    assert extract_pages(df.limit(0)).count() == 0


LONG = "the cat and the dog are in the house with a lot of the other animals of the town"


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><main><article><p>Text</p></article></main></div>",
        "<div class='content-sidebar-wrap'><div class=content><p>Text</p></div></div>".replace("Text", LONG),
        "<article><div class='elementor-element elementor-widget elementor-widget-text-editor'><p>Text</p></div></article>",
        "<div class=sidebar><main><p>Text</p></main></div>",
        "<div class=widget><article><p>Text</p></article></div>",
        "<article><div class='market-share'><p>Text</p></div></article>",
        "<article><div class='legal-notice' id=searchResults><p>Text</p></div></article>",
        "<div class='page-with-sidebar hasSidebar'><p>Text</p></div>".replace("Text", LONG),
        "<div id=relatedWorkText><p>Text</p></div>".replace("Text", LONG),
    ],
)
def test_words_in_names(page):
    assert extract(page) == (LONG if LONG in page else "Text")


@pytest.mark.parametrize("name", "ad ads ad-1 adSlot sidebar site-sidebar acme-sidebar sidebar-primary widget-area social-share share-buttons post-share related-posts comments comment-list page-footer main-nav cookie-notice cookie-bar breadcrumb-trail page-header newsletter-form menu-item".split())
def test_marked_names(name):
    for kind in ("class", "id"):
        assert extract(f"<article><p>Text</p></article><div {kind}='{name}'><p>{LONG}</p></div>") == "Text"
    if name not in ("acme-sidebar", "page-header"):
        assert extract(f"<article><p>Text</p><div class='x {name}'><p>{LONG}</p></div></article>") == "Text"
    if name.startswith(("ad", "related", "comment")):
        assert extract(f"<article><p>Text</p></article><div class='{name}'><article><p>{LONG}</p></article></div>") == "Text"


def test_links_in_articles():
    page = "<nav><a href=x>Home</a></nav><article><h1><a href=x>Title</a></h1><p>Text</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><nav><a href=z>Next</a></nav></article><div><a href=x>Out</a></div>"
    assert extract(page) == "Title\n\nText\n\nOne\n\nTwo"
    assert extract("<nav><a href=x>Home</a></nav><article><h1><a href=x>Title</a></h1></article><footer>f</footer>") == "Title"


def test_a_slash_does_not_close_a_script():
    body = "<article><p>One is the text of it.</p>{}<p>Two is the text of it.</p></article>"
    both, one = "One is the text of it.\n\nTwo is the text of it.", "One is the text of it."
    for inner, expected in (
        ('<script src="a"/>var x=1</script>', both), ('<script src="a"></script>', both), ('<script src="a"/>', both), ("<SCRIPT/ >var x=1</script >", both), ("<style/>p{}</style>", both),
        ('<script src="a"/><script>var x=1</script>', both), ("<svg/>", both), ("<svg><text>x</text></svg>", both), ("<script>never closed", one), ("<iframe src='x'/>", both),
    ):
        assert extract(body.format(inner)) == expected, inner
