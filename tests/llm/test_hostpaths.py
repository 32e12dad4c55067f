from __future__ import annotations

import re
from html import unescape

import pytest

from tests.conftest import SF
from tillbook.llm import hostpaths, queries


def by_splitting(html: str) -> str:
    """The article of a page of the given tables, whose only tags in it are p, h1, b and br."""
    article = html[html.index("<article>") + 9 : html.index("</article>")]
    blocks = [" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(x for x in blocks if x)


def test_registered_query_on_the_given_table(spark):
    rows = queries.QUERIES["op13_host_paths"](spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) > 0
    for r in rows:
        assert r.text == by_splitting(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


ARTICLE = "A first paragraph of the article, which is long enough to count. " * 3
AROUND = {
    "menu": '<div class="main-menu"><a href="/a">Home</a> <a href="/b">News</a></div><ul role="navigation"><li>Menu item</ul>',
    "header": '<header><h2>The Site</h2><p>Its slogan</p></header><div id="top-banner">Banner words</div>',
    "sidebar": '<aside>Side words</aside><div class="col sidebar-left"><p>Side words of a paragraph</p></div>',
    "notice": '<div class="cookie-consent"><p>We use cookies.</p></div><div role="alert">Notice!</div><div hidden>Hidden</div><p style="display: none">Hid</p>',
    "advert": '<div class="ad"><p>Buy this now, it is very cheap and good.</p></div><span class="sponsored">Paid</span><ins class="adsense">x<ins>y</ins></ins>',
    "form": '<form action="/x"><p>Your name</p><input name="a"><label>Mail</label><button>Send</button></form><select><option>One<option>Two</select>',
    "code": "<script>var a = '<p>no</p>';</script><style>p{}</style><noscript>no</noscript><template><p>t</p></template><svg><text>s</text></svg><!-- <p>c</p> -->",
    "footer": '<footer><p>&copy; someone</p></footer><div class="copyright">2020</div>',
    "comments": '<section id="comments"><article class="comment-body"><p>' + "A reader writes a long comment here. " * 20 + "</p></article></section>",
}


@pytest.mark.parametrize("kind", AROUND)
@pytest.mark.parametrize("inside", [False, True])
def test_what_is_not_the_article_is_left_out(kind, inside):
    extra = AROUND[kind]
    if kind == "header" and inside:
        extra = "<header><p>No heading</p></header>"
    body = f"<article><h1>Title</h1>{extra if inside else ''}<p>{ARTICLE}</p></article>{'' if inside else extra}"
    page = hostpaths.Page(f"<html><head><title>T</title></head><body><div class='wrap'>{'' if inside else extra}{body}</div></body></html>")
    assert page.text([]) == f"Title\n{ARTICLE.strip()}" and page.paths[page.best()] == "body>div.wrap>article"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain & simple", "plain & simple"), ("a < b &lt; c &amp d&nbsp;e &#x41;", "a < b < c & d e A"),
        ("<p>one<p>two <b>bold<p>three</b> on", "one\ntwo bold\nthree on"),
        ("<p>a\n\t b<br>c</p><pre>x\n y</pre><hr>z", "a b c\nx y\nz"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>", "a\nb\nc\nd\ne\nf"),
        ('<P CLASS=x title="a > b">up</P>', "up"), ("<p>cut off <a href='x", "cut off"), ("<p>a<!-- c --->b<!---->c", "abc"),
        ("<script>never closed <p>x</p>", ""), ("<article><header><h1>T</h1></header><p>x</article>", "T\nx"),
        ("<form id=aspnetForm><article><p>x</p></article></form>", "x"), ("<nav>n</nav><p>x</p></body></html><p>after", "x\nafter"),
        ('<div class="ad"><div>x</div>y</div>z', "z"), ("<p>a<span class=ad>b<span>c</span>d</span>e", "ae"), ("\x00<p>é\U0001f600", "\x00\né\U0001f600"),
        ("<main class='has-sidebar'><p>m</p></main><div class=sidebar>s</div>", "m"), ("</p></div>x</article>", "x"),
        ("<body class=comments-open><div id=content class=no-sidebar><article class='post comments-open'>x</article></div>", "x"),
    ],
)
def test_markup(html, text):
    assert hostpaths.Page(html).text([]) == text


def test_hosts():
    known = {"HTTP://User:p@WWW.Example.com:80/x?y": "www.example.com", "//a.b/c": "a.b", "a/b": "", None: "", "": "", " https://h": "h"}
    assert {u: hostpaths.host_of(u) for u in known} == known


def pages_of(spark, rows):
    schema = "page_id long, url string, html string, text string, n_chars string, host string, path string, paths string, __x string"
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema)


def test_a_host_decides_for_its_pages(spark):
    """A short article beside a long thread without telling names: alone the thread is taken, the host's other pages tell better."""
    good = "<div class='story-{0}'><h1>T{0}</h1><p>" + ARTICLE + "</p></div><div class=thread><p>Ok.</p></div>"
    odd = "<div class=story-99><h1>Odd</h1><p>Short.</p></div><div class=thread><p>" + "Long words of readers. " * 40 + "</p></div>"
    rows = [(i, f"http://A.com/{i}", good.format(i)) for i in range(9)] + [(50, "https://a.com:8080/odd", odd), (60, "http://b.com", odd)]
    found = {r.page_id: r.text for r in hostpaths.extract(pages_of(spark, rows), keep=["page_id"]).collect()}
    assert found[50] == "Odd\nShort." and found[60] == ("Long words of readers. " * 40).strip()
    assert found[3] == f"T3\n{ARTICLE.strip()}"


def test_two_templates_of_a_host_and_a_page_with_neither(spark):
    one, two = "<article><p>{}</p></article>", "<div class=body><p>{}</p></div><div class=x><p>a</p></div>"
    rows = [(i, "http://a/", (one if i % 2 else two).format(ARTICLE + str(i))) for i in range(20)] + [(99, "http://a/", f"<section><p>{ARTICLE}</section>")]
    found = {r.page_id: r.text for r in hostpaths.extract(pages_of(spark, rows), keep=["page_id"]).collect()}
    assert all(found[i] == f"{ARTICLE}{i}" for i in range(20)) and found[99] == ARTICLE.strip()
    winners = hostpaths.winning_paths(hostpaths.votes(pages_of(spark, rows))).collect()
    assert [(r.host, sorted(r.paths)) for r in winners] == [("a", ["body>article", "body>div.body"])]


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_rows(spark, broadcast):
    """Nulls, empties, repeated rows, columns with clashing names, and a host with most of the rows; joined either way."""
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (2, None, "<p>y"), (3, "http://a/", None), (4, None, None), (None, "", ""), (5, "http://b/", "<nav>n")]
    rows += [(100 + i, "http://hot/", f"<article><p>w{i}</p></article>") for i in range(300)] + [(999, "http://a/", "<p>" + "long text " * 100_000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = hostpaths.extract(pages_of(spark, rows), keep=["page_id", "host", "path", "paths", "__x"])
        found = sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(1, "x", 1), (1, "x", 1), (2, "y", 1), (3, "", 0), (4, "", 0), (None, "", 0), (5, "", 0), (999, ("long text " * 100_000).strip(), 999_999)]
    assert found == sorted(want + [(100 + i, f"w{i}", len(f"w{i}")) for i in range(300)], key=str)
    assert out.columns == ["page_id", "host", "path", "paths", "__x", "text", "n_chars"]
    assert hostpaths.extract(pages_of(spark, rows).where("page_id < 0"), keep=["page_id"]).count() == 0


def test_very_long_and_broken_pages():
    for html in ("<" * 200_000, "<a " * 100_000, "<div>" * 20_000 + "x", "<p title='" * 20_000, "&amp" * 100_000, "<!--" * 100_000, "</p>" * 100_000):
        hostpaths.Page(html).text([])
