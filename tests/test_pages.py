"""Links, titles, dates, page parsing."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from textloom.functions import dates, pages, urls
from textloom.functions.text import Rules
from textloom.plans import pipelines


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("y")).first()[0]


@pytest.mark.parametrize(
    "href,want",
    [
        ("/a/b#c", "https://e.org/a/b"),
        ("https://x.net/q", "https://x.net/q"),
        ("//cdn.net/p", "https://cdn.net/p"),
        (" /t ", "https://e.org/t"),
        ("../up", None),
        ("?q=1", None),
        ("#top", "https://e.org/x/y?z=1"),
        ("rel", None),
        ("/a/../b", None),
    ],
)
def test_resolve(spark, href, want):
    from urllib.parse import urljoin

    base = "https://e.org/x/y?z=1"
    assert one(spark, urls.resolve("h", "b"), h=href, b=base) == want
    full = urljoin(base, href.split("#", 1)[0].strip())
    assert one(spark, urls.resolve_any("h", "b"), h=href, b=base) == full
    assert want is None or want == full


def test_links_are_distinct_in_order(spark):
    html = "<a href='/n/1'>x</a><A class=b HREF=\"../n/2#f\">y</A><a href=/bare>z</a><a href='/n/1#g'>again</a><a href='https://other.net/n/3'>o</a><a name=q>none</a>"
    df = spark.createDataFrame([("https://e.org/p/", html), ("https://e.org/q/", None)], "url string, html string")
    got = [(r.pos, r.dst) for r in pages.links(df).orderBy("pos").collect()]
    assert got == [(0, "https://e.org/n/1"), (1, "https://e.org/n/2"), (3, "https://other.net/n/3")]
    assert [r.dst for r in pages.links(df, r"https://e\.org/n/(?!1)", "e.org").collect()] == ["https://e.org/n/2"]


def test_host_and_pattern(spark):
    assert one(spark, urls.host_ends_with("u", "e.org"), u="https://www.e.org/x")
    assert not one(spark, urls.host_ends_with("u", "e.org"), u="no url e.org")
    assert one(spark, urls.matches("u", r"https://e\.org/news/(?!tag-|page)[a-z-]+/?$"), u="https://e.org/news/some-thing/")
    assert not one(spark, urls.matches("u", r"https://e\.org/news/(?!tag-|page)[a-z-]+/?$"), u="https://e.org/news/tag-x")


def test_page_addresses(spark):
    assert [tuple(r) for r in urls.numbered_pages(spark, "https://e.org/a", 2).collect()] == [(1, "https://e.org/a/"), (2, "https://e.org/a/page/2/")]
    assert [r.url for r in urls.day_pages(spark, "d_%s", date(2024, 2, 29), date(2024, 3, 1), "latest", date(2024, 3, 2)).collect()] == ["d_01032024", "d_29022024"]
    with pytest.raises(ValueError):
        urls.day_pages(spark, "d_%s", date(2024, 3, 2), date(2024, 3, 1))


def test_date_arguments():
    assert dates.date_argument("05.03.2024") == dates.date_argument("2024-03-05") == date(2024, 3, 5)
    with pytest.raises(ValueError):
        dates.date_argument("5 March")
    assert dates.day_range(None, None, 3, date(2024, 3, 5)) == (date(2024, 3, 3), date(2024, 3, 5))
    assert dates.day_range(None, "2024-03-05", 0) == (date(2024, 3, 5), date(2024, 3, 5))
    with pytest.raises(ValueError):
        dates.day_range("2024-03-06", "2024-03-05")


@pytest.mark.parametrize(
    "html,body,url,want",
    [
        ('{"datePublished" : "2024-01-02T03:04:05Z"}', "", "", "2024-01-02T03:04:05Z"),
        ("<meta property='article:published_time' content='p'>", "", "", "p"),
        ('<META NAME="article:published_time" CONTENT="n">', "", "", "n"),
        ("<meta content='c' data-x=1 property=article:published_time>", "", "", "c"),
        ('<meta property="article:published_time"><meta property="og:x" content="o"><meta name="Article:published_time" content="n">', "", "", "n"),
        ("", "– 8 May, 10:15", "https://e.org/2023/01/31/12/", "2023-05-08 10:15"),
        ("", "8 May, 10:15 — by us", "https://e.org/2023/01/31/12/", "2023-01-31"),
        ("", "x — 7 March, 9:05 y", "https://e.org/2023/01/31/12/", "2023-03-07 9:05"),
        ("", "x — 7 Smarch, 9:05", "https://e.org/2023/01/31/12", "2023-01-31"),
        ("", "x — 7 March, 9:05", "https://e.org/2023/13/40/1", ""),
        ("", "", "https://e.org/x", ""),
    ],
)
def test_published(spark, html, body, url, want):
    assert one(spark, dates.published("h", "t", "u"), h=html, t=body, u=url) == want


@pytest.mark.parametrize(
    "pattern,value,stamp",
    [
        (dates.DAY_MONTH, "5 March 2024, 9:07", "2024-03-05 09:07:00"),
        (dates.DAY_MONTH_CYRILLIC, "5 березня 2024, 09:07", None),
        (dates.ZONED, "5 March, 2024, 9:07 PM EET", "2024-03-05 21:07:00"),
        (dates.DOTTED, "05.03.2024 09:07", "2024-03-05 09:07:00"),
    ],
)
def test_date_forms(spark, pattern, value, stamp):
    assert one(spark, dates.in_text("t", pattern), t=f"on {value} here") == value
    assert one(spark, dates.typed("t").cast("string"), t=value) == stamp


def test_time_tag(spark):
    assert one(spark, dates.in_time_tag("h"), h="<TIME class=x datetime='2024-01-01'>") == "2024-01-01"


def test_titles(spark):
    assert one(spark, pages.title("h", ["Site", "S2"]), h="<meta property='og:title' content='A &amp; B | site news'><h1>no</h1>") == "A & B"
    assert one(spark, pages.title("h", ["Site"]), h="<title>t</title><h1>The <b>bold</b>\n one</h1>") == "The bold one"
    assert one(spark, pages.title("h"), h="<title> only | kept </title>") == "only | kept"
    assert one(spark, pages.title("h"), h=None) == ""


PAGE = """<html><head><title>T</title><script>var x="</p>";</script><style>p{}</style></head><body><nav><li>menu</li></nav>
<article class="x"><h1>Head <i>line</i></h1><p>First <b>bold<p>Second &amp; more</p><ul><li>item<p>inner</p></li></ul><blockquote>quote</blockquote></article><main><p>other</p></main><p>outside"""


def test_parse_gives_each_text_once():
    got = pages.parse(PAGE, ["article", "main", "div.none", "[class=x]"])
    assert got["h1"] == "Head line" and got["title"] == "T" and got["og_title"] is None
    whole = [(b["tag"], b["text"]) for b in got["blocks"] if b["container"] == -1]
    assert whole == [("li", "menu"), ("p", "First bold"), ("p", "Second & more"), ("li", "item"), ("p", "inner"), ("blockquote", "quote"), ("p", "other"), ("p", "outside")]
    assert [b["text"] for b in got["blocks"] if b["container"] == 0] == [b["text"] for b in got["blocks"] if b["container"] == 3] == ["First bold", "Second & more", "item", "inner", "quote"]
    assert "var x" not in " ".join(got["lines"])
    assert pages.parse(None)["blocks"] == []


def test_containers_and_floors(spark):
    df = spark.createDataFrame([(PAGE,)], "h string").select(pages.parsed("h", ["div.none", "main", "article"]).alias("p"))
    p = F.col("p")
    row = df.select(pages.by_priority(p, 3), pages.paragraphs(p, 2, ["p"], 10), pages.by_length(p, 3, Rules(drop_exact=("inner",)))).first()
    assert row[0] == ["other"]
    assert row[1] == ["First bold", "Second & more"]
    assert row[2] == "First bold\nSecond & more\nitem\nquote"


def test_after_title(spark):
    lines = ["nav", "Title", "01.01.2024 10:00", "Agency", "body", "Title", "more", "Read also", "tail"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    cut = lambda **kw: df.select(pages.after_title(F.col("l"), F.lit("Title"), ["Read also"], F.lit("01.01.2024 10:00"), "Agency", **kw)).first()[0]
    assert cut() == "body\nTitle\nmore"
    assert cut(last=True) == "more"
    assert df.select(pages.after_title(F.col("l"), F.lit("Other"))).first()[0] is None


@pytest.mark.parametrize("n,below,want", [(0, 1, "fallback"), (199, 200, "fallback"), (199, 1, "x" * 199), (200, 200, "x" * 200)])
def test_fallback(spark, n, below, want):
    assert one(spark, pages.with_fallback(F.col("a"), F.lit("fallback"), below), a="x" * n) == want


def test_scrape_floors(spark):
    page = "<h1>T</h1><article><p>{}</p><p>short</p></article>"
    rows = [("https://e.org/2024/01/02/3", page.format("a" * 200)), ("u2", page.format("a" * 199)), ("u3", "<article><p>" + "a" * 300), ("u4", None)]
    got = pipelines.scrape(spark.createDataFrame(rows, "url string, html string"), pipelines.Site("src", "x")).collect()
    assert [tuple(r) for r in got] == [("src", "T", "2024-01-02", "https://e.org/2024/01/02/3", "a" * 200)]


def test_article_urls_stop_and_limit(spark):
    a = lambda *ns: "".join(f"<a href='/n/{n}'>x</a>" for n in ns)
    rows = [("https://e.org/1", 1, a(1, 2, 1)), ("https://e.org/2", 2, a(2, 3)), ("https://e.org/3", 3, a(1, 3)), ("https://e.org/4", 4, a(9))]
    df = spark.createDataFrame(rows, "url string, page_no long, html string")
    site = pipelines.Site("s", r"https://e\.org/n/\d+", "e.org")
    got = lambda **kw: [r.url[-1] for r in pipelines.article_urls(df, site, **kw).collect()]
    assert got(limit=10) == ["1", "2", "3"]
    assert got(limit=10, stop=False) == ["1", "2", "3", "9"]
    assert got(limit=2) == ["1", "2"]
    assert got(limit=10, max_pages=1) == ["1", "2"]
    with pytest.raises(ValueError):
        got(limit=0)
