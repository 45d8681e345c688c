"""Whole crawls over stored pages and sitemaps."""

import json

import pytest

from textloom.operators import annotate
from textloom.plans import crawls, pipelines

BODY = "<p>" + "A sentence of the article. " * 12 + "</p>"
SITE = pipelines.Site("s", r"https://e\.org/news/\d+", "e.org", pick="main", date_form=r"\d{1,2} May 2024")


def table(spark, pages):
    return spark.createDataFrame(list(pages.items()), "url string, html string")


def page(n):
    return f"<html><body><nav><p><a href='/x'>Menu menu menu menu menu</a></p></nav><article><h1>T{n}</h1><p>{n} May 2024</p>{BODY}{BODY}<p><a href='/y'>A link that is all of its paragraph and long</a></p></article></body></html>"


def test_collected_gives_a_row_for_each_address(spark):
    pages = table(spark, {"https://e.org/news/1": page(1), "https://e.org/news/2": "<h1>T</h1><p>A paragraph that is kept but far too short.</p>", "https://e.org/news/3": BODY, "https://e.org/news/4": None})
    asked = spark.createDataFrame([(f"https://e.org/news/{n}",) for n in range(1, 6)], "url string")
    got = {r.url[-1]: r for r in crawls.collected(asked, crawls.stored(pages), SITE).collect()}
    assert got["1"].error is None and got["1"].title == "T1" and got["1"].published_at == "1 May 2024"
    assert got["1"].text == "1 May 2024\n" + ("A sentence of the article. " * 12).strip()
    assert got["2"].error == "text under 200 characters" and got["3"].error == "no title"
    assert "404" in got["4"].error and "404" in got["5"].error


def test_main_text_falls_back(spark):
    listed = "<article><h1>T</h1><p>Few words.</p><ul>" + "<li>An item that is long enough to be kept as text.</li>" * 6 + "</ul></article>"
    row = crawls.collected(spark.createDataFrame([("u",)], "url string"), crawls.stored(table(spark, {"u": listed})), SITE).first()
    assert row.error is None and row.text.count("An item") == 6


def listing(*numbers):
    return "".join(f"<a href='/news/{n}'>n</a>" for n in numbers)


@pytest.mark.parametrize("block", [1, 2, 10])
def test_listings_end(spark, block):
    urls = spark.createDataFrame([(n, f"https://e.org/l/{n}") for n in range(1, 6)], "page_no long, url string")
    run = lambda pages, limit=100, most=50: [r.url.rsplit("/", 1)[1] for r in crawls.from_listings(urls, crawls.stored(table(spark, {f"https://e.org/l/{n}": h for n, h in pages.items()})), SITE, limit, most, block).collect()]
    assert run({1: listing(3, 1), 2: listing(1, 2), 3: listing(2), 4: listing(9)}) == ["3", "1", "2"]  # nothing new
    assert run({1: listing(1), 2: "no links", 3: listing(2)}) == ["1"]
    assert run({1: listing(1), 3: listing(2)}) == ["1"]  # a failed page
    assert run({1: listing(1, 2, 3), 2: listing(4)}, limit=2) == ["1", "2"]
    assert run({1: listing(1), 2: listing(2)}, most=1) == ["1"]
    assert run({}) == []


def test_sitemap_first_then_listings(spark):
    pages = {
        "https://e.org/sitemap.xml": "<sitemapindex><sitemap><loc>https://e.org/a.xml</loc></sitemap><sitemap><loc>https://e.org/gone.xml</loc></sitemap></sitemapindex>",
        "https://e.org/a.xml": "<urlset><url><loc>https://e.org/news/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://e.org/news/2</loc><lastmod>2024-02-01</lastmod></url><url><loc>https://e.org/about</loc></url></urlset>",
        "https://e.org/l/1": listing(3),
        **{f"https://e.org/news/{n}": page(n) for n in (1, 2, 3)},
    }
    fetch = crawls.stored(table(spark, pages))
    listings = lambda: crawls.from_listings(spark.createDataFrame([(1, "https://e.org/l/1")], "page_no long, url string"), fetch, SITE, 9)
    assert [r.url[-1] for r in crawls.from_sitemap("https://e.org/sitemap.xml", fetch, SITE, 9).collect()] == ["2", "1"]
    first = crawls.crawled(lambda: crawls.from_sitemap("https://e.org/sitemap.xml", fetch, SITE, 1), listings, fetch, SITE)
    assert [(r.title, r.error) for r in first.collect()] == [("T2", None)]
    second = crawls.crawled(lambda: crawls.from_sitemap("https://e.org/none.xml", fetch, SITE, 1), listings, fetch, SITE)
    assert [(r.title, r.error) for r in second.collect()] == [("T3", None)]


def test_one_article(spark):
    class Refusing:
        def generate(self, prompt, temperature):
            raise annotate.ProviderError("not allowed", 403)

    given = {"title": "T", "source": "s", "published_at": "", "url": "u", "text": "First line.\nSecond."}
    got = json.loads(pipelines.annotated_one(spark, annotate.OfflineProvider, **given).first().value)
    assert list(got) == ["title", "source", "published_at", "url", "text", "pairs"] and got["pairs"][0]["answer"] == "First line."
    with pytest.raises(Exception, match="not allowed"):
        pipelines.annotated_one(spark, Refusing, **given).collect()


def test_each_page_of_an_address_is_collected(spark):
    """Pages that share an address, addresses asked more often than stored, a title cut within a reference: as in the query's SQL."""
    stored = spark.createDataFrame([("u1", "b"), ("u1", "a"), ("u2", "c"), ("u2", None), ("u4", "d"), ("u4", "e")], "url string, html string")
    asked = spark.createDataFrame([(u,) for u in ["u1", "u1", "u2", "u2", "u2", "u3", "u3", "u4"]], "url string")
    got = crawls.stored(stored)(asked).collect()
    assert sorted((r.url, r.status or 0, r.html or "") for r in got) == [("u1", 200, "a"), ("u1", 200, "b"), ("u2", 200, "c"), ("u2", 200, "c"), ("u2", 200, "c"), ("u3", 0, ""), ("u3", 0, ""), ("u4", 200, "d")]
