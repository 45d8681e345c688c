"""Whole crawls: addresses from sitemaps or listing pages, fetching, extraction, each failure a row with its reason.

A fetch is any function from addresses (url) to rows (url, status, html, error): ``over_http`` asks the sites, ``stored``
looks pages up in a table of earlier answers, so that a crawl can be repeated without a network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import pages as P
from textloom.operators import crawl, ordering
from textloom.plans.pipelines import Site
from textloom.sources import http
from textloom.tables import written

Fetch = Callable[[DataFrame], DataFrame]


def over_http(make: Callable[[], list] = http.providers, delay: float = 1.0) -> Fetch:
    """Pages from the sites, one host a task, so many seconds after each request. Answers are written once: what follows may be retried without asking again."""
    return lambda addresses: written(http.fetch(addresses, make, delay), "fetched")


def stored(pages: DataFrame) -> Fetch:
    """Pages of a table (url, html). An address that is there more than once gives its pages in turn, the least first and the last for every further request. Others are errors."""
    of = Window.partitionBy("url").orderBy("html")
    kept = pages.filter(F.col("html").isNotNull()).select("url", "html", F.row_number().over(of).alias("_n"), F.lead("url").over(of).isNull().alias("_last"))

    def fetch(addresses: DataFrame) -> DataFrame:
        asked = addresses.groupBy("url").agg(F.count(F.lit(1)).alias("_asked"))
        there, n, times = F.col("html").isNotNull(), F.col("_n"), F.col("_asked")
        rows = F.when(~there, times).when(n > times, 0).when(F.col("_last"), times - n + 1).otherwise(1)
        got = asked.join(kept, "url", "left").filter(rows > 0).select("url", "html", F.explode(F.sequence(F.lit(1).cast("long"), rows)))
        return got.select("url", F.when(there, 200).alias("status"), "html", F.when(~there, F.lit("RuntimeError: HTTP 404")).alias("error"))

    return fetch


def from_listings(listings: DataFrame, fetch: Fetch, site: Site, limit: int, max_pages: int = 50, block: int = 10) -> DataFrame:
    """(page_no, pos, url) of the first ``limit`` article addresses of listing pages (page_no, url), in order.

    Pages are fetched a block at a time. The first that fails or shows nothing new ends the crawl, as does the limit.
    """
    if limit <= 0 or max_pages <= 0 or block <= 0:
        raise ValueError("limits are positive numbers")
    links = seen = None
    for first in range(1, max_pages + 1, block):
        asked = listings.filter(F.col("page_no").between(first, min(first + block - 1, max_pages)))
        got = fetch(asked.select("url")).join(asked.withColumnRenamed("url", "_asked"), F.col("url") == F.col("_asked")).select("page_no", "url", "html")
        shown = P.links(got.filter(F.col("html").isNotNull()), site.article, site.domain).join(got.select(F.col("url").alias("src"), "page_no"), "src")
        shown = written(shown.select("page_no", "pos", F.col("dst").alias("url")), "links")
        links, seen = (shown, asked) if links is None else (links.unionByName(shown), seen.unionByName(asked))
        found = ordering.until_nothing_new(links, pages=seen)
        ended = ordering.new_per_page(links, pages=seen).filter(F.col("new_count") == 0)
        if asked.isEmpty() or not ended.isEmpty() or found.count() >= limit:
            break
    return ordering.first_n(found, limit, "page_no", "pos").select("page_no", "pos", "url")


def from_sitemap(root: str, fetch: Fetch, site: Site, limit: int, max_sitemaps: int = 50) -> DataFrame:
    """(url, lastmod, ord) of the latest articles that a tree of sitemaps lists; one that fails lists nothing."""

    def read(urls: list[str]) -> DataFrame:
        # a block of sitemaps, bounded by max_sitemaps
        return fetch(SparkSession.active().createDataFrame([(u,) for u in urls], "url string")).filter(F.col("html").isNotNull()).select("url", F.col("html").alias("xml"))

    return crawl.sitemaps(read, root, site.article, limit, max_sitemaps).withColumnRenamed("loc", "url")


def collected(addresses: DataFrame, fetch: Fetch, site: Site) -> DataFrame:
    """ARTICLE columns and ``error`` of each address (url): fetched, then extracted. An error is the request's, or why the page is no article."""
    out = P.extracted(fetch(addresses), site.source, keep=["error"], **site.how())
    error = F.coalesce("error", P.refused(site.least))
    return out.withColumn("error", error)


def crawled(first: Callable[[], DataFrame], second: Callable[[], DataFrame], fetch: Fetch, site: Site) -> DataFrame:
    """``collected`` over the addresses of the first way to find some, or of the second where the first finds none."""
    return collected(crawl.either(first().select("url"), lambda: second().select("url")), fetch, site)
