"""Breadth-first crawls over a link table, one DataFrame frontier at a time; paging over stored or fetched pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.tables import shared_dir


def bfs(edges: DataFrame, seeds: Sequence[str], max_depth: int = 10, max_pages: int | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(url, depth) of what the seeds reach over edges (src, dst), the seeds at depth 0.

    A level is the distinct targets of the last one that no level has; each is checkpointed, so plans stay short and a
    lost executor costs one level. Pages listed in ``failed`` (url) count as visited but give no links. ``max_pages``
    bounds the pages scanned: once so many are visited, no further level is read.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    level = spark.createDataFrame([(u,) for u in dict.fromkeys(seeds)], "url string")
    seen = level.withColumn("depth", F.lit(0))
    links = edges if failed is None else edges.join(failed.select(F.col("url").alias("src")), "src", "left_anti")
    scanned = level.count()
    for depth in range(1, max_depth + 1):
        if max_pages is not None and scanned > max_pages:
            break
        level = links.join(level.withColumnRenamed("url", "src"), "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").checkpoint()
        new = level.count()
        if not new:
            break
        scanned += new
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth)))
    return seen


def discovered(edges: DataFrame, visited: DataFrame, limit: int | None = None) -> DataFrame:
    """(url, depth, src, pos): targets of visited pages at their first occurrence, by depth, page and position."""
    first = edges.join(visited.withColumnRenamed("url", "src"), "src").groupBy("dst").agg(F.min(F.struct("depth", "src", "pos")).alias("f"))
    out = first.select(F.col("dst").alias("url"), "f.depth", "f.src", "f.pos")
    return out if limit is None else out.orderBy("depth", "src", "pos").limit(limit)


def sitemaps(fetch: Callable[[list[str]], DataFrame], root: str, pattern: str, limit: int, max_sitemaps: int = 50) -> DataFrame:
    """Article addresses of a sitemap tree, latest first. ``fetch`` gives (url, xml) for addresses; failures give no row."""
    from textloom.functions import urls
    from textloom.operators.ordering import latest_first
    from textloom.sources.sitemap import children, entries

    queue, visited, found = [root], [], None
    while queue and len(visited) < max_sitemaps:
        batch = [u for u in queue if u not in visited][: max_sitemaps - len(visited)]
        visited += batch
        docs = fetch(batch).persist()
        rows = entries(docs).filter(urls.matches("loc", pattern)).withColumn("ord", F.col("ord") + F.lit(len(visited)) * F.lit(1 << 40))
        found = rows if found is None else found.unionByName(rows)
        # a site's tree of sitemaps is small, and bounded by max_sitemaps
        queue = [r.loc for r in children(docs).select("loc").distinct().limit(10 * max_sitemaps).collect()] if batch else []
    return latest_first(found, limit)


def either(first: DataFrame, second: Callable[[], DataFrame]) -> DataFrame:
    """The first source, or the second if the first has no row."""
    return first if not first.isEmpty() else second()


def listing_pages(links: DataFrame, prefix: str, not_these: Sequence[str] = (), words: Sequence[str] = ("page",), ends: Sequence[str] = ("/news",)) -> DataFrame:
    """Links that lead to further listing pages: below a prefix, with a paging word or ending."""
    d = F.col("dst")
    paging = F.lit(False)
    for w in words:
        paging = paging | F.contains(d, F.lit(w))
    for e in ends:
        paging = paging | F.endswith(d, F.lit(e))
    return links.filter(F.startswith(d, F.lit(prefix)) & paging & ~d.isin(*not_these, ""))
