"""Order, first occurrences and limits. Rows carry their order in a column; nothing depends on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.tables import written


def first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in order. Partial minima before the shuffle, so a frequent key is cheap."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_first") if not any(t.startswith(("map", "variant")) for c, t in df.dtypes if c in rest) else F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    out = df.groupBy(*keys).agg(least)
    return out.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns))


def new_per_page(links: DataFrame, page: str = "page_no", pos: str = "pos", url: str = "url", pages: DataFrame | None = None) -> DataFrame:
    """(page_no, new_count): how many addresses a page shows for the first time. ``pages`` lists pages that may show none; without it only those in ``links`` are known."""
    first = links.groupBy(url).agg(F.min(F.struct(page, pos)).alias("f")).groupBy(F.col(f"f.{page}").alias(page)).agg(F.count(F.lit(1)).alias("n"))
    return (links if pages is None else pages).select(page).distinct().join(first, page, "left").select(page, F.coalesce("n", F.lit(0)).cast("long").alias("new_count"))


def until_nothing_new(links: DataFrame, page: str = "page_no", pos: str = "pos", url: str = "url", max_pages: int | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Links of the pages before the first that shows nothing new (or beyond a page cap), first occurrences only."""
    counts = new_per_page(links, page, pos, url, pages)
    stop = counts.filter(F.col("new_count") == 0).agg(F.min(page).alias("stop"))  # one row
    kept = links.join(F.broadcast(stop), F.col("stop").isNull() | (F.col(page) < F.col("stop"))).drop("stop")
    if max_pages is not None:
        kept = kept.filter(F.col(page) <= max_pages)
    return first_occurrence(kept, [url], [page, pos])


def first_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    if n <= 0:
        raise ValueError("a limit is a positive number")
    return df.orderBy(*order).limit(n)


def latest_first(df: DataFrame, n: int, lastmod: str = "lastmod", url: str = "loc", ord_: str = "ord") -> DataFrame:
    """Sitemap order: last change descending as a string (missing ones last), ties as found, one row an address."""
    one = df.groupBy(url).agg(F.max(F.struct(F.coalesce(lastmod, F.lit("")).alias("m"), (-F.col(ord_)).alias("o"))).alias("f"))
    return one.select(url, F.nullif(F.col("f.m"), F.lit("")).alias(lastmod), (-F.col("f.o")).alias(ord_)).orderBy(F.coalesce(lastmod, F.lit("")).desc(), ord_).limit(n)


def numbered(df: DataFrame, *order: str | Column, name: str = "row_no") -> DataFrame:
    """Adds dense numbers from 1 without bringing all rows to one task: each row's place in its range, then the ranges' sizes.

    The ranged rows are written once and read twice. Planned twice they would be ranged twice, by other samples, and the
    sizes would not fit the ranges. Rows that tie in order are numbered as the writing task met them.
    """
    free = lambda n: n if n not in df.columns else free("_" + n)
    at, base = free("_at"), free("_base")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the upper bits are the range, the lower 33 the place in it
    ranged = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    sizes = ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("p").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    out = ranged.join(F.broadcast(bases), part == F.col("_p"))
    return out.withColumn(name, (F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop(at, base, "_p")


def required(df: DataFrame, start_row: int = 1, max_rows: int | None = None, row_no: str = "row_no", columns: Sequence[str] = ("url", "text")) -> DataFrame:
    """Rows from ``start_row`` on that have all columns, at most ``max_rows`` of these: skipped rows use up nothing."""
    from textloom.functions.text import no_null

    out = df.filter(F.col(row_no) >= start_row)
    for c in columns:
        out = out.filter(no_null(c) != "")
    return out if max_rows is None else out.orderBy(row_no).limit(max_rows)
