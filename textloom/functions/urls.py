"""URL expressions: normalising, filtering, page addresses."""

from __future__ import annotations

from datetime import date
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.text import col, strip


def without_fragment(href: Column | str) -> Column:
    return strip(F.substring_index(col(href), "#", 1))


def resolve(href: Column | str, base: Column | str) -> Column:
    """An address relative to a base, for absolute, ``//host`` and ``/path`` forms; null for those that need ``resolve_any``."""
    h, b = without_fragment(href), col(base)
    scheme, site = F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    plain = ~F.rlike(h, F.lit(r"(^|/)\.\.?(/|$|\?)"))
    return (
        F.when(h == "", F.substring_index(b, "#", 1))
        .when(F.rlike(h, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), h)
        .when(F.startswith(h, F.lit("//")) & plain, F.concat(scheme, F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")) & plain, F.concat(site, h))
    )


@F.pandas_udf(StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    out = []
    for b, h in zip(base, href, strict=True):
        try:
            out.append(None if b is None or h is None else urljoin(b, h))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


def resolve_any(href: Column | str, base: Column | str) -> Column:
    """The full rules of RFC 3986; null if the parts make no address."""
    return _join(col(base), without_fragment(href))


def host_ends_with(url: Column | str, domain: str) -> Column:
    return F.coalesce(F.endswith(F.try_parse_url(col(url), F.lit("HOST")), F.lit(domain)), F.lit(False))


def matches(url: Column | str, pattern: str) -> Column:
    """An allow-pattern of article addresses, anchored at the start."""
    return F.rlike(col(url), F.lit(f"^(?:{pattern})"))


def numbered_pages(spark: SparkSession, base: str, pages: int, rest: str = "page/%d/") -> DataFrame:
    """(page_no, url): the base itself, then numbered ones; ``rest`` may also be a query such as ``?page=%d``."""
    base = base if rest.startswith("?") else base.rstrip("/") + "/"
    return spark.range(1, pages + 1).select(F.col("id").alias("page_no"), F.when(F.col("id") == 1, F.lit(base)).otherwise(F.format_string(base.replace("%", "%%") + rest, "id")).alias("url"))


def day_pages(spark: SparkSession, template: str, first: date, last: date, latest: str | None = None, today: date | None = None) -> DataFrame:
    """(page_no, url) of a date archive, latest day first. ``%s`` takes ddMMyyyy; today's page is ``latest``."""
    if first > last:
        raise ValueError("the first day is after the last")
    days = spark.range(1).select(F.posexplode(F.sequence(F.lit(last), F.lit(first), F.expr("interval -1 day"))).alias("pos", "day"))
    url = F.format_string(template, F.date_format("day", "ddMMyyyy"))
    if latest and last == (today or date.today()):
        url = F.when(F.col("pos") == 0, F.lit(latest)).otherwise(url)
    return days.select((F.col("pos") + 1).cast("long").alias("page_no"), url.alias("url"))
