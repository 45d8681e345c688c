"""Sitemap XML in a column: entries and child sitemaps. Namespaces do not matter; entries without loc fall out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip


def _elements(docs: DataFrame, name: str, xml: str) -> DataFrame:
    # the element's own text, so that nested tags of other kinds (images, news) do not count
    body = F.regexp_replace(F.coalesce(F.col(xml), F.lit("")), r"(?s)<!--.*?-->", "")
    return docs.select("url", F.posexplode(F.regexp_extract_all(body, F.lit(rf"(?is)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{name}\s*>"), F.lit(1))).alias("ord", "e"))


def _field(name: str):
    raw = strip(F.regexp_extract("e", rf"(?is)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>(.*?)</", 1))
    cdata = F.regexp_replace(raw, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    return F.nullif(F.replace(strip(cdata), F.lit("&amp;"), F.lit("&")), F.lit(""))


def entries(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """(url, ord, loc, lastmod) of documents (url, xml)."""
    return _elements(docs, "url", xml).select("url", F.col("ord").cast("long").alias("ord"), _field("loc").alias("loc"), _field("lastmod").alias("lastmod")).filter(F.col("loc").isNotNull())


def children(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """(url, ord, loc) of child sitemaps."""
    return _elements(docs, "sitemap", xml).select("url", F.col("ord").cast("long").alias("ord"), _field("loc").alias("loc")).filter(F.col("loc").isNotNull())


def read_files(spark, path: str) -> DataFrame:
    """(loc, lastmod) of sitemap files, by the XML reader."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).withColumn("loc", strip("loc")).filter(F.coalesce("loc", F.lit("")) != "")
