"""The four pipelines from pages to training text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import pages as P
from textloom.functions.text import Rules, no_null, prompt
from textloom.operators import annotate as A
from textloom.operators import chat, ordering, qa
from textloom.sources import files


@dataclass(frozen=True)
class Site:
    """What differs between sites. Defaults are neutral."""

    source: str
    article: str
    domain: str | None = None
    containers: tuple[str, ...] = P.DEFAULT_CONTAINERS
    rules: Rules = field(default_factory=Rules)
    paragraph: int = 35
    least: int = 200
    names: tuple[str, ...] = ()
    pick: str = "priority"
    date_form: str | None = None
    open_references: bool = True

    def how(self) -> dict:
        """Arguments of the page extraction."""
        return {k: getattr(self, k) for k in ("containers", "rules", "paragraph", "least", "names", "pick", "date_form", "open_references")}


def article_urls(pages: DataFrame, site: Site, limit: int, page_no: str = "page_no", max_pages: int | None = None, stop: bool = True) -> DataFrame:
    """(url, page_no, pos) of the first addresses that listing pages (url, html, page_no) show, in order."""
    if limit <= 0 or max_pages is not None and max_pages <= 0:
        raise ValueError("limits are positive numbers")
    found = P.links(pages, site.article, site.domain).join(pages.select(F.col("url").alias("src"), page_no), "src").select(page_no, "pos", F.col("dst").alias("url"))
    one = ordering.until_nothing_new(found, page_no, max_pages=max_pages, pages=pages) if stop else ordering.first_occurrence(found, ["url"], [page_no, "pos"])
    return ordering.first_n(one, limit, page_no, "pos")


def scrape(pages: DataFrame, site: Site) -> DataFrame:
    """ARTICLE rows of fetched pages (url, html)."""
    return P.articles(pages.filter(F.col("html").isNotNull()), site.source, **site.how())


def annotated(articles: DataFrame, provider: Callable[[], A.Provider], row_no: str = "row_no", start_row: int = 1, max_rows: int | None = None, max_chars: int = 12_000, cut: Iterable[str] = (), drop: Iterable[str] = (), settings: A.Settings | None = None) -> DataFrame:
    """ANNOTATED rows of numbered articles: rows are chosen first, so that no request is made for one that is not."""
    rows = ordering.required(articles, start_row, max_rows, row_no)
    asked = rows.withColumn("prompt", prompt(max_chars, cut, drop)).select(*(no_null(c).alias(c) for c in ("title", "source", "published_at", "url", "text")), "prompt")
    return A.annotate(asked, provider, settings)


def annotated_one(spark: SparkSession, provider: Callable[[], A.Provider], max_chars: int = 12_000, settings: A.Settings | None = None, **values: str | None) -> DataFrame:
    """(value): one article given by hand, with its pairs, as indented JSON; a failed request is an error, not a row."""
    asked = files.one_article(spark, **values).withColumn("prompt", prompt(max_chars))
    out = A.annotate(asked, provider, settings)
    pairs = F.when(F.col("error").isNull(), F.col("pairs")).otherwise(F.raise_error(F.col("error")).cast(out.schema["pairs"].dataType))
    return files.pretty(out.select("title", "source", "published_at", "url", "text", pairs.alias("pairs")))


def flattened(records: DataFrame, deduplicate: bool = True) -> DataFrame:
    """question and answer of JSON records (idx, obj)."""
    return qa.flatten_variants(records, deduplicate=deduplicate).select("question", "answer")


def training_text(pairs: DataFrame, template: chat.Template | None = None) -> DataFrame:
    """messages and text of question-answer rows."""
    return chat.with_text(qa.messages(pairs), template).select("messages", "text")
