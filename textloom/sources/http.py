"""Pages over HTTP: one partition a host, a session of retries and delays in each, failures as rows.

``register(spark)`` adds the data source ``textloom_http``; ``fetch`` does the same for a DataFrame of addresses. Both
give (url, status, html, error). Providers are tried in turn, the first that gives a page wins.
"""

from __future__ import annotations

import importlib
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "url string, status int, html string, error string"
STATUSES = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Policy:
    timeout: float = 30.0
    retries: int = 5
    backoff: float = 1.0
    delay: float = 1.0
    agent: str = "textloom/0.1"


def decoded(body: bytes, content_type: str = "") -> str:
    """By the header's charset, the page's own, or UTF-8."""
    found = re.search(r"charset=[\"']?([\w-]+)", content_type) or re.search(rb"(?i)<meta[^>]+charset=[\"']?([\w-]+)", body[:2048])
    name = found[1].decode() if found and isinstance(found[1], bytes) else found[1] if found else "utf-8"
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


class UrlProvider:
    """Plain requests by the standard library. Retries for STATUSES and broken connections, twice as long each time."""

    def __init__(self, policy: Policy | None = None, sleep: Callable[[float], None] = time.sleep):
        self.policy, self.sleep = policy or Policy(), sleep

    def get(self, url: str) -> tuple[int, str]:
        for n in range(self.policy.retries + 1):
            try:
                request = urllib.request.Request(url, headers={"User-Agent": self.policy.agent, "Accept-Language": "en,*;q=0.5"})
                with urllib.request.urlopen(request, timeout=self.policy.timeout) as r:  # noqa: S310
                    return r.status, decoded(r.read(), r.headers.get("Content-Type", ""))
            except urllib.error.HTTPError as e:
                if e.code not in STATUSES or n == self.policy.retries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n == self.policy.retries:
                    raise
            self.sleep(self.policy.backoff * 2**n)
        raise AssertionError


class BrowserProvider:
    """A headless browser, where the optional library is installed; it starts with the first page."""

    def __init__(self, policy: Policy | None = None, settle: float = 0.7, headed: bool = False):
        self.policy, self.settle, self.headed, self.page = policy or Policy(), settle, headed, None

    def get(self, url: str) -> tuple[int, str]:
        if self.page is None:
            run = importlib.import_module("playwright.sync_api").sync_playwright().start()
            self.page = run.chromium.launch(headless=not self.headed).new_page(user_agent=self.policy.agent)
        r = self.page.goto(url, timeout=self.policy.timeout * 1000, wait_until="domcontentloaded")
        if r is not None and r.status >= 400:
            raise RuntimeError(f"HTTP {r.status}")
        time.sleep(self.settle)
        return (r.status if r else 200), self.page.content()


class StoredProvider:
    """Pages from a mapping: tests and repeats without a network."""

    def __init__(self, pages: dict[str, str]):
        self.pages = pages

    def get(self, url: str) -> tuple[int, str]:
        if url not in self.pages:
            raise RuntimeError("HTTP 404")
        return 200, self.pages[url]


def providers(mode: str = "auto", policy: Policy | None = None) -> list:
    chain = {"requests": [UrlProvider], "browser": [BrowserProvider], "auto": [UrlProvider, BrowserProvider]}
    if mode not in chain:
        raise ValueError(f"mode is one of {', '.join(chain)}")
    return [p(policy) for p in chain[mode]]


def first_page(chain: list, url: str) -> tuple[int | None, str | None, str | None]:
    """(status, html, error): the first provider that succeeds, else the last error."""
    error = "no provider"
    for p in chain:
        try:
            return (*p.get(url), None)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    return None, None, error


def fetch(urls: DataFrame, make: Callable[[], list], delay: float = 0.0) -> DataFrame:
    """PAGE rows of addresses; those of a host stay together, so that the delay between requests holds for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = make()
        for rows in batches:
            out = []
            for u in rows["url"]:
                out.append((u, *first_page(chain, u)))
                if delay:
                    time.sleep(delay)
            yield pd.DataFrame(out, columns=["url", "status", "html", "error"]).astype({"status": "Int32"})

    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    return urls.select("url").repartition(host).mapInPandas(run, PAGE)


@dataclass
class _Host(InputPartition):
    urls: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.options.get("urls", "").split():
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(us) for us in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        o = self.options
        policy = Policy(*(float(o.get(k, d)) if k != "retries" else int(o.get(k, d)) for k, d in (("timeout", 30), ("retries", 5), ("backoff", 1), ("delay", 1))))
        chain = providers(o.get("mode", "auto"), policy)
        for u in partition.urls:
            yield (u, *first_page(chain, u))
            time.sleep(policy.delay)


class HttpPages(DataSource):
    """Options: urls (separated by blanks), mode, timeout, retries, backoff, delay."""

    @classmethod
    def name(cls) -> str:
        return "textloom_http"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPages)
