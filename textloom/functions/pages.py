"""Pages: links and metadata by built-in expressions, the element tree by one UDF that parses a page once.

``parsed`` gives a struct; what follows it (paragraph floors, the choice of container, titles, body slices) is built in.
Text belongs to the innermost open block, once; a paragraph that is not closed ends at the next block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import dates, text, urls
from textloom.functions.text import Rules, col

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"
OG_TITLE = r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']og:title["'][^>]*\bcontent\s*=\s*["']([^"']*)["']"""
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))

PAGE = "struct<h1:string,title:string,og_title:string,lines:array<string>,blocks:array<struct<container:int,tag:string,text:string,linked:int>>>"
_ARROW = pa.struct({"h1": pa.string(), "title": pa.string(), "og_title": pa.string(), "lines": pa.list_(pa.string()), "blocks": pa.list_(pa.struct({"container": pa.int32(), "tag": pa.string(), "text": pa.string(), "linked": pa.int32()}))})
SLICE = 1 << 20
DEFAULT_CONTAINERS = ("article", "main article", "div.post-content", "div.entry-content", "main")
_BLOCK = frozenset("address article aside blockquote body br dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript".split())
_UNITS = frozenset("p li blockquote".split())
_REFERENCE = re.compile(r"&(?!amp)(?!#(?:\d+|[xX][0-9a-fA-F]+);)(?=[#\w])(\w+;)?")


def hrefs(html: Column | str) -> Column:
    """Link targets of a page in order, as written."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(HREF), F.lit(1)), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))


def links(pages: DataFrame, pattern: str | None = None, domain: str | None = None, base: Column | None = None, page: str = "url", html: str = "html") -> DataFrame:
    """(src, pos, dst): the distinct addresses that a page links to, first occurrences in order, absolute and filtered."""
    rows = pages.select(F.col(page).alias("src"), (base if base is not None else F.col(page)).alias("_base"), F.posexplode(hrefs(html)).alias("pos", "href"))
    simple = rows.withColumn("dst", urls.resolve("href", "_base"))
    # the rare rest goes through Python, the others do not
    rest = simple.filter(F.col("dst").isNull()).withColumn("dst", urls.resolve_any("href", "_base"))
    out = simple.filter(F.col("dst").isNotNull()).unionByName(rest).filter(F.col("dst").isNotNull())
    if domain:
        out = out.filter(urls.host_ends_with("dst", domain))
    if pattern:
        out = out.filter(urls.matches("dst", pattern))
    return out.groupBy("src", "dst").agg(F.min("pos").alias("pos")).select("src", "pos", "dst")


def plain(fragment: Column) -> Column:
    """A fragment without tags, the usual entities decoded, white space single."""
    out = F.regexp_replace(fragment, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return text.strip(F.regexp_replace(out, r"(?U)\s+", " "))


def h1(html: Column | str) -> Column:
    return plain(F.regexp_extract(col(html), H1, 1))


def without_suffix(title: Column, names: Sequence[str] = ()) -> Column:
    """A title without `` | Site name ...``."""
    return text.strip(F.regexp_replace(title, rf"(?iu)\s+\|\s+(?:{text.quoted(names)}).*$", "")) if names else text.strip(title)


def title(html: Column | str, names: Sequence[str] = ()) -> Column:
    """og:title, else the first h1, else the title tag, else empty."""
    c = F.coalesce(col(html), F.lit(""))
    forms = [without_suffix(plain(F.regexp_extract(c, p, 1)), names) for p in (OG_TITLE, H1, TITLE)]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in forms), F.lit(""))


class _Selector:
    """``tag``, ``tag.class``, ``[name=value]``, ``tag[name=value]``, and ``outer inner``."""

    def __init__(self, form: str):
        *outer, last = form.split()
        self.outer = _Selector(" ".join(outer)) if outer else None
        self.name = self.value = self.cls = None
        if "[" in last:
            last, _, attribute = last.rstrip("]").partition("[")
            self.name, _, self.value = attribute.partition("=")
        last, _, self.cls = last.partition(".")
        self.tag = last or None

    def fits(self, tag: str, attrs: dict[str, str | None], open_: list) -> bool:
        if self.tag and tag != self.tag or self.cls and self.cls not in (attrs.get("class") or "").split() or self.name and attrs.get(self.name) != self.value:
            return False
        return not self.outer or any(self.outer.fits(t, a, open_[:i]) for i, (t, a, _) in enumerate(open_))


class _Page(HTMLParser):
    def __init__(self, containers: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.selectors = [_Selector(c) for c in containers]
        self.open: list[tuple[str, dict, list[int]]] = []
        self.seen: set[int] = set()
        self.lines: list[str] = []
        self.units: list[list] = []  # tag, containers, parts, characters in links
        self.unit: list[int] = []  # open units, as indexes
        self.first: dict[str, list[str]] = {}
        self.inside: str | None = None
        self.og: str | None = None

    def _close(self, i: int) -> None:
        for tag, _, _ in self.open[i:]:
            if tag in _UNITS and self.unit:
                self.unit.pop()
            if tag == self.inside:
                self.inside = None
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("property") == "og:title" and self.og is None:
            self.og = a.get("content")
        if tag in _BLOCK:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p" or tag == self.open[i][0] == "li":
                    self._close(i)
                    break
                if self.open[i][0] in _BLOCK:
                    break
        if tag in _VOID:
            return
        new = [n for n, s in enumerate(self.selectors) if n not in self.seen and s.fits(tag, a, self.open)]
        self.seen.update(new)
        self.open.append((tag, a, new))
        if tag in _UNITS:
            self.unit.append(len(self.units))
            self.units.append([tag, [n for _, _, ns in self.open for n in ns], [], 0])
        if tag in ("h1", "title") and tag not in self.first:
            self.first[tag], self.inside = [], tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return
            if tag not in _BLOCK and self.open[i][0] in _BLOCK:
                return

    def handle_data(self, data):
        s = data.strip()
        if not s or any(t in _HIDDEN for t, _, _ in self.open):
            return
        self.lines += [x.strip() for x in s.splitlines() if x.strip()]
        if self.inside:
            self.first[self.inside].append(s)
        if self.unit:
            unit = self.units[self.unit[-1]]
            unit[2].append(s)
            if any(t == "a" for t, _, _ in self.open):
                unit[3] += len(s)


def parse(page: str | None, containers: Sequence[str] = DEFAULT_CONTAINERS, open_references: bool = True) -> dict:
    """What PAGE lists: container -1 is the whole page, others are positions among the selectors (first match of each).

    Browsers decode some character references that have no semicolon (a title cut after ``&quot``). Without
    ``open_references`` these are text, but for ``&amp``.
    """
    p = _Page(containers)
    page = page or ""
    p.feed(page if open_references else _REFERENCE.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + m[0][1:], page))
    p.close()
    blocks = [{"container": c, "tag": tag, "text": " ".join(parts), "linked": linked} for tag, inside, parts, linked in p.units if parts for c in (-1, *inside)]
    return {"h1": " ".join(p.first["h1"]) if "h1" in p.first else None, "title": " ".join(p.first["title"]) if "title" in p.first else None, "og_title": p.og, "lines": p.lines, "blocks": blocks}


def parse_batches(batches: Iterator[pa.Array], containers: Sequence[str] = DEFAULT_CONTAINERS, open_references: bool = True) -> Iterator[pa.Array]:
    """PAGE structs of Arrow batches of any size: the objects of SLICE bytes of pages (or of one page) are held at a time."""
    for pages in batches:
        for part in text.slices(pages, SLICE):
            yield pa.array([parse(x, containers, open_references) for x in part.to_pylist()], _ARROW)


def parsed(html: Column | str, containers: Sequence[str] = DEFAULT_CONTAINERS, open_references: bool = True) -> Column:
    containers = tuple(containers)

    @F.arrow_udf(PAGE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return parse_batches(batches, containers, open_references)

    return run(col(html))


def paragraphs(page: Column, container: int, tags: Sequence[str] = ("p", "li"), least: int = 0) -> Column:
    rows = F.filter(page["blocks"], lambda b: (b["container"] == container) & b["tag"].isin(*tags) & (F.length(b["text"]) >= least))
    return F.transform(rows, lambda b: b["text"])


def by_priority(page: Column, containers: int, tags: Sequence[str] = ("p", "li"), least: int = 0) -> Column:
    """Paragraphs of the first container that has any block, else of the whole page."""
    has = lambda n: F.exists(page["blocks"], lambda b: b["container"] == n)
    out = paragraphs(page, -1, tags, least)
    for n in range(containers - 1, -1, -1):
        out = F.when(has(n), paragraphs(page, n, tags, least)).otherwise(out)
    return out


def by_length(page: Column, containers: int, rules: Rules, tags: Sequence[str] = ("p", "li", "blockquote")) -> Column:
    """The longest cleaned text of all containers; of the whole page if there is none, of its lines if that is empty."""
    clean = lambda a: text.site_clean(F.array_join(a, "\n"), rules)
    found = F.exists(page["blocks"], lambda b: b["container"] >= 0)
    best = F.when(found, text.longest(F.array(*(clean(paragraphs(page, n, tags)) for n in range(containers))))).otherwise(clean(paragraphs(page, -1, tags)))
    return F.coalesce(F.nullif(best, F.lit("")), clean(page["lines"]))


def main_text(page: Column, containers: int, rules: Rules) -> Column:
    """Cleaned main text, chosen for precision: paragraphs and quotations of the first container that has any, else of the page.

    Blocks that are links by half or more fall out, and a paragraph that comes again counts once.
    """
    solid = lambda n: F.filter(page["blocks"], lambda b: (b["container"] == n) & b["tag"].isin("p", "blockquote") & (2 * b["linked"] < F.length(b["text"])))
    blocks = solid(-1)
    for n in range(containers - 1, -1, -1):
        blocks = F.when(F.size(solid(n)) > 0, solid(n)).otherwise(blocks)
    return text.site_clean(F.array_join(F.array_distinct(F.transform(blocks, lambda b: b["text"])), "\n"), rules)


def after_title(lines: Column, heading: Column, stop: Sequence[str] = (), date: Column | None = None, agency: str | None = None, last: bool = False) -> Column:
    """The lines after the one that equals the heading, up to a stop prefix, without a leading date and agency line; null without such a line."""
    at = F.array_position(lines, heading)
    if last:
        at = F.when(at > 0, F.size(lines) - F.array_position(F.reverse(lines), heading) + 1).otherwise(F.lit(0))
    body = text.until_prefix(F.slice(lines, (at + 1).cast("int"), F.size(lines)), stop) if stop else F.slice(lines, (at + 1).cast("int"), F.size(lines))
    rest = lambda a, drop: F.when(drop, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    if date is not None:
        body = rest(body, F.coalesce(F.get(body, 0) == date, F.lit(False)))
    if agency is not None:
        body = rest(body, F.coalesce(F.get(body, 0) == agency, F.lit(False)))
    return F.when(at > 0, text.compact(F.array_join(body, "\n")))


def with_fallback(main: Column, fallback: Column, below: int = 1) -> Column:
    """The fallback where the main text is shorter than so many characters."""
    return F.when(F.length(F.coalesce(main, F.lit(""))) < below, F.coalesce(fallback, F.lit(""))).otherwise(main)


def extracted(
    pages: DataFrame, source: str, containers: Sequence[str] = DEFAULT_CONTAINERS, rules: Rules | None = None, paragraph: int = 35, least: int = 200, names: Sequence[str] = (), pick: str = "priority", date_form: str | None = None, open_references: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """ARTICLE columns of every page (url, html), each parsed once, whatever it gives; columns in ``keep`` come along.

    ``pick`` is "priority" (paragraphs of so many characters in the first container), "length" (the longest container), or
    "main" (the main text, and where that is shorter than ``least`` what "priority" gives). ``date_form`` is looked for in
    the page's text where its metadata and address give no date. ``open_references``: see ``parse``.
    """
    rules, n = rules or Rules(), len(containers)
    page = F.col("_page")
    by_rank = text.site_clean(F.array_join(by_priority(page, n, least=paragraph), "\n"), rules)
    if pick not in ("priority", "length", "main"):
        raise ValueError("pick is priority, length or main")
    body = by_length(page, n, rules) if pick == "length" else with_fallback(main_text(page, n, rules), by_rank, least) if pick == "main" else by_rank
    heading = F.coalesce(*(F.nullif(without_suffix(page[k], names), F.lit("")) for k in ("og_title", "h1", "title")), F.lit(""))
    lines = F.array_join(page["lines"], "\n")
    published = F.nullif(dates.published("html", lines, "url"), F.lit(""))
    if date_form:
        published = F.coalesce(published, dates.in_text(lines, date_form))
    return pages.select("url", "html", *keep, parsed("html", containers, open_references).alias("_page")).select(F.lit(source).alias("source"), heading.alias("title"), published.alias("published_at"), "url", body.alias("text"), *keep)


def refused(least: int) -> Column:
    """Why an extracted row is no article, null if it is one."""
    body = F.coalesce("text", F.lit(""))
    return F.when(F.coalesce("title", F.lit("")) == "", F.lit("no title")).when(body == "", F.lit("no text")).when(F.length(body) < least, F.concat(F.lit("text under "), F.lit(least), F.lit(" characters")))


def articles(pages: DataFrame, source: str, least: int = 200, **how) -> DataFrame:
    """ARTICLE rows of pages (url, html); pages without a title or with less text than ``least`` fall out. See ``extracted``."""
    return extracted(pages, source, least=least, **how).filter(refused(least).isNull())
