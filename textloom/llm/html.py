"""Main text of web pages (operator 5) by two passes of block rules.

The page is split once into blocks: runs of text between block-level tags, with the characters inside links. Containers
that never hold the article (head, script, style, nav, header, footer, aside, form and the like, or class and id names of
adverts, notices, forms and reader comments) drop their blocks outright. Names of menus, sharing bars and link lists do so
outside a marked article; inside they only make a block suspect. A class or id counts if all its hyphenated words are
such names or say nothing (site-footer, but not has-sidebar). A name never drops a container that holds the only main, or
more text outside links than all that is left (reader comments excepted). Where the page marks its article (article or
main), only blocks in there stand for trial.

Pass one looks at each block alone. Its link density is the share of its characters that stand in links (white space left
out on both sides), its stop-word density the share of its words that are in a list. A block of links is bad outside a
marked article; inside one it is bad as a suspect, or in a run of such blocks (a menu). Other blocks of links, and those
under ``SHORT_CHARS`` and headings, stay open. Of the rest, long ones with many stop words are good, those with few are
bad outside a marked article and open in it, and those between are near good.

Pass two: an open block takes the label of the nearest decided block (bad if two at equal distance differ), but inside a
marked article it is bad between two bad ones only. A near one is good beside a good one, and in a marked article anyway,
and a heading belongs to what follows it. Where no block
is good, near ones with many stop words count as good, and where none is either, all that is not bad is kept. Where a
page's long blocks together have too few stop words, the list does not know the language (or it writes no spaces), and
length and link density alone decide.

Nulls and empty pages give an empty text. Markup that is never closed ends with its parent: an open ``p`` or ``b`` ends
at the next block tag. One page is parsed in memory; each tag costs constant time besides the elements that it closes.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Everything that is markup: comments, raw-text elements, declarations, tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select|object|canvas|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^<>])*+)>|<[!?/][^<>]*>""",
    re.S | re.I,
)
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link "
    "main menu meta nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("head nav header footer aside form button menu dialog fieldset audio video label".split())
SCOPE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEM = HEADING | frozenset("li dt dd td th option".split())
NAMES = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|navbar|breadcrumbs?|masthead|footer|sidebar|side-bar|aside|widget|related|share|sharing|social|cookies?|consent|notice|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|comments?|respond|reply|disqus|pagination|pager|tags|toolbar|skip|disclaimer|copyright",
    re.I,
)
#: Those that inside a marked article make a block suspect only.
SUSPECT = re.compile(r"menu|nav\w*|navbar|breadcrumbs?|masthead|footer|widget|related|share|sharing|social|alert|pagination|pager|tags|toolbar|skip|disclaimer|copyright", re.I)
#: Words that say nothing beside a name.
PLAIN = re.compile(r"site|page|global|main|primary|secondary|top|bottom|left|right|upper|lower|box|bar|block|list|links?|items?|section|area|container|slot|unit|form|body|text|message|buttons?|post|posts|media|side|to|the|\d*", re.I)
#: Headers of the page go, those of the article stay; an article whose names say comment is a reader's.
HEADER, COMMENT = re.compile(r"header", re.I), re.compile(r"comments?|respond|reply|disqus", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
STOP = frozenset(
    "the of and to in a is that for it was on as with be by this are at from or an not but have he his they which you we her she had been their has were will would there all one "
    "der die das und von zu den mit im nicht ein eine sich auf für ist dem des auch als an er es aus bei nach wie sind wird oder "
    "de la le les et des un une du que est dans pour sur pas par au avec il elle ce qui ne se plus sont ou "
    "el los las y en del por para con una no su al lo como más o pero sus es si".split()
)
WHITE, EDGE = re.compile(r"\s+"), re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Letters that stand for a syllable or a word count twice towards a block's length.
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
LONG_CHARS, SHORT_CHARS, STOP_LOW, STOP_HIGH, MOST_LINKS, ALL_LINKS = 200, 70, 0.05, 0.12, 0.5, 0.95


@dataclass
class Block:
    text: str
    links: int
    scoped: bool
    heading: bool
    label: str = ""
    named: int = -1  # the innermost container around it that its name would drop
    suspect: bool = False
    chars: int = 0  # of the text, without white space; links counts likewise


def _solid(text: str) -> int:
    """Characters without white space."""
    return len("".join(text.split()))


def _names(value: str, name: re.Pattern[str]) -> bool:
    """Whether one of the class or id tokens says the name and nothing else of weight."""
    for token in value.split():
        words = re.split("[_-]+", token)
        if name.fullmatch(token) or any(map(name.fullmatch, words)) and all(name.fullmatch(w) or PLAIN.fullmatch(w) for w in words):
            return True
    return False


def _unwanted(tag: str, attributes: str, scoped: bool) -> str:
    """Why a container is unwanted: "kind" for good, "name" or "comment" by its names only, "suspect"; empty where it is not."""
    if tag in DROP and not (tag == "header" and scoped):
        return "kind"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    if HIDDEN.search(attributes):
        return "kind"
    why = ""
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        k, v = k.lower(), a or b or c
        if k in ("class", "id"):
            if _names(v, COMMENT):
                why = "comment"
            elif scoped and _names(v, SUSPECT):
                why = why or "suspect"
            elif why in ("", "suspect") and tag != "article" and (_names(v, NAMES) or not scoped and _names(v, HEADER)):
                why = "name"
        elif k == "role" and v.lower() in ROLES:
            return "kind"
    return why


def _spared(found: list[Block], named: list[tuple[int, str]], scopes: list[tuple[str, int]]) -> set[int]:
    """The containers that their names do not drop: those around the only main, and those that hold most of the text."""
    spared = {-1}
    marked = any(at < 0 for _, at in scopes)
    if not marked:
        for tag, at in scopes:
            while tag == "main" and at not in spared:
                spared.add(at)
                at = named[at][0]
    own, children = [0] * (len(named) + 1), [[] for _ in range(len(named) + 1)]  # the last entry is the page
    for b in found:
        if b.scoped or not marked:
            own[b.named] += max(b.chars - b.links, 0)
    inside = own[:]
    for i in range(len(named) - 1, -1, -1):
        inside[named[i][0]] += inside[i]
        children[named[i][0]].append(i)
    left, heap = own[-1], []
    open_ = [-1]
    while open_:
        for i in children[open_.pop()]:
            if i in spared:
                left += own[i]
                open_.append(i)
            elif named[i][1] != "comment":
                heapq.heappush(heap, (-inside[i], i))
        if not open_ and heap and -heap[0][0] > left:
            i = heapq.heappop(heap)[1]
            spared.add(i)
            left += own[i]
            open_.append(i)
    return spared


def blocks(page: str) -> tuple[list[Block], bool]:
    """The blocks of a page outside unwanted containers, and whether it marks its article."""
    out: list[Block] = []
    parts: list[str] = []
    # open elements: tag, unwanted inside, in an article, innermost of named, suspect
    stack: list[tuple[str, bool, bool, int, bool]] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    open_blocks: list[int] = []  # where in the stack block elements are open
    named: list[tuple[int, str]] = []  # containers unwanted by name: the one around it, why
    scopes: list[tuple[str, int]] = []  # article and main elements: tag, innermost of named
    links = linked = 0
    heading = False
    at = 0

    def unwanted() -> bool:
        return bool(stack) and stack[-1][1]

    def scoped() -> bool:
        return bool(stack) and stack[-1][2]

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not unwanted():
            parts.append(raw)
            if links:
                linked += _solid(html.unescape(raw))

    def end() -> None:
        nonlocal linked
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked, scoped(), heading, named=stack[-1][3] if stack else -1, suspect=bool(stack) and stack[-1][4], chars=_solid(text)))
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        while len(stack) > i:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in BLOCK:
                open_blocks.pop()

    for m in TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = m[3].lower() if m[3] else ""
        if not tag:
            continue
        block = tag in BLOCK
        if block:
            end()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            # an inline element does not end a block that was opened inside it
            if places.get(tag) and (block or not open_blocks or places[tag][-1] > open_blocks[-1]):
                close(places[tag][-1])
            if tag in HEADING:
                heading = False
        elif tag not in VOID and not m[4].endswith("/"):
            if block:
                links = 0
                inner = stack[open_blocks[-1]][0] if open_blocks else ""
                if inner == "p" or inner == tag and tag in ITEM:  # an open paragraph, or item of the same kind, ends here
                    close(open_blocks[-1])
            if tag == "a":
                links += 1
            why = "kind" if unwanted() else _unwanted(tag, m[4], scoped())
            bad, inside, within = why == "kind", scoped() or tag in SCOPE, stack[-1][3] if stack else -1
            doubt = why == "suspect" or bool(stack) and stack[-1][4]
            if why and why != "suspect" and not bad:
                named.append((within, why))
                within = len(named) - 1
            if tag in SCOPE and not bad:
                scopes.append((tag, within))
            if block or why:
                places.setdefault(tag, []).append(len(stack))
                if block:
                    open_blocks.append(len(stack))
                stack.append((tag, bad, inside, within, doubt))
            if tag in HEADING:
                heading = True
    take(page[at:])
    end()
    spared = _spared(out, named, scopes) if named else {-1}
    return [b for b in out if b.named in spared], any(at in spared for _, at in scopes)


def _stops(words: list[str]) -> int:
    return sum(EDGE.sub("", w) in STOP for w in words)


def pass_one(found: list[Block], marked: bool) -> list[str]:
    """Each block's own label: good, near (near! with many stop words), open or bad."""
    density = [b.links / max(b.chars, 1) for b in found]
    words = [b.text.lower().split() for b in found]
    long_ = [i for i, b in enumerate(found) if not b.heading and len(b.text) >= SHORT_CHARS and density[i] <= MOST_LINKS]
    stops = [_stops(w) for w in words]
    known = sum(stops[i] for i in long_) >= STOP_LOW * sum(len(words[i]) for i in long_)
    out = []
    for i, b in enumerate(found):
        n, stop = len(b.text), stops[i] / max(len(words[i]), 1)
        if not known:
            n += len(WIDE.findall(b.text))
        if density[i] > MOST_LINKS and not b.heading:
            menu = density[i] >= ALL_LINKS and any(0 <= j < len(found) and density[j] >= ALL_LINKS for j in (i - 1, i + 1))
            out.append("bad" if not marked or b.suspect or menu else "open")
        elif b.heading or n < SHORT_CHARS:
            out.append("open")
        elif not known or stop >= STOP_HIGH:
            out.append("good" if n >= LONG_CHARS else "near!")
        elif stop >= STOP_LOW:
            out.append("near")
        else:
            out.append("open" if marked else "bad")
    return out


def pass_two(found: list[Block], labels: list[str], marked: bool) -> list[str]:
    """Good or bad for each block, from the labels of pass one and the nearest decided neighbours."""
    if "good" not in labels:  # a page of middling blocks only: those with many stop words decide
        labels = ["good" if x == "near!" else x for x in labels]
    n = len(found)
    far = (n + 1, "good" if marked else "bad")  # what lies beyond the first and the last block
    left, right = [far] * n, [far] * n
    for order, side, step in ((range(n), left, -1), (range(n - 1, -1, -1), right, 1)):
        for i in order:
            j = i + step
            if 0 <= j < n:
                side[i] = (1, labels[j]) if labels[j] in ("good", "bad") else (side[j][0] + 1, side[j][1])
    out = []
    for i, b in enumerate(found):
        a, z = left[i], right[i]
        if labels[i] != "open":
            out.append(labels[i] if not labels[i].startswith("near") else "good" if marked or "good" in (a[1], z[1]) else "bad")
        elif b.heading:
            out.append((z if z[0] <= n else a)[1])
        elif a[1] == z[1]:
            out.append(a[1])
        else:
            out.append("good" if marked else "bad" if a[0] == z[0] else min(a, z)[1])
    return out


def classify(found: list[Block], marked: bool) -> list[Block]:
    """Both passes; returns the good blocks."""
    if marked:
        found = [b for b in found if b.scoped]
    labels = pass_one(found, marked)
    final = pass_two(found, labels, marked)
    if "good" not in final:
        # nothing stands out: keep what pass one left, and long blocks that are no links
        final = ["good" if was != "bad" or len(b.text) >= SHORT_CHARS and b.links / max(b.chars, 1) <= MOST_LINKS else x for b, was, x in zip(found, labels, final, strict=True)]
    for b, x in zip(found, final, strict=True):
        b.label = x
    return [b for b in found if b.label == "good"]


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(*blocks(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
