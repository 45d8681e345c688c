"""Boolean trigram queries derived from regular expressions, and evaluated on an inverted index of postings.

A query is in disjunctive form: a list of alternatives, each a set of trigrams of which a matching text has all, in
lower case. ``None`` means that some match needs no trigram: the rule reads every text.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that an expression may expand to before they are taken as they are, members of a class that are spelled out,
#: trigrams kept of one string, documents of one posting.
MOST_STRINGS, MOST_MEMBERS, MOST_TRIGRAMS, BLOCK = 64, 8, 8, 4096


def _members(items: list) -> set[str] | None:
    """Characters of a class in lower case; None if they are many."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 64:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= MOST_MEMBERS else None


def _alternatives(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """What a text that holds one of the strings has; None if one is too short to tell."""
    if any(len(s) < 3 for s in strings):
        return None
    grams = lambda s: list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
    spread = lambda g: g if len(g) <= MOST_TRIGRAMS else [g[i * (len(g) - 1) // (MOST_TRIGRAMS - 1)] for i in range(MOST_TRIGRAMS)]
    return frozenset(frozenset(spread(grams(s))) for s in strings)


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x, y in product(a, b)) if len(a) * len(b) <= MOST_STRINGS else min(a, b, key=len)


def _walk(parsed) -> tuple[set[str] | None, frozenset | None]:
    """(all strings the expression matches, or None; the query of what it matches)."""
    exact: set[str] = {""}
    whole, query = True, None

    def settle() -> None:
        nonlocal exact, query, whole
        query, exact, whole = _both(query, _alternatives(exact)), {""}, False

    for op, arg in parsed:
        some, more = None, None
        if op is C.LITERAL:
            some = {chr(arg).lower()}
        elif op is C.IN:
            some = _members(arg)
        elif op is C.SUBPATTERN:
            some, more = _walk(arg[3])
        elif op is C.BRANCH:
            each = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                some = set().union(*(s for s, _ in each))
            else:
                parts = [q if s is None else _alternatives(s) for s, q in each]
                more = None if any(p is None for p in parts) else frozenset().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            s, q = _walk(inner)
            if high == 1 and s is not None:
                some = s | {""} if low == 0 else s
            elif low >= 1:
                more = q if s is None else _alternatives(s)
        elif op is C.AT:
            continue
        if some is not None and len(exact) * len(some) <= MOST_STRINGS:
            exact = {a + b for a, b in product(exact, some)}
        else:
            settle()
            if some is not None:
                exact = some
            query = _both(query, more)
    if whole:
        return exact, None
    settle()
    return None, query


def derive(pattern: str) -> list[list[str]] | None:
    """The Boolean trigram query of a regular expression."""
    strings, query = _walk(_parser.parse(pattern))
    query = _alternatives(strings) if strings is not None else query
    return None if query is None else sorted(sorted(x) for x in query if not any(y < x for y in query))


def vocabulary(queries: list[list[list[str]] | None]) -> list[str]:
    return sorted({t for q in queries if q for alt in q for t in alt})


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram number, block, ids): the documents that hold a trigram, in blocks of BLOCK ids.

    A trigram that every document holds has one posting a block, so no task gets a whole posting list. Rows without an
    id are not indexed.
    """
    # explode makes the lower-cased text a column of its own: else each of the tests below would lower-case it anew
    low = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(F.lower(F.coalesce(F.col(text_col), F.lit(""))))).alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    rows = low.select("id", has.alias("has")).select("id", F.explode("has").alias("trigram"))
    return rows.groupBy("trigram", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.collect_set("id").alias("ids"))


def candidates(index: DataFrame, trigrams: list[str], queries: list[list[list[str]] | None]) -> DataFrame:
    """(id, mask): bit r is set if the document satisfies query r. Postings of a block are intersected and united."""
    number = {t: i for i, t in enumerate(trigrams)}
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("of"))
    none = F.array().cast("array<bigint>")
    posting = lambda t: F.coalesce(F.try_element_at("of", F.lit(number[t])), none)
    found = []
    for r, query in enumerate(queries):
        for alt in query or []:
            ids = posting(alt[0])
            for t in alt[1:]:
                ids = F.array_intersect(ids, posting(t))
            found.append(F.struct(ids.alias("ids"), F.lit(1 << r).cast("long").alias("bit")))
    each = blocks.select(F.explode(F.array(*found)).alias("x")).select(F.explode("x.ids").alias("id"), F.col("x.bit").alias("bit"))
    return each.groupBy("id").agg(F.bit_or("bit").alias("mask"))
