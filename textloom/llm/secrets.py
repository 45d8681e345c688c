"""Secret scans (operator 1), in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query; a trigram inverted index over the documents answers it by
intersecting postings, and only candidate rows are tried against that rule. A rule without mandatory trigrams (long hex
runs) reads every text. Candidates whose bytes are few (counted first) go to all executors, so that no text is
shuffled; beyond that the table joins them by id.

Spans are code points, end exclusive, leftmost and non-overlapping per kind. A null text is empty and has none. Rows
that share an id are each scanned; rows without an id are candidates for every rule. An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import trigrams as T
from textloom.llm.common import free, sent, written

#: What a candidate (an id and a mask) takes in memory at most.
MARK_BYTES = 64


@dataclass(frozen=True)
class Rule:
    """A match counts if the group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("pem", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
BASE = 3
SPANS = "array<struct<start:int,kind:int,end:int>>"


def candidate_masks(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, mask) of the documents that may match a rule which has a trigram query."""
    queries = [T.derive(r.pattern) for r in rules]
    grams = T.vocabulary(queries)
    return T.candidates(T.build_index(docs, grams), grams, queries)


def _found(text: F.Column, number: int, rule: Rule) -> F.Column:
    """The rule's spans in a text. Matches and what lies between them alternate, so their lengths give positions."""
    pattern = F.lit(rule.pattern)
    parts = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    at = lambda acc, x: acc["pos"] + x["gap"]
    step = lambda acc, x: F.struct(
        (at(acc, x) + F.length(x["m"])).alias("pos"), F.concat(acc["out"], F.array(F.struct(at(acc, x).alias("start"), (at(acc, x) + F.length(x["m"])).alias("end"), x["m"].alias("m")))).alias("out")
    )
    spans = F.aggregate(F.filter(parts, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    if rule.least:
        size = (lambda m: F.length(m)) if not rule.group else (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)))
        spans = F.filter(spans, lambda x: size(x["m"]) >= rule.least)
    return F.transform(spans, lambda x: F.struct(x["start"], F.lit(number).alias("kind"), x["end"]))


def with_spans(docs: DataFrame, name: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a new column: an array of (start, kind number, end), sorted."""
    id_, mask_ = free(docs, "_id", "_mask")
    marked = written(candidate_masks(docs, rules), "secret-candidates").withColumnsRenamed({"id": id_, "mask": mask_})
    text, every = F.coalesce("text", F.lit("")), F.lit((1 << len(rules)) - 1)
    joined = docs.join(sent(marked, MARK_BYTES), F.col("doc_id") == F.col(id_), "left")
    mask = F.when(F.col("doc_id").isNull(), every).otherwise(F.coalesce(mask_, F.lit(0)))
    none = F.array().cast(SPANS)
    each = []
    for i, rule in enumerate(rules):
        tried = F.lit(True) if T.derive(rule.pattern) is None else (mask.bitwiseAND(F.lit(1 << i)) != 0)
        each.append(F.when(tried & F.rlike(text, F.lit(rule.pattern)), _found(text, i, rule)).otherwise(none).cast(SPANS))
    return joined.withColumn(name, F.sort_array(F.concat(*each))).drop(id_, mask_)


def _listed(spans: F.Column, rules: tuple[Rule, ...]) -> F.Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans."""
    found = with_spans(docs.select("doc_id", "text"), "_spans", rules)
    n = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("_spans", lambda x: x["kind"] < BASE)
    return found.select("doc_id", *(n(k).alias(f"n_{rules[k].kind}") for k in range(BASE)), F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("_spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlapping ones together) replaced by a mark; n_chars, if there, follows the new text."""
    (spans,) = free(docs, "_spans")
    found = with_spans(docs, spans, rules)
    step = lambda acc, x: F.struct(
        F.greatest(acc["pos"], x["end"]).alias("pos"),
        F.when(x["start"] >= acc["pos"], F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    kinds = dict(docs.dtypes)
    out = found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in kinds:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kinds["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The digests in DuckDB's SQL, without an index."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(rules):
        size = f"length(regexp_extract(m, {quoted(r.pattern)}, {r.group}))" if r.least else "1"
        parts.append(
            f"SELECT rid, {i} AS k, {quoted(r.kind)} AS kind, s, s + length(m) AS e FROM (SELECT rid, unnest(list_transform(range(1, len(ms) + 1), lambda i: "
            f"list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0))) AS s, unnest(ms) AS m "
            f"FROM (SELECT rid, regexp_extract_all(t, {quoted(r.pattern)}) AS ms, regexp_split_to_array(t, {quoted(r.pattern)}) AS gs FROM d WHERE regexp_matches(t, {quoted(r.pattern)}))) WHERE {size} >= {max(r.least, 1)}"
        )
    listed = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k)"
    counts = ", ".join(f"coalesce(count(*) FILTER (k = {k}), 0)::BIGINT AS n_{rules[k].kind}" for k in range(BASE))
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), p AS (" + " UNION ALL ".join(parts) + "), "
        f"g AS (SELECT rid, {counts}, {listed} FILTER (k < {BASE}) AS b, {listed} AS a FROM p GROUP BY rid) "
        + "SELECT doc_id, "
        + ", ".join(f"coalesce(n_{rules[k].kind}, 0) AS n_{rules[k].kind}" for k in range(BASE))
        + ", sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (rid)"
    )
