"""SimHash near-duplicates (operator 9): 64-bit fingerprints, links at ``RADIUS`` or fewer differing bits, components.

Candidates: a fingerprint has ``BLOCKS`` blocks of bits; two that differ in at most four bits agree in at least three of
the seven, so every link lies in one of 35 buckets keyed by three blocks (27 or 28 bits). Only distinct fingerprints
are keyed, so copies cost nothing. Within a bucket the pivot distance table decides: Hamming distances of each distinct
fingerprint to the ``PIVOTS`` reference fingerprints are computed once, before it is keyed, and travel with it, a byte a
pivot. A pair whose largest coordinate difference exceeds the radius is discarded (triangle inequality), and survivors
are verified bit by bit.

A bucket yields a spanning forest of its links, not all its pairs: small buckets pair by pair, larger ones by a search
that removes what it has reached. A task holds ``SPLIT`` fingerprints of a bucket at most. It passes a larger bucket on,
each member under five new keys, one for each of five groups of the bits that its keys do not cover; a link agrees in one
of these, so nothing is lost. That goes on until no bucket is too large, as it must: each round fixes a fifth of the open
bits, and twelve open bits have no more than SPLIT values.

Nulls: a null or empty text has fingerprint zero and links like any other. Repeated rows share a fingerprint. With
null ids the component id is the least id that is not null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free, sent, written
from textloom.llm.components import components
from textloom.llm.words import mix

SHINGLE, SEED, RADIUS = 4, 42, 4
WIDTHS = (9, 9, 9, 9, 9, 9, 10)
BLOCKS, AGREE, PAIRWISE, SPLIT = len(WIDTHS), 3, 48, 4096
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}", 1) for i in range(8)], np.uint64)
#: What a dropped row's key takes in memory at most.
DROP_BYTES = 200
KEYED = "u long, v long, key long, at long, mask long"


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        return digest(joined, SEED)
    length = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length).tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and the signed fingerprint ``fp`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(fp)], names=[*keys, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*keys, "text").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "fp long"]))


def bucket_keys(fp: F.Column) -> F.Column:
    """The 35 bucket keys of a fingerprint."""
    at = np.concatenate([[0], np.cumsum(WIDTHS)]).tolist()
    block = [F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1)) for i in range(BLOCKS)]
    out = []
    for n, (i, j, k) in enumerate(combinations(range(BLOCKS), AGREE)):
        out.append(F.shiftleft(F.lit(n).cast("long"), 30).bitwiseOR(F.shiftleft(block[i], 20)).bitwiseOR(F.shiftleft(block[j], 10)).bitwiseOR(block[k]))
    return F.array(*out)


def covered() -> np.ndarray:
    """The bits that each of the 35 keys covers."""
    at = np.concatenate([[0], np.cumsum(WIDTHS)]).tolist()
    return np.array([sum(((1 << WIDTHS[i]) - 1) << at[i] for i in some) for some in combinations(range(BLOCKS), AGREE)], np.uint64)


def pivot_distances(fp: F.Column) -> F.Column:
    """Distances of a fingerprint to the pivots, a byte each."""
    each = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(PIVOTS.view(np.int64).tolist())]
    out = each[0]
    for e in each[1:]:
        out = out.bitwiseOR(e)
    return out


def pivot_table(at: np.ndarray) -> np.ndarray:
    """The same as rows of coordinates."""
    return np.ascontiguousarray(at).view(np.int8).reshape(len(at), len(PIVOTS))


def linked(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For index pairs: whether they link. Pivot coordinates discard, bits verify."""
    near = np.flatnonzero(np.abs(table[a, :4] - table[b, :4]).max(axis=1, initial=0) <= RADIUS)
    near = near[np.abs(table[a[near], 4:] - table[b[near], 4:]).max(axis=1, initial=0) <= RADIUS]
    near = near[np.bitwise_count(fps[a[near]] ^ fps[b[near]]) <= RADIUS]
    return near


def _search(fps: np.ndarray, table: np.ndarray, members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among members: what is reached leaves the rest."""
    out, rest = [], members
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = np.full(len(rest), todo.pop())
            hit = linked(fps, table, at, rest)
            if len(hit):
                out.append((at[: len(hit)], rest[hit]))
                todo += rest[hit].tolist()
                rest = np.delete(rest, hit)
    return out


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # key, fingerprint, pivot distances, covered bits


def _out(u: np.ndarray, v: np.ndarray | None = None, key: np.ndarray | None = None, at: np.ndarray | None = None, mask: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [pa.nulls(len(u), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (u, v, key, at, mask)]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v", "key", "at", "mask"])


def passed_on(rows: Rows) -> pa.RecordBatch:
    """Each row under five new keys, by groups of the bits that its mask leaves open."""
    key, fp, at, mask = (x.view(np.uint64) for x in rows)
    out: list[tuple] = []
    for m in np.unique(mask):
        mine = np.flatnonzero(mask == m)
        open_ = [b for b in range(64) if not int(m) >> b & 1]
        for g in range(RADIUS + 1):
            bits = np.uint64(sum(1 << b for b in open_[g :: RADIUS + 1]))
            new = mix(key[mine] ^ mix((fp[mine] & bits) + np.uint64(g + 1)))
            out.append((fp[mine], new, at[mine], np.full(len(mine), m | bits)))
    fp, key, at, mask = (np.concatenate(x) for x in zip(*out, strict=True))
    return _out(fp, None, key, at, mask)


def bucket_links(rows: Rows) -> Iterator[pa.RecordBatch]:
    """Spanning links of whole buckets, rows sorted by key; buckets above SPLIT are passed on."""
    key = rows[0]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    large = np.repeat(size > SPLIT, size)
    if large.any():
        yield passed_on(tuple(x[large] for x in rows))
    some = (size > 1) & (size <= SPLIT)
    many = np.repeat(some, size)
    key, fps, table = key[many], rows[1][many].view(np.uint64), pivot_table(rows[2][many])
    size = size[some]
    begin = (np.cumsum(size) - size).astype(np.int64)
    found = []
    small = np.repeat(size <= PAIRWISE, size)
    for d in range(1, PAIRWISE):
        a = np.flatnonzero((key[d:] == key[:-d]) & small[d:]) if d < len(key) else []
        if not len(a):
            break
        hit = a[linked(fps, table, a, a + d)]
        found.append((hit, hit + d))
    for at, n in zip(begin[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
        found += _search(fps, table, np.arange(at, at + n))
    if found:
        yield _out(fps[np.concatenate([x for x, _ in found])], fps[np.concatenate([x for _, x in found])])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by key; the last bucket of a batch waits for the next one, up to SPLIT rows of it."""
    held: list[Rows] = []
    over = None  # the bucket that is being passed on
    joined = lambda parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    for batch in batches:
        rows: Rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "fp", "at", "mask"))
        if over is not None:
            n = int(np.searchsorted(rows[0], over, "right"))
            if n:
                yield passed_on(tuple(x[:n] for x in rows))
            rows = tuple(x[n:] for x in rows)
        if not len(rows[0]):
            continue
        over = None
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if cut or held and held[-1][0][-1] != rows[0][-1]:
            yield from bucket_links(joined([*held, tuple(x[:cut] for x in rows)]))
            held = []
        held.append(tuple(x[cut:] for x in rows))
        if sum(len(h[0]) for h in held) > SPLIT:
            over = held[-1][0][-1]
            yield passed_on(joined(held))
            held = []
    if held:
        yield from bucket_links(joined(held))


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp`` that span each component; not every pair is listed."""
    bits = F.array(*(F.lit(m) for m in covered().view(np.int64).tolist()))
    rows = nodes.select("fp", pivot_distances(F.col("fp")).alias("at")).select("fp", "at", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    rows = rows.repartition("key").sortWithinPartitions("key").withColumn("mask", F.element_at(bits, (F.shiftright("key", 30) + 1).cast("int")))
    found = None
    while True:
        out = written(rows.select("key", "fp", "at", "mask").mapInArrow(_links, KEYED), "simhash-links")
        some = out.filter(F.col("v").isNotNull()).select("u", "v")
        found = some if found is None else found.unionByName(some)
        again = out.filter(F.col("key").isNotNull())
        if again.isEmpty():
            return found
        rows = again.withColumnRenamed("u", "fp").repartition("key").sortWithinPartitions("key")


def groups(found: DataFrame) -> DataFrame:
    """(fp, root) of each distinct fingerprint of a table with ``fp``."""
    nodes = written(found.select("fp").distinct(), "simhash-nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs."""
    found = written(fingerprints(docs), "simhash")
    ids = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = written(groups(found), "simhash-roots")
    least = written(root.join(ids, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = written(root.join(least, "root").select("fp", "component_id"), "simhash-named")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but the first (by doc_id, then by the text's hash) of each component."""
    key = free(docs, "_d", "_h")
    keyed = docs.withColumns({key[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), key[1]: F.sha2(F.coalesce("text", F.lit("\x00")), 256)})
    found = written(fingerprints(keyed, tuple(key)).groupBy("fp", *key).agg(F.count(F.lit(1)).alias("n")), "simhash")
    root = written(groups(found), "simhash-roots")
    ids = found.groupBy("fp").agg(F.min(F.struct(*key)).alias("least"))
    least = written(root.join(ids, "fp").groupBy("root").agg(F.min("least").alias("least")), "simhash-least")
    named = written(root.join(least, "root").select("fp", "least"), "simhash-named")
    rated = found.join(named, "fp").select(*key, "n", (F.struct(*key) == F.col("least")).alias("first"))
    drop = written(rated.filter(~F.col("first") | (F.col("n") > 1)).select(*key, (F.col("first") & (F.col("n") > 1)).alias("again")), "simhash-drop")
    out = keyed.join(sent(drop, DROP_BYTES), key, "left_anti")
    twice = drop.filter("again").select(*key)
    if not twice.isEmpty():
        out = out.unionByName(keyed.join(sent(twice, DROP_BYTES), key, "left_semi").dropDuplicates(key))
    return out.select(*docs.columns)
