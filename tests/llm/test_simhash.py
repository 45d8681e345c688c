"""SimHash groups against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from textloom.llm import simhash as S

ROWS = "doc_id long, text string, source string, fp string"


def brute_print(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [b" ".join(ws)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if bin(a ^ b).count("1") <= 4:
            root[find(a)] = find(b)
    return {p: find(p) for p in root}


def expected(rows):
    prints = {i: brute_print(r[1]) for i, r in enumerate(rows)}
    groups = brute_groups(set(prints.values()))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            g = groups[prints[i]]
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted((str(r[0]), f"{prints[i]:016x}", least.get(groups[prints[i]])) for i, r in enumerate(rows))


def texts(n, rng):
    vocab = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 40, 200, 400]))]
        out.append("\t ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            out.append(" \n".join(other))
    return out


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i * 3 % 1009, t, "s", "clash") for i, t in enumerate(texts(120, rng))]
    rows += [(7, None, None, None), (8, "", "s", ""), (9, " \n", "s", ""), (None, rows[0][1], "s", ""), rows[3], rows[3]]
    got = S.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert S.near_duplicates(empty).collect() == []
    assert S.keep_one(empty).columns == empty.columns
    assert S.keep_one(empty).collect() == []


def test_keep_one_keeps_the_first_of_each_group(spark):
    rng = random.Random(6)
    rows = [(i, t, "s", "clash") for i, t in enumerate(texts(60, rng))]
    rows += [rows[0], rows[0], (None, "only here " * 30, "s", None)]
    want = {c for _, _, c in expected(rows) if c is not None}
    got = [r.doc_id for r in S.keep_one(spark.createDataFrame(rows, ROWS)).collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 1


def rounds_of(fps, size):
    """Links of one bucket whose key covers the lower 28 bits, passed on until no bucket is too large; batches of so many rows."""
    at = (S.PIVOTS[None, :] ^ fps[:, None]).view(np.uint64)
    at = np.ascontiguousarray(np.bitwise_count(at).astype(np.int8)).view(np.int64).ravel()
    rows = [np.zeros(len(fps), np.int64), fps.view(np.int64), at, np.full(len(fps), (1 << 28) - 1)]
    u, v, rounds = [], [], 0
    while len(rows[0]):
        rounds += 1
        order = np.argsort(rows[0], kind="stable")
        batches = [pa.RecordBatch.from_arrays([pa.array(x[order[i : i + size]]) for x in rows], names=["key", "fp", "at", "mask"]) for i in range(0, len(order), size)]
        out = pa.Table.from_batches(list(S._links(iter(batches))), pa.schema([(k, pa.int64()) for k in ("u", "v", "key", "at", "mask")]))
        again = out.filter(pc.is_valid(out["key"]))
        some = out.filter(pc.is_valid(out["v"]))
        u += some["u"].to_pylist()
        v += some["v"].to_pylist()
        rows = [again[k].to_numpy() for k in ("key", "u", "at", "mask")]
    return np.array(u, np.int64), np.array(v, np.int64), rounds


def test_a_task_holds_no_more_than_a_bounded_part_of_a_bucket(monkeypatch):
    """A bucket of 60,000 fingerprints streams through; what is joined up never exceeds a batch and SPLIT rows."""
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 62, 60_000, dtype=np.int64).view(np.uint64) << np.uint64(28))
    most, join = [0], np.concatenate

    def watched(parts, *a, **k):
        out = join(parts, *a, **k)
        most[0] = max(most[0], len(out))
        return out

    monkeypatch.setattr(S.np, "concatenate", watched)
    rows = [np.zeros(len(fps), np.int64), fps.view(np.int64), np.zeros(len(fps), np.int64), np.full(len(fps), (1 << 28) - 1)]
    batches = (pa.RecordBatch.from_arrays([pa.array(x[i : i + 1000]) for x in rows], names=["key", "fp", "at", "mask"]) for i in range(0, len(fps), 1000))
    n = sum(b.num_rows for b in S._links(batches))
    assert n == 5 * len(fps) and most[0] <= 5 * (S.SPLIT + 1000)


def test_pivot_distances_travel_as_bytes(spark):
    from pyspark.sql import functions as F

    fps = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 50)
    got = spark.createDataFrame([(int(x),) for x in fps], "fp long").select("fp", S.pivot_distances(F.col("fp")).alias("at")).collect()
    table = S.pivot_table(np.array([r.at for r in got], np.int64))
    want = np.bitwise_count(np.array([r.fp for r in got], np.int64).view(np.uint64)[:, None] ^ S.PIVOTS[None, :])
    assert (table == want).all()


def test_bucket_search_links_what_brute_force_links(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3, dtype=np.int64).view(np.uint64)
    fps = set()
    for b in base.tolist():
        for _ in range(150):
            x = b
            for bit in rng.integers(28, 64, rng.integers(0, 9)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    for split, size in ((20, 7), (20, 1000), (4096, 60)):
        monkeypatch.setattr(S, "SPLIT", split)
        u, v, rounds = rounds_of(fps, size)
        assert (rounds > 1) == (split < len(fps))
        root = {int(p): int(p) for p in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist(), strict=True):
            assert bin(a ^ b).count("1") <= 4
            root[find(a)] = find(b)
        want = brute_groups([int(p) for p in fps])
        pairs = {(find(p), want[p]) for p in root}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_keys_agree_for_any_four_flips(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        rows.append((i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "i long, a long, b long")
    assert df.filter(~F.arrays_overlap(S.bucket_keys(F.col("a")), S.bucket_keys(F.col("b")))).count() == 0
