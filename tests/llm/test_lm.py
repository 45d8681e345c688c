"""Language-model scores against counting in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import lm

ROWS = "doc_id long, text string, score string, n_tokens string"


def documents(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Straße", "ABC", "abc"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 60, 300]))) if i % 11 else "a\tb\n a b " * 3, "x", "y") for i in range(250)]
    return rows + [(900, None, None, None), (901, "", None, None), (None, "no id w1", None, None), rows[5], rows[5]]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def grams(text):
    ts = tokens(text)
    return list(zip([None, None, *ts[:-2]][: len(ts)], [None, *ts[:-1]], ts, strict=True)), ts


def brute(docs):
    fold = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 for d, *_ in docs]
    uni, bi, tri = ([Counter(), Counter()] for _ in range(3))
    for (_, t, *_), f in zip(docs, fold, strict=True):
        g, ts = grams(t)
        for k, on in ((0, f != 2), (1, f == 3)):
            if on:
                uni[k].update(ts)
                bi[k].update(x[1:] for x in g)
                tri[k].update((i == 0, *x) for i, x in enumerate(g))
    n, v = sum(uni[0].values()), len(uni[0])
    n_left, v_left = n - sum(uni[1].values()), sum(uni[0][k] > uni[1][k] for k in uni[0])
    bucket = lambda c: 0 if c <= 0 else int(math.log2(c)) + 1

    def looked_up(i, x, left, own=0):
        """Bucket by all counts, and ratios by these or those without the deleted fold's."""
        c = lambda of, key, left=left: of[0][key] - left * of[1][key]
        a, b, w = x
        one, two = c(uni, b), c(uni, None) if i == 0 else c(bi, (a, b))
        all_one, all_two = c(uni, b, 0) + own, own + (c(uni, None, 0) if i == 0 else c(bi, (a, b), 0))
        return (64 + bucket(all_two) if all_two > 1 else bucket(all_one)), [c(tri, (i == 0, *x)) / max(two, 1), c(bi, (b, w)) / max(one, 1), c(uni, w) / (n_left if left else n)]

    events = {}
    for (_, t, *_), f in zip(docs, fold, strict=True):
        if f == 3:
            for i, x in enumerate(grams(t)[0]):
                b, p = looked_up(i, x, 1)
                q, place = lm._octaves(np.array(p))
                events.setdefault(b, {}).setdefault(tuple(q.tolist()), []).append(place)
    weights = {}
    for b, hist in events.items():
        rows = sorted(hist)
        p = np.array([[2.0**-x * m / lm.GRID if x >= 0 else 0.0 for x, m in zip(q, np.mean(hist[q], axis=0), strict=True)] + [1 / (v_left + 1)] for q in rows])
        weights[b] = lm.mix_weights(p, np.array([len(hist[q]) for q in rows], float))
    table = {}
    for b in range(128):
        last = np.array(weights.get(b, table[b - 1] if b % 64 else [0.0, 0.0, 0.9, 0.1] if b == 0 else [0.3, 0.3, 0.3, 0.1]))
        table[b] = last
    for b, w in table.items():
        w = np.array([*w[:3], max(w[3], 1e-6)])
        table[b] = w / w.sum()
    out = []
    for (d, t, *_), f in zip(docs, fold, strict=True):
        g, ts = grams(t)
        base = sum(math.log10((uni[0][x] + 1) / (n + v + 1)) for x in ts)
        score = 0
        for i, x in enumerate(g):
            b, p = looked_up(i, x, 0, int(f == 2))
            score += math.log10(sum(w * y for w, y in zip(table[b], [*p, 1 / (v + 1)], strict=True)))
        out.append((str(d), f == 2, len(ts), sum(uni[0][x] > 0 for x in ts), n, round(base, 6), round(score, 5)))
    return sorted(out), lambda i, a, b, w: sum(x * y for x, y in zip(table[looked_up(i, (a, b, w), 0)[0]], [*looked_up(i, (a, b, w), 0)[1], 1 / (v + 1)], strict=True)), uni[0]


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_scores_match_counting(spark, block, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, ROWS).repartition(3).write.parquet(str(tmp_path / "d"))
    got = lm.score(spark.read.parquet(str(tmp_path / "d")), block=block, ranges=5).collect()
    want, *_ = brute(docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in got) == want


def test_probabilities_sum_to_one_and_beat_the_base():
    out, p, uni = brute(documents())
    for i, a, b in [(0, None, None), (1, None, b"w1"), (2, b"w1", b"w2"), (2, b"w5", b"never")]:
        assert abs(sum(p(i, a, b, w) for w in uni) + p(i, a, b, b"unseen") - 1) < 1e-6
    held = [r for r in out if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_copies_score_above_the_rest(spark, tmp_path):
    """A text that stands twice among many others is told apart by its score a token."""
    rng = random.Random(3)
    vocab = [f"v{int(3000 ** rng.random())}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(vocab, k=120)), "x", "y") for i in range(600)]
    rows += [(1000 + i, rows[i][1], "x", "y") for i in range(0, 600, 20)]
    spark.createDataFrame(rows, ROWS).repartition(3).write.parquet(str(tmp_path / "d"))
    got = [(r.score / r.n_tokens, r.doc_id >= 1000 or r.doc_id % 20 == 0) for r in lm.score(spark.read.parquet(str(tmp_path / "d"))).collect() if not r.held_out]
    got.sort(reverse=True)
    copies = sum(c for _, c in got)
    assert sum(c for _, c in got[:copies]) >= 0.9 * copies


def test_keys_and_counts_round_trip():
    x = np.array([0, 1, 254, 255, 256, 10**12])
    assert [y.tolist() for y in lm.unpack_both(lm.pack_both(x, x[::-1]), len(x))] == [x.tolist(), x[::-1].tolist()]
    for bits in (20, 56, 64):
        keys = np.unique(np.random.default_rng(1).integers(0, 1 << bits, 5000, dtype=np.uint64, endpoint=False) if bits < 64 else np.random.default_rng(1).integers(0, (1 << 64) - 1, 5000, dtype=np.uint64))
        assert (lm.unpack_keys(lm.pack_keys(keys), len(keys)) == keys).all()


def test_one_very_long_text_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    rows = [(1, " ".join(f"w{rng.randrange(90_000)}" for _ in range(300_000)), "s", "t"), (2, "w1 w2", "s", "t"), (3, "é" * 100_000, "s", "t")]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in lm.score(spark.read.parquet(str(tmp_path / "d")), block=1000).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3)] == [300_001, 3, 2] and all(math.isfinite(r.score) for r in got.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(str(tmp_path / "d"))
    assert lm.score(spark.read.parquet(str(tmp_path / "d"))).collect() == []
