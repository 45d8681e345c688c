"""Quality rules against counting in plain Python and the same concentration steps in numpy."""

import math
import random
import re
from collections import Counter

import numpy as np

from textloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "doc_id long, text string, lang string, source string, n_words string, kept string, grp string"


def brute_counts(text):
    ws = WORD.findall(text or "")
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = set()
    for i in range(len(ws) - 7):
        if windows[tuple(ws[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    joined = "".join(ws)
    marks = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "#*$%&|<>")
    return (len(ws), len(joined), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(set(ws)), len(re.findall("[A-Z]", text or "")), sum(c in marks for c in text or ""))


def vector(c):
    n, chars = max(c[0], 1), max(c[1], 1)
    forms = (math.log(n), math.log(max(c[5], 1) / n), math.log(chars / n), *(math.sqrt(c[k] / chars) for k in (2, 6, 7)))
    return [math.floor(f * Q.GRID + 0.5) if f >= 0 else -math.floor(-f * Q.GRID + 0.5) for f in forms]


def distance(x, mean, inverse):
    d = x / Q.GRID - mean
    return np.einsum("ni,ij,nj->n", d, inverse, d)


def fitted(x, w):
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    cov = ((w[:, None] * x).T @ x / w.sum() - np.outer(mean, mean)) / Q.GRID**2 + np.diag(np.square(Q.FLOOR))
    return mean / Q.GRID, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def settled(x):
    """Where each start ends, row by row: a row is as far as its cell's mean, and the cell at the edge counts in part."""
    cell = np.unique(np.floor(x / (np.array(Q.FLOOR) * Q.GRID)), axis=0, return_inverse=True)[1].ravel()
    size = np.bincount(cell)
    mid = np.stack([np.bincount(cell, c) / size for c in x.T], axis=1)[cell]

    def quantile(v, share):
        values = sorted(v.tolist())
        return values[max(math.ceil(share * len(values)) - 1, 0)]

    def nearest(d, share):
        order = sorted(range(len(x)), key=lambda i: (d[i], cell[i]))
        w, left, i = np.zeros(len(x)), share * len(x), 0
        while left > 1e-9:
            members = order[i : i + size[cell[order[i]]]]
            w[members] = min(1.0, left / len(members))
            left, i = left - len(members), i + len(members)
        return w

    low, med, high = (np.array([quantile(c, s) for c in mid.T]) for s in (0.25, 0.5, 0.75))
    spread = ((high - low) / (1.349 * Q.GRID)) ** 2 + np.square(Q.FLOOR)
    z = np.abs(mid - med) / Q.GRID / np.sqrt(spread)
    near = (z <= Q.NEAR).all(axis=1)
    full = mid[np.flatnonzero(cell == size.argmax())[0]]
    starts = [nearest(distance(mid, med / Q.GRID, np.diag(1 / spread)), Q.COVER), np.ones(len(x)), near.astype(float) if near.any() else np.ones(len(x)), nearest(z.sum(axis=1), 0.5), nearest(distance(mid, full / Q.GRID, np.diag(1 / spread)), 0.5)]
    out = []
    for w in starts:
        while True:
            mean, inverse, logdet = fitted(x, w)
            after = nearest(distance(mid, mean, inverse), Q.COVER)
            if np.allclose(after, w):
                break
            w = after
        out.append((mean, inverse, logdet))
    return out, lambda mean, inverse: quantile(distance(mid, mean, inverse), 0.5)


def fit(x):
    fits, middle = settled(x)
    mean, inverse, _ = min(fits, key=lambda f: f[2])
    return mean, inverse, max(middle(mean, inverse) / Q.MEDIAN, 0.2)


def brute(rows):
    counts = [brute_counts(r[1]) for r in rows]
    x = np.array([vector(c) for c in counts], float)
    lang, pair = [r[2] for r in rows], [(r[2], r[3]) for r in rows]
    n_lang, n_pair = Counter(lang), Counter(pair)
    out = []
    fits = {}
    for r, c, v in zip(rows, counts, x, strict=True):
        key = ("s", (r[2], r[3])) if n_pair[r[2], r[3]] >= Q.MIN_ROWS else ("l", r[2]) if n_lang[r[2]] >= Q.MIN_ROWS else ("all",)
        if key not in fits:
            fits[key] = fit(x[[key[0] == "all" or key[0] == "l" and a == key[1] or key[0] == "s" and b == key[1] for a, b in zip(lang, pair, strict=True)]])
        mean, inverse, scale = fits[key]
        d = distance(v[None], mean, inverse)[0] / scale * c[0] / (c[0] + Q.NOISE)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        out.append((str(r[0]), *c[:5], failed, not failed and d <= Q.CUTOFF, d))
    return out


def documents(seed=1):
    rng = random.Random(seed)
    vocab = {k: [f"{k}{''.join(rng.choice('abcdeé') for _ in range(rng.randrange(1, 8)))}" for _ in range(300)] for k in ("en", "fr", "xx")}
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "en", "en", "fr", "xx"] if i % 10 == 0 else ["en", "en", "fr"])
        source = rng.choice(["src0", "src0", "src1", f"src{i % 40}"])
        ws = rng.choices(vocab[lang], k=rng.choice([25, 60, 150, 400]))
        kind = i % 60
        if kind == 1:
            ws = [w + rng.choice(["%%%", "***", "|"]) for w in ws]
        elif kind == 2:
            ws = [w.upper() + "!!" for w in ws]
        elif kind == 3:
            ws = ws[:3] * 40
        elif kind == 4:
            ws = ws[:12]
        rows.append((i, "\n".join(" ".join(ws[j : j + 17]) for j in range(0, len(ws), 17)), lang, source, "a", "b", "c"))
    rows += [(2000, None, "en", "src0", None, None, None), (2001, "", None, None, None, None, None), (None, "one two\none two\n\t\x0b one", None, "src0", None, None, None), rows[7], rows[7]]
    return rows


def test_counts_match_plain_python():
    import pyarrow as pa

    rng = random.Random(3)
    bits = ["a", "bb", "É", "日本", " ", "  ", "\n", "\t", "\r\n", "\x0b", "#", "%%%", "|", "!", "A", "\xa0", "\U0001f600", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "\n\n", "w " * 30, "a b c d e f g h " * 3 + "z", "same line\n" * 5, "q" * 5000]
    got = Q.count(pa.array(texts))
    assert list(zip(*(got[k].tolist() for k in Q.COUNTS), strict=True)) == [brute_counts(t) for t in texts]


def test_verdicts_match_brute_force(spark):
    rows = documents()
    want = sorted(brute(rows), key=str)
    got = sorted(((str(r.doc_id), *(r[k] for k in Q.COUNTS[:5]), r.base_failed, r.kept, r.distance2) for r in Q.quality(spark.createDataFrame(rows, ROWS).repartition(3)).collect()), key=str)
    assert [g[:-2] for g in got] == [w[:-2] for w in want]
    assert np.allclose([g[-1] for g in got], [w[-1] for w in want], rtol=1e-6)
    assert all(g[-2] == w[-2] for g, w in zip(got, want, strict=True) if abs(w[-1] - Q.CUTOFF) > 1e-6)
    kept = {int(w[0]) % 60 for w in want if w[-2] and w[0] != "None"}
    assert not kept & {1, 2, 3, 4}
    clean = [w for w in want if w[0] != "None" and int(w[0]) < 900 and int(w[0]) % 60 not in (1, 2, 3, 4)]
    assert sum(w[-2] for w in clean) >= 0.995 * len(clean)


def test_the_least_determinant_of_all_starts_is_chosen(spark):
    """Two clouds of unlike size and a few far rows: the starts settle apart, and the tightest fit is taken."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 400, (300, Q.P)), rng.normal(1500, 60, (250, Q.P)), rng.normal(-6000, 2000, (40, Q.P))]).round().astype(int)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "grp string, " + ", ".join(f"{k} long" for k in Q.NAMES)).repartition(3)
    got = Q.fits(rows).first()
    want = settled(x.astype(float))[0]
    assert np.allclose(got.logdets, [f[2] for f in want], rtol=1e-6) and max(got.logdets) > min(got.logdets)
    assert np.isclose(-np.linalg.slogdet(np.array(got.inverse).reshape(Q.P, Q.P))[1], min(got.logdets))


def test_filter_keeps_the_same_rows(spark):
    rows = documents(2)
    df = spark.createDataFrame(rows, ROWS)
    kept = sorted(w[0] for w in brute(rows) if w[-2])
    out = Q.keep_good(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == kept


def test_verdict_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(documents(), ROWS)
    a, b = (sorted((str(r.doc_id), r.kept, r.distance2) for r in Q.quality(df.repartition(n)).collect()) for n in (1, 7))
    assert a == b


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert Q.quality(empty).collect() == []
    assert Q.keep_good(empty).collect() == []


def test_runs_match_plain_python():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghij", k=n)) for n in (0, 1, 4, 5, 6, 9, 40)] + [None, "a " * 30]
    for span in (1, 5, 40, 100):
        for text in texts:
            ws = (text or "").split()
            before = np.array([max((j for j in range(i) if ws[j] == ws[i]), default=-1) for i in range(len(ws))], int)
            got = Q.run_distinct(before, np.array([0, len(ws)]), span).sum()
            assert got == sum(len(set(ws[i : i + span])) for i in range(max(len(ws) - span, 0) + 1))
    long = [" ".join(rng.choices("abcdefghij", k=n)) + " z" for n in (700, 3, 2000)]
    assert Q.count(pa.array(long))[Q.RUNS].tolist() == [sum(len(set(ws[i : i + Q.SPAN])) for i in range(max(len(ws) - Q.SPAN, 0) + 1)) for ws in map(str.split, long)]


def prose(rng, n):
    """Words of a skewed vocabulary, 5,000 words in all."""
    ws = [f"w{int(5000 ** rng.random()):x}" for _ in range(n)]
    return "\n".join(" ".join(ws[j : j + 20]) + "." for j in range(0, n, 20))


def test_clean_texts_of_any_length_are_kept(spark):
    """Ordinary lengths with a few very long texts, and a source of long texts with a few short ones."""
    rng = random.Random(6)
    usual = [(i, prose(rng, int(math.exp(rng.gauss(5.5, 0.7))) + 25), "en", "web", None, None, None) for i in range(600)]
    long = [(1000 + n, prose(rng, n), "en", "web", None, None, None) for n in (10_000, 20_000, 50_000, 100_000)]
    books = [(2_000_000 + i, prose(rng, int(math.exp(rng.gauss(7.5, 0.4)))), "en", "book", None, None, None) for i in range(250)]
    short = [(3_000_000 + n, prose(rng, n), "en", "book", None, None, None) for n in (80, 160, 30_000)]
    junk = [(4_000_000 + n, prose(rng, n).replace(" ", "%%% "), "en", "web", None, None, None) for n in (300, 20_000)]
    junk += [(5_000_000, " ".join(rng.choices("abcdefghijklmnopqrst", k=20_000)), "en", "web", None, None, None)]
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(usual + long + books + short + junk, ROWS)).collect()}
    assert [(i, r.distance2) for i, r in got.items() if i < 4_000_000 and not r.kept] == []
    assert not any(got[r[0]].kept for r in junk)
