"""Top-k against brute force and SQL."""

import math

import numpy as np
import pytest
from oracle import check

from textloom.llm import queries
from textloom.llm import topk as T

ROWS = "vec_id long, embedding array<float>, label int, grp string, v string"


def brute(rows, k=5, every=50):
    ok = [(i, np.floor(np.array(e, np.float32).astype(np.float64) * 256).astype(object)) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dim = max((len(e) for _, e in ok), default=0)
    ok = [(i, [int(x) for x in e] + [0] * (dim - len(e))) for i, e in ok]
    out, seen = [], set()
    for q, e in ok:
        if q % every == 0 and (q, tuple(e)) not in seen:
            seen.add((q, tuple(e)))
            s = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in ok if i != q)[:k]
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def got(spark, rows, **more):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(spark.createDataFrame(rows, ROWS), **more).collect())


def vectors(n, seed, dim=8, scale=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim)) * 3
    return [(i, ((centers[i % 6] + rng.normal(size=dim)) * scale).astype(np.float32).tolist(), 0, "g", "v") for i in range(n)]


@pytest.mark.parametrize("cell,block", [(4096, 512), (40, 3)])
def test_matches_brute_force(spark, cell, block, monkeypatch):
    monkeypatch.setattr(T, "CELL", cell)
    monkeypatch.setattr(T, "BLOCK", block)
    rows = vectors(500, 1)
    rows += [(600 + i, rows[3][1], None, None, None) for i in range(120)]  # a common vector: ties
    rows += [(7, None, 0, "", ""), (8, [None] * 8, 0, "", ""), (9, [float("nan")] * 8, 0, "", ""), (None, rows[0][1], 0, "", ""), (1000, [], 0, "", ""), (1001, [1.0, 2.0], 0, "", "")]
    rows += [rows[100], rows[100], rows[51]]
    assert got(spark, rows) == brute(rows)


def kept_share(v, every=50, block=T.BLOCK):
    """The (data row, group) pairs that the bounds keep, of all; and that no group misses a row that its queries need."""
    ids, v = np.arange(len(v)), np.floor(np.asarray(v) * 256)
    pick = np.random.default_rng(5).choice(len(v), math.isqrt(len(v)), replace=False)
    pivots = T.Pivots(v[pick], ids[pick])
    cell, dist = pivots.assign(v)
    asks = ids % every == 0
    least, norm = pivots.reached(v[asks], ids[asks], 5), np.sqrt(np.square(v).sum(axis=1))
    of = lambda c: (cell[asks] == c)
    near = lambda c: [(i, dist[i], norm[i]) for i in sorted(np.flatnonzero(cell == c), key=lambda i: dist[i])[:6]]
    t = lambda c: max(least[of(c)].min(), T.reached_near(near(c), dist[asks][of(c)].max(), norm[asks][of(c)].min(), 5))
    cells = [(c, int(of(c).sum()), dist[asks][of(c)].max(), norm[asks][of(c)].max(), t(c)) for c in np.unique(cell[asks]).tolist()]
    made, where = T.plan(cells, pivots.rows, block)
    needed = made.needed(v)
    grp = np.unique(cell)
    open_ = made.cells_needed(pivots.rows[grp], np.array([dist[cell == c].max() for c in grp]), np.array([norm[cell == c].max() for c in grp]))
    assert not (needed & ~open_[np.searchsorted(grp, cell)]).any()
    scores = v[asks] @ v.T
    group = np.array([np.searchsorted(made.first, where[c][0], "right") - 1 for c in cell[asks]])
    for q, i in enumerate(ids[asks]):
        s = np.where(ids == i, -np.inf, scores[q])
        assert needed[np.argsort(-s, kind="stable")[:5], group[q]].all()
    return needed.mean(), len(made.starts) - 1


def test_bounds_keep_what_is_needed_and_prune_clusters():
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 16))  # fewer than pivots
    v = centers[rng.integers(0, 12, 6000)] + 0.02 * rng.normal(size=(6000, 16))
    share, n = kept_share(v, block=20)
    assert n >= 5 and share < 0.5
    assert kept_share(rng.normal(size=(3000, 64)), block=20)[0] > 0.5  # nothing to prune in random directions


def test_columns_that_clash_and_repeated_ids(spark):
    rows = [(i % 60, e, d, a, b) for i, e, d, a, b in vectors(200, 4)]
    df = spark.createDataFrame(rows, ROWS).withColumnsRenamed({"label": "grp_", "grp": "least", "v": "cell"})
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(df, every=7).collect()) == brute(rows, every=7)
    wide = spark.createDataFrame(rows, ROWS.replace("label int", "query_id int").replace("grp string", "key string"))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(wide, every=7).collect()) == brute(rows, every=7)


def test_few_rows_and_empty(spark):
    assert got(spark, []) == []
    rows = vectors(3, 2)
    assert got(spark, rows) == brute(rows)
    assert got(spark, vectors(1, 2)) == []


def test_large_components_stay_exact(spark):
    rows = vectors(60, 3, scale=3e5)
    assert got(spark, rows, every=10) == brute(rows, every=10)


def test_query_matches_sql(spark):
    assert check(spark, queries.QUERIES["op7_exact_topk"], queries.SQL["op7_exact_topk"], "/root/testdata/sf0.01") > 0
