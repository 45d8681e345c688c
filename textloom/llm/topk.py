"""Exact top-k by inner product (operator 7): a Voronoi kNN join.

Vectors become integers floor(256 x). Pivots are a sample of about the square root of the table (the rows of the least
hash of vec_id, ``MOST_PIVOTS`` at most); every row, query or data, goes to the cell of its nearest pivot. Pivots only
steer: the result is exact for any choice.

Summaries. Pivots are rows themselves, so the k-th best score of a query among them is reached for sure. Each cell's
summary has, of its queries, their number, the largest distance u to the pivot p, the largest norm n and the least of those
reached scores; of its data, the largest distance r to the pivot, the largest norm, and the k + 1 rows nearest to the pivot.
A query of norm m reaches (m m + |x| |x| - (u + |x - p|)^2) / 2 with each of these rows x, and at most one of them has its id.
The larger of both is the cell's t.

Bounds. For a query q of a cell around p and a data row x, q.x = p.x + (q - p).x is p.x + u |x| at most, n |x| at most,
and (n n + |x| |x| - d d) / 2 at most, where d = |p - x| - u if that is above 0. If the least of the three is below t for
a cell, no query of the cell needs x. Query cells that lie near each other form groups of about ``BLOCK`` queries, and a
data row is replicated to the groups in which one cell needs it, and to no other. A whole data cell is passed over where
the same bounds, taken from its summary, exclude it.

Each group's data is dealt out by turns over pieces of about ``CELL`` rows of the table, whatever their ids, so neither
a common vector nor a repeated id fills a task; the group's queries go to each of its pieces, which are solved by matrix
products and give back only scores of t or more. A cell with more queries than BLOCK has several blocks.

Ties go to the smaller vec_id. Nulls: vectors that are null or hold null or non-finite components, and rows without
vec_id, take no part. Vectors of unequal lengths are padded with zeros. Repeated rows are candidates each; equal rows
with one vec_id are one query, and no row with the query's vec_id is its candidate. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written

K, EVERY, MOST_PIVOTS, CELL, BLOCK, SCALE = 5, 50, 8192, 4096, 2048, 256
#: Query rows scored at once in a piece.
ROWS = 512
ASSIGNED = "vec_id long, v binary, grp int, dist double, norm double, least double"
MET = "cell long, ord int, vec_id long, v binary"
FOUND = "query_id long, key long, vec_id long, score long"


def _matrix(rows: list[bytes], dim: int | None = None) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    sizes = {len(r) for r in rows}
    dim = dim or max(sizes, default=0) // 8
    if sizes == {8 * dim}:
        return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<f8")[:dim]
        out[i, : len(x)] = x
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == n else np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)


def _bytes(column: pa.Array) -> list[bytes]:
    flat = np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64) * SCALE)
    at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[a:b].astype("<f8").tobytes() for a, b in zip(at, at[1:], strict=False)]


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_bytes(batch.column("x")), pa.binary())], names=["vec_id", "v"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indexes of each row's k best; ids ascend, so the earlier column wins a tie."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if scores.dtype != object and np.abs(scores).max(initial=0) < (1 << 62) // n:
        order = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        return np.argpartition(order, n - k, axis=1)[:, n - k :]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: as doubles while all sums stay below 2^53, else as Python's integers."""
    a, b = _same_width(a, b)
    if np.sqrt(np.square(a).sum(axis=1).max(initial=0)) * np.sqrt(np.square(b).sum(axis=1).max(initial=0)) < 2**53:
        return np.rint(a @ b.T)
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)))


@dataclass
class Pivots:
    rows: np.ndarray
    ids: np.ndarray

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and its distance."""
        m, p = _same_width(m, self.rows)
        cell = np.argmin(np.square(p).sum(axis=1)[None, :] - 2 * (m @ p.T), axis=1)
        return cell, np.sqrt(np.square(m - p[cell]).sum(axis=1))

    def reached(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """A score that k other rows reach for each query: the k-th best of the pivots."""
        s = dot(q, self.rows).astype(np.float64)
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        if s.shape[1] < k:
            return np.full(len(q), -np.inf)
        out = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.where(np.abs(out) < 2**53, out, out - 1e-9 * np.abs(out))  # a sum that was rounded stays a lower bound


def _assign(batches: Iterator[pa.RecordBatch], pivots: Pivots, k: int, every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _bytes(batch.column("x"))
        for at in range(0, len(rows), CELL):
            part, own = rows[at : at + CELL], batch.column("vec_id").slice(at, CELL)
            m, ids = _matrix(part), own.to_numpy()
            cell, dist = pivots.assign(m)
            least = np.full(len(part), np.nan)
            asks = ids % every == 0
            if asks.any():
                least[asks] = pivots.reached(m[asks], ids[asks], k)
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(part, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(np.sqrt(np.square(m).sum(axis=1))), pa.array(least)], names=["vec_id", "v", "grp", "dist", "norm", "least"]
            )


@dataclass
class Plan:
    """Query cells in the order of their groups, with their summaries; group g has cells starts[g] to starts[g + 1]."""

    pivots: np.ndarray  # of the query cells
    radius: np.ndarray
    norm: np.ndarray
    least: np.ndarray
    starts: np.ndarray
    blocks: np.ndarray  # blocks of queries of each group
    first: np.ndarray  # number of each group's first block

    def needed(self, x: np.ndarray) -> np.ndarray:
        """For each vector, whether a group needs it."""
        x, p = _same_width(x, self.pivots)
        norm = np.sqrt(np.square(x).sum(axis=1))[:, None]
        at = x @ p.T
        apart = np.sqrt(np.maximum(np.square(norm) - 2 * at + np.square(p).sum(axis=1)[None, :], 0))
        return self._groups(at, norm, apart, np.zeros(1))

    def cells_needed(self, centre: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """For each data cell, whether a group may need a row of it."""
        c, p = _same_width(centre, self.pivots)
        size = np.sqrt(np.square(p).sum(axis=1))[None, :]
        # p.x = p.c + p.(x - c)
        at = c @ p.T + size * radius[:, None]
        apart = np.sqrt(np.maximum(np.square(c).sum(axis=1)[:, None] - 2 * (c @ p.T) + np.square(size), 0))
        return self._groups(at, norm[:, None], apart, radius[:, None])

    def _groups(self, at: np.ndarray, norm: np.ndarray, apart: np.ndarray, radius: np.ndarray) -> np.ndarray:
        gap = np.maximum(apart - self.radius - radius, 0)
        most = np.minimum(np.minimum(at + self.radius * norm, self.norm * norm), (np.square(self.norm) + np.square(norm) - np.square(gap)) / 2)
        slack = 1 + 1e-9 * (self.norm * norm + np.square(self.norm) + np.square(norm))  # rounding must not lose a row
        return np.logical_or.reduceat(most + slack >= self.least, self.starts[:-1], axis=1)


def reached_near(near: list[tuple[int, float, float]], radius: float, norm: float, k: int) -> float:
    """A score that k other rows reach for each query of a cell of so large a radius, of this norm at least; near: (id, distance, norm) of rows."""
    scores = sorted((norm * norm + n * n - (radius + d) ** 2) / 2 for _, d, n in {i: (i, d, n) for i, d, n in near[::-1]}.values())
    return scores[-k - 1] - 1e-9 * (norm * norm + radius * radius) - 1 if len(scores) > k else -math.inf


def plan(cells: list[tuple[int, int, float, float, float]], pivots: np.ndarray, block: int) -> tuple[Plan, dict[int, tuple[int, int]]]:
    """Groups near query cells (cell, queries, radius, norm, least); also each cell's first block and blocks."""
    left, order = {c[0]: c for c in cells}, []
    at = pivots[cells[0][0]]
    while left:  # a chain of nearest neighbours
        ids = np.array(list(left))
        nearest = int(ids[np.square(pivots[ids] - at).sum(axis=1).argmin()])
        order.append(left.pop(nearest))
        at = pivots[nearest]
    starts, n = [0], 0
    for i, c in enumerate(order):
        if n and n + c[1] > block:
            starts.append(i)
            n = 0
        n += c[1]
    starts.append(len(order))
    queries = [sum(c[1] for c in order[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    blocks = np.array([-(-q // block) for q in queries])
    first = np.cumsum(blocks) - blocks
    of = {c[0]: (int(first[g]), int(blocks[g])) for g, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) for c in order[a:b]}
    columns = [np.array(x, np.float64) for x in zip(*order, strict=True)]
    return Plan(pivots[columns[0].astype(np.int64)], columns[2], columns[3], columns[4], np.array(starts), blocks, first), of


def _data(batches: Iterator[pa.RecordBatch], made: Plan, open_: np.ndarray, pieces: int) -> Iterator[pa.RecordBatch]:
    """Data rows go to a piece of each block of the groups that need them. open_: cells by groups."""
    turn = TaskContext.get().partitionId()
    for batch in batches:
        for at in range(0, batch.num_rows, CELL):
            part = batch.slice(at, CELL)
            v = part.column("v").to_pylist()
            needed = made.needed(_matrix(v)) & open_[part.column("grp").to_numpy()]
            for g in np.flatnonzero(needed.any(axis=0)).tolist():
                rows = np.flatnonzero(needed[:, g])
                ids, vs = part.column("vec_id").take(pa.array(rows)), pa.array([v[r] for r in rows], pa.binary())
                for b in range(made.first[g], made.first[g] + made.blocks[g]):
                    cell = b * pieces + (turn + np.arange(len(rows))) % pieces
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(rows), np.int32)), ids, vs], names=["cell", "ord", "vec_id", "v"])
                turn += len(rows)


def _queries(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries (rows sorted by block) go to each piece of their data, as one Arrow table each."""
    held: list[pa.RecordBatch] = []

    def sent(block: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).select(["vec_id", "key", "least", "v"])
        held.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        body = sink.getvalue().to_pybytes()
        for i in range(pieces):
            yield pa.RecordBatch.from_arrays([pa.array([block * pieces + i], pa.int64()), pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([body], pa.binary())], names=["cell", "ord", "vec_id", "v"])

    now = None
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if b == a:
                continue
            if held and block[a] != now:
                yield from sent(now)
            now = int(block[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from sent(now)


def _solve(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, data before query blocks."""
    cell, ids, rows, matrix = None, [], [], None
    for batch in batches:
        for c, kind, i, v in zip(*(batch.column(x).to_pylist() for x in ("cell", "ord", "vec_id", "v")), strict=True):
            if c != cell:
                cell, ids, rows, matrix = c, [], [], None
            if kind == 0:
                ids.append(i)
                rows.append(v)
                continue
            if not rows:
                continue
            if matrix is None:
                order = np.argsort(np.array(ids, np.int64), kind="stable")
                own, matrix = np.array(ids, np.int64)[order], _matrix(rows)[order]
            table = pa.ipc.open_stream(v).read_all()
            for at in range(0, table.num_rows, ROWS):
                q = table.slice(at, ROWS)
                qid, key, least = q["vec_id"].to_numpy(), q["key"].to_numpy(), q["least"].to_numpy()
                scores = dot(_matrix(q["v"].to_pylist()), matrix)
                # one more for each row of the cell that has the query's id: those fall out
                extra = int((np.searchsorted(own, qid, "right") - np.searchsorted(own, qid, "left")).max(initial=0))
                at_ = best(scores, own, k + extra)
                r = np.repeat(np.arange(len(qid)), at_.shape[1])
                at_ = at_.ravel()
                keep = (own[at_] != qid[r]) & (scores[r, at_] >= least[r])
                r, at_ = r[keep], at_[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(key[r]), pa.array(own[at_]), pa.array(scores[r, at_].astype(np.int64))], names=["query_id", "key", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of each row whose id is divisible by ``every``."""
    rows = _valid(vectors, id_col, vec_col)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(min(max(math.isqrt(total), k + 1), MOST_PIVOTS)).mapInArrow(_to_bytes, "vec_id long, v binary").collect()
    # of rows that share an id one is enough: reached() counts rows of different ids
    one = {r.vec_id: bytes(r.v) for r in sample}
    pivots = Pivots(_matrix(list(one.values())), np.array(list(one), np.int64))
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    if not total:
        return empty
    assigned = written(rows.mapInArrow(lambda it: _assign(it, pivots, k, every), ASSIGNED), "vectors")
    query = F.col("vec_id") % every == 0
    asked = lambda c: F.when(query, F.col(c))
    summary = assigned.groupBy("grp").agg(
        F.max("dist").alias("r"), F.max("norm").alias("n"), F.count_if(query).alias("queries"), F.max(asked("dist")).alias("qr"), F.max(asked("norm")).alias("qn"), F.min(asked("norm")).alias("qm"), F.min(asked("least")).alias("least")
    ).collect()  # one row a pivot at most
    nearest = F.row_number().over(Window.partitionBy("grp").orderBy("dist", "vec_id"))
    near: dict[int, list] = {}
    for x in assigned.select("grp", "vec_id", "dist", "norm").withColumn("k", nearest).filter(F.col("k") <= k + 1).collect():  # k + 1 rows a pivot
        near.setdefault(x.grp, []).append((x.vec_id, x.dist, x.norm))
    cells = [(g.grp, g.queries, g.qr, g.qn, max(g.least, reached_near(near[g.grp], g.qr, g.qm, k))) for g in sorted(summary, key=lambda g: g.grp) if g.queries]
    if not cells:
        return empty
    made, of = plan(cells, pivots.rows, BLOCK)
    open_ = np.zeros((len(pivots.rows), len(made.blocks)), bool)
    grp = np.array([g.grp for g in summary])
    open_[grp] = made.cells_needed(pivots.rows[grp], np.array([g.r for g in summary]), np.array([g.n for g in summary]))
    pieces = -(-total // CELL)
    floor = np.full(len(pivots.rows), -np.inf)
    floor[[c[0] for c in cells]] = [c[4] for c in cells]
    first, blocks = (np.array([of.get(c, (0, 1))[i] for c in range(len(pivots.rows))]) for i in (0, 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp = b.column("grp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[grp] + b.column("turn").to_numpy() % blocks[grp]), *(b.column(c) for c in ("vec_id", "v", "key")), pa.array(np.maximum(b.column("least").to_numpy(), floor[grp]))], names=["block", "vec_id", "v", "key", "least"])

    data = assigned.select("vec_id", "v", "grp").mapInArrow(lambda it: _data(it, made, open_, pieces), MET)
    asks = assigned.filter(query).select("vec_id", "v", "grp", "least").dropDuplicates(["vec_id", "v"])
    asks = asks.withColumns({"key": F.xxhash64("v"), "turn": F.xxhash64("vec_id", "v", F.lit(7))}).mapInArrow(dealt, "block long, vec_id long, v binary, key long, least double")
    sent = asks.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _queries(it, pieces), MET)
    found = data.unionByName(sent).repartition("cell").sortWithinPartitions("cell", "ord").mapInArrow(lambda it: _solve(it, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = K, every: int = EVERY) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], d.e::DOUBLE[])::BIGINT AS score
      FROM v q, v d WHERE q.vec_id % {every} = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
