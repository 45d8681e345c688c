"""Language-model scoring (operator 10): trigrams by deleted interpolation, over all documents.

Counting and scoring never move single n-grams. Documents are read in blocks of about ``BLOCK`` tokens. Each block sends
the sorted hashes of its distinct words, pairs and triples, with its counts, as one packed row for each hash range; the
task of a range adds up all blocks and answers each block with the totals, in the block's own order. A word or n-gram that
is everywhere is one entry a block, so no key is hot. The number of ranges follows the bytes of text, ``RANGE_BYTES`` each,
so a task's memory stays the same however large the input is, and what is gathered grows with it. Answers are written
once, one file for each partition of the documents, and the partition's task reads its own from the shared folder:
texts are not moved.

The model is p(w | u v) = l3 c(u v w) / c(u v) + l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights for each bucket
of the context's frequency (a power of two). Frequencies count the text at hand: those of a training text have it in
them, for a held-out text one is added. The bucket is that of u v from a frequency of two on, else, where only the text
itself has u v, that of v. Weights are learned by expectation-maximisation on deleted counts: training documents of one
fold of the checksum are taken out of the counts, and predicted from the rest in the buckets that they have with all. So a
context that only one text has says nothing about the next word, however surely it seems to. For that their events are
summed in a histogram of bucket and the octaves of p3, p2 and p1, with the mean of each ratio: all of them count, and the
histogram is bounded. The score then uses the counts of all training documents.

A text is its lower-cased (A-Z) words and one end; the end also stands, twice, before the first word as its context.
Nulls: a null text is empty; a null doc_id has the checksum of the empty string and is training. Repeated rows count each.
An empty table gives an empty result. One text is never parted: a very long one is a block of its own. Words are keyed by
64 bits, pairs and triples by 56.

Blocks are read three times (counting, events, scores) and must be the same each time, so docs has to be a table that
is read in the same order again, such as files; a block whose keys differ is an error, never a wrong score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import words as W
from textloom.llm.common import new_path
from textloom.llm.records import filesystem

MODULUS, HELD_OUT, DELETED, BLOCK, RANGE_BYTES, EM_ROUNDS = 7, 2, 3, 1 << 20, 16 << 20, 60
#: Octaves that ratios are told apart by, and the grid of their place in an octave.
OCTAVES, GRID = 60, 1 << 20
#: Bits of the keys of words, pairs and triples.
BITS = (64, 56, 56)
#: Buckets of contexts of one word come first, then those of two.
BUCKETS = 64
END = np.uint64(0x5851F42D4C957F2D)
CELL = "kind int, bucket int, home int, block long, size int, keys binary, counts binary, mark long"
ANSWER = "home int, block long, kind int, bucket int, size int, payload binary, mark long, n long, v long, n_del long, v_left long"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold_of(doc_id: object) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS


def pack_counts(x: np.ndarray) -> bytes:
    """One byte a count; larger ones follow in full."""
    big = x >= 255
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[big].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """n counts, and what follows them."""
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = np.frombuffer(data, "<u8", len(big), n).astype(np.int64)
    return out, data[n + 8 * len(big) :]


def pack_both(a: np.ndarray, b: np.ndarray) -> bytes:
    return zstandard.compress(pack_counts(a) + pack_counts(b), 1)


def unpack_both(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, rest = unpack_counts(zstandard.decompress(data), n)
    return a, unpack_counts(rest, n)[0]


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys in byte planes; the upper planes are nearly empty and compress well."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(planes[:, :4].T).tobytes() + zstandard.compress(np.ascontiguousarray(planes[:, 4:].T).tobytes(), 1)


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    out = np.empty((n, 8), np.uint8)
    out[:, :4] = np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T
    out[:, 4:] = np.frombuffer(zstandard.decompress(data[4 * n :]), np.uint8).reshape(4, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Tokens of a run of documents: distinct words, pairs and triples, and where each token's are among them."""

    def __init__(self, number: int, doc_ids: list, tokens: np.ndarray, first: np.ndarray):
        self.number, self.doc_ids, self.first = number, doc_ids, first
        self.fold = np.array([fold_of(d) for d in doc_ids], np.int64)
        begin = first[:-1]
        before = np.empty_like(tokens)
        before[1:], before[begin] = tokens[:-1], END
        pair = W.mix(before * W.M3 + tokens) >> np.uint64(8)
        last = np.empty_like(pair)
        last[1:], last[begin] = pair[:-1], END  # no pair stands before the first word
        triple = W.mix(last * W.M3 ^ tokens) >> np.uint64(8)
        self.keys, self.at = [], []
        for x in (tokens, pair, triple):
            keys, at = np.unique(x, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at.astype(np.int32))
        self.end = int(np.searchsorted(self.keys[0], END))
        self.before, self.last = np.empty_like(self.at[0]), np.empty_like(self.at[1])
        self.before[1:], self.before[begin] = self.at[0][:-1], self.end
        self.last[1:], self.last[begin] = self.at[1][:-1], -1
        self.mark = int(np.array([k.sum(dtype=np.uint64) for k in self.keys], np.uint64).sum(dtype=np.uint64).view(np.int64))

    def contexts(self, counts: list[np.ndarray], some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the word, and of the two words, before some tokens."""
        last = self.last[some]
        # the beginning of a text was seen as often as its end
        return counts[0][self.before[some]], np.where(last < 0, counts[0][self.end], counts[1][np.maximum(last, 0)])

    def ratios(self, counts: list[np.ndarray], n: int, some: np.ndarray | slice) -> list[np.ndarray]:
        """Maximum-likelihood estimates of some tokens by triples, pairs and words."""
        one, two = self.contexts(counts, some)
        return [counts[2][self.at[2][some]] / np.maximum(two, 1), counts[1][self.at[1][some]] / np.maximum(one, 1), counts[0][self.at[0][some]] / max(n, 1)]

    def buckets(self, counts: list[np.ndarray], own: np.ndarray | int, some: np.ndarray | slice) -> np.ndarray:
        """Buckets of the contexts of some tokens; own is added to counts that do not have the token's own text in them."""
        one, two = (c + own for c in self.contexts(counts, some))
        return np.where(two > 1, BUCKETS + bucket_of(two), bucket_of(one))


def token_blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[Block]:
    number, held, n = TaskContext.get().partitionId() << 24, [], 0

    def made() -> Block:
        sizes = np.concatenate([np.diff(f) for _, _, f in held])
        return Block(number, [d for ids, _, _ in held for d in ids], np.concatenate([t for _, t, _ in held]), np.concatenate([[0], np.cumsum(sizes)]))

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for a, b, data, offsets in W.slices(batch.column("text")):
            low = W.LOWER[data]
            starts, ends, first = W.spans(low, offsets)
            tokens = np.full(len(starts) + b - a, END, np.uint64)
            tokens[np.arange(len(starts)) + W.doc_of(first)] = W.hashes(low, starts, ends)
            held.append((doc_ids[a:b], tokens, first + np.arange(b - a + 1)))
            n += len(tokens)
            if n >= block:
                yield made()
                number, held, n = number + 1, [], 0
    if held:
        yield made()


def _cuts(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each hash range begins in sorted keys."""
    edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**bits / ranges)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _cells(batches: Iterator[pa.RecordBatch], ranges: int, block: int) -> Iterator[pa.RecordBatch]:
    home = TaskContext.get().partitionId()
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    for b in token_blocks(batches, block):
        fold = np.repeat(b.fold, np.diff(b.first))
        train, gone = fold != HELD_OUT, fold == DELETED
        for kind, (keys, at) in enumerate(zip(b.keys, b.at, strict=True)):
            count, deleted = np.bincount(at[train], minlength=len(keys)), np.bincount(at[gone], minlength=len(keys))
            cuts = _cuts(keys, BITS[kind], ranges).tolist()
            rows = [(kind, r, home, b.number, j - i, pack_keys(keys[i:j]), pack_both(count[i:j], deleted[i:j]), b.mark) for r, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "home", "block", "size", "keys", "counts", "mark"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each hash range over all blocks, and answers each block."""
    held: list[dict] = []

    def answer() -> pa.RecordBatch:
        kind, sizes = held[0]["kind"], [c["size"] for c in held]
        unique, at = np.unique(np.concatenate([unpack_keys(c["keys"], c["size"]) for c in held]), return_inverse=True)
        total, gone = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        begin = np.cumsum(sizes) - sizes
        for c, i in zip(held, begin.tolist(), strict=True):
            mine = at[i : i + c["size"]]  # distinct within a block
            for out, x in zip((total, gone), unpack_both(c["counts"], c["size"]), strict=True):
                out[mine] += x
        sums = [int(total.sum()), int((total > 0).sum()), int(gone.sum()), int((total > gone).sum())] if kind == 0 else [0] * 4
        rows = []
        for c, i in zip(held, begin.tolist(), strict=True):
            mine = at[i : i + c["size"]]
            rows.append((c["home"], c["block"], kind, c["bucket"], c["size"], pack_both(total[mine], gone[mine]), c["mark"], *sums))
            sums = [0] * 4
        held.clear()
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *(pa.int64(),) * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["home", "block", "kind", "bucket", "size", "payload", "mark", "n", "v", "n_del", "v_left"])

    for batch in batches:
        for c in batch.to_pylist():
            if held and (held[0]["kind"], held[0]["bucket"]) != (c["kind"], c["bucket"]):
                yield answer()
            held.append(c)
    if held:
        yield answer()


class Answers:
    """The answers to the blocks of one partition, as its task comes to them."""

    def __init__(self, folder: str, home: int):
        from pyarrow import fs as arrow

        fs, path = filesystem(folder)
        found = fs.get_file_info(arrow.FileSelector(f"{path}/home={home}", allow_not_found=True))
        self.files = [(fs, f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
        self.rows, self.next = self._rows(), None

    def _rows(self) -> Iterator[dict]:
        for fs, path in self.files:
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(64, columns=["block", "kind", "size", "payload", "mark"]):
                    yield from batch.to_pylist()

    def of(self, b: Block) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Totals and deleted totals of a block's words, pairs and triples."""
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        row = self.next or next(self.rows, None)
        while row and row["block"] == b.number:
            if row["mark"] != b.mark:
                raise RuntimeError("a block was read differently the second time; write the table and read it again")
            total, gone = unpack_both(row["payload"], row["size"])
            out[row["kind"]].append(total)
            out[3 + row["kind"]].append(gone)
            row = next(self.rows, None)
        self.next = row
        found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        if [len(x) for x in found[:3]] != [len(k) for k in b.keys]:
            raise RuntimeError("the answers to a block are not complete")
        return found[:3], found[3:]


def _octaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The octave below 1 that a ratio lies in (-1 for none), and its place in it as an integer."""
    q = np.where(p > 0, np.minimum(np.round(-np.log2(np.maximum(p, 1e-30))), OCTAVES), -1).astype(np.int64)
    return q, np.round(p * np.exp2(q) * GRID * (q >= 0)).astype(np.int64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than its count's power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


EVENTS = "b long, q3 long, q2 long, q1 long, count long, s3 long, s2 long, s1 long"


def _events(batches: Iterator[pa.RecordBatch], block: int, folder: str, n: int) -> Iterator[pa.RecordBatch]:
    """The histogram of the deleted tokens, as the other folds predict them."""
    answers = None
    for b in token_blocks(batches, block):
        answers = answers or Answers(folder, TaskContext.get().partitionId())
        total, gone = answers.of(b)
        some = np.flatnonzero(np.repeat(b.fold, np.diff(b.first)) == DELETED)
        code, places = b.buckets(total, 0, some), []  # one number for each row of the histogram
        for p in b.ratios([t - g for t, g in zip(total, gone, strict=True)], n, some):
            q, place = _octaves(p)
            code = code << 8 | q + 1
            places.append(place)
        keys, at, count = np.unique(code, return_inverse=True, return_counts=True)
        sums = [np.bincount(at, x, len(keys)).astype(np.int64) for x in places]  # whole numbers below 2^53
        yield pa.RecordBatch.from_arrays([pa.array(keys >> 24), *(pa.array((keys >> k & 255) - 1) for k in (16, 8, 0)), pa.array(count), *map(pa.array, sums)], names=["b", "q3", "q2", "q1", "count", "s3", "s2", "s1"])


def mix_weights(p: np.ndarray, count: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Expectation-maximisation of mixture weights; p has a column for each component."""
    w = np.full(p.shape[1], 1.0 / p.shape[1])
    w[~(p > 0).any(axis=0)] = 0
    w /= w.sum()
    for _ in range(rounds):
        part = p * w
        w = (part / part.sum(axis=1, keepdims=True) * count[:, None]).sum(axis=0) / count.sum()
    return w


def learn(events: DataFrame, v: int) -> DataFrame:
    """(b, l3, l2, l1, l0) of each context bucket; a bucket's histogram is bounded."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        q = rows.sort_values(["q3", "q2", "q1"])
        count = q["count"].to_numpy(np.float64)
        x = q[["q3", "q2", "q1"]].to_numpy()
        p = np.where(x >= 0, np.exp2(-x) * q[["s3", "s2", "s1"]].to_numpy() / (count[:, None] * GRID), 0.0)
        w = mix_weights(np.column_stack([p, np.full(len(p), 1.0 / (v + 1))]), count)
        return pd.DataFrame({"b": rows["b"].iloc[:1], **{f"l{3 - i}": w[i] for i in range(4)}})

    return events.groupBy("b").applyInPandas(fit, "b long, l3 double, l2 double, l1 double, l0 double")


def weight_table(weights: dict[int, tuple[float, ...]]) -> np.ndarray:
    """Weights of each bucket; one without events takes the next lower one's of its kind."""
    table = np.zeros((2 * BUCKETS, 4))
    for first, least in ((0, (0.0, 0.0, 0.9, 0.1)), (BUCKETS, (0.3, 0.3, 0.3, 0.1))):
        last = least
        for b in range(first, first + BUCKETS):
            table[b] = last = weights.get(b, last)
    table[:, 3] = np.maximum(table[:, 3], 1e-6)
    return table / table.sum(axis=1, keepdims=True)


def _scores(batches: Iterator[pa.RecordBatch], block: int, folder: str, n: int, v: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    answers = None
    for b in token_blocks(batches, block):
        answers = answers or Answers(folder, TaskContext.get().partitionId())
        total, _ = answers.of(b)
        bucket = b.buckets(total, np.repeat((b.fold == HELD_OUT).astype(np.int64), np.diff(b.first)), slice(None))
        p = table[bucket, 3] / (v + 1)
        for i, r in enumerate(b.ratios(total, n, slice(None))):
            p += table[bucket, i] * r
        count = total[0][b.at[0]]
        rows = [np.add.reduceat(x, b.first[:-1]) for x in ((count > 0).astype(np.int64), np.log10((count + 1) / (n + v + 1)), np.log10(p))]
        ids = b.doc_ids
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(b.fold == HELD_OUT), pa.array(np.diff(b.first)), pa.array(rows[0]), pa.array(np.full(len(ids), n)), pa.array(rows[1]), pa.array(rows[2])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """Scores of every row of docs, by a model of those that are not held out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ranges or max(1, -(-size // RANGE_BYTES))
    folder = new_path(spark, "lm-answers")
    cells = docs.mapInArrow(lambda it: _cells(it, ranges, block), CELL)
    # a kind's range is a partition of its own
    totals = cells.repartitionById(3 * ranges, F.col("kind") * ranges + F.col("bucket")).sortWithinPartitions("kind", "bucket", "block").mapInArrow(_totals, ANSWER)
    # homes are dealt in turn, so a task's share does not hang on hashes or on the set number of shuffle partitions
    totals.repartitionById(ranges, F.col("home")).sortWithinPartitions("home", "block", "kind", "bucket").write.partitionBy("home").parquet(folder)
    answers = spark.read.schema(ANSWER).parquet(folder)
    n, v, n_del, v_left = (int(x or 0) for x in answers.agg(*(F.sum(k) for k in ("n", "v", "n_del", "v_left"))).first())
    events = docs.mapInArrow(lambda it: _events(it, block, folder, n - n_del), EVENTS)
    learned = learn(events.groupBy("b", "q3", "q2", "q1").agg(*(F.sum(k).alias(k) for k in ("count", "s3", "s2", "s1"))), v_left)
    table = weight_table({r.b: (r.l3, r.l2, r.l1, r.l0) for r in learned.collect()})  # one row for each power of two
    return docs.mapInArrow(lambda it: _scores(it, block, folder, n, v, table), SCORE)
