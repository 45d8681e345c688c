"""Sum-of-squares online packing (operator 2) of token sequences into windows of a fixed size.

Each partition packs its documents as they come, with no shuffle. A document's ids (and an end id) are cut into whole
windows first; the rest goes to the fill level that minimises the sum of squared counts of partially filled windows,
kept in an array by level (ties: the fullest). A window that becomes full is written at once.

After each run of ``RUN`` placed pieces, the windows still open are merged: their pieces are cut to fill windows whole,
so at most one is left, which stays open. At the partition's end that one is cut at powers of two, which need no padding.
Every placement follows the one rule, whatever the texts, and a task holds no more than a run's ids (RUN * size * 4
bytes, 128 MB, if each piece opened a window and nearly filled it; a few MB for usual texts).

Nulls and empty texts are the end id alone. Repeated rows are packed each. An empty table gives an empty result.
sequence_id is the partition number times 2^32 plus a count, so ids differ between partitions; a task that runs again
on the same input gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.pieces import encoder, public_path

SIZE, END, RUN, ROWS = 4096, 2, 8192, 20_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
Piece = tuple[object, int, int, np.ndarray]  # doc_id, start, tokens of the document, ids


class Packer:
    """Packs pieces into windows; ``done`` gets (pieces of a window) whenever one is complete."""

    def __init__(self, size: int = SIZE, run: int = RUN):
        self.size, self.run, self.placed = size, run, 0
        self.count = np.zeros(size + 1, np.int64)  # partially filled windows by level
        self.at: dict[int, list[list[Piece]]] = {}
        self.done: list[list[Piece]] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        n = len(ids)
        full = n // self.size * self.size
        for at in range(0, full, self.size):
            self.done.append([(doc_id, at, n, ids[at : at + self.size])])
        if n > full:
            self.place((doc_id, full, n, ids[full:].copy()))

    def level(self, s: int) -> int:
        """The fill level to which a piece of s ids goes; 0 is a new window."""
        levels = np.append(np.flatnonzero(self.count[: self.size - s + 1]), 0)
        to = levels + s
        gain = np.where(to < self.size, 2 * self.count[to] + 1, 0) - np.where(levels > 0, 2 * self.count[levels] - 1, 0)
        return int(levels[gain == gain.min()].max())

    def place(self, piece: Piece) -> None:
        s = len(piece[3])
        h = self.level(s)
        window = [] if h == 0 else self._take(h)
        window.append(piece)
        if h + s == self.size:
            self.done.append(window)
        else:
            self.count[h + s] += 1
            self.at.setdefault(h + s, []).append(window)
        self.placed += 1
        if self.placed % self.run == 0:
            self.merge()

    def _take(self, h: int) -> list[Piece]:
        self.count[h] -= 1
        return self.at[h].pop()

    def merge(self, last: bool = False) -> None:
        """Cuts the pieces of open windows to fill windows whole; one partially filled window stays."""
        window, fill = [], 0
        for h in sorted(self.at, reverse=True):
            for other in self.at[h]:
                for doc_id, start, n, ids in other:
                    while len(ids):
                        k = min(self.size - fill, len(ids))
                        window.append((doc_id, start, n, ids[:k]))
                        start, ids, fill = start + k, ids[k:], fill + k
                        if fill == self.size:
                            self.done.append(window)
                            window, fill = [], 0
        self.count[:] = 0
        self.at = {}
        if fill and not last:
            self.count[fill], self.at = 1, {fill: [window]}
        elif fill:
            self.halves(window)

    def halves(self, pieces: list[Piece]) -> None:
        """Sequences whose lengths are powers of two, largest first."""
        left = sum(len(p[3]) for p in pieces)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            window: list[Piece] = []
            while want:
                doc_id, start, n, ids = pieces[0]
                k = min(want, len(ids))
                window.append((doc_id, start, n, ids[:k]))
                want -= k
                pieces = pieces[1:] if k == len(ids) else [(doc_id, start + k, n, ids[k:]), *pieces[1:]]
            self.done.append(window)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: SCHEMA. Only doc_id and text are read."""
    path = tokenizer or public_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence, rows = Packer(size), TaskContext.get().partitionId() << 32, []
        encode = encoder(path).encode

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, sequence
            for window in packer.done:
                offset = 0
                for doc_id, start, n, ids in window:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset))
                    offset += len(ids)
                sequence += 1
            packer.done = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(FIELDS))
                rows = []

        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for i, ids in encode(batch.column("text")):
                packer.add(doc_ids[i], np.append(ids, np.uint32(end)))
                if len(packer.done) >= ROWS // 8:
                    yield from flush()
            yield from flush()
        packer.merge(last=True)
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
