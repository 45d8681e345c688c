"""SentencePiece encoding and decoding (operator 3) by a streaming Viterbi search.

``Lattice.stream`` reads characters and keeps, for each position of a window, the best path's backpointer: the piece
that ends there. Pieces have at most ``longest`` characters, so only the last ``longest`` positions can be extended.
Whenever the backpointer paths of all of these meet in one boundary, the ids up to it are final and are emitted, and
the window before it is dropped: a text of any length needs no more than its longest undecided stretch.

- A unigram model ranks paths by the sum of log probabilities (ties: the longer last piece).
- A BPE model has no path score: its result is what greedy merging leaves. A sequence of pieces is that result exactly
  if each two neighbours, joined, are merged back into the same two. So a path is admissible or not, each position has
  one admissible backpointer, and the same search gives exactly the library's ids. (Ranking paths by the scores of a
  BPE model, which are merge ranks, would not.)

Where no piece holds white space after another character, paths always meet before a run of white space; texts are cut
there first, and a stretch that a worker has seen before is looked up. The stretches of a BPE model are searched in lock
step: each has a window of its own, is extended by ``WINDOW`` bytes a round, and commits where its paths meet.
Where only a few windows are left to fill a step, the same search goes on from their boundaries a character at a time.
Characters without a piece become their bytes' ids, or the unknown id; a stretch that holds one is searched so too.
Models that change texts first (normalisation rules) are run on the library's normalised text.

Nulls and empty texts have no ids and decode to an empty text. U+2581 stands for a space in the model's alphabet, so it
decodes to one. Repeated rows are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from textloom.llm import words as W
from textloom.llm.pieces import PieceEncoder, public_path
from textloom.llm.tables import Table, Trie

MARK = "▁"
#: Bytes by which a window grows in a round; windows below which a step in numpy takes longer than one for each; log probability taken off for an unknown character; pairs of pieces whose fit
#: is kept.
WINDOW, FEW, UNKNOWN_PENALTY, MOST_FITS = 256, 10, 10.0, 1_000_000
SPACE = np.zeros(256, bool)
SPACE[32] = True
DIGEST = "n_tokens long, ids_crc32 long, text_sha256 string, n_chars long, same boolean"


class Lattice:
    """The pieces of a model, and the search over them."""

    def __init__(self, scores: dict[str, float], bpe: bool):
        self.bpe, self.scores = bpe, scores
        self.longest = max(map(len, scores), default=1)
        if bpe:
            self.steps: dict[str, tuple] = {}
            self.fits: dict[tuple[str, str], bool] = {}
            self.usable = {p for p in scores if len(p) == 1 or self._merges(p) is not None}
        else:
            self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def _merges(self, piece: str) -> tuple | None:
        """(score, first part, last part) after each merge that builds a piece; None if merging builds something else."""
        if piece in self.steps:
            return self.steps[piece]
        parts, out = list(piece), [(0.0, piece[0], piece[-1])]
        while len(parts) > 1:
            best = max(((self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=None)
            if best[0] == -np.inf:
                return None
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            out.append((best[0], parts[0], parts[-1]))
        self.steps[piece] = tuple(out)
        return self.steps[piece]

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b side by side: both are built best first, and no merge across wins meanwhile."""
        left, right = self._merges(a), self._merges(b)
        i = j = 0
        while True:
            across = self.scores.get(left[i][2] + right[j][1], -np.inf)
            x = left[i + 1][0] if i + 1 < len(left) else -np.inf
            y = right[j + 1][0] if j + 1 < len(right) else -np.inf
            if x == y == -np.inf:
                return across == -np.inf
            if across > x and across >= y:
                return False
            if x >= y:
                i += 1
            else:
                j += 1

    def _extend_bpe(self, text: str, last: list[str | None]) -> None:
        """Adds to last, for each further boundary of text, the one admissible piece that ends there; None if its path left the committed one earlier."""
        longest, usable, fits = self.longest, self.usable, self.fits
        for end in range(len(last), len(text) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                piece = text[begin:end]
                if piece not in usable and begin < end - 1:
                    continue
                before = last[begin]
                if before is None:
                    continue
                if not before:
                    break
                key = (before, piece)
                fit = fits.get(key)
                if fit is None:
                    if len(fits) > MOST_FITS:
                        fits.clear()
                    fit = fits[key] = self._fit(before, piece)
                if fit:
                    break
            else:
                piece = None
            last.append(piece)

    def _extend_unigram(self, text: str, last: list[str], total: list[float]) -> None:
        """Adds to last and total, for each further boundary of text, the last piece of the best path and its score."""
        for end in range(len(last), len(text) + 1):
            best, found = -np.inf, text[end - 1 : end]
            for begin in range(max(0, end - self.longest), end):
                piece = text[begin:end]
                score = self.scores.get(piece)
                if score is None:
                    if begin < end - 1:
                        continue
                    score = self.unknown
                if total[begin] + score > best:
                    best, found = total[begin] + score, piece
            last.append(found)
            total.append(best)

    def stream(self, chunks: Iterable[str], before: str = "") -> Iterator[list[str]]:
        """Pieces of a text that comes in chunks, as they become final; ``before`` is the piece that ends where it begins."""
        # the window: its characters, and for each boundary the piece that ends there and the path's score
        text, last, total = "", [before], [0.0]
        step = 2 * self.longest
        limit = 2 * step
        for chunk in chunks:
            for at in range(0, len(chunk), step):
                text += chunk[at : at + step]
                if self.bpe:
                    self._extend_bpe(text, last)
                else:
                    self._extend_unigram(text, last, total)
                if len(text) < limit:
                    continue
                meet = self._meeting(last)
                if meet:
                    yield self._path(last, meet)
                    # the piece that ends at the boundary stays, as the next one must fit it
                    text, last, total = text[meet:], last[meet:], [x - total[meet] for x in total[meet:]] if total[1:] else total
                limit = len(text) + step
        if text:
            yield self._path(last, len(text))

    def _meeting(self, last: list[str | None]) -> int:
        """The boundary in which the paths of all positions that can still be extended meet."""
        open_ = {i for i in range(max(0, len(last) - self.longest), len(last)) if last[i] is not None}
        while len(open_) > 1:
            at = max(open_)
            open_.discard(at)
            open_.add(max(0, at - len(last[at])))
        return open_.pop()

    @staticmethod
    def _path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]


class LockStep:
    """The streaming search of a BPE model over many stretches at once, a boundary of each a step."""

    def __init__(self, lattice: Lattice, id_of: dict[str, int], byte_ids: list[int]):
        self.lattice = lattice
        id_of = {p: i for p, i in id_of.items() if p in lattice.usable} | {chr(b): i for b, i in enumerate(byte_ids[:128]) if chr(b) not in lattice.scores}
        self.id_of, self.piece = id_of, {i: p for p, i in id_of.items()}
        names = sorted(id_of)
        raw = [p.encode() for p in names]
        ends = np.cumsum([len(r) for r in raw])
        self.trie = Trie()
        self.trie.learn(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends, np.array([id_of[p] for p in names], np.int32))
        self.longest = max(map(len, raw), default=1)
        self.fits = Table()

    def _fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = ((before + 1).astype(np.uint64) << np.uint64(32)) | piece.astype(np.uint64)
        out = self.fits.get(key)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            a, b = before[new[first]].tolist(), piece[new[first]].tolist()
            value = np.array([self.lattice._fit(self.piece[x], self.piece[y]) for x, y in zip(a, b, strict=True)], np.int32)
            if self.fits.used > MOST_FITS:
                self.fits = Table()
            self.fits.put(fresh, value)
            out[new] = value[inverse]
        return out > 0

    def search(self, texts: list[bytes]) -> list[list[int] | None]:
        """Ids of each text; None for one that holds a character without a piece."""
        out: list[list[int] | None] = []
        for at in range(0, len(texts), 1 << 16):
            out += self._stream(texts[at : at + (1 << 16)])
        return out

    def _stream(self, texts: list[bytes]) -> list[list[int] | None]:
        out: list[list[int] | None] = [[] for _ in texts]
        # texts not yet ended: which, where the window begins, where it ends, the piece that ends at its beginning
        live = [(i, 0, self._grown(t, 0, 0), -2) for i, t in enumerate(texts) if t]
        while live:
            if len(live) < FEW:
                for i, a, _, seed in live:
                    rest = [self.id_of.get(p) for found in self.lattice.stream([texts[i][a:].decode()], self.piece.get(seed, "")) for p in found]
                    out[i] = None if None in rest else out[i] + rest
                break
            found = self._search([texts[i][a:b] for i, a, b, _ in live], [seed for *_, seed in live], [b == len(texts[i]) for i, _, b, _ in live])
            more = []
            for (i, a, b, seed), committed in zip(live, found, strict=True):
                if committed is None:
                    out[i] = None
                    continue
                ids, size = committed
                out[i] += ids
                if b < len(texts[i]):
                    more.append((i, a + size, self._grown(texts[i], a + size, b), ids[-1] if ids else seed))
            live = more
        return out

    @staticmethod
    def _grown(text: bytes, begin: int, end: int) -> int:
        """Where a window ends next: by as much again as is undecided if that is more than WINDOW, before a character."""
        end = min(len(text), end + max(WINDOW, end - begin))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        return end

    def _search(self, texts: list[bytes], seeds: list[int], final: list[bool]) -> list[tuple[list[int], int] | None]:
        """For each window the ids up to the boundary in which its paths meet, and that boundary; the end if final."""
        n, size = len(texts), np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(np.arange(n), size)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        begin, state, limit, found = at, np.zeros(len(at), np.int64), off[own[at] + 1], []
        for step in range(self.longest):
            live = np.flatnonzero(begin + step < limit)
            if len(live) < len(begin):
                begin, state, limit = begin[live], state[live], limit[live]
            state = self.trie.step(state, data[begin + step].astype(np.uint64)).astype(np.int64)
            live = np.flatnonzero(state != Trie.DEAD)
            begin, state, limit = begin[live], state[live], limit[live]
            if not len(begin):
                break
            piece = self.trie.values[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((begin[hit], np.full(len(hit), step + 1), piece[hit]))
        begin, length, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        text = own[begin]
        begin, end = begin + text, begin + text + length  # boundaries: one more than bytes for each text
        local = end - off[text] - text
        order = np.lexsort((begin, local))
        begin, end, piece, local = begin[order], end[order], piece[order], local[order]
        start = off[:-1] + np.arange(n)
        last, back = np.full(len(data) + n, -1, np.int64), np.zeros(len(data) + n, np.int64)
        last[start] = seeds
        cuts = np.searchsorted(local, np.arange(1, (int(local[-1]) if len(local) else 0) + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            before, mine = last[begin[a:b]], np.arange(a, b)
            inner = np.flatnonzero(before >= 0)
            good = before == -2
            good[inner] = self._fit(before[inner], piece[a:b][inner])
            mine = mine[good]
            last[end[mine]], back[end[mine]] = piece[mine], begin[mine]
        pos = off[1:] + np.arange(n)
        done = last[pos] >= 0
        for i in np.flatnonzero(done & ~np.array(final)).tolist():
            pos[i] = self._meeting(back, last, int(start[i]), int(pos[i]))
        size = pos - start
        which = np.flatnonzero(done & (size > 0))
        pos, paths = pos[which], []
        while len(which):
            paths.append((which, last[pos]))
            pos = back[pos]
            keep = pos > start[which]
            which, pos = which[keep], pos[keep]
        if not paths:
            return [([], 0) if d else None for d in done.tolist()]
        text, ids = np.concatenate([w for w, _ in paths[::-1]]), np.concatenate([i for _, i in paths[::-1]])
        order = np.argsort(text, kind="stable")
        flat, edge = ids[order].tolist(), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).tolist()
        return [(flat[a:b], s) if d else None for a, b, s, d in zip(edge, edge[1:], size.tolist(), done.tolist(), strict=False)]

    def _meeting(self, back: np.ndarray, last: np.ndarray, start: int, end: int) -> int:
        """The boundary in which the paths of all boundaries that a further piece can begin at meet."""
        at = max(start, end - self.longest + 1)
        open_ = set((np.flatnonzero(last[at : end + 1] >= 0) + at).tolist())
        while len(open_) > 1:
            most = max(open_)
            open_.discard(most)
            open_.add(max(start, int(back[most])))
        return open_.pop()


class ViterbiEncoder(PieceEncoder):
    """Ids of whole texts by the search, and texts of ids; stretches between certain boundaries are kept."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds, form = sentencepiece_model_pb2.ModelProto.SentencePiece, proto.normalizer_spec
        if proto.trainer_spec.model_type not in (1, 2) or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.bytes = True
        self.tk = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.unknown = self.tk.unk_id()
        self.byte_ids = [self.tk.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None
        self.bpe, self.words = proto.trainer_spec.model_type == 2, False
        self.lattice = Lattice({p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}, self.bpe)
        # as is: a text only gets a space in front, and spaces become marks
        self.as_is = not form.precompiled_charsmap and not form.remove_extra_whitespaces and form.add_dummy_prefix and form.escape_whitespaces
        self.cuts = MARK in self.id_of and not any(MARK in p.lstrip(MARK) for p in self.id_of)
        longer = set().union(*(p for p in self.id_of if len(p) > 1))
        alone = self.bpe or self.byte_ids  # else unknown characters that meet become one id
        self.lone = np.array([bool(alone) and b < 128 and b != 32 and chr(b) not in longer for b in range(256)])
        raw = []
        for i, p in enumerate(proto.pieces):
            raw.append(bytes([self.byte_ids.index(i)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode())
        self.odd_ids = np.array([p.type in (kinds.CONTROL, kinds.UNKNOWN) for p in proto.pieces])
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.steps = LockStep(self.lattice, self.id_of, self.byte_ids or []) if self.bpe else None
        self.clear()

    def ids_of(self, found: list[str]) -> list[int]:
        out: list[int] = []
        for piece in found:
            i = self.id_of.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += (self.byte_ids[b] for b in piece.encode())
            elif self.bpe or not out or out[-1] != self.unknown:
                out.append(self.unknown)  # a unigram model gives one for a run
        return out

    def search(self, text: str) -> list[int]:
        """Ids of a text in the model's alphabet, a window at a time."""
        return self.ids_of([p for found in self.lattice.stream([text]) for p in found])

    def whole(self, text: str) -> list[int]:
        return self.search(MARK + text.replace(" ", MARK) if self.as_is and text else self.tk.normalize(text))

    def _ids_of(self, pieces: list[tuple[int, bytes]]) -> list[tuple[int, list[int]]]:
        texts = [b.replace(b" ", MARK.encode()) for _, b in pieces]
        found = self.steps.search(texts) if self.bpe else [None] * len(texts)
        return [(h, self.search(t.decode()) if ids is None else ids) for (h, _), t, ids in zip(pieces, texts, found, strict=True)]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with the mark itself are searched whole."""
        n = len(offsets) - 1
        out = np.zeros(n, bool)
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        out[np.searchsorted(offsets, at, "right") - 1] = True
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word with the spaces before it, and the spaces that end a row; bytes that no longer piece holds stand alone."""
        _, ends, first = W.spans(data, offsets, SPACE)
        lone = np.flatnonzero(self.lone[data])
        starts = np.sort(np.concatenate([offsets, ends, lone, lone + 1]), kind="stable")
        starts = starts[: np.searchsorted(starts, len(data))]
        starts = starts[np.diff(starts, prepend=-1) > 0]
        return starts, np.append(starts[1:], len(data))

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not (self.as_is and self.cuts):
            parts = [np.array(self.whole(data[a:b].tobytes().decode()), np.uint32) for a, b in zip(offsets, offsets[1:], strict=False)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        some = (np.diff(offsets) > 0).astype(np.int64)
        at = offsets + np.concatenate([[0], np.cumsum(some)])
        text = np.full(len(data) + int(some.sum()), 32, np.uint8)
        text[np.arange(len(data)) + np.repeat(np.cumsum(some), np.diff(offsets))] = data
        return super().encode_slice(text, at)

    def _whole_row(self, row: bytes) -> list[int]:
        return self.whole(row[1:].decode())  # without the space that encode_slice put in front

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        ids = ids.astype(np.int64)
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.raw_at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        odd = np.concatenate([[0], np.cumsum(self.odd_ids[ids])])
        out = []
        for a, b in zip(offsets, offsets[1:], strict=False):
            text = None
            if self.as_is and odd[a] == odd[b]:
                try:
                    text = data[total[a] : total[b]].decode()
                except UnicodeDecodeError:
                    pass
            out.append(self.tk.decode(ids[a:b].tolist()) if text is None else text.removeprefix(" "))
        return out


_LOADED: dict[str, ViterbiEncoder] = {}


def encoder(path: str) -> ViterbiEncoder:
    """The worker's encoder for a model file; it outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = ViterbiEncoder(path)
    return _LOADED[path]


def _with_column(df: DataFrame, name: str, kind: DataType, used: str, made) -> DataFrame:
    """df with a column that a function of an Arrow column makes; a column of that name is replaced."""
    keep = [c for c in df.columns if c.lower() != name.lower()]
    schema = StructType([*df.select(*keep).schema.fields, StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made(batch.column(used))], names=[*keep, name])

    return df.select(*keep).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text (array<int>)."""
    path = model or public_path("piece_bpe_32k.model")

    def made(column: pa.Array) -> pa.Array:
        found = [ids for _, ids in encoder(path).encode(column)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)))

    return _with_column(docs, ids_col, ArrayType(IntegerType()), text_col, made)


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the text of each row's ids; null ids are none."""
    path = model or public_path("piece_bpe_32k.model")

    def made(column: pa.Array) -> pa.Array:
        sizes = np.asarray(column.value_lengths().fill_null(0))
        return pa.array(encoder(path).decode(np.asarray(column.flatten(), np.int64), np.concatenate([[0], np.cumsum(sizes)])), pa.string())

    return _with_column(encoded, text_col, StringType(), ids_col, made)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and digests of each text's ids and of what they decode to; ``same``: that is the text itself."""
    path = model or public_path("piece_bpe_32k.model")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, doc_ids, at = encoder(path), batch.column("doc_id"), 0
            for a, b, data, offsets in W.slices(batch.column("text")):
                ids, cuts = own.encode_slice(data, offsets)
                texts = own.decode(ids, cuts)
                raw = [t.encode() for t in texts]
                le, text = ids.astype("<u4"), data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(at, b - a), pa.array(np.diff(cuts).astype(np.int64)), pa.array([zlib.crc32(le[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([len(t) for t in texts], pa.int64()), pa.array([r == text[i:j] for r, i, j in zip(raw, offsets, offsets[1:], strict=False)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "text_sha256", "n_chars", "same"],
                )
                at += b - a

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {DIGEST}")
