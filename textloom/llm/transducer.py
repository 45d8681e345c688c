"""Token counts (operator 6) by a finite-state transducer compiled from a tokenizer's own rules.

The machine reads the bytes of normalised text. A symbol is a byte, a byte that ends a pre-token, or a gap between
pre-tokens. A state says which pieces of the vocabulary may still be under way: for each of their begins, the place in
the vocabulary's trie, the token that ends there, and how many tokens more or less the text has there than here. The
encoding of a text's beginning is its last token after the encoding of what stands before that token, and a token may
follow another exactly if merging both side by side leaves them apart. So of the tokens that end at a symbol just one is
admissible. The transition emits by how many tokens the encoding has grown (a number below zero where a merge took
tokens back), and what a pre-token emits adds up to its tokens. Pieces have bounded length, so states are finitely many.
They are compiled from merges and ranks when first met, and kept by the worker. The tokenizers library is not asked.

A run of symbols is cut into chunks of ``CHUNK``, which advance in lock-step, one symbol of each a step. A chunk's state
map is a partial function, known at the entries from which the chunk was run: first at a guess, the state that the ``WARM``
symbols before it lead to. A prefix scan by doubling composes the maps. Where a composition is not defined, as a chunk
entered in a state that it was not run from, it is run from there and the scan goes on. Counts are exact either way.

The normaliser (composition, lower case by character) and the pre-tokenizer (contractions, runs of letters, single
digits, runs of others) are applied to whole slices of code points. Strings of special tokens count as one token each
and part the text. A tokenizer of another kind than the word-level byte BPE is counted by its library.

Null and empty texts have no tokens. Repeated rows are counted each. An empty table gives an empty result. The machine
is dropped at ``MOST_STATES`` states and compiled anew, so its memory is bounded; a text of any length is run in
segments of ``SEGMENT`` symbols, each entered in the state that the one before it left.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from textloom.llm import words as W
from textloom.llm.pieces import byte_chars, public_path

CHUNK, WARM, SEGMENT, MOST_STATES, MOST_FITS, OVER = 512, 48, 1 << 20, 150_000, 1_000_000, 2048
START, ROOT, NONE, END, GAP = 0, 0, -1, 256, 512
LIFT = 128  # emitted counts are kept in a byte
INF = 1 << 60

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Merges:
    """A vocabulary of byte pairs: which tokens merging builds, and which may stand side by side."""

    def __init__(self, model: dict):
        suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        byte = {c: b for b, c in enumerate(byte_chars())}
        self.symbols: dict[int, list[int]] = {}
        for token, i in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            of = [byte.get(c, NONE) for c in (token[: -len(suffix)] if ends else token)]
            if NONE not in of:
                self.symbols[i] = of[:-1] + [of[-1] + END * ends]
        self.single = {of[0]: i for i, of in self.symbols.items() if len(of) == 1}
        if not suffix:  # a pre-token's last byte is like any other
            self.single |= {s + END: i for s, i in self.single.items()}
        self.open = not suffix
        self.history: dict[int, list[tuple[int, int, int]] | None] = {}
        self.fit: dict[int, bool] = {}

    def built(self, token: int) -> list[tuple[int, int, int]] | None:
        """(rank, first part, last part) after each merge that builds a token; None if merging builds something else."""
        if token not in self.history:
            parts = [self.single[s] for s in self.symbols[token]]
            out = [(INF, parts[0], parts[-1])]
            while len(parts) > 1:
                rank, i = min((self.merge[p][0], i) if (p := (a, b)) in self.merge else (INF, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == INF:
                    break
                parts[i : i + 2] = [self.merge[parts[i], parts[i + 1]][1]]
                out.append((rank, parts[0], parts[-1]))
            self.history[token] = out if parts == [token] else None
        return self.history[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: both are built lowest rank first, and no merge across comes before."""
        left, right, i, j = self.built(a), self.built(b), 0, 0
        while True:
            across = self.merge.get((left[i][2], right[j][1]), (INF,))[0]
            x = left[i + 1][0] if i + 1 < len(left) else INF
            y = right[j + 1][0] if j + 1 < len(right) else INF
            if across < x and across <= y or x == y == INF:
                break
            i, j = (i + 1, j) if x <= y else (i, j + 1)
        if len(self.fit) > MOST_FITS:
            self.fit.clear()
        self.fit[a << 20 | b] = across == INF
        return across == INF


def begin(before: int) -> int:
    """A piece that begins here, after a token. States are tuples of such: trie node, token before, lifted count before."""
    return ROOT << 28 | before + 1 << 8 | LIFT


class Machine:
    """The transducer: a dense table of packed next states and counts, by state and symbol. 0 is a transition not yet compiled."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.trie: dict[int, int] = {}  # (node, symbol) to node
        self.token = [NONE]
        self.inner = [True]  # nodes that go on
        for i, of in sorted(merges.symbols.items()):
            if len(of) > 1 and merges.built(i) is None:
                continue
            node = ROOT
            for s in of:
                to = self.trie.get(node << 10 | s)
                if to is None:
                    to = self.trie[node << 10 | s] = len(self.token)
                    self.token.append(NONE)
                    self.inner.append(False)
                    self.inner[node] = True
                node = to
            self.token[node] = i
        self.compile()

    def compile(self, state: tuple | None = None) -> int:
        """Forgets all states but the start and the given one; its new number."""
        start = (begin(NONE),)
        self.info, self.number = [start], {start: START}
        # the columns of the symbols that were met, the gap first
        self.met, self.column, self.bits = [GAP], np.full(GAP + 1, -1, np.int32), 8
        self.column[GAP] = 0
        self.moves = np.zeros(1 << 20, np.int32)
        return self._numbered(state or start)

    def _numbered(self, state: tuple) -> int:
        i = self.number.setdefault(state, len(self.info))
        if i == len(self.info):
            self.info.append(state)
            if len(self.info) << self.bits > len(self.moves):
                self.moves = np.concatenate([self.moves, np.zeros(len(self.moves), np.int32)])
        return i

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """The table's columns of symbols; new symbols get one."""
        for s in np.flatnonzero((np.bincount(symbols, minlength=GAP + 1) > 0) & (self.column < 0)).tolist():
            self.column[s] = len(self.met)
            self.met.append(s)
        while len(self.met) > 1 << self.bits:
            wide = np.zeros((len(self.moves) >> self.bits, 2 << self.bits), np.int32)
            wide[:, : 1 << self.bits] = self.moves.reshape(-1, 1 << self.bits)
            self.moves, self.bits = wide.reshape(-1), self.bits + 1
        return self.column[symbols]

    def _move(self, state: int, symbol: int) -> int:
        """The packed next state and count of a transition, from the merges."""
        if symbol == GAP:
            return START << 8 | LIFT
        trie, token, inner, fit, fits = self.trie.get, self.token, self.inner, self.merges.fit.get, self.merges.fits
        ends, found, count, live = symbol >= END, NONE, 0, []
        read = symbol - END if ends and self.merges.open else symbol
        for entry in self.info[state]:
            to = trie(entry >> 28 << 10 | read)
            if to is None:
                continue
            if found < 0 and token[to] >= 0:
                before, t = (entry >> 8 & 0xFFFFF) - 1, token[to]
                if before >= 0:
                    good = fit(before << 20 | t)
                    if good is None:
                        good = fits(before, t)
                if before < 0 or good:
                    found, count = t, (entry & 255) - LIFT + 1
            if inner[to] and not ends:
                live.append(to << 28 | entry & 0xFFFFFFF)
        if found < 0:
            raise ValueError(f"the vocabulary has no token for byte {symbol & 255}")
        if not -LIFT < count < LIFT:
            raise ValueError("a token of more than 127 bytes")
        return (START if ends else self._numbered((*[e - count for e in live], begin(found)))) << 8 | count + LIFT

    def step(self, packed: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The packed next states and emitted counts; transitions that are not there yet are compiled."""
        at = (packed & -256).astype(np.int64)
        if self.bits > 8:
            at <<= self.bits - 8
        at += column
        out = self.moves[at]
        if not out.all():
            keys = np.unique(at[out == 0])
            made = [self._move(k >> self.bits, self.met[k & (1 << self.bits) - 1]) for k in keys.tolist()]
            self.moves[keys] = made
            out = self.moves[at]
        return out

    def _advance(self, packed: np.ndarray, columns: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The packed states after all rows of columns, a chunk each; the emitted counts, lifted, go to out."""
        for i, row in enumerate(columns):
            packed = self.step(packed, row)
            if out is not None:
                out[i] = packed.astype(np.uint8)
        return packed & -256

    def run(self, symbols: np.ndarray, entry: int = START) -> tuple[np.ndarray, int]:
        """The emitted counts by symbol, lifted, of a run that is entered in a state, and the state that it leaves."""
        n = -(-len(symbols) // CHUNK)
        rows = np.zeros(n * CHUNK, np.int32)
        rows[: len(symbols)] = self.columns(symbols)
        rows = np.ascontiguousarray(rows.reshape(n, CHUNK).T)
        guess = self._advance(np.full(n, START, np.int32), rows[CHUNK - WARM :])
        enter = np.concatenate([np.array([entry << 8], np.int32), guess[:-1]])
        out = np.zeros((CHUNK, n), np.uint8)
        leave = self._advance(enter, rows, out)
        while not compose(enter, leave).all():
            # where a chunk meets a state that its map is not known at, all such at once
            todo = np.flatnonzero(enter[1:] != leave[:-1]) + 1
            enter[todo] = leave[todo - 1]
            some = np.zeros((CHUNK, len(todo)), np.uint8)
            leave[todo] = self._advance(enter[todo], np.ascontiguousarray(rows[:, todo]), some)
            out[:, todo] = some
        # the padding is gaps: the state at the end is that of the last symbol
        rest = len(symbols) % CHUNK
        last = self._advance(enter[-1:], rows[:rest, -1:]) if rest else leave[-1:]
        return np.ascontiguousarray(out.T).reshape(-1)[: len(symbols)], int(last[0]) >> 8

    def sums(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What a text of any length emits between places in it, run from the start, by segments."""
        out, state = np.zeros(len(at) - 1, np.int64), START
        for begin in range(0, len(symbols), SEGMENT):
            if len(self.info) > MOST_STATES:
                state = self.compile(self.info[state])
            part, state = self.run(symbols[begin : begin + SEGMENT], state)
            total = np.concatenate([[0], np.cumsum(part, dtype=np.int64)])
            cut = np.clip(at - begin, 0, len(part))
            out += total[cut[1:]] - total[cut[:-1]] - LIFT * (cut[1:] - cut[:-1])
        return out


def compose(enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Whether the composition of each chunk's map after all maps before it is defined, by a parallel prefix scan.

    A map is the partial function that takes enter to leave. Maps of neighbours, f then g, compose to one that takes f's
    enter to g's leave, defined if f leaves in the state that g is known to be entered in.
    """
    first, known, shift = enter.copy(), np.ones(len(enter), bool), 1
    while shift < len(enter):
        fits = known[:-shift] & known[shift:] & (leave[:-shift] == first[shift:])
        known[shift:], first[shift:], shift = fits, first[:-shift].copy(), 2 * shift
    return known


class Characters:
    """Lower case and kind of each code point; built once a worker."""

    def __init__(self) -> None:
        self.lower, self.kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
        self.longer: dict[int, str] = {}
        kinds = {"L": LETTER, "N": DIGIT}
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            kind = kinds.get(unicodedata.category(x)[0])
            if kind:
                self.kind[c] = kind
            low = x.lower()
            if low != x:
                if len(low) == 1:
                    self.lower[c] = ord(low)
                else:
                    self.longer[c] = low
        self.kind[WHITE] = SPACE
        # characters whose lower case is several, or has another number of bytes
        size = 1 + (np.arange(0x110000) >= 0x80) + (np.arange(0x110000) >= 0x800) + (np.arange(0x110000) >= 0x10000)
        self.longer |= {int(c): chr(self.lower[c]) for c in np.flatnonzero(size != size[self.lower])}


class Counter:
    """Token counts of texts by the compiled machine of a tokenizer file."""

    def __init__(self, path: str):
        with open(path) as f:
            d = json.load(f)
        normal, pre = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])], d.get("pre_tokenizer") or {}
        steps = [x["type"] for x in pre.get("pretokenizers", [])]
        self.own = None
        if d["model"]["type"] != "BPE" or d.get("truncation") or d.get("padding") or d["model"].get("byte_fallback") or normal != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"]:
            from textloom.llm.pieces import PieceEncoder

            self.own = PieceEncoder(path)
            return
        self.machine, self.characters = Machine(Merges(d["model"])), Characters()
        special = [x["content"] for x in d.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.odd = np.arange(256) >= 0xCC
        self.odd[[0xC4, 0xC8, *(s.encode()[0] for s in special)]] = True
        self.longer = re.compile("[" + "".join(map(chr, self.characters.longer)) + "]")
        self.ascii = np.concatenate([self.characters.kind[:128], np.zeros(128, np.uint8)])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slice with odd rows put in the normal form, and the special tokens taken out of each row."""
        n = len(offsets) - 1
        taken = np.zeros(n, np.int64)
        # what lies below U+0300 is composed, and U+0130, U+023A and U+023E alone have other lower cases there
        at = np.flatnonzero(self.odd[data])
        odd = np.unique(np.searchsorted(offsets, at, "right") - 1).tolist()
        if not odd:
            return data, offsets, taken
        rows = []
        raw = data.tobytes()
        changed = False
        last = 0
        sizes = np.diff(offsets)
        for i in odd:
            was = raw[offsets[i] : offsets[i + 1]]
            text = was.decode()
            if self.special:
                text, taken[i] = self.special.subn(" ", text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = self.longer.sub(lambda m: self.characters.longer[ord(m[0])], text)
            now = text.encode()
            if now != was:
                rows += [raw[last : offsets[i]], now]
                last, sizes[i], changed = offsets[i + 1], len(now), True
        if not changed:
            return data, offsets, taken
        rows.append(raw[last:])
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), taken

    def _kinds(self, text: np.ndarray) -> np.ndarray:
        """The kind of each byte's character, and lower case put in its place where it has as many bytes."""
        kind = self.ascii[text]
        at = np.flatnonzero(text >= 0xC0)
        if not len(at):
            return kind
        lead, follow = text[at], [text[np.minimum(at + k, len(text) - 1)].astype(np.uint32) & 63 for k in (1, 2, 3)]
        size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        code = lead.astype(np.uint32) & np.array([0, 0, 31, 15, 7], np.uint32)[size]
        for k, more in enumerate(follow, 1):
            code = np.where(size > k, code << np.uint32(6) | more, code)
        low = self.characters.lower[code]
        change = np.flatnonzero(low != code)
        for i, c in zip(change.tolist(), low[change].tolist(), strict=True) if len(change) < 64 else ():
            text[at[i] : at[i] + size[i]] = np.frombuffer(chr(c).encode(), np.uint8)
        if len(change) >= 64:
            new = np.frombuffer(low[change].tobytes().decode("utf-32-le").encode(), np.uint8)
            w = size[change]
            text[np.repeat(at[change] - (np.cumsum(w) - w), w) + np.arange(len(new))] = new
        of = self.characters.kind[low]
        for k in range(4):
            some = np.flatnonzero(size > k)
            kind[at[some] + k] = of[some]
        return kind

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all rows, a gap after each row, and where each row begins."""
        n = len(offsets) - 1
        at = offsets + np.arange(n + 1)
        text = np.empty(len(data) + n, np.uint8)
        gap = np.ones(len(text), bool)
        gap[at[1:] - 1] = False
        text[gap], text[at[1:] - 1] = W.LOWER[data], 10
        kind = self._kinds(text)
        before = np.empty_like(kind)
        before[:1], before[1:] = SPACE, kind[:-1]
        start = (kind != before) | (kind == DIGIT)
        start &= (text & 0xC0) != 0x80
        self._contractions(text, kind, before, start)
        blank = kind == SPACE
        ends = ~blank
        ends[:-1] &= start[1:] | blank[1:]
        out = text.astype(np.int32)
        out[ends] += END
        out[blank] = GAP
        return out, at

    @staticmethod
    def _contractions(text: np.ndarray, kind: np.ndarray, before: np.ndarray, start: np.ndarray) -> None:
        """An apostrophe that begins a pre-token takes one of a few endings with it; what follows begins anew."""
        at = np.flatnonzero(text == 39)
        at = at[before[at] != OTHER]
        one, two = (text[np.minimum(at + k, len(text) - 1)] for k in (1, 2))  # a row ends in a gap
        size = np.where(np.isin(one, [*b"stmd"]), 2, np.where((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108), 3, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        to = at + size
        start[to[kind[to] != SPACE]] = True

    def counts(self, column: pa.Array) -> np.ndarray:
        """Token counts of the texts of a column."""
        parts = [np.zeros(0, np.int64)]
        for a, b, data, offsets in W.slices(column):
            if self.own:
                parts.append(np.array([len(self.own.whole(data[i:j].tobytes().decode())) for i, j in zip(offsets, offsets[1:], strict=False)], np.int64))
                continue
            data, offsets, taken = self._plain(data, offsets)
            symbols, at = self.symbols(data, offsets)
            parts.append(self.machine.sums(symbols, at) + taken)
        return np.concatenate(parts)


_BUILT: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's machine for a tokenizer file; it outlives a task."""
    if path not in _BUILT:
        _BUILT[path] = Counter(path)
    return _BUILT[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs."""
    path = tokenizer or public_path("word_bpe_49k.json")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column("text")
            n = own.counts(texts)
            size = np.array(pa.compute.binary_length(texts).fill_null(0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > over)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
