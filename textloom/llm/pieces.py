"""Token ids of whole texts, exactly as the tokenizers library gives them, from a cache of pieces.

A text is cut where the tokenizer's own rules always cut: at white space. Each distinct piece goes to the library once
per worker; a batch is then a lookup of piece hashes and one gather of ids. Texts to which the cut does not apply
(special-token strings, combining marks before lower-casing, white space outside ASCII) go to the library whole, as do
all texts of a tokenizer whose configuration is not one of the two known kinds.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from textloom.llm import words as W
from textloom.llm.tables import Table

#: Pieces and ids that a worker keeps before it begins anew; pieces that it learns at once.
MOST_PIECES, MOST_IDS, LEARN = 800_000, 8_000_000, 200_000
_LOADED: dict[str, PieceEncoder] = {}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


_BYTE = dict(enumerate(byte_chars()))


def mapped(text: str) -> str:
    return text.encode().decode("latin-1").translate(_BYTE)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        with open(path) as f:
            d = json.load(f)
        normal, pre = d.get("normalizer"), d.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in (normal or {}).get("normalizers", [])]
        plain = not d.get("post_processor") and not d.get("truncation") and not d.get("padding")
        self.words = plain and kinds == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]
        self.bytes = plain and normal is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex")
        self.special = [x["content"].encode() for x in d.get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        self.slot = Table()
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def whole(self, text: str) -> list[int]:
        return self.tk.encode(text, add_special_tokens=False).ids

    def _whole_row(self, row: bytes) -> list[int]:
        return self.whole(row.decode())

    def _simple(self, text: str) -> list[int] | None:
        """Ids of letters with one final full stop or comma at most, straight from the model."""
        lead = self.bytes and text[:1] == " "
        body = text[1:] if lead else text
        core = body.rstrip(".,")
        if not core.isalpha() or len(body) - len(core) > 1 or not (core.isascii() or max(core) < "ɐ" and unicodedata.is_normalized("NFC", core)):
            return None
        if self.words and core.lower() != core:
            return None
        model = self.tk.model
        ids = [t.id for t in model.tokenize(mapped(" " + core if lead else core))]
        return ids + [t.id for t in model.tokenize(body[len(core) :])] if len(body) > len(core) else ids

    def _ids_of(self, pieces: list[tuple[int, bytes]]) -> list[tuple[int, list[int]]]:
        """Hashes and ids of distinct pieces."""
        hard: list[tuple[int, str]] = []
        got: list[tuple[int, list[int]]] = []
        for h, b in pieces:
            text = b.decode()
            ids = self._simple(text) if len(b) <= W.LONG else None
            if ids is None:
                hard.append((h, text))
            else:
                got.append((h, ids))
        for at in range(0, len(hard), 1000):
            part = hard[at : at + 1000]
            got += [(h, e.ids) for (h, _), e in zip(part, self.tk.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True)]
        return got

    def _learn(self, pieces: list[tuple[int, bytes]]) -> None:
        got = self._ids_of(pieces)
        n, size = self.slot.used, np.array([len(ids) for _, ids in got], np.int64)
        flat = np.fromiter(chain.from_iterable(ids for _, ids in got), np.uint32, int(size.sum()))
        while n + len(got) > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.begin[n : n + len(got)], self.size[n : n + len(got)] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slot.put(np.array([h for h, _ in got], np.uint64), np.arange(n, n + len(got), dtype=np.int32))

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that go to the library whole."""
        n = len(offsets) - 1
        if not (self.words or self.bytes):
            return np.ones(n, bool)
        after = np.append(data[1:], 0)
        if self.words:
            bad = (data == 0xCC) | (data == 0xCD)
        else:
            bad = (data == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (data == 0xE1) & (after == 0x9A) | (data == 0xE2) & ((after == 0x80) | (after == 0x81)) | (data == 0xE3) & (after == 0x80)
        for s in {x[:2] for x in self.special}:
            bad |= (data == s[0]) & (after == s[1] if len(s) > 1 else True)
        out = np.zeros(n, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = W.spans(data, offsets)
        if self.words:
            return starts, ends
        # byte level: a run of white space before a word gives up its last character, to the word if that is a space
        row = W.doc_of(first)
        before = np.empty_like(starts)
        before[1:] = ends[:-1]
        before[first[:-1][np.diff(first) > 0]] = 0
        before = np.maximum(before, offsets[row])
        run = starts - before
        spaced = (run > 0) & (data[np.maximum(starts - 1, 0)] == 32)
        a, b = run >= 2, (run >= 1) & ~spaced
        last = np.where(np.diff(first) > 0, np.append(ends, 0)[np.maximum(first[1:] - 1, 0)], offsets[:-1]) if len(ends) else offsets[:-1]
        t = last < offsets[1:]
        s = np.concatenate([starts - spaced, before[a], starts[b] - 1, last[t]])
        e = np.concatenate([ends, starts[a] - 1, starts[b], offsets[1:][t]])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a slice, and each row's offset into them."""
        n = len(offsets) - 1
        odd = self._odd(data, offsets)
        text = W.LOWER[data] if self.words else data
        starts, ends = self._pieces(text, offsets) if not odd.all() else (np.zeros(0, np.int64),) * 2
        row = np.searchsorted(offsets, starts, "right") - 1
        if odd.any():
            keep = ~odd[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        h = np.maximum(W.hashes(text, starts, ends), np.uint64(1))
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        cut = lambda of: [(k, text[starts[i] : ends[i]].tobytes()) for k, i in zip(keys[of].tolist(), where[of].tolist(), strict=True)]
        slots = self.slot.get(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            if self.slot.used + len(missing) > MOST_PIECES or self.used > MOST_IDS:
                self.clear()
                missing = np.arange(len(keys))
            for at in range(0, len(missing), LEARN):
                self._learn(cut(missing[at : at + LEARN]))
            slots = self.slot.get(keys)
        slot = slots[inverse]
        size = self.size[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.begin[slot] - total[:-1], size) + np.arange(total[-1])]
        at = total[np.searchsorted(row, np.arange(n + 1))]
        if not odd.any():
            return ids, at
        parts = [np.array(self._whole_row(data[offsets[i] : offsets[i + 1]].tobytes()), np.uint32) if odd[i] else ids[at[i] : at[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text in order; a null is empty."""
        for a, b, data, offsets in W.slices(column):
            ids, at = self.encode_slice(data, offsets)
            for i in range(b - a):
                yield a + i, ids[at[i] : at[i + 1]]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a file; it outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
