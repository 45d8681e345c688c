"""Token counts by the transducer against the tokenizers library."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from test_tokens import FILES, texts
from tokenizers import Tokenizer

from textloom.llm import pieces
from textloom.llm import transducer as T

PATH = pieces.public_path("word_bpe_49k.json")
LONG = ["x" * 700 + " y " + "z" * 199 + " " + "é" * 300, "ab " * 2000, "q" * 5000, " " * 600, ("w" * 200 + " ") * 5, "z" * 256 + " a", "the" * 9000 + "n"]
MARKS = ["it's 'sam's ''ll we're we'r 5's don't", "'s's't're've'm'll'd'x", "'", "''", "a'", "12 3²", "!?!'s...'t", "a<|endoftext|>b<|startoftext|> c<|end", "<|endoftext|>"]
WIDE = ["İstanbul ΑΣ Σ ß ÜBER ȺȾ K", "éà ́x", "　a​b c d", "日本語テキスト한국어", "ﬁ½²", "𝒜𝓑 😀😀👩‍👩‍👧"]


def library(all_texts, name=PATH):
    return [len(e.ids) for e in Tokenizer.from_file(name).encode_batch_fast([t or "" for t in all_texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("most", [50, T.MOST_STATES])
def test_counts_are_the_library_s(name, most, monkeypatch):
    monkeypatch.setattr(T, "MOST_STATES", most)
    own, all_texts = T.Counter(pieces.public_path(name)), texts(1200, 9) + LONG + MARKS + WIDE
    random.Random(1).shuffle(all_texts)
    want = library(all_texts, pieces.public_path(name))
    for _ in range(2):
        assert own.counts(pa.array(all_texts)).tolist() == want


def test_small_chunks_and_segments(monkeypatch):
    """Maps that are not known at the state a chunk is entered in, and a text that crosses segments."""
    monkeypatch.setattr(T, "CHUNK", 7)
    monkeypatch.setattr(T, "WARM", 2)
    monkeypatch.setattr(T, "SEGMENT", 1000)
    all_texts = LONG + ["internationalisation" * 300] + MARKS + WIDE
    assert T.Counter(PATH).counts(pa.array(all_texts)).tolist() == library(all_texts)


def test_every_letter_of_some_blocks():
    codes = [c for a, b in ((0, 0x2000), (0x1E00, 0x2100), (0xAC00, 0xAC80), (0x1D400, 0x1D500)) for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    all_texts = [f"a{chr(c)}b 1{chr(c)}'s {chr(c)}" for c in codes]
    assert T.Counter(PATH).counts(pa.array(all_texts)).tolist() == library(all_texts)


def test_transitions_emit_what_the_encoding_grows_by():
    own = T.Counter(PATH)
    model = own.machine.merges
    word = b"understanding"
    symbols = np.array([*word[:-1], word[-1] + T.END, T.GAP], np.int32)
    emitted = own.machine.run(symbols)[0].astype(int) - T.LIFT
    tk = Tokenizer.from_file(PATH)
    assert emitted.sum() == len(tk.encode(word.decode(), add_special_tokens=False).ids)
    grown = []  # tokens of each beginning, merged without a word's end
    for n in range(1, len(word)):
        parts = [model.single[b] for b in word[:n]]
        while pairs := [(model.merge[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in model.merge]:
            i = min(pairs)[1]
            parts[i : i + 2] = [model.merge[parts[i], parts[i + 1]][1]]
        grown.append(len(parts))
    assert np.cumsum(emitted)[: len(grown)].tolist() == grown


def test_scan_composes_partial_maps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        for wrong in (0.0, 0.05, 0.5):
            leave = rng.integers(0, 9, n)
            enter = np.concatenate([[T.START], leave[:-1]])
            enter = np.where(rng.random(n) < wrong, enter + 1, enter)
            enter[0] = T.START
            want = np.logical_and.accumulate(np.concatenate([[True], enter[1:] == leave[:-1]]))
            assert (T.compose(enter, leave) == want).all()


def test_query_columns(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts(100, 2))] + [(None, "a b", "x", 2), (3, "word " * 2049, "x", 3), (4, "lang" * 200_000 + " und " * 50_000, "x", 4)]
    got = T.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes long")).collect()
    want = [(str(d), len((t or "").encode()), n) for (d, t, *_), n in zip(rows, library([t for _, t, *_ in rows]), strict=True)]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
