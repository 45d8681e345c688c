"""SentencePiece encoding and decoding against the library, on the public BPE model and on small unigram models."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as S
from sentencepiece import sentencepiece_model_pb2 as M
from textloom.llm import viterbi as V
from textloom.llm.common import table
from textloom.llm.queries import op3_sentencepiece

PATH = V.public_path("piece_bpe_32k.model")
LIBRARY = S.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "", " ", "   ", "a", " a ", "hello  world", "hello\nworld\n\n", "x ▁ y", "▁▁", "tab\tand\rreturn", "<s>not special</s> <unk> <0x41>", "日本語のテキスト𠮷", "é é ß", "\x00\x01", "a" * 5000, " " * 700, "0123456789" * 200,
    "thequickbrownfox" * 300, "…　  x",
]


def noise(seed, n=400):
    rng = random.Random(seed)
    alphabet = "   abcdeinorst  ▁\n\t日本é̈ß𠮷.,;019ABT"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def encoded(own, texts):
    return [ids.tolist() for _, ids in own.encode(pa.array(texts, pa.string()))]


def test_ids_and_texts_are_the_librarys():
    own, texts = V.encoder(PATH), TEXTS + noise(1)
    got = encoded(own, texts)
    assert got == [LIBRARY.encode(t) for t in texts]
    flat, at = np.concatenate([np.array(g, np.int64) for g in got]), np.concatenate([[0], np.cumsum([len(g) for g in got])])
    assert own.decode(flat, at) == [LIBRARY.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]


def test_decoding_of_broken_bytes_and_control_ids():
    own = V.encoder(PATH)
    for ids in ([243, 163], [1, 6312, 2], [0], [243, 163, 177, 186, 131], []):
        assert own.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [LIBRARY.decode(ids)]


def test_streaming_commits_early_and_gives_the_same_ids():
    own = V.encoder(PATH)
    for text in [*TEXTS[12:], *noise(2, 50)]:
        if not text or "\x00" in text:
            continue
        marked = V.MARK + text.replace(" ", V.MARK)
        parts = list(own.lattice.stream(marked[i : i + 7] for i in range(0, len(marked), 7)))
        assert own.ids_of([p for found in parts for p in found]) == LIBRARY.encode(text)
    parts = list(own.lattice.stream([V.MARK + "thequickbrownfox" * 300]))
    assert len(parts) > 20 and max(sum(map(len, p)) for p in parts) < 200


def test_lock_step_streams_stretches_of_any_length(monkeypatch):
    own, rng = V.encoder(PATH), random.Random(5)
    words = "the quick brown fox thequick 日本語 straße naïve 0123 ...... aaaa éé".split()
    texts = ["".join(rng.choice(words) for _ in range(n)) for n in (1, 40, 60, 64, 200, 3000)] + ["ab" * n for n in (127, 128, 129, 5000)] + ["日本" * 700]
    windows = []
    search = V.LockStep._search
    monkeypatch.setattr(V.LockStep, "_search", lambda self, texts, *more: windows.extend(map(len, texts)) or search(self, texts, *more))
    for size, few in ((16, 0), (16, 5), (V.WINDOW, 0), (V.WINDOW, V.FEW), (1 << 20, 0)):
        monkeypatch.setattr(V, "WINDOW", size)
        monkeypatch.setattr(V, "FEW", few)
        windows.clear()
        found = own.steps.search([(V.MARK + t).encode() for t in texts])
        assert all(f is not None for f in found) and found == [LIBRARY.encode(t) for t in texts]
        assert size > 1 << 16 or max(windows) <= max(4 * size, 600)


def test_one_very_long_text_without_white_space(spark):
    text = "thequickbrownfox,日本語" * 12_000
    docs = spark.createDataFrame([(1, text, 0), (2, "x", 0)], "doc_id long, text string, ids long")
    got = {r.doc_id: r for r in V.digests(docs).collect()}
    ids = LIBRARY.encode(text)
    assert got[1].n_tokens == len(ids) and got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and got[1].same
    assert got[2].n_tokens == len(LIBRARY.encode("x"))


def model(tmp_path, pieces, fallback=False, tidy=False):
    proto = M.ModelProto()
    kinds = M.ModelProto.SentencePiece
    proto.pieces.add(piece="<unk>", score=0, type=kinds.UNKNOWN)
    proto.pieces.add(piece="<s>", score=0, type=kinds.CONTROL)
    proto.pieces.add(piece="</s>", score=0, type=kinds.CONTROL)
    for b in range(256) if fallback else ():
        proto.pieces.add(piece=f"<0x{b:02X}>", score=0, type=kinds.BYTE)
    for p, score in pieces.items():
        proto.pieces.add(piece=p, score=score, type=kinds.NORMAL)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, fallback
    proto.normalizer_spec.name, proto.normalizer_spec.remove_extra_whitespaces = "identity", tidy
    path = str(tmp_path / f"{fallback}{tidy}.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return path


@pytest.mark.parametrize(("fallback", "tidy"), [(False, False), (True, False), (False, True)])
def test_unigram_models(tmp_path, fallback, tidy):
    rng = random.Random(3)
    names = {V.MARK, *"abcn", *("".join(rng.choice("abcn") for _ in range(rng.randint(2, 6))) for _ in range(60)), *(V.MARK + "".join(rng.choice("abcn") for _ in range(rng.randint(1, 4))) for _ in range(40))}
    path = model(tmp_path, {p: -rng.uniform(2, 12) for p in sorted(names)}, fallback, tidy)
    own, library = V.ViterbiEncoder(path), S.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "abc", "  a  b ", "xyz", "axyzb x", *("".join(rng.choice("abcn  x\né") for _ in range(rng.randint(0, 120))) for _ in range(300))]
    assert encoded(own, texts) == [library.encode(t) for t in texts]


def test_unigram_path_is_the_best_of_all():
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -4.2, "aba": -7.0, "bab": -9.0}
    lattice = V.Lattice(scores, False)

    def brute(text):
        if not text:
            return [(0.0, [])]
        return [(scores[text[:k]] + s, [text[:k], *rest]) for k in range(1, len(text) + 1) if text[:k] in scores for s, rest in brute(text[k:])]

    for text in ("ababab", "bbaab", "abbaabab"):
        found = [p for part in lattice.stream([text]) for p in part]
        assert abs(sum(scores[p] for p in found) - max(s for s, _ in brute(text))) < 1e-9


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = op3_sentencepiece(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        back = LIBRARY.decode(ids)
        assert (r.text_sha256, r.n_chars, r.same) == (hashlib.sha256(back.encode()).hexdigest(), len(back), back == (docs[r.doc_id] or ""))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", None), (3, "", "y"), (3, "a b", "z"), (3, "a b", "z")], "doc_id long, text string, ids string")
    both = V.decode(V.encode(docs.drop("ids"))).collect()
    assert sorted((r.doc_id or 0, r.text, r.ids) for r in both) == sorted([(1, "", []), (0, "a b", LIBRARY.encode("a b")), (3, "", []), *[(3, "a b", LIBRARY.encode("a b"))] * 2])
    assert V.encode(docs).columns == ["doc_id", "text", "ids"]
    assert V.digests(docs).count() == 5 and V.digests(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert V.decode(none).first().text == ""
