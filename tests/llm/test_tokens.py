"""Token ids, packing, record files and token counts against the tokenizers library."""

import random
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import packing, pieces, records

ROWS = "doc_id long, text string, start string, ids string"
BITS = ["a", "Word", "I'm", "don't", " ", "  ", "\n", "\n\n", "\t", " \n", "é", "É", "É", "J̌", "\xa0", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "12345", "...", "!?", "%%%"]
BITS += ["日本", "　", "ß", "İ", "ΑΣ", "Σ", "\U0001f600", ".", ",", "x.", "y,", "\r\n", "\x85", "\x1c", "_", "http://a.b/c?d=e", "K"]
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(n)] + [None, "", " ", "\n", "a" * 3000, " a", "a ", "a \n b"]


def documents(seed=4):
    rng = random.Random(seed)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts(200, seed))]
    rows += [(500 + i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta."]) for _ in range(rng.choice([5, 300, 2000, 9000]))), None, None) for i in range(40)]
    return rows + [(None, "no id", None, None), rows[3], rows[3]]


@pytest.mark.parametrize("most", [300, 800_000])
@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_library_s_ids(name, most, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PIECES", most)
    own, all_texts = pieces.PieceEncoder(pieces.public_path(name)), texts()
    for i, ids in own.encode(pa.array(all_texts)):
        assert ids.tolist() == own.whole(all_texts[i] or ""), repr(all_texts[i])


def library(name, text, end):
    return np.append(np.array(pieces.encoder(pieces.public_path(name)).whole(text or ""), np.uint32), np.uint32(end))


def test_packing_is_a_partition_of_all_ids(spark):
    docs = documents()
    got = packing.pack(spark.createDataFrame(docs, ROWS).repartition(3)).collect()
    want = sorted((str(d), library(FILES[0], t, 2).tobytes()) for d, t, *_ in docs)
    by_doc = {}
    for r in got:
        by_doc.setdefault(str(r.doc_id), []).append(r)
    left = {}
    for d, b in want:
        left.setdefault(d, []).append(np.frombuffer(b, np.uint32))
    assert by_doc.keys() == left.keys()
    for d, rows in by_doc.items():
        n_ids = sum(len(x) for x in left[d])
        assert sum(r.length for r in rows) == n_ids
        if len(left[d]) == 1:
            rows.sort(key=lambda r: r.start)
            at = 0
            for r in rows:
                assert r.start == at and r.doc_tokens == n_ids and r.length > 0
                assert zlib.crc32(left[d][0][at : at + r.length].astype("<u4").tobytes()) == r.ids_crc32
                at += r.length
    total = padded = 0
    for _, rows in groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padded += at if at & (at - 1) == 0 else 4096
    assert padded == total


def test_sum_of_squares_places_by_least_sum():
    rng, p = random.Random(1), packing.Packer(64)
    for _ in range(2000):
        s = rng.randrange(1, 65)
        count = p.count.copy()
        best = None
        for h in range(64 - s + 1):
            if h == 0 or count[h]:
                c = count.copy()
                if h:
                    c[h] -= 1
                if h + s < 64:
                    c[h + s] += 1
                value = int((c**2).sum())
                if best is None or value <= best[0]:
                    best = (value, h)
        assert p.level(s) == best[1]
        p.add(0, np.zeros(s, np.uint32))
        assert p.count.sum() == sum(len(x) for x in p.at.values())


def test_early_merge_loses_nothing():
    rng, p = random.Random(2), packing.Packer(64, run=5)
    sizes = [rng.randrange(1, 300) for _ in range(500)]
    for i, s in enumerate(sizes):
        p.add(i, np.arange(s, dtype=np.uint32))
    p.merge(last=True)
    seen = {}
    for window in p.done:
        assert sum(len(x[3]) for x in window) <= 64
        for i, start, n, ids in window:
            assert ids.tolist() == list(range(start, start + len(ids))) and n == sizes[i]
            seen[i] = seen.get(i, 0) + len(ids)
    assert [seen[i] for i in range(500)] == sizes


def test_files_round_trip_in_doc_id_order(spark, tmp_path):
    docs = documents(5)
    df = spark.createDataFrame(docs, ROWS)
    folder = "file://" + str(tmp_path / "ids")
    manifest = records.write(df, folder, most=20_000)
    got = sorted(records.read(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, *_ in docs), key=lambda d: (d is not None, d))
    want = sorted((str(d), len(x := library(FILES[1], t, 0)), zlib.crc32(x.astype("<u4").tobytes())) for d, t, *_ in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    f = manifest.orderBy("part", "number").first()
    in_order = list(records.read_file(folder, f["data"], f["index"]))
    for number in (0, len(in_order) - 1):
        doc_id, ids = records.read_record(folder, f["data"], f["index"], number)
        assert doc_id == in_order[number][0] and ids.tolist() == in_order[number][1].tolist()
    assert manifest.count() > 3


def test_corruption_is_found():
    data = records.frame(7, np.arange(50, dtype=np.uint32), 2)
    assert records.parse(memoryview(data), 0)[1].tolist() == list(range(50))
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(records.CorruptRecord):
            records.parse(memoryview(bytes(bad)), 0)
        with pytest.raises(records.CorruptRecord):
            records.parse(memoryview(data[:i]), 0)
    assert all(records.unmask(records.masked(x)) == zlib.crc32(x) for x in (b"", b"abc", data))


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], ROWS)
    assert packing.pack(empty).collect() == []
    folder = "file://" + str(tmp_path / "none")
    assert records.read(records.write(empty, folder), folder).collect() == []
