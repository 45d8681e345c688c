"""Token-id files (operator 4): length-delimited binary records with masked checksums, and a separate offset index.

A data file is a run of records. A record frames its payload as

    length (u64) | masked crc of the length (u32) | payload | masked crc of the payload (u32)

and the payload is a header (doc_id i64, has-id u8, bytes an id u8, number of ids u64) and the ids, little-endian: two
bytes each if the vocabulary allows, else four. The checksum is zlib's CRC-32, rotated right by 15 bits plus a constant,
so that the checksum of data that holds checksums stays meaningful. The index file has one u64 offset a record and
the end, for shuffled reads: ``read_record`` seeks to any record.

``write`` puts documents in ascending doc_id order (nulls first) into files of about FILE_BYTES: one range partition by
doc_id, each file written under a name of its own attempt. The manifest, a table, names the files of the attempts that
Spark committed; what a lost task left behind is never read. ``read`` goes through the manifest, checks every checksum
and gives each document's position among all ids. Files are reached through Arrow's file systems by URI.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.llm.pieces import encoder, public_path

#: READERS: tasks that read files, at most.
END, FILE_BYTES, GROUP, READERS = 0, 64 << 20, 1024, 10_000
HEAD = struct.Struct("<qBBQ")
FRAME, CRC = struct.Struct("<QI"), struct.Struct("<I")
MANIFEST = "part long, number long, data string, index string, records long, ids long"
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unmask(crc: int) -> int:
    crc = (crc - 0xA282EAD8) & 0xFFFFFFFF
    return (crc >> 17 | crc << 15) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = HEAD.pack(doc_id or 0, doc_id is not None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, CRC.pack(masked(size)), payload, CRC.pack(masked(payload))))


class CorruptRecord(ValueError):
    pass


def parse(buffer: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids as u32, offset of the next record)."""
    if at + FRAME.size > len(buffer):
        raise CorruptRecord(f"a record's length is cut short at {at}")
    size, crc = FRAME.unpack_from(buffer, at)
    if masked(bytes(buffer[at : at + 8])) != crc:
        raise CorruptRecord(f"bad checksum of the length at {at}")
    begin, end = at + FRAME.size, at + FRAME.size + size
    if end + CRC.size > len(buffer):
        raise CorruptRecord(f"a record is cut short at {at}")
    payload = buffer[begin:end]
    if masked(payload) != CRC.unpack_from(buffer, end)[0]:
        raise CorruptRecord(f"bad checksum of the payload at {at}")
    doc_id, has, width, n = HEAD.unpack_from(payload)
    return doc_id if has else None, np.frombuffer(payload, f"<u{width}", n, HEAD.size).astype(np.uint32), end + CRC.size


def filesystem(uri: str):
    """(Arrow file system, path) of a URI; a path without a scheme is local."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes records to files of about so many bytes; ``files`` lists what is complete."""

    def __init__(self, folder: str, part: int, width: int, most: int = FILE_BYTES):
        self.fs, self.path = filesystem(folder)
        self.part, self.width, self.most = part, width, most
        self.files: list[tuple] = []
        self.out = None

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.out is None:
            self.fs.create_dir(self.path, recursive=True)
            self.name = f"{self.path}/{self.part:08d}-{len(self.files):06d}-{uuid.uuid4().hex}"
            self.out, self.offsets, self.ids = self.fs.open_output_stream(self.name + ".rec"), [0], 0
        data = frame(doc_id, ids, self.width)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))
        self.ids += len(ids)
        if self.offsets[-1] >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        with self.fs.open_output_stream(self.name + ".idx") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        self.files.append((self.part, len(self.files), self.name + ".rec", self.name + ".idx", len(self.offsets) - 1, self.ids))


def read_record(folder: str, data: str, index: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record of a file, by its number, through the index."""
    fs, _ = filesystem(folder)
    with fs.open_input_file(index) as f:
        begin, end = np.frombuffer(f.read_at(16, 8 * number), "<u8").tolist()
    with fs.open_input_file(data) as f:
        doc_id, ids, _ = parse(memoryview(f.read_at(end - begin, begin)), 0)
    return doc_id, ids


def read_file(folder: str, data: str, index: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a file in order; they must end where the index says."""
    fs, _ = filesystem(folder)
    with fs.open_input_file(index) as f:
        offsets = np.frombuffer(f.read(), "<u8").tolist()
    with fs.open_input_stream(data) as f:
        for begin, end in zip(offsets, offsets[1:], strict=False):
            doc_id, ids, used = parse(memoryview(f.read(end - begin)), 0)
            if used != end - begin:
                raise CorruptRecord(f"{data} and its index differ at {begin}")
            yield doc_id, ids


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, most: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of docs' texts, each with an end id, below a folder; returns the manifest, itself written."""
    path = tokenizer or public_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        out = Writer(folder, TaskContext.get().partitionId(), 2 if max(own.tk.get_vocab_size(), end + 1) <= 1 << 16 else 4, most)
        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for i, ids in own.encode(batch.column("text")):
                out.add(doc_ids[i], np.append(ids, np.uint32(end)))
        out.close()
        if out.files:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out.files, strict=True)], names=["part", "number", "data", "index", "records", "ids"])

    # the partition's sample reads doc_id alone; texts move once
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(rows.mapInArrow(run, MANIFEST), "token-manifest")


def positions(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all files before. Sums within groups of partitions, then over the few groups."""
    m = manifest.withColumn("grp", F.floor(F.col("part") / GROUP))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = m.groupBy("grp").agg(F.sum("ids").alias("ids")).select("grp", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("grp").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("inner", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(sums, "grp").withColumn("start", F.col("base") + F.col("inner")).drop("grp", "base", "inner")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record of the manifest's files, each file read by one task.

    The number of tasks is that of the files, READERS at most: left open, it would follow the bytes of the manifest, and one
    task would read all files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                at, rows = f["start"], []
                for doc_id, ids in read_file(folder, f["data"], f["index"]):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                if len(rows) != f["records"] or at - f["start"] != f["ids"]:
                    raise CorruptRecord(f"{f['data']} has not what the manifest says")
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return positions(manifest).repartitionByRange(min(max(manifest.count(), 1), READERS), "part", "number").mapInArrow(run, ROW)
