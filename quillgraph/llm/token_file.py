"""Token ids in binary files: fixed-size blocks as compressed byte or bit planes with an index.

A file is: magic ``QTB1``; the planes of each block, one zstandard frame per plane; an index frame;
its length and magic again (12 bytes). A block holds ``block`` ids (the last one fewer) as unsigned
32-bit integers, transposed so that byte k (or bit k) of all ids lies together; planes without a
set bit take no space. The index is JSON: ids per block, plane kind, and for each block the place
and length of each plane; the documents' ids and lengths follow as two frames of 64-bit integers.

Files are written to the shared folder under a name of their own for each attempt, so a task that
runs twice leaves at most an unused file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import chunk_count, cut, shared_dir, text_bytes
from .tokens import encoded, library_encoder

MAGIC = b"QTB1"
BLOCK = 1 << 16
NO_ID = np.iinfo(np.int64).min


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of unsigned 32-bit ids, least significant first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(parts: list[bytes], kind: str, n: int) -> np.ndarray:
    if kind == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(parts):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(parts):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    """Appends ids of documents; holds one block in memory."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.sink, self.kind, self.block = sink, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.held, self.n_held, self.n_ids = 0, [], [], 0, 0
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        data = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(data) if all_of_it else len(data) - len(data) % self.block
        for a in range(0, end, self.block):
            own = []
            for p in planes(data[a : min(a + self.block, end)], self.kind):
                frame = self.zip.compress(p) if any(p) else b""
                own.append((self.at, len(frame)))
                self._put(frame)
            self.index.append(own)
        self.held = [data[end:]] if end < len(data) else []
        self.n_held = len(data) - end

    def close(self) -> None:
        self._flush(True)
        head = json.dumps({"block": self.block, "kind": self.kind, "n_ids": self.n_ids, "n_docs": len(self.lengths), "planes": self.index}).encode()
        frames = [self.zip.compress(x) for x in (head, np.array(self.doc_ids, "<i8").tobytes(), np.array(self.lengths, "<i8").tobytes())]
        body = struct.pack("<3Q", *map(len, frames)) + b"".join(frames)
        self._put(body + struct.pack("<Q", len(body)) + MAGIC)


class Reader:
    """Random access to a file: blocks, ranges of ids, and documents in order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 12)
        tail = source.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token-id file")
        n = struct.unpack("<Q", tail[:8])[0]
        source.seek(size - 12 - n)
        body = source.read(n)
        sizes = struct.unpack_from("<3Q", body)
        cuts = np.cumsum((24, *sizes)).tolist()
        self.unzip = zstandard.ZstdDecompressor()
        head, ids, lengths = (self.unzip.decompress(body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        self.head = json.loads(head)
        self.doc_ids, self.lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")

    def read_block(self, i: int) -> np.ndarray:
        n = min(self.head["block"], self.head["n_ids"] - i * self.head["block"])
        parts = []
        for at, size in self.head["planes"][i]:
            self.source.seek(at)
            parts.append(self.unzip.decompress(self.source.read(size)) if size else b"")
        return join_planes(parts, self.head["kind"], n)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1, from the blocks that hold them."""
        b = self.head["block"]
        got = [self.read_block(i) for i in range(start // b, -(-stop // b))] if stop > start else []
        return np.concatenate(got)[start - start // b * b :][: stop - start] if got else np.zeros(0, np.uint32)

    def documents(self):
        """(doc_id, ids) in file order; holds the blocks of one document at a time."""
        rest, block = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            got = [rest]
            have = len(rest)
            while have < n:
                got.append(self.read_block(block))
                have += len(got[-1])
                block += 1
            data = np.concatenate(got) if len(got) > 1 else rest
            yield (None if doc_id == NO_ID else doc_id), data[:n]
            rest = data[n:]


def write_ids(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, end_id: int = 2, folder: str | None = None, kind: str = "byte", file_bytes: int = 16 << 20) -> DataFrame:
    """Encodes whole texts by a tokenizer file, appends ``end_id``, and writes files in ascending doc_id order.

    Returns one row per file: ``path, first_id, n_docs, n_ids`` (already written). Null texts count
    as empty (only the end id); null ids come first; rows that repeat a ``doc_id`` keep together,
    ordered by text. An empty table writes no file.
    """
    n = chunk_count(text_bytes(docs), file_bytes, least=24)
    folder = f"{(folder or shared_dir(docs.sparkSession)).rstrip('/')}/ids-{uuid.uuid4().hex}"

    def run(batches):
        out = name = None
        first = None
        for part, blobs in encoded(batches, lambda: library_encoder(path, pattern), 16 << 20):
            ids = part.column("doc_id").to_pylist()
            if out is None:
                fs, where = pafs.FileSystem.from_uri(folder)
                fs.create_dir(where, recursive=True)
                name = f"{uuid.uuid4().hex}.qtb"
                sink = fs.open_output_stream(f"{where}/{name}")
                out, first = Writer(sink, kind), ids[0]
            for i, b in zip(ids, blobs, strict=True):
                out.add(i, np.append(np.frombuffer(b, np.uint32), np.uint32(end_id)))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([len(out.lengths)], pa.int64()), pa.array([out.n_ids], pa.int64())], ["path", "first_id", "n_docs", "n_ids"])

    placed = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(placed.mapInArrow(run, "path string, first_id long, n_docs long, n_ids long"))


def read_ids(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files of ``write_ids``.

    ``start`` counts the ids of all documents before it; one small row per file is summed for it.
    """
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        for t in batches:
            for uri, base in zip(t.column("path").to_pylist(), t.column("base").to_pylist(), strict=True):
                fs, where = pafs.FileSystem.from_uri(uri)
                ids, starts, sizes, crcs = [], [], [], []
                with fs.open_input_file(where) as f:
                    for doc_id, got in Reader(f).documents():
                        ids.append(doc_id)
                        starts.append(base)
                        sizes.append(len(got))
                        crcs.append(zlib.crc32(np.ascontiguousarray(got, "<u4").tobytes()))
                        base += len(got)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.select("path", "base").repartition(max(24, files.rdd.getNumPartitions()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
