"""Helpers shared by the corpus operators: sizing, shared storage, packed blocks, words."""

from __future__ import annotations

import contextlib
import ctypes
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one chunk of documents holds on average; a chunk is what one Python call sees.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, and where it is unset a folder of the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` of a few numbers a row, dealt to an eighth of the shuffle partitions, four at least, before they are written.

    Where AQE does not put small partitions together, each is a file of its own. In a local folder
    without Hadoop's native library an executor starts a child process to set the rights of each file
    and of its checksum, and until that child runs its own program the executor's memory counts twice.
    """
    return cut(df.repartition(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, one pass over that column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def chunk_count(total: int, target: int = CHUNK_BYTES, least: int = 48) -> int:
    return max(least, -(-total // target))


def hash_bucket(n: int, *columns: str) -> Column:
    """A deterministic bucket of 0 .. n-1; null keys take part like any value."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(n)).cast("int")


def range_bucket(docs: DataFrame, n: int, column: str = "doc_id") -> Column:
    """A bucket of 0 .. n-1 or fewer that rises with the id; null ids are in bucket 0, equal ids together.

    The driver holds n bounds, approximate quantiles of the id column.
    """
    bounds = np.unique(np.array(docs.filter(F.col(column).isNotNull()).approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n), np.float64))
    at = F.pandas_udf(lambda x: pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32)), "int")
    return F.coalesce(F.when(F.col(column).isNotNull(), at(F.coalesce(F.col(column), F.lit(0)))), F.lit(0))


def may_hold(rows: DataFrame, column: str, ids: DataFrame, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts, without a shuffle: those whose ``column`` may be in the one column of ``ids``, and those where it is not.

    A bitmap of hashes, some 16 bits an id and 2**most in all at most, is broadcast in words of 64
    bits. Beyond that size more rows are in the first part by chance, but none is ever missing there.
    """
    ids = ids.toDF("id")
    n = 1 << min(most, max(10, (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    marks = ids.select(place(F.col("id")).alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    words = F.broadcast(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    at = place(rows[column])
    found = (F.shiftright(at, 6) == words["word"]) & (F.call_function("shiftright", words["bits"], at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return rows.join(words, found, "left_semi"), rows.join(words, found, "left_anti")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- workers' memory


def trim() -> None:
    """Gives memory that this worker has freed back to the system, where it can be done."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(function):
    """A group function that leaves no freed memory with its worker, which outlives it."""

    def one(table):
        out = function(table)
        trim()
        return out

    def two(left, right):
        out = function(left, right)
        trim()
        return out

    return one if function.__code__.co_argcount == 1 else two  # Spark counts the arguments


def lean_batches(function):
    """The same for a function of an iterator of batches."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return run


def sliced(batches, some: int = 8 << 20, column: str = "text"):
    """The batches in slices of about ``some`` bytes of a text column, of one row at least."""
    for t in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(t.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < t.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + some, side="right")))
            yield t.slice(a, b - a)
            a = b


# ---------------------------------------------------------------- packed blocks


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays and byte strings as one zstandard frame."""
    parts = []
    for a in arrays:
        raw, kind = (a, b"raw") if isinstance(a, bytes) else (np.ascontiguousarray(a).tobytes(), a.dtype.str.encode())
        parts.append(struct.pack("<3sQ", kind.ljust(3), len(raw)) + raw)
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(block: bytes) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        kind, size = struct.unpack_from("<3sQ", raw, at)
        at += 11
        body = raw[at : at + size]
        out.append(body if kind == b"raw" else np.frombuffer(body, dtype=kind.decode().strip()))
        at += size
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as byte planes of their differences; the empty high planes compress away."""
    return np.ascontiguousarray(np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U64).ravel(), dtype=U64)


def pack_planes(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes: small ones leave the high planes empty."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shares(keys: np.ndarray, shards: int, bits: int = 64):
    """Shard numbers and slices of ascending keys that are uniform over ``bits`` bits."""
    if len(keys):
        shard = ((keys >> U64(bits - 32)) * U64(shards)) >> U64(32)
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
            yield int(shard[a]), slice(a, b)


# ---------------------------------------------------------------- words


def word_codes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (runs without x20, x09-x0D) of texts: each as a number, the numbers' 64-bit hashes, and how many words a text has.

    Texts are lowered in A-Z only and split by Arrow, so Python meets each distinct word of the column once.
    The words are lowered, not the texts: of an array whose first offset is not 0, as the cast of a
    slice, Arrow's ascii_lower returns bytes that it has not written.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    found = pc.ascii_lower(parts.flatten()).dictionary_encode()
    words = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    codes, sizes = found.indices.to_numpy().astype(np.int64), np.diff(parts.offsets.to_numpy())
    if b"" in words:  # blanks at the ends of a text
        none = words.index(b"")
        kept = codes != none
        upto = np.r_[0, np.cumsum(kept)]
        sizes = np.diff(upto[np.r_[0, np.cumsum(sizes)]])
        codes = codes[kept]
        codes -= codes > none
        words.pop(none)
    return codes, np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words)), sizes.astype(np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on a fresh array."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h
