"""Document fingerprints from Merkle trees over pieces, paragraphs and sections.

The leaves are pieces of a few words, cut after blanks whose surroundings ask for it and at line
breaks. Paragraphs end with their line (or, in very long lines, after a piece whose hash asks for
it); sections end after a paragraph whose hash is 0 modulo 4, sections of sections likewise, until one
node is left: the root. All boundaries move with the content, so an edit changes the branches it
lies in and their ancestors, and no others.

A fingerprint is the root, 32 hex digits, then the branches of each level from the sections below
the root down to the finest level of at most ``MOST`` branches: 8 hex digits of each branch's hash
and its length in bytes. Two fingerprints alone tell whether the texts are equal (the roots),
which stretches of one the other does not have (``changed``), and what share of the text lies in
branches that both have (``likeness``).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, chunk_count, lean_batches, mix64, range_bucket, text_bytes

NO_ID = np.iinfo(np.int64).min
#: Branches of the finest level that a fingerprint carries.
MOST = 96
#: Pieces without a cut for so many bytes are cut by their bytes alone, and then, as in texts that repeat themselves, every so many bytes.
LONG_PIECE = 256
#: Children that a branch has at most; texts that repeat themselves may never ask for an end.
LONG_RUN = 32
#: Bytes of text that one range of ids holds on average; a range is streamed, so it may be larger.
RANGE_BYTES = 16 << 20
Level = list[tuple[bytes, int]]  # (hash, bytes) of each node in the order of the text


def _asks(data: np.ndarray, at: np.ndarray, one_in: int) -> np.ndarray:
    """Those places before which the last four bytes ask for a cut."""
    back = [data[np.maximum(at - k, 0)].astype(U64) for k in range(4)]
    return at[mix64(back[0] | back[1] << U64(8) | back[2] << U64(16) | back[3] << U64(24)) % U64(one_in) == 0]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the pieces."""
    n = len(data)
    blank = np.flatnonzero(data == 32)
    ends = np.union1d(np.flatnonzero(data == 10), _asks(data, blank[blank > 0] - 1, 3) + 1) + 1
    ends = np.union1d(ends, [n])
    for more in (lambda a, b: _asks(data, np.arange(a + 8, b - 8), 32) + 1, lambda a, b: np.arange(a + LONG_PIECE, b, LONG_PIECE)):
        starts = np.r_[0, ends[:-1]]
        inside = [more(starts[i], ends[i]) for i in np.flatnonzero(ends - starts > LONG_PIECE).tolist()]
        ends = np.union1d(ends, np.concatenate(inside)) if inside else ends
    return ends


def _join(level: Level, closes: Callable[[int, bytes], bool], most: int = LONG_RUN) -> Level:
    """Nodes over runs of at most ``most`` nodes that end where ``closes`` says so."""
    out: Level = []
    own: list[bytes] = []
    size = 0
    for i, (h, n) in enumerate(level):
        own.append(h)
        size += n
        if len(own) == most or closes(i, h):
            out.append((xxhash.xxh3_128_digest(b"".join(own)), size))
            own, size = [], 0
    if own:
        out.append((xxhash.xxh3_128_digest(b"".join(own)), size))
    return out


def tree(text: bytes) -> list[Level]:
    """Levels of the tree: pieces, paragraphs, sections, ... , the root alone."""
    if not text:
        return [[(xxhash.xxh3_128_digest(b""), 0)]]
    ends = _cuts(np.frombuffer(text, np.uint8)).tolist()
    starts = [0, *ends[:-1]]
    levels = [[(xxhash.xxh3_128_digest(text[a:b]), b - a) for a, b in zip(starts, ends, strict=True)]]
    levels.append(_join(levels[0], lambda i, h: text[ends[i] - 1] == 10 or h[0] % 16 == 0))
    while len(levels[-1]) > 1:
        up = _join(levels[-1], lambda i, h: h[1] % 4 == 0)
        levels.append(up if len(up) < len(levels[-1]) else _join(levels[-1], lambda i, h: False, len(up)))
    return levels


def fingerprint(text: bytes) -> str:
    levels = tree(text)
    root = levels[-1][0][0].hex()
    kept = [x for x in levels[:-1] if len(x) <= MOST]
    # Levels are numbered from the pieces up, so that those of two fingerprints can be set side by side.
    return ".".join([root, str(len(levels) - 1 - len(kept)), *[",".join(f"{h[2:6].hex()}{n:x}" for h, n in x) for x in kept]])


def branches(print_: str) -> dict[int, list[tuple[str, int]]]:
    """Levels by number: (hash, bytes) of the branches that a fingerprint carries."""
    _, least, *levels = print_.split(".")
    return {int(least) + k: [(b[:8], int(b[8:], 16)) for b in x.split(",")] for k, x in enumerate(levels)}


def _side_by_side(a: str, b: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Branches of the finest level that both carry; none where there is none."""
    x, y = branches(a), branches(b)
    both = x.keys() & y.keys()
    return (x[min(both)], y[min(both)]) if both else ([], [])


def likeness(a: str, b: str) -> float:
    """Bytes in branches that both texts have, wherever they stand, as a share of those in either's.

    1 for equal roots and for no others: where all branches agree but their order, one of them counts as lost.
    """
    if a[:32] == b[:32]:
        return 1.0
    x, y = _side_by_side(a, b)
    p, q = Counter(x), Counter(y)
    both = sum(n * min(c, q[h, n]) for (h, n), c in p.items())
    either = sum(n for _, n in x) + sum(n for _, n in y) - both
    return min(both, either - min(n for _, n in x)) / either if either else 0.0


def changed(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of b's text that lie in branches a does not have, from the fingerprints alone.

    [] for equal roots. Where no level is carried by both, the whole text may have changed.
    """
    if a[:32] == b[:32]:
        return []
    x, y = _side_by_side(a, b)
    if not y:
        return [(0, sum(n for _, n in max(branches(b).values(), key=len, default=[])))]
    have, at, out = Counter(x), 0, []
    for node in y:
        if have[node]:
            have[node] -= 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + node[1])
        else:
            out.append((at, at + node[1]))
        at += node[1]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of whole texts, without a shuffle; null counts as empty.

    Rows keep their number: repeated rows, null ids and empty tables need no care, further columns
    are ignored. A task holds one text's tree at a time.
    """

    def run(batches):
        for t in batches:
            texts = [x or "" for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([fingerprint(x.encode()) for x in texts])], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(lean_batches(run), "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, each: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str, size: int = RANGE_BYTES) -> DataFrame:
    """Streams ``(doc_id, text, next text)`` of neighbours in ascending doc_id order through ``each``.

    Documents travel once, in ranges of ids; the first document of a range also goes to the range
    before it (that of the first range to the last), where it sorts last. Ranges are sorted by Spark
    and streamed, so a task holds two texts at a time however many rows share an id. The driver
    knows the ranges' bounds and first ids only, one number each a range. Null ids come first; rows
    that repeat an id are ordered by text. An empty table has no rows; further columns are ignored.
    """
    n = chunk_count(text_bytes(docs), size)
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"), range_bucket(docs, n).alias("range"))
    heads = sorted((r["range"], r["least"]) for r in placed.groupBy("range").agg(F.min("key").alias("least")).collect())
    if not heads:
        return docs.sparkSession.createDataFrame([], schema)
    least, before = np.array([h for _, h in heads], np.int64), np.array([heads[i - 1][0] for i in range(len(heads))], np.int32)

    def other(x: pd.Series) -> pd.Series:
        keys = x.to_numpy()
        at = np.minimum(np.searchsorted(least, keys), len(least) - 1)
        return pd.Series(np.where(least[at] == keys, before[at], -1).astype(np.int32))

    place = lambda r, tail: F.struct(r.alias("range"), F.lit(tail).alias("tail"))
    own = place(F.col("range"), False)
    both = placed.withColumn("other", F.pandas_udf(other, "int")("key"))
    both = both.withColumn("to", F.when(F.col("other") < 0, F.array(own)).otherwise(F.array(own, place(F.col("other"), True))))
    sent = both.select("doc_id", "text", "key", F.explode("to").alias("to")).select("doc_id", "text", "key", "to.range", "to.tail")

    def run(batches):
        def pairs():
            held = None
            for t in batches:
                cols = [t.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")]
                for r, tail, doc_id, text in zip(*cols, strict=True):
                    if held is not None and held[0] == r:
                        yield held[1], held[2], text
                    held = None if tail else (r, doc_id, text)

        yield from each(pairs())

    return sent.repartition(n, "range").sortWithinPartitions("range", "tail", "key", "text").select("range", "tail", "doc_id", "text").mapInArrow(lean_batches(run), schema)


def edit_likeness(docs: DataFrame, some: int = 2000) -> DataFrame:
    """Fingerprints of each text and of its edit by the next text, and their likeness.

    The edit replaces the last quarter (floor, in code points) by as many of the next document's
    first (or all it has). Columns as in the query ``op9``; special cases as in ``with_next``.
    """
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def each(rows):
        out: list[tuple] = []
        known: tuple[str, str] = ("", fingerprint(b""))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

        for doc_id, text, follow in rows:
            k = len(text) // 4
            edited = (text[: len(text) - k] + follow[:k]).encode()
            own = known[1] if known[0] == text else fingerprint(text.encode())
            after = fingerprint(follow.encode())
            known = (follow, after)
            changed_ = fingerprint(edited)
            out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, changed_, likeness(own, changed_), likeness(own, after)))
            if len(out) == some:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return with_next(docs, each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
