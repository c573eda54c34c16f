"""Byte-level BPE on whole documents, and exact length counts.

Encoding works on units: what stands between spaces and newlines, with the one space before it. Where
no two blanks of any kind (``\\s``) are neighbours, no match of the split pattern reaches over the start
of a unit, so a unit's ids do not depend on its neighbours, and a worker encodes each distinct unit
once while its bounded cache holds it. Texts with runs of blanks are split by the pattern as a whole
instead.

``fold_native`` is the same fold as one Spark higher-order expression over a literal rank table.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .base import cut, lean_batches, sliced

#: Distinct units that a worker keeps at most.
CACHE_UNITS = 1_000_000
#: Byte length above which a word is merged with a heap instead of list scans.
LONG_WORD = 64
#: Two blanks side by side, of whatever kinds: a match may begin in one unit and end in the next.
_RUN = re.compile(r"\s\s").search
#: Every blank that re's \s has, for Arrow.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Units that end in a blank, or have one after a first newline: before another unit these would make runs.
_BLANK_END = rf"\A\z|{_BLANK}\z|\A\n{_BLANK}"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 piece and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of least rank, leftmost first, until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _fold_long(word, ranks)
    none = 1 << 40
    get = ranks.get
    cut = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[cut[i] : cut[i + 2]], none)
        if i:
            pair[i - 1] = get(word[cut[i - 1] : cut[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, in n log n: a heap of pairs over a linked list of pieces."""
    import heapq

    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if not live[i] or j >= n or end[j] != stop:
            continue
        live[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if live[i]]


#: Signs that often follow a word; each is a match of its own where white space or nothing comes after it.
SIGNS = frozenset(".,;:!?")


class Encoder:
    """Text -> int32 ids as bytes.

    ``pieces`` encodes matches of the split pattern on their own, as int32 bytes. Texts that hold one
    of ``special`` go to ``whole`` as they are. A unit is what follows a space, or a line break and
    what follows it; a batch's distinct units are found by Arrow and looked up once. A unit cache
    that is half full becomes the old one, whose entries are taken over as they are met again, so
    memory is bounded and frequent units stay. With ``run`` a batch's distinct units are encoded
    together instead, and only units that it does not suit are cached.
    """

    def __init__(self, pattern: str, pieces: Callable[[list[str]], Iterable[bytes]], whole: Callable[[str], bytes] | None = None, special: tuple[str, ...] = (), run: Callable | None = None):
        self.split = regex.compile(pattern).findall
        self.pieces, self.whole, self.special, self.run = pieces, whole, special, run
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # matches that are no words after a space

    def _know(self, matches: Iterable[str]) -> None:
        fresh = [p for p in matches if p not in self.odd]
        self.odd.update(zip(fresh, self.pieces(fresh), strict=True))

    def _learn(self, units: list[str]) -> None:
        """Fills the cache; words, and words with one sign after them, are split by hand."""
        known, odd, split = self.known, self.odd, self.split
        words: set[str] = set()
        signed: list[str] = []
        parts: dict[str, list[str]] = {}
        for u in units:
            if u.isalpha():
                words.add(u)
            elif u[-1:] in SIGNS and u[:-1].isalpha():
                signed.append(u)
                words.add(u[:-1])
            elif u[:1] == "\n":
                parts[u] = ["\n", *split(u[1:])]
            else:
                parts[u] = split(f" {u}")
        fresh = [w for w in words if w not in known]
        known.update(zip(fresh, self.pieces([f" {w}" for w in fresh]), strict=True))
        self._know({u[-1] for u in signed}.union(*parts.values()))
        for u in signed:
            known[u] = known[u[:-1]] + odd[u[-1]]
        for u, own in parts.items():
            known[u] = b"".join([odd[p] for p in own])

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        known, old = self.known, self.old
        got = list(map(known.get, units))
        missed = [i for i, g in enumerate(got) if g is None]
        for i in missed:
            if (g := old.get(units[i])) is not None:
                got[i] = known[units[i]] = g
        missed = [i for i in missed if got[i] is None]
        self._learn([units[i] for i in missed])
        for i in missed:
            got[i] = known[units[i]]
        return got

    def _pool(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, one after another, and how many each has."""
        own = units.to_numpy(zero_copy_only=False).tolist()
        if self.run is not None:
            odd = pc.match_substring_regex(units, _BLANK_END).to_numpy(zero_copy_only=False)
            tame = [u for u, o in zip(own, odd.tolist(), strict=True) if not o] if odd.any() else own
            long = (pc.binary_length(units).to_numpy() + ~pc.starts_with(units, "\n").to_numpy(zero_copy_only=False))[~odd]
            if (found := self.run(tame, long)) is not None:
                rest = self._ids([u for u, o in zip(own, odd.tolist(), strict=True) if o])
                size = np.empty(len(own), np.int64)
                size[~odd], size[odd] = found[1], [len(x) // 4 for x in rest]
                # The ids of tame units come first, then those of the others.
                pool = np.concatenate([found[0], np.frombuffer(b"".join(rest), np.int32)])
                if not odd.any():
                    return pool, size
                order = np.argsort(odd, kind="stable")
                begin = np.empty(len(own), np.int64)
                begin[order] = np.cumsum(size[order]) - size[order]
                end = np.cumsum(size)
                return pool[np.repeat(begin - end + size, size) + np.arange(end[-1])], size
        ids = self._ids(own)
        return np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_UNITS // 2:
            self.old, self.known = self.known, {}
        if len(self.odd) > CACHE_UNITS // 8:
            self.odd.clear()
        self._know(["\n"])
        out = [b""] * len(texts)
        plain: list[int] = []
        for i, x in enumerate(texts):
            if not x:
                continue
            if any(k in x for k in self.special):
                out[i] = self.whole(x)
            elif _RUN(x) or x.isspace():
                parts = self.split(x)
                self._know(set(parts))
                out[i] = b"".join([self.odd[p] for p in parts])
            else:
                plain.append(i)
        if not plain:
            return out
        # Every text begins with a line break of its own, whose ids are left out again.
        marked = ["\n" + texts[i].replace("\n", " \n") for i in plain]
        units = pc.split_pattern(pa.array([" ".join(marked)], pa.large_string()), " ").values.dictionary_encode()
        pool, size = self._pool(units.dictionary)
        at = units.indices.to_numpy()
        start = np.cumsum(size) - size
        long = size[at]
        end = np.cumsum(long)
        flat = pool[np.repeat(start[at] - end + long, long) + np.arange(end[-1])].tobytes()
        cuts = 4 * np.r_[0, end[np.cumsum([m.count(" ") + 1 for m in marked]) - 1]]
        skip = len(self.odd["\n"])
        for i, a, b in zip(plain, cuts.tolist(), cuts[1:].tolist(), strict=False):
            out[i] = flat[a + skip : b]
        return out


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


#: Encoders of this worker by their making, so that later tasks find the caches filled.
_MADE: dict[tuple, Encoder] = {}


def _once(make: Callable[..., Encoder]) -> Callable[..., Encoder]:
    def made(*args: str) -> Encoder:
        key = (make.__name__, *args)
        if key not in _MADE:
            _MADE[key] = make(*args)
        return _MADE[key]

    return made


@_once
def fold_encoder(path: str, pattern: str) -> Encoder:
    """Ranked merges of every pattern match."""
    ranks = read_ranks(path)
    return Encoder(pattern, lambda pieces: [_bytes(fold_word(w.encode(), ranks)) for w in pieces])


def _joined(words: list[str], ids_of: Callable[[str], np.ndarray], size: np.ndarray) -> Iterator[bytes]:
    """Ids of words that begin with a space: many at once, since a split parts them again and the ids' byte lengths tell where."""
    for a in range(0, len(words), 1000):
        own = words[a : a + 1000]
        ids = ids_of("".join(own))
        ends = 4 * (np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(w.encode()) for w in own])) + 1)
        raw, at = ids.astype("<i4").tobytes(), 0
        for end in ends.tolist():
            yield raw[at:end]
            at = end


def _pieces(ids_of: Callable[[str], np.ndarray], each: Callable[[list[str]], Iterable[bytes]], size: np.ndarray) -> Callable[[list[str]], list[bytes]]:
    """Words after a space joined, other matches by themselves."""

    def pieces(fresh: list[str]) -> list[bytes]:
        out: list = [None] * len(fresh)
        plain = [i for i, p in enumerate(fresh) if p[:1] == " " and p[1:].isalpha()]
        for i, ids in zip(plain, _joined([fresh[i] for i in plain], ids_of, size), strict=True):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, each([fresh[i] for i in rest]) if rest else [], strict=True):
            out[i] = ids
        return out

    return pieces


def _runs(ids_of: Callable[[str], np.ndarray], size: np.ndarray, special: tuple[str, ...]) -> Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray] | None]:
    """Ids of units in texts of 1000 units, as a document holds them; the ids' byte lengths tell where a unit ends. None where they do not."""

    def run(units: list[str], long: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        got = [np.zeros(0, np.int32)]
        for a in range(0, len(units), 1000):
            text = (" " + " ".join(units[a : a + 1000])).replace(" \n", "\n")
            if any(k in text for k in special):
                return None
            got.append(ids_of(text))
        ids, ends = np.concatenate(got), np.cumsum(long)
        upto = np.cumsum(size[ids])
        last = np.searchsorted(upto, ends)
        if len(ends) and (last[-1] != len(ids) - 1 or (upto[last] != ends).any()):
            return None
        return ids, np.diff(last, prepend=-1)

    return run


@_once
def library_encoder(path: str, pattern: str) -> Encoder:
    """The tokenizers library on a byte-level tokenizer file, without special tokens added.

    ``pattern`` is the split that the file's byte-level step makes.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    size = np.zeros(t.get_vocab_size(), np.int64)
    for piece, i in t.get_vocab(with_added_tokens=False).items():
        size[i] = len(piece)  # a character of the file's alphabet stands for a byte
    many = lambda texts: t.encode_batch_fast(texts, add_special_tokens=False)
    pieces = _pieces(lambda x: np.array(many([x])[0].ids, np.int32), lambda rest: [_bytes(e.ids) for e in many(rest)], size)
    special = tuple(x.content for x in t.get_added_tokens_decoder().values())
    run = _runs(lambda x: np.array(many([x])[0].ids, np.int32), size, special)
    return Encoder(pattern, pieces, lambda x: _bytes(t.encode(x, add_special_tokens=False).ids), special, run)


@_once
def rank_encoder(path: str, pattern: str) -> Encoder:
    """The tiktoken library on a rank file, without special tokens."""
    ranks = read_ranks(path)
    t = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        size[i] = len(piece)
    return Encoder(pattern, _pieces(lambda x: np.array(t.encode_ordinary(x), np.int32), lambda rest: [_bytes(t.encode_ordinary(x)) for x in rest], size))


def encoded(batches: Iterator[pa.RecordBatch], make: Callable[[], Encoder], some: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, of about ``some`` bytes of text, with the ids of their texts."""
    encoder = make()
    for part in sliced(batches, some):
        yield part, encoder.batch([x or "" for x in part.column("text").to_pylist()])


def _list(blobs: list[bytes]) -> pa.ListArray:
    cuts = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def _encode(path: str, pattern: str):
    def run(batches):
        for part, blobs in encoded(batches, lambda: fold_encoder(path, pattern)):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _list(blobs)], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        ranks = read_ranks(path)
        piece = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            piece[v] = k
        for t in batches:
            got = [b"".join([piece[i] for i in row or ()]) for row in _rows_of(t.column("ids"))]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("ids"), pa.array(got, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


# ---------------------------------------------------------------- operators


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, ids)`` by the ranks of a rank file; null and empty texts have no ids.

    One pass without a shuffle; a task holds a few hundred texts and the bounded unit cache.
    Rows keep their number and order; further columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(lean_batches(_encode(path, pattern)), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the pieces of the ids, concatenated. Null ids decode to no bytes."""
    return ids.select("doc_id", "ids").mapInArrow(lean_batches(_decode(path)), "doc_id long, ids array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``decode(encode(docs))`` with one Python worker for a task instead of two, which its executor would keep."""
    there, back = _encode(path, pattern), _decode(path)

    def run(batches):
        yield from back(there(batches))

    return docs.select("doc_id", "text").mapInArrow(lean_batches(run), "doc_id long, ids array<int>, decoded binary")


def _rows_of(col: pa.ListArray) -> Iterator[list[int]]:
    cuts, values = col.offsets.to_pylist(), col.values
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield values.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()


def encoded_lengths(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens)`` of whole texts; null and empty texts have 0."""

    def run(batches):
        for part, blobs in encoded(batches, lambda: rank_encoder(path, pattern)):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) // 4 for b in blobs], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(lean_batches(run), "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens", coarse: int = 1024) -> DataFrame:
    """The exact length histogram with prefix and suffix sums, one row per distinct length.

    ``n_tokens, n_docs``: the histogram. ``docs_up_to, tokens_up_to``: documents no longer than this
    and their tokens. ``docs_from, tokens_from``: the suffix sums. ``truncated_total``: tokens left
    in the whole corpus if every document is cut at this length. ``quantile``: the share of
    documents no longer than this. Any context limit, also between lengths, follows from the row of
    the next smaller length (see ``answer``). Null lengths are left out; an empty table has no rows.

    Sums run in two levels, by ranges of ``coarse`` lengths and inside each, so that no task sees
    all distinct lengths.
    """
    hist = lengths.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    hist = cut(hist.withColumn("range", F.floor(F.col("n_tokens") / F.lit(coarse))))  # used twice; the lengths are dear
    ranges = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"))
    inside = Window.partitionBy("range").orderBy("n_tokens")
    out = hist.join(ranges, "range")
    out = out.withColumn("docs_up_to", F.col("d0") + F.sum("n_docs").over(inside)).withColumn("tokens_up_to", F.col("t0") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
    out = out.withColumn("docs_from", F.col("d_all") - F.col("docs_up_to") + F.col("n_docs")).withColumn("tokens_from", F.col("t_all") - F.col("tokens_up_to") + F.col("n_docs") * F.col("n_tokens"))
    return out.select(
        "n_tokens", "n_docs", "docs_up_to", "tokens_up_to", "docs_from", "tokens_from",
        (F.col("tokens_up_to") + (F.col("d_all") - F.col("docs_up_to")) * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_up_to") / F.col("d_all")).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(context, docs_over, truncated_total)`` for any context limits, from the histogram alone."""
    n = F.col("n_tokens")
    sums = [F.struct(F.lit(c).cast("long").alias("context"), F.coalesce(F.sum(F.when(n > c, F.col("n_docs"))), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.least(n, F.lit(c)) * F.col("n_docs")), F.lit(0)).alias("truncated_total")) for c in limits]
    return histogram.agg(F.array(*sums).alias("a")).select(F.inline("a"))


# ---------------------------------------------------------------- the fold as one Spark expression

_SLOTS, _GROUPS = 1 << 17, 1 << 15


def _place(keys: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements, hashes and ranks of a collision-free table over the pieces."""
    h = np.array([xxhash.xxh64_intdigest(k, seed=42) for k in keys], np.uint64)
    if len(np.unique(h)) != len(h):
        raise ValueError("two pieces share a hash")
    a, b = (h & np.uint64(0x7FFFFFFF)).astype(np.int64), (h >> np.uint64(33)).astype(np.int64)
    g = (a ^ b) & (_GROUPS - 1)
    disp, used, slot = np.zeros(_GROUPS, np.int64), np.zeros(_SLOTS, bool), np.zeros(len(keys), np.int64)
    order = np.argsort(g, kind="stable")
    for own in sorted(np.split(order, np.flatnonzero(np.diff(g[order])) + 1), key=len, reverse=True):
        d = 0
        while len(set(s := ((a[own] + d * (2 * b[own] + 1)) & (_SLOTS - 1)).tolist())) < len(s) or used[s].any():
            d += 1
        used[s], disp[g[own[0]]], slot[own] = True, d, s
    held, rank = np.zeros(_SLOTS, np.int64), np.full(_SLOTS, -1, np.int64)
    held[slot], rank[slot] = h.view(np.int64), [ranks[k] for k in keys]
    return disp, held, rank


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_native(word: Column, ranks: dict[bytes, int]) -> Column:
    """``fold_word`` as an expression on a binary column of non-empty words."""
    disp, held, rank = (F.expr("cast(split('" + ",".join(map(str, x.tolist())) + "', ',') as array<bigint>)") for x in _place(list(ranks), ranks))

    def look(piece: Column) -> Column:
        def at(h: Column) -> Column:
            a, b = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
            slot = (a + F.get(disp, a.bitwiseXOR(b).bitwiseAND(F.lit(_GROUPS - 1)).cast("int")) * (b * 2 + 1)).bitwiseAND(F.lit(_SLOTS - 1)).cast("int")
            return _let(slot, lambda s: F.when(F.get(held, s) == h, F.get(rank, s)))

        return _let(F.xxhash64(piece), at)

    def between(cut: Column, i: Column, n: int) -> Column:
        return F.substring(word, F.get(cut, i) + 1, F.get(cut, i + n) - F.get(cut, i))

    def step(cut: Column, _: Column) -> Column:
        least = F.array_min(F.transform(F.sequence(F.lit(0), F.size(cut) - 3), lambda i: look(between(cut, i, 2)) * 65536 + i))
        merged = _let(least, lambda c: F.when(c.isNull(), cut).otherwise(F.filter(cut, lambda x, j: j != (c % 65536).cast("int") + 1)))
        return F.when(F.size(cut) < 3, cut).otherwise(merged)

    n = F.length(word)
    cuts = F.when(n < 2, F.sequence(F.lit(0), n)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.sequence(F.lit(0), n), step))
    pieces = _let(cuts, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: look(between(c, i, 1))))
    whole = look(word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(pieces)
