"""Removal of repeated byte strings by suffix arrays over shards.

Every ``length``-byte window of a document belongs to the least ``gram``-byte hash inside it, its
anchor; equal windows have equal anchors, so all places of a repeated string meet in the shard of
its anchor whatever document they lie in. Runs of windows with one anchor travel together.

1. Chunks of documents, in ascending order of ids, send the anchors and text hashes of their runs
   to shards. Where an anchor has one text in the whole corpus, by 64 bits of the anchor and 64 of
   the text, the shard knows all there is to know: its windows repeat as a whole or not at all, and
   the first chunk with it keeps one.
2. Texts of the other anchors follow, each distinct text once per chunk. A shard concatenates its
   distinct texts, builds their suffix array by induced sorting and the permuted common prefixes,
   and groups the windows that agree on ``length`` bytes. In each group the earliest place stays;
   the shard answers which windows go.
3. Chunks turn the answers into byte ranges.

Chunks and shards exchange packed blocks, one row per (chunk, shard) pair that has something to
say; documents are dealt once. An anchor with more than ``hot_anchor`` texts is split: its windows
travel one by one and are dealt by their own content, so no shard gathers a frequent passage's
surroundings.

Special cases: null text counts as empty; documents shorter than ``length`` keep all bytes; null
``doc_id`` sorts first; rows that repeat a ``doc_id`` are ordered by text and are separate
documents; identical rows likewise (all but one lose what repeats). Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .base import U64, chunk_count, lean, mix64, pack, pack_keys, range_bucket, shares, text_bytes, unpack, unpack_keys
from .suffix_array import common_prefixes, suffix_array

_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 20
_MAX = np.iinfo(np.uint64).max


class Params:
    def __init__(self, length: int = 100, gram: int = 40, hot_anchor: int = 20_000, chunk: int = 8 << 20):
        self.length, self.gram, self.hot_anchor, self.chunk = length, gram, hot_anchor, chunk


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * _STEP)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE, U64)])
            self.down = np.cumprod(np.r_[U64(1), np.full(size - 1, inverse, U64)])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _batches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about a megabyte together."""
    a = total = 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > _STEP:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def runs_of(texts: list[bytes], p: Params) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document number, first window, windows, anchor, text hash, flag.

    The flag marks anchors that come twice within ``length`` bytes: such a run may repeat itself.
    """
    found = []
    wide = p.length - p.gram + 1
    sizes = np.array([len(x) for x in texts], np.int64)
    for a, b in _batches(sizes):
        joined = b"".join(texts[a:b])
        data = np.frombuffer(joined, np.uint8)
        n = len(data)
        if n < p.length:
            continue
        up, down = _POWERS.get(n)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * up, out=total[1:])
        grams = mix64((total[p.gram :] - total[: -p.gram]) * down[: n - p.gram + 1])
        least = _sliding_min(grams, wide)
        ends = np.cumsum(sizes[a:b])
        starts = ends - sizes[a:b]
        doc = np.repeat(np.arange(a, b), sizes[a:b])[: len(least)]
        ok = np.arange(len(least)) + p.length <= ends[doc - a]
        first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])])
        count = np.diff(np.r_[first, len(least)])
        keep = ok[first]
        first, count = first[keep], count[keep]
        anchor, end = least[first], first + count - 1 + p.length
        # A place is an anchor if the largest least value of the windows over it is its own.
        inverted = np.full(len(grams) + wide - 1, _MAX, U64)
        inverted[wide - 1 : wide - 1 + len(least)] = np.where(ok, ~least, _MAX)
        place = np.flatnonzero(~_sliding_min(inverted, wide) == grams)
        value = grams[place]
        order = np.argsort(value, kind="stable")
        twice = (value[order][1:] == value[order][:-1]) & (np.diff(place[order]) < p.length)
        flag = np.isin(anchor, value[order][1:][twice]) if twice.any() else np.zeros(len(anchor), bool)
        text = np.fromiter((xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(first.tolist(), end.tolist(), strict=True)), U64, len(first))
        found.append((doc[first], first - starts[doc[first] - a], count, mix64(anchor), text, flag))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _entries(anchor: np.ndarray, text: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (anchor, text) pairs, whether any is flagged, each run's pair, and each pair's first run."""
    order = np.lexsort((text, anchor))
    a, t = anchor[order], text[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])][: len(a)]
    at = np.flatnonzero(fresh)
    pair = np.empty(len(a), np.int64)
    pair[order] = np.cumsum(fresh) - 1
    any_flag = np.logical_or.reduceat(flag[order], at) if len(at) else flag
    return a[at], t[at], any_flag, pair, order[at]


def _sorted_table(t: pa.Table) -> pa.Table:
    """The rows of a chunk in the order that counts as earlier and later."""
    t = t.set_column(t.column_names.index("text"), "text", pc.fill_null(t.column("text").cast(pa.large_binary()), b""))
    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def _sorted_docs(t: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts in that order."""
    t = _sorted_table(t)
    return t.column("doc_id").to_pylist(), t.column("text").to_pylist()


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _join_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U64).ravel()


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard numbers and the places of their hashes, in the order of the input."""
    shard = (((h >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]][: len(order)]).tolist()
    for a, b in zip(at, [*at[1:], len(order)][: len(at)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"blob": pa.binary()}
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), kinds.get(n, pa.int32())) for n, c in zip(names, cols, strict=True)})


def _ask(p: Params, shards: int):
    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        _, texts = _sorted_docs(t)
        anchor, text, flag, _, _ = _entries(*runs_of(texts, p)[3:])
        return _rows([(s, chunk, pack(pack_keys(anchor[at]), _planes(text[at]), flag[at])) for s, at in shares(anchor, shards)], ("shard", "chunk", "blob"))

    return run


#: What a shard says of an (anchor, text) pair: settled here, settled in an earlier chunk, to be compared, to be split and compared.
HERE, ELSEWHERE, COMPARE, SPLIT = range(4)


def _settle(p: Params):
    def run(t: pa.Table) -> pa.Table:
        chunks = t.column("chunk").to_pylist()
        blocks = [unpack(x) for x in t.column("blob").to_pylist()]
        anchor = np.concatenate([unpack_keys(b[0]) for b in blocks])
        text = np.concatenate([_join_planes(b[1]) for b in blocks])
        flag = np.concatenate([b[2] for b in blocks])
        chunk = np.repeat(np.array(chunks, np.int64), [len(b[2]) for b in blocks])
        order = np.lexsort((chunk, text, anchor))
        a, x = anchor[order], text[order]
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_pair = new_a | np.r_[True, x[1:] != x[:-1]]
        group = np.cumsum(new_a) - 1
        texts = np.bincount(group, new_pair)[group]
        odd = np.bincount(group, flag[order])[group] > 0
        state = np.empty(len(a), np.uint8)
        state[order] = np.where(texts > p.hot_anchor, SPLIT, np.where((texts > 1) | odd, COMPARE, np.where(new_pair, HERE, ELSEWHERE)))
        shard, out, at = t.column("shard")[0].as_py(), [], 0
        for c, b in zip(chunks, blocks, strict=True):
            out.append((c, shard, pack(state[at : at + len(b[2])])))
            at += len(b[2])
        return _rows(out, ("chunk", "shard", "blob"))

    return run


def _send(p: Params, shards: int):
    """Answers -> texts to compare, for each shard, and the chunk's own notes (to shard ``shards`` + chunk)."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([], ("shard", "chunk", "blob"))
        chunk = t.column("chunk")[0].as_py()
        _, texts = _sorted_docs(t)
        doc, first, count, *rest = runs_of(texts, p)
        anchor, _, _, pair, lead = _entries(*rest)
        state = np.zeros(len(anchor), np.uint8)
        said = dict(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        for s, at in shares(anchor, shards):
            state[at] = unpack(said[s])[0]
        own = state[pair]
        later = np.ones(len(pair), bool)
        later[lead] = False
        gone = np.flatnonzero((own == ELSEWHERE) | (own == HERE) & later)
        known: dict[bytes, int] = {}
        places: list[tuple] = []  # of each distinct text: shard key, document number, window, windows
        uses = []  # document number, first window, windows, text number, whether it is the text's first place
        for i in np.flatnonzero(own >= COMPARE).tolist():
            d, s, w, hot = int(doc[i]), int(first[i]), int(count[i]), own[i] == SPLIT
            for at, n in ([(s + k, 1) for k in range(w)] if hot else [(s, w)]):
                text = texts[d][at : at + n - 1 + p.length]
                k = known.get(text)
                if k is None:
                    k = known[text] = len(places)
                    places.append((int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") if hot else int(rest[0][i]), d, at, n))
                    uses.append((d, at, n, k, 1))
                else:
                    uses.append((d, at, n, k, 0))
        out = []
        if places:
            bodies = list(known)
            key = np.array([x[0] for x in places], U64)
            at = np.array([x[1:] for x in places], np.int64)
            for s, own_at in _by_shard(key, shards):
                size = np.array([len(bodies[k]) for k in own_at.tolist()], np.int64)
                out.append((s, chunk, pack(b"".join(bodies[k] for k in own_at.tolist()), size, at[own_at, 0], at[own_at, 1], own_at)))
        if len(gone) or uses:
            out.append((shards + chunk, chunk, pack(doc[gone], first[gone], count[gone], np.array(uses, np.int64).ravel())))
        return _rows(out, ("shard", "chunk", "blob"))

    return run


def repeated_windows(bodies: list[bytes], first: np.ndarray, length: int) -> list[np.ndarray]:
    """Per distinct text, which of its windows also start earlier; first: (document, row, window) of each text."""
    size = np.array([len(b) for b in bodies], np.int64)
    joined = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    t = joined.astype(np.uint16) + np.uint16(2)
    t[ends] = 1
    t = np.r_[t, np.uint16(0)]
    sa = suffix_array(t, 258)
    lcp = common_prefixes(t, sa)
    owner = np.repeat(np.arange(len(bodies)), size + 1)
    real = sa < len(owner)
    place = np.where(real, sa, 0)
    text = owner[place]
    valid = real & (place + length <= ends[text])
    # A break in the chain of common prefixes starts a new group, also across suffixes without a window.
    group = np.cumsum(np.minimum(lcp, length) < length)
    sa, text, group = place[valid], text[valid], group[valid]
    at = first[text, 2] + sa - starts[text]
    order = np.lexsort((at, first[text, 1], first[text, 0], group))
    lead = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else np.zeros(0, bool)
    gone = np.zeros(len(joined), bool)
    gone[sa[order[~lead]]] = True
    return [gone[a : b - length + 1] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _judge(p: Params, shards: int):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        if shard >= shards:  # notes of a chunk to itself
            return t.select(["chunk", "shard", "blob"])
        known: dict[bytes, int] = {}
        best: list[tuple] = []
        asked = []
        for chunk, block in zip(t.column("chunk").to_pylist(), t.column("blob").to_pylist(), strict=True):
            body, size, row, window, number = unpack(block)
            cuts = np.r_[0, np.cumsum(size)].tolist()
            mine, places = [], list(zip([chunk] * len(row), row.tolist(), window.tolist(), strict=True))
            for j, place in enumerate(places):
                text = body[cuts[j] : cuts[j + 1]]
                k = known.setdefault(text, len(best))
                if k == len(best):
                    best.append(place)
                elif place < best[k]:
                    best[k] = place
                mine.append(k)
            asked.append((chunk, mine, number, places))
        gone = repeated_windows(list(known), np.array(best, np.int64).reshape(-1, 3), p.length)
        out = []
        for chunk, mine, number, places in asked:
            leads = np.array([best[k] == place for k, place in zip(mine, places, strict=True)], bool)
            masks = [gone[k] for k, lead in zip(mine, leads.tolist(), strict=True) if lead]
            out.append((chunk, shard, pack(number, leads, np.concatenate(masks) if masks else np.zeros(0, bool))))
        return _rows(out, ("chunk", "shard", "blob"))

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _whole(text: bytes, off: np.ndarray) -> bytes:
    """What is left where a character with a removed byte goes whole."""
    char = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    hit = np.zeros(char[-1] + 1, bool)
    hit[char[off]] = True
    return np.frombuffer(text, np.uint8)[~hit[char]].tobytes()


def _apply(p: Params, shards: int, keep_text: bool, carry: list[str], whole: bool = False):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = _sorted_table(t)
        ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        lead, masks, notes, replies = {}, {}, None, []
        for shard, block in zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            if shard >= shards:
                notes = unpack(block)
            else:
                replies.append(unpack(block))
        gone: dict[int, np.ndarray] = {}

        def stretch(d: int, a: int, n: int) -> None:
            """Windows a .. a+n-1 of document d all go."""
            g = gone.get(d)
            if g is None:
                g = gone[d] = np.zeros(len(texts[d]) + 1, np.int32)
            g[a] += 1
            g[a + n - 1 + p.length] -= 1

        if notes is not None:
            for d, s, n in zip(*(x.tolist() for x in notes[:3]), strict=True):
                stretch(d, s, n)
            use = notes[3].reshape(-1, 5)
            windows = {k: n for n, k in use[use[:, 4] == 1][:, 2:4].tolist()}
            for number, leads, mask in replies:
                at = 0
                for k, yes in zip(number.tolist(), leads.tolist(), strict=True):
                    lead[k] = yes
                    if yes:
                        masks[k] = mask[at : at + windows[k]]
                        at += windows[k]
            for d, s, n, k, is_first in use.tolist():
                if is_first and lead[k]:
                    m = np.r_[False, masks[k], False].astype(np.int8)
                    turns = np.flatnonzero(np.diff(m))
                    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                        stretch(d, s + a, b - a)
                else:
                    stretch(d, s, n)
        n_removed, n_spans, sha, kept = [], [], [], []
        for d, text in enumerate(texts):
            g = gone.get(d)
            left, spans, lost, off = text, 0, 0, None
            if g is not None:
                off = np.cumsum(g[:-1]) > 0
                lost = int(off.sum())
                if lost:
                    spans = int(off[0]) + int(np.count_nonzero(off[1:] & ~off[:-1]))
                    left = np.frombuffer(text, np.uint8)[~off].tobytes()
            n_removed.append(lost)
            n_spans.append(spans)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(None if not keep_text else _whole(text, off) if whole and lost else left)
        return pa.table({
            **{f"_{c}": t.column(f"_{c}") for c in carry}, "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()),
        })

    return run


def remove_repeats(docs: DataFrame, params: Params | None = None, keep_text: bool = False, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``, one row per row of ``docs``.

    Columns named in ``carry`` come along as ``_<name>``. ``kept`` holds the remaining bytes where ``keep_text`` asks for them. They need not be valid
    UTF-8: a removed stretch may begin or end inside a character; with ``whole``, such characters are
    not in ``kept``.
    """
    p = params or Params()
    n = chunk_count(text_bytes(docs), p.chunk)
    own = [F.col(c).alias(f"_{c}") for c in carry]
    chunks = docs.select(*own, "doc_id", "text", range_bucket(docs, n).alias("chunk")).repartition(n, "chunk")
    grouped = chunks.groupBy("chunk")
    pair, back = "shard int, chunk int, blob binary", "chunk int, shard int, blob binary"
    settled = grouped.applyInArrow(lean(_ask(p, n)), pair).groupBy("shard").applyInArrow(lean(_settle(p)), back)
    sent = grouped.cogroup(settled.groupBy("chunk")).applyInArrow(lean(_send(p, n)), pair)
    replies = sent.groupBy("shard").applyInArrow(lean(_judge(p, n)), back)
    schema = StructType([*(StructField(f"_{c}", docs.schema[c].dataType) for c in carry), *StructType.fromDDL(_RESULT).fields])
    return grouped.cogroup(replies.groupBy("chunk")).applyInArrow(lean(_apply(p, n, keep_text, list(carry), whole)), schema)
