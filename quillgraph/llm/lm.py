"""Language-model scores by a weighted backoff automaton over smoothed n-grams of one to three words.

Model: P(w | uv) = (c(uvw) + m3 * P(w | v)) / (c(uv) + m3), P(w | v) = (c(vw) + m2 * P(w)) / (c(v) + m2),
P(w) = (c(w) - D) / N for known words and D * V / N for the one class of unknown words;
D = n1 / (n1 + 2 n2). It sums to one for every history.

Automaton: the root, a state for every word and one for every pair of words that training holds. A
seen word pair is an arc from the first word's state, a seen triple an arc from its first pair's
state, both to the state of the last pair; the root has an arc for every word, to the word's state
if it is known. Where a state has no arc for a word, its failure arc, of weight
log10(m / (c(h) + m)), leads to the state one word shorter. One traversal from left to right carries
the state; weights of the arcs and failure arcs taken add up.

Counts come in two rounds over chunks of documents that are dealt once. In the first, a chunk sends
each distinct word and pair it holds, with its count in training and elsewhere, to shards; they
answer with the corpus count and whether the pair comes more than once at all. In the second it
sends the triples: those with a pair that comes once come once themselves, and are not asked for.
The chunk then builds the part of the automaton that its documents can reach. What moves grows with
the input; nothing is broadcast or collected but the likelihood of each pair of priors; frequent
words weigh no more than rare ones, since each chunk names an n-gram once.

The priors are the pair of ``PRIORS`` under which the training tokens are likeliest when each is
left out of the counts.

Special cases: null and blank texts hold only the end token. Rows with null or repeated ``doc_id``
are scored like any other, copies alike. Without training tokens every token is the unknown class,
of probability one. An empty table has no rows; further columns are ignored, also ones named like
those of the result. A chunk holds whole documents, so the longest text bounds a task's memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import U64, chunk_count, crc_of_id, cut, hash_bucket, lean, mix64, pack, pack_keys, pack_planes, shares, text_bytes, unpack, unpack_keys, unpack_planes, word_codes

END, START = U64(0xE4D), U64(0x57A27)
_STEP = U64(0x9E3779B97F4A7C15)
#: Bits of a pair's or triple's hash: less to move, and at 10**13 n-grams one in 7000 meets another.
GRAM_BITS = 56
#: (m2, m3), from light to heavy smoothing.
PRIORS = ((16.0, 0.5), (256.0, 0.5), (256.0, 4.0), (4096.0, 2.0), (4096.0, 16.0), (16384.0, 64.0))
#: Tokens of a document that are read in one go; longer documents go in pieces side by side.
PIECE = 256
WORDS, PAIRS = 0, 1


class _Grams:
    """Tokens of a chunk as numbers of its distinct words, pairs and triples.

    Numbers follow the words' hashes: the chunk's rows may come in another order each time.
    """

    def __init__(self, t: pa.Table):
        codes, words, sizes = word_codes(t.column("text"))
        words, place = np.unique(words, return_inverse=True)
        codes = place[codes]
        self.end, self.start, self.symbols = len(words), len(words) + 1, len(words) + 2
        self.sizes = sizes + 1
        last = np.cumsum(self.sizes) - 1
        self.first = last - sizes
        self.token = np.full(int(self.sizes.sum()), self.end, np.int64)
        own = np.ones(len(self.token), bool)
        own[last] = False
        self.token[own] = codes
        self.in_train = np.repeat(~t.column("held_out").to_numpy(), self.sizes)
        before = np.roll(self.token, 1)
        before[self.first] = self.start
        self.word = np.r_[words, END, START]
        pairs, self.pair_of = np.unique(before * self.symbols + self.token, return_inverse=True)
        self.pair_first, self.pair_last = pairs // self.symbols, pairs % self.symbols
        self.pair = mix64(mix64(self.word[self.pair_first] * _STEP) + self.word[self.pair_last])
        self.inner = np.ones(len(self.token), bool)  # positions with two tokens before them, START counting as one
        self.inner[self.first] = False
        at = np.flatnonzero(self.inner)
        triples, place, self.triple_of = np.unique(self.pair_of[at - 1] * self.symbols + self.token[at], return_index=True, return_inverse=True)
        self.triple_first, self.triple_word, self.triple_last = triples // self.symbols, triples % self.symbols, self.pair_of[at[place]]
        self.triple = mix64(self.pair[self.triple_first] * _STEP + self.word[self.triple_word])

    def counts(self, of: np.ndarray, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training and elsewhere."""
        train = self.in_train if at is None else self.in_train[at]
        return np.bincount(of[train], minlength=n).astype(np.uint32), np.bincount(of[~train], minlength=n).astype(np.uint32)

    def grams(self):
        """(kind; hashes in ascending order, their bits, and the place of each among the chunk's words or pairs)."""
        for kind, h, bits in ((WORDS, self.word[:-1], 64), (PAIRS, self.pair >> U64(64 - GRAM_BITS), GRAM_BITS)):
            order = np.argsort(h, kind="stable")
            yield kind, h[order], bits, order


def _blocks(h: np.ndarray, bits: int, shards: int, counts: tuple[np.ndarray, np.ndarray], every: bool = False) -> dict[int, bytes]:
    """Packed requests by shard; with ``every``, empty ones too."""
    block = lambda at: pack(pack_keys(h[at]), *[pack_planes(x[at]) for x in counts])
    out = {s: block(slice(0)) for s in range(shards)} if every else {}
    out.update({s: block(at) for s, at in shares(h, shards, bits)})
    return out


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"shard": pa.array(a, pa.int32()), "chunk": pa.array(b, pa.int32()), "blob": pa.array(c, pa.binary())})


def _ask(shards: int):
    """Words to shards 0 .. shards-1, each of which also owes the chunk its sums, and pairs to the shards after them."""

    def run(t: pa.Table) -> pa.Table:
        chunk, g = t.column("chunk")[0].as_py(), _Grams(t)
        rows = []
        for kind, h, bits, order in g.grams():
            n, m = g.counts(g.token if kind == WORDS else g.pair_of, len(h))
            rows += [(kind * shards + s, chunk, b) for s, b in _blocks(h, bits, shards, (n[order], m[order]), kind == WORDS).items()]
        return _table(rows)

    return run


def _count(shards: int, notes: int):
    """Answers in the order asked: twice the training count, plus one if the n-gram comes more than once at all.

    Shards below ``shards`` add their training tokens, words, and words met once and twice; rows from
    ``notes`` on are a chunk's notes to itself.
    """

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        if shard >= notes:
            return t.select(["chunk", "shard", "blob"])
        blocks = [unpack(x) for x in t.column("blob").to_pylist()]
        keys = [unpack_keys(b[0]) for b in blocks]
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(of, np.concatenate([unpack_planes(b[k], np.uint32) for b in blocks]).astype(np.float64)).astype(np.int64) for k in (1, 2)]
        known = sums[0]
        own = np.array([known.sum(), (known > 0).sum(), (known == 1).sum(), (known == 2).sum()] if shard < shards else [], np.int64)
        answer, at, out = (2 * known + (known + sums[1] > 1))[of], 0, []
        for k in keys:
            out.append(pack(pack_planes(answer[at : at + len(k)]), own))
            at += len(k)
        return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "blob": pa.array(out, pa.binary())})

    return run


def _heard(g: _Grams, said: dict[int, bytes], shards: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Answers for the chunk's words and pairs, and the sums over all shards of words."""
    out, sums = [], np.zeros(4, np.int64)
    for kind, h, bits, order in g.grams():
        got = np.zeros(len(h), np.int64)
        for s, at in shares(h, shards, bits):
            got[order[at]] = unpack_planes(unpack(said[kind * shards + s])[0], np.int64)
        out.append(got)
    for s in range(shards):
        if s in said:
            sums += unpack(said[s])[1]
    return out, sums


def _said(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True))


def _open_triples(g: _Grams, pair: np.ndarray) -> np.ndarray:
    """Triples both of whose pairs come more than once: only these can come more than once themselves."""
    return (pair[g.triple_first] & 1 > 0) & (pair[g.triple_last] & 1 > 0)


def _ask_triples(shards: int):
    """Open triples to shards, and the answers so far (to shard ``shards`` + chunk) for the chunk's last step."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([])
        chunk, g = t.column("chunk")[0].as_py(), _Grams(t)
        (word, pair), sums = _heard(g, _said(answers), shards)
        n, m = g.counts(g.triple_of, len(g.triple), np.flatnonzero(g.inner))
        at = np.flatnonzero(_open_triples(g, pair))
        at = at[np.argsort(g.triple[at], kind="stable")]
        rows = [(s, chunk, b) for s, b in _blocks(g.triple[at] >> U64(64 - GRAM_BITS), GRAM_BITS, shards, (n[at], m[at])).items()]
        return _table([*rows, (shards + chunk, chunk, pack(pack_planes(word), pack_planes(pair), sums))])

    return run


class Automaton:
    """States and arcs that the words, pairs and triples of one chunk can reach.

    State 0 is the root, 1 + w a word's, 1 + symbols + p a pair's. Weights depend on the priors,
    the way through the automaton does not.
    """

    def __init__(self, g: _Grams, word: np.ndarray, pair: np.ndarray, triple: np.ndarray):
        self.symbols = g.symbols
        pairs = 1 + g.symbols
        self.level = np.r_[np.zeros(1, np.int8), np.ones(g.symbols, np.int8), np.full(len(pair), 2, np.int8)]
        self.held = np.r_[0, word, pair]  # how often a state's words come, as a history
        self.fail = np.r_[np.zeros(pairs, np.int64), np.where(word[g.pair_last] > 0, 1 + g.pair_last, 0)]
        self.enter = np.where(word > 0, 1 + np.arange(g.symbols), 0)  # where the root's arcs lead
        two, three = np.flatnonzero(pair > 0), np.flatnonzero(triple > 0)
        self.source = np.r_[1 + g.pair_first[two], pairs + g.triple_first[three]]
        self.target = np.r_[pairs + two, pairs + g.triple_last[three]]
        self.last = np.r_[g.pair_last[two], g.triple_word[three]]
        self.seen = np.r_[pair[two], triple[three]]
        # The shorter arc over the same word, for arcs of triples; -1 for arcs of pairs.
        place = np.full(len(pair), -1, np.int64)
        place[two] = np.arange(len(two))
        self.shorter = np.r_[np.full(len(two), -1, np.int64), place[g.triple_last[three]]]
        self.arcs = pd.Index(self.source * self.symbols + self.last)

    def read(self, token: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the state it is read in and the arc that is taken at last, -1 for one of the root.

        Documents are read side by side from left to right. A piece of a long document starts two
        tokens early in the root: no state remembers more than two words, so it has caught up.
        """
        n = -(-sizes // PIECE)
        doc = np.repeat(np.arange(len(sizes)), n)
        begin = first[doc] + PIECE * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(begin + PIECE, first[doc] + sizes[doc])
        at = np.maximum(begin - 2, first[doc])
        order = np.argsort(at - stop, kind="stable")
        begin, stop, at = begin[order], stop[order], at[order]
        state = np.where(at == first[doc[order]], self.enter[start], 0)
        states, taken = np.zeros(len(token), np.int64), np.full(len(token), -1, np.int64)
        live = len(at)
        while live:
            s, w = state[:live], token[at[:live]]
            now, arc = s, self.arcs.get_indexer(s * self.symbols + w)
            for _ in range(2):
                lost = np.flatnonzero((arc < 0) & (now > 0))
                if not len(lost):
                    break
                now = now.copy()
                now[lost] = self.fail[now[lost]]
                arc[lost] = self.arcs.get_indexer(now[lost] * self.symbols + w[lost])
            here = np.flatnonzero(at[:live] >= begin[:live])
            states[at[here]], taken[at[here]] = s[here], arc[here]
            state[:live] = np.where(arc >= 0, self.target[arc], self.enter[w])
            at[:live] += 1
            live = int(np.searchsorted(at[:live] - stop[:live], 0))
        return states, taken

    def weights(self, p: np.ndarray, m2: float, m3: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 weights of the failure arc of each state, of each arc, and of the root's arc for each word."""
        m = np.where(self.level == 2, m3, m2)
        fail = np.log10(m / (self.held + m))
        fail[0] = 0.0
        two = self.shorter < 0
        value = np.empty(len(self.seen))
        value[two] = (self.seen[two] + m2 * p[self.last[two]]) / (self.held[self.source[two]] + m2)
        value[~two] = (self.seen[~two] + m3 * value[self.shorter[~two]]) / (self.held[self.source[~two]] + m3)
        return fail, np.log10(value), np.log10(p)

    def score(self, token: np.ndarray, states: np.ndarray, taken: np.ndarray, p: np.ndarray, m2: float, m3: float) -> np.ndarray:
        """The weight that reading each token adds: of the failure arcs passed and of the arc taken."""
        fail, arc, root = self.weights(p, m2, m3)
        from_root = taken < 0
        reached = np.where(from_root, 0, self.level[self.source[taken]]) if len(self.source) else np.zeros(len(taken), np.int8)
        level = self.level[states]
        out = np.where(from_root, root[token], arc[taken] if len(arc) else 0.0)
        out += np.where(level > reached, fail[states], 0.0)
        twice = np.flatnonzero(level > reached + 1)
        out[twice] += fail[self.fail[states[twice]]]
        return out


def _left_out(g: _Grams, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, n: int, d: float, unknown: float) -> list[float]:
    """log10 likelihood of the chunk's training tokens under each pair of priors, each token left out of the counts."""
    own = g.in_train
    w, of = word[g.token[own]], g.pair_of[own]
    p1 = np.where(w > 1, (w - 1 - d) / max(n - 1, 1), unknown)
    c2, h2 = pair[of] - 1, word[g.pair_first[of]] - 1
    inner = g.inner[own]
    at = g.triple_of[own[g.inner]]
    c3, h3 = triple[at] - 1, pair[g.triple_first[at]] - 1
    out = []
    for m2, m3 in PRIORS:
        p2 = (c2 + m2 * p1) / (h2 + m2)
        p2[inner] = (c3 + m3 * p2[inner]) / (h3 + m3)
        out.append(float(np.log10(p2).sum()))
    return out


def _score(shards: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        g, said = _Grams(t), _said(answers)
        word, pair, sums = unpack(said[shards + t.column("chunk")[0].as_py()])
        word, pair = unpack_planes(word, np.int64), unpack_planes(pair, np.int64)
        own_triples, _ = g.counts(g.triple_of, len(g.triple), np.flatnonzero(g.inner))
        triple = own_triples.astype(np.int64)  # those not asked for come once
        at = np.flatnonzero(_open_triples(g, pair))
        at = at[np.argsort(g.triple[at], kind="stable")]
        for s, own in shares(g.triple[at] >> U64(64 - GRAM_BITS), shards, GRAM_BITS):
            triple[at[own]] = unpack_planes(unpack(said[s])[0], np.int64) >> 1
        word, pair = np.r_[word >> 1, 0], pair >> 1
        word[g.start] = word[g.end]  # a start is a history as often as training documents end
        n, v, n1, n2 = (int(x) for x in sums)
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.1, 0.1), 0.95)
        unknown = d * v / n if n else 1.0
        p = np.where(word > 0, (word - d) / max(n, 1), unknown)
        machine = Automaton(g, word, pair, triple)
        states, taken = machine.read(g.token, g.first, g.sizes, g.start)
        total = lambda x: np.add.reduceat(x, g.first)
        scores = [total(machine.score(g.token, states, taken, p, m2, m3)) for m2, m3 in PRIORS]
        seen = word[g.token]
        rows = len(g.sizes)
        once = [_left_out(g, word, pair, triple, n, d, unknown)] + [[0.0] * len(PRIORS)] * (rows - 1)
        return pa.table({
            "doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(g.sizes), "n_known": pa.array(total((seen > 0).astype(np.int64))), "train_tokens": pa.array(np.full(rows, n)),
            "base_score": pa.array(total(np.log10((seen + 1) / (n + v + 1)))), "scores": pa.array(np.stack(scores, 1).tolist(), pa.list_(pa.float64())), "left_out": pa.array(once, pa.list_(pa.float64())),
        })

    return run


def backoff_scores(docs: DataFrame, held_out: Column | None = None, chunk: int = 8 << 20) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, prior)`` per row of ``docs``.

    ``held_out`` marks the documents that the model does not learn from (default: crc32 of the id's
    text, modulo 7, is 2). ``prior`` holds m2 and m3.
    """
    held_out = crc_of_id() % 7 == 2 if held_out is None else held_out
    n = chunk_count(text_bytes(docs), chunk)
    chunks = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("chunk", hash_bucket(n, "doc_id", "text")).repartition(n, "chunk")
    grouped = chunks.groupBy("chunk")
    asked, back = "shard int, chunk int, blob binary", "chunk int, shard int, blob binary"
    first = grouped.applyInArrow(lean(_ask(n)), asked).groupBy("shard").applyInArrow(lean(_count(n, 2 * n)), back)
    second = grouped.cogroup(first.groupBy("chunk")).applyInArrow(lean(_ask_triples(n)), asked).groupBy("shard").applyInArrow(lean(_count(0, n)), back)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, left_out array<double>"
    scored = cut(grouped.cogroup(second.groupBy("chunk")).applyInArrow(lean(_score(n)), schema))
    likely = scored.agg(*[F.sum(F.get("left_out", F.lit(i))) for i in range(len(PRIORS))]).first()
    best = max(range(len(PRIORS)), key=lambda i: likely[i] if likely[i] is not None else float("-inf"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.get("scores", F.lit(best)).alias("score"), F.array(*[F.lit(m) for m in PRIORS[best]]).alias("prior"))
