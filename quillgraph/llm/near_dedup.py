"""MinHash near-duplicate detection with tensored banding.

Two collections of ``bands`` band hashes (``rows`` minhashes each) are computed per set; the
tables are the ``bands**2`` pairs of one hash from either collection, so ``bands**2`` tables cost
``2 * bands * rows`` minhashes. Two sets of Jaccard similarity s share a table with probability
``(1 - (1 - s**rows)**bands)**2`` (0.99993 at s = 0.85 with the defaults).

1. Rows with equal sets form a class; everything below runs on class representatives.
2. Buckets of the tables with the same members are looked at once. Members are compared by a
   one-permutation sketch: first each with its buckets' least members, which labels most of them;
   then, where a bucket has several labels, those outside its commonest label with all, in tiles of
   at most ``tile`` x ``tile``. A tile returns links between labels, a forest and never the pairs.
3. Components of those forests are candidate clusters, whose links are confirmed on the full sets.
   In a cluster of more than ``verify_tile`` members, each is first compared with the least one, in
   groups of that size; then those that have no such link with all, again in tiles. A tile returns
   a spanning forest of true links.
4. Components of the true links are the result.

No bucket, cluster or partner list is capped. Memory of a task is bounded by two tile sides.

Special cases: null, empty or blank text has the empty set, ``n_shingles`` 0, and links with
nothing. A row without ``doc_id`` has a null component and is kept. Rows that repeat a ``doc_id``
are one node, linked with what either row links with. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, cut, cut_small, lean, lean_batches, may_hold, mix64, sliced, word_codes
from .components import components

BINS = 128


class Params:
    """Defaults: sets of ``shingle`` words, linked at ``percent`` per cent or more."""

    def __init__(self, shingle: int = 5, percent: int = 80, bands: int = 8, rows: int = 2, tile: int = 2048, verify_tile: int = 512):
        self.shingle, self.percent, self.bands, self.rows = shingle, percent, bands, rows
        self.tile, self.verify_tile = tile, verify_tile
        #: Sketch estimates this far below the threshold still count: five standard deviations.
        t = percent / 100
        self.floor = t - 5 * (t * (1 - t) / BINS) ** 0.5
        rng = np.random.default_rng(7)
        n = 2 * bands * rows
        self.mul = rng.integers(1, 2**62, n, dtype=np.uint64) * U64(2) + U64(1)
        self.add = rng.integers(1, 2**62, n, dtype=np.uint64)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a word-hash sequence."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    acc = hashes[: n - width + 1].copy()
    for k in range(1, width):
        acc = mix64(acc * U64(0x9E3779B97F4A7C15)) + hashes[k : n - width + 1 + k]
    return np.unique(mix64(acc + U64(width)))


def sketch(s: np.ndarray) -> np.ndarray:
    """One-permutation sketch: per bin the least hash folded to 1..255, 0 where empty."""
    out = np.zeros(BINS, np.uint8)
    if len(s):
        h = mix64(s * U64(0xD6E8FEB86659FD93))
        h.sort()
        bins = (h >> U64(57)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out[bins[first]] = (h[first] % U64(255)).astype(np.uint8) + 1
    return out


def band_hashes(s: np.ndarray, p: Params) -> np.ndarray:
    """The two collections of band hashes, as 2 * bands signed 64-bit values."""
    low = np.empty(len(p.mul), U64)
    for k in range(len(p.mul)):
        x = s * p.mul[k] + p.add[k]
        x ^= x >> U64(32)
        low[k] = (x * U64(0xD6E8FEB86659FD93)).min()
    low = low.reshape(2 * p.bands, p.rows)
    acc = np.arange(2 * p.bands, dtype=np.uint64)
    for k in range(p.rows):
        acc = mix64(acc * U64(0x9E3779B97F4A7C15) + low[:, k])
    return acc.view(np.int64)


def _sets(texts: pa.Array | pa.ChunkedArray, p: Params):
    """Each text's sorted distinct shingle hashes."""
    codes, hashes, sizes = word_codes(texts)
    words, at = hashes[codes], 0
    for n in sizes.tolist():
        yield shingle_set(words[at : at + n], p.shingle)
        at += n


def _signer(p: Params):
    def run(batches):
        for t in sliced(batches):
            n, fp, bands, sk = [], [], [], []
            for s in _sets(t.column("text"), p):
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_hashes(s, p).tolist() if len(s) else [])
                sk.append(sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "fp", "bands", "sketch"])

    return run


class _Union:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.fromiter((self.find(int(i)) for i in members), np.int64, len(members))


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a tile's two sides; a row may be on both."""
    return np.flatnonzero(t.column("asks").to_numpy()), np.flatnonzero(t.column("told").to_numpy())


def _known(label: np.ndarray, u: _Union) -> tuple[np.ndarray, np.ndarray]:
    """The distinct labels and a row of each; rows with one label are joined."""
    labels, heads, of = np.unique(label, return_index=True, return_inverse=True)
    for i, k in enumerate(of.tolist()):
        u.join(int(heads[k]), i)
    return labels, heads


def _stars(ids: np.ndarray, u: _Union, at: np.ndarray | None = None) -> pa.Table:
    """Each linked id with the least one of its tree, so that tiles with the same members say the same; at: the ids' places."""
    root = u.roots(np.arange(len(ids)) if at is None else at)
    order = np.lexsort((ids, root))
    lead = np.r_[True, root[order][1:] != root[order][:-1]][: len(ids)]
    least = ids[order][lead][np.cumsum(lead) - 1]
    linked = least != ids[order]
    return pa.table({"a": pa.array(least[linked], pa.int64()), "b": pa.array(ids[order][linked], pa.int64())})


def _sketches(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), np.uint8).reshape(-1, BINS)


def _near(x: np.ndarray, y: np.ndarray, p: Params) -> np.ndarray:
    """Whether sketches estimate a similarity near or over the threshold."""
    return ((x == y) & (x > 0)).sum(-1) >= p.floor * ((x > 0) | (y > 0)).sum(-1)


def _leader_estimates(p: Params):
    """Keeps pairs of a member and a bucket's least member that are near by sketch."""

    def run(batches):
        for t in batches:
            ok = pa.array(_near(_sketches(t, "sketch_a"), _sketches(t, "sketch"), p))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("id").filter(ok)], ["a", "b"])

    return run


def _tile_estimates(p: Params):
    """Links between groups of a bucket's members; rows with one ``label`` are known to belong together."""

    def run(t: pa.Table) -> pa.Table:
        n, sk = t.column("n").to_numpy(), _sketches(t, "sketch")
        left, right = _sides(t)
        u = _Union(len(n))
        labels, heads = _known(t.column("label").to_numpy(), u)
        for i in left:
            own = right[(100 * np.minimum(n[right], n[i]) >= p.percent * np.maximum(n[right], n[i]))]
            if len(own):
                own = own[u.roots(own) != u.find(int(i))]
            if len(own):
                for j in own[_near(sk[own], sk[i], p)]:
                    u.join(int(i), int(j))
        return _stars(labels, u, heads)

    return run


def _tile_links(p: Params):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        sets = [np.frombuffer(x, U64) for x in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        left, right = _sides(t)
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.r_[0, np.cumsum(size)]
        here = np.zeros(int(dense.max()) + 1, bool)
        u = _Union(len(ids))
        _known(t.column("label").to_numpy(), u)
        for i in left:
            own = right[(100 * np.minimum(size[right], size[i]) >= p.percent * np.maximum(size[right], size[i]))]
            if len(own):
                own = own[u.roots(own) != u.find(int(i))]
            if not len(own):
                continue
            mine = dense[at[i] : at[i + 1]]
            here[mine] = True
            for j in own:
                inter = int(np.count_nonzero(here[dense[at[j] : at[j + 1]]]))
                if 100 * inter >= p.percent * (int(size[i]) + int(size[j]) - inter):
                    u.join(int(i), int(j))
            here[mine] = False
        return _stars(ids, u)

    return run


def _set_reader(p: Params):
    def run(batches):
        for t in sliced(batches):
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array([s.tobytes() for s in _sets(t.column("text"), p)], pa.binary())], ["id", "shingles"])

    return run


def _tiles(rows: DataFrame, group: str, side: int) -> DataFrame:
    """Each row (``id``, ``label``) once for every tile ``t1, t2`` of its group that it takes part in.

    Rows outside their group's commonest label ask, all are told: tile (i, j) sets the i-th block of
    those that ask against the j-th block of all. Groups of one label have no tile.
    """
    sizes = rows.groupBy(group, "label").agg(F.count("*").alias("k")).groupBy(group).agg(F.sum("k").alias("c"), F.max(F.struct("k", (-F.col("label")).alias("least"))).alias("most"))
    sizes = sizes.select(group, "c", F.col("most.k").alias("k"), (-F.col("most.least")).alias("major")).filter("c > k")
    blocks = lambda n: F.ceil(n / F.lit(side)).cast("int")
    own = rows.join(sizes, group).withColumn("asking", blocks(F.col("c") - F.col("k"))).withColumn("all", blocks(F.col("c")))
    own = own.withColumn("minor", F.col("label") != F.col("major")).withColumn("i", F.pmod(F.xxhash64("id", group), F.col("asking")).cast("int")).withColumn("j", F.pmod(F.xxhash64(group, "id"), F.col("all")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda t1, t2, asks, told: F.struct(t1.alias("t1"), t2.alias("t2"), asks.alias("asks"), told.alias("told"))
    told = F.transform(upto("asking"), lambda o: tile(o, F.col("j"), F.col("minor") & (o == F.col("i")), F.lit(True)))
    asks = F.transform(F.filter(upto("all"), lambda o: F.col("minor") & (o != F.col("j"))), lambda o: tile(F.col("i"), o, F.lit(True), F.lit(False)))
    return own.withColumn("tile", F.explode(F.concat(told, asks))).select(*rows.columns, "tile.*")


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    p = params or Params()
    docs = docs.select("doc_id", "text")
    signed = cut(docs.mapInArrow(lean_batches(_signer(p)), "doc_id long, n_shingles long, fp binary, bands array<long>, sketch binary"))
    held = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = held.groupBy("fp").agg(F.min("doc_id").alias("id"))
    # A repeated doc_id with different texts belongs to several classes: one node.
    member = held.select("doc_id", "fp").join(classes, "fp").select("doc_id", "id").distinct()
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("doc_id", "a")
    tied = member.join(several, "doc_id").select("a", F.col("id").alias("b"))

    reps = held.join(classes, (held.fp == classes.fp) & (held.doc_id == classes.id), "left_semi").dropDuplicates(["doc_id", "fp"])
    reps = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch")
    k = p.bands
    keys = F.flatten(F.transform(F.slice("bands", 1, k), lambda a: F.transform(F.slice("bands", k + 1, k), lambda b: F.xxhash64(a, b))))
    rows = reps.select("id", F.explode(keys).alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("m")).filter("c > 1")
    buckets = buckets.groupBy("c", "x", "m").agg(F.min("key").alias("key")).select("key", "c", F.col("m").alias("a"))
    members = cut_small(rows.join(buckets, "key"))
    sketches = reps.select("id", "n", "sketch")
    led = members.filter("a < id").select("a", "id").distinct().join(sketches.select("id", "sketch"), "id").join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    led = cut_small(led.select("a", "id", "sketch_a", "sketch").mapInArrow(_leader_estimates(p), "a long, b long"))
    labels = led.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
    labelled = members.filter("c > 2").select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    tiles = _tiles(labelled, "key", p.tile).join(sketches, "id").select("key", "t1", "t2", "asks", "told", "label", "n", "sketch")
    near = led.union(tiles.groupBy("key", "t1", "t2").applyInArrow(_tile_estimates(p), "a long, b long"))
    clusters = components(near)

    sized = clusters.join(clusters.groupBy("component").agg(F.count("*").alias("c")), "component")
    groups = F.ceil(F.col("c") / F.lit(p.verify_tile)).cast("int")
    # A few sets more than those of the clusters; the joins below leave them out. The texts are not dealt.
    wanted = cut(may_hold(docs.filter("doc_id IS NOT NULL"), "doc_id", clusters.select("id"))[0].mapInArrow(lean_batches(_set_reader(p)), "id long, shingles binary").filter("length(shingles) > 0"))
    # Large clusters: the least member goes to each group and is the one that asks there.
    leads = F.col("id") == F.col("component")
    own = F.when(leads, F.sequence(F.lit(0), groups - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), groups).cast("int")))
    led = sized.filter(F.col("c") > p.verify_tile).select("id", "component", F.col("id").alias("label"), leads.alias("asks"), (~leads).alias("told"), F.explode(own).alias("t1"))
    led = cut_small(led.join(wanted, "id").groupBy("component", "t1").applyInArrow(lean(_tile_links(p)), "a long, b long"))
    rest = clusters.join(led.select(F.col("b").alias("id"), F.col("a").alias("label")), "id", "left").select("component", "id", F.coalesce("label", "id").alias("label"))
    links = _tiles(rest, "component", p.verify_tile).join(wanted, "id").groupBy("component", "t1", "t2").applyInArrow(lean(_tile_links(p)), "a long, b long")
    final = components(led.union(links).union(tied))

    labelled = classes.join(final, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    lone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("fp")).alias("fp"))
    out = out.join(labelled, "fp", "left").select("doc_id", "n_shingles", F.coalesce(lone, F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of every group of near-duplicates the one of least doc_id.

    Rows without a ``doc_id`` stay. Where ids repeat, rows with different texts are different
    documents, of which those of a group go but the first by id and text; equal rows are one document.
    """
    total, different = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    held = docs.filter("doc_id IS NOT NULL")
    if total == different:
        gone = cut_small(near_duplicates(docs, params).filter("NOT kept").select("doc_id"))
        some, others = may_hold(held, "doc_id", gone)
        out = others.union(some.join(gone, some["doc_id"] == gone["doc_id"], "left_anti"))
    else:
        texts = cut(held.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).distinct().orderBy("_id", "_text").withColumn("_node", F.monotonically_increasing_id()))
        kept = near_duplicates(texts.select(F.col("_node").alias("doc_id"), F.col("_text").alias("text")), params).filter("kept").select(F.col("doc_id").alias("_node"))
        out = held.dropDuplicates(["doc_id", "text"]).join(texts.join(kept, "_node", "left_semi"), (F.col("doc_id") == F.col("_id")) & F.col("text").eqNullSafe(F.col("_text")), "left_semi")
    return out.union(docs.filter("doc_id IS NULL"))
