"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Queries and candidates are dealt into blocks; a task holds one block of either. Vectors are
quantised to int8 with a scale each; a tile of int8 products estimates the inner products, and with
x = x' + e and y = y' + f the error is at most |x'| |f| + |e| |y|. Candidates whose upper bound lies
below the k-th best lower bound cannot be among the k nearest of the block; the others are computed
again in double precision, in the order of the components. Heaps merge the blocks' lists. The
result is exact: nothing is sampled and no candidate is left out. A candidate travels once for each
block of queries, so n candidates and q queries move n * q / 4096 vectors: the price of the method.

Special cases are told in ``nearest``. Components so large that products overflow give infinite
scores; such candidates always survive their tile, and a score that is no number ranks last.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE_Q, SIDE_C = 4096, 8192


def usable(column: str = "embedding") -> Column:
    """True for vectors that take part: not null, no null or non-finite component, not all zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


class _Side:
    def __init__(self, t: pa.Table, rows: np.ndarray):
        self.ids = t.column("vec_id").to_numpy()[rows]
        flat = t.column("v").combine_chunks()
        dim = t.column("dim")[0].as_py()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        self.x = values[rows].astype(np.float64)
        scale = np.maximum(np.abs(self.x).max(1) / 127, np.nextafter(0, 1))  # of tiny values the share can be 0
        q = np.rint(self.x / scale[:, None]).astype(np.int8)
        back = q * scale[:, None]
        self.scale = scale
        # float32 holds sums of int8 products exactly up to 2**24.
        self.q = q.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)
        self.near = np.sqrt((back * back).sum(1))
        self.off = np.sqrt(((self.x - back) ** 2).sum(1))
        self.norm = np.sqrt((self.x**2).sum(1))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * y[:, d]
    return s


def _lists(t: pa.Table, k: int) -> pa.Table:
    is_query = t.column("query").to_numpy()
    q, c = _Side(t, np.flatnonzero(is_query)), _Side(t, np.flatnonzero(~is_query))
    ids, found, scores = [], [], []
    for a in range(0, len(q.ids) if len(c.ids) else 0, 256):
        b = slice(a, a + 256)
        est = (q.q[b] @ c.q.T) * (q.scale[b, None] * c.scale[None, :])
        # A little more than the bound, for the rounding of the bound itself.
        err = (q.near[b, None] * c.off[None, :] + q.off[b, None] * c.norm[None, :]) * (1 + 1e-9) + 1e-12 * (q.norm[b, None] * c.norm[None, :]) + 1e-300
        own = q.ids[b, None] == c.ids[None, :]
        low = np.where(own, -np.inf, est - err)
        n = low.shape[1]
        low[np.isnan(low)] = -np.inf
        bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
        qi, ci = np.nonzero(~(est + err < bar[:, None]) & ~own)
        s = _exact(q.x[b][qi], c.x[ci])
        order = np.lexsort((c.ids[ci], -s, qi))  # what is no number sorts last, by id
        qi, ci, s = qi[order], ci[order], s[order]
        start = np.searchsorted(qi, np.arange(len(low) + 1))
        for i in range(len(low)):
            top = slice(start[i], min(start[i] + k, start[i + 1]))
            if top.stop > top.start:
                ids.append(q.ids[a + i])
                found.append(c.ids[ci[top]].tobytes())
                scores.append(s[top].tobytes())
    return pa.table({"query_id": pa.array(ids, pa.int64()), "ids": pa.array(found, pa.binary()), "scores": pa.array(scores, pa.binary())})


def _tile(k: int):
    def run(t: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", invalid="ignore"):
            return _lists(t, k)

    return run


def _merge(k: int):
    def run(t: pa.Table) -> pa.Table:
        lists: dict[int, list] = {}
        for q, i, s in zip(t.column("query_id").to_pylist(), t.column("ids").to_pylist(), t.column("scores").to_pylist(), strict=True):
            own = np.frombuffer(s, np.float64)
            lists.setdefault(q, []).append(list(zip(np.isnan(own).tolist(), np.where(np.isnan(own), 0.0, -own).tolist(), np.frombuffer(i, np.int64).tolist(), own.tolist(), strict=True)))
        out: list[tuple] = []
        for q, parts in lists.items():
            for rank, (_, _, i, s) in enumerate(heapq.merge(*parts, key=lambda x: x[:3]), 1):
                if rank > k:
                    break
                out.append((q, rank, i, s))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(list(c), kind) for n, c, kind in zip(("query_id", "rank", "vec_id", "score"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)})

    return run


def nearest(vectors: DataFrame, k: int = 20, is_query: Column | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest rows by inner product.

    Queries are the rows ``is_query`` marks (default: ids divisible by 20); a query's own id is no
    candidate. Ties go to the smaller id. Unusable vectors and rows without an id take no part;
    vectors of different lengths are not compared. Rows that repeat an id count once, by their
    least vector.
    """
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable()).groupBy("vec_id").agg(F.min("embedding").alias("v"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    n, n_q = rows.agg(F.count("*"), F.count_if("asks")).first()
    c_blocks, q_blocks = max(6, -(-n // SIDE_C)), max(1, -(-n_q // SIDE_Q))
    h = F.xxhash64("vec_id")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cand = rows.withColumn("cb", F.pmod(h, F.lit(c_blocks)).cast("int")).withColumn("qb", spread(q_blocks)).withColumn("query", F.lit(False))
    ask = rows.filter("asks").withColumn("qb", F.pmod(h, F.lit(q_blocks)).cast("int")).withColumn("cb", spread(c_blocks)).withColumn("query", F.lit(True))
    tiles = cand.unionByName(ask).select("vec_id", "v", "dim", "qb", "cb", "query")
    lists = tiles.groupBy("dim", "qb", "cb").applyInArrow(_tile(k), "query_id long, ids binary, scores binary")
    merged = lists.withColumn("m", F.pmod(F.xxhash64("query_id"), F.lit(max(48, n_q // 1024))))
    return merged.groupBy("m").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
