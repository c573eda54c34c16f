"""Temperature mixing of sources, with DataFrame operations only.

Shares p_s are token shares. Weights are p_s**a normalised; the exponent a in [0, 1] is bisected: as
flat as the target entropy (a share of ln S) asks for, but no flatter than the repetition limit
allows (no source more than ``max_repeats`` times over within the budget). A source's budget is its
weight times the token budget. It is filled by whole and partial epochs; in each epoch the source's
blocks (hash buckets of about ``block_tokens`` tokens) come in a pseudo-random order, and the
documents of a block likewise. Blocks bound what a task sorts, so a hot source needs no task of
its own; one row per block is summed for the offsets.

Tokens are runs without x20 and x09-x0D. Null text counts as empty; a null source is the source
''; a null ``doc_id`` hashes like the empty text. Sources without tokens have no weight: their
documents come once if ``whole`` is set, else not at all. Repeated rows are separate documents. Ties in
the order are broken by block, id and length. A text of any length is one document of its block; the
tables that are sorted hold counts, never texts. An empty table has no rows. Further columns are
ignored by ``mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, ROUNDS = 4, 10
#: Bits of a block's place that are summed apart, so that no task sorts all blocks of a source.
STRATUM_SHIFT = 50
#: Tables of up to so many sources are broadcast; larger ones meet the documents in a shuffled join.
FEW_SOURCES = 10_000


def token_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def _bisect(low: float, high: float, holds, want_high: bool) -> float:
    """The end of [low, high] side where ``holds`` turns, by LEVELS halvings per job.

    want_high: the largest exponent that holds (it holds at low); else the smallest (at high).
    """
    for _ in range(ROUNDS):
        n = 1 << LEVELS
        mids = [low + (high - low) * i / n for i in range(1, n)]
        said = holds(mids)
        a, b = 0, n
        while b - a > 1:
            m = (a + b) // 2
            if said[m - 1] == want_high:
                a = m
            else:
                b = m
        low, high = low + (high - low) * a / n, low + (high - low) * b / n
    return low if want_high else high


def mixture(sources: DataFrame, entropy_share: float, max_repeats: float, whole: bool = False) -> tuple[float, DataFrame]:
    """The exponent, and ``(source, tokens, weight, budget)`` for a table ``(source, tokens)``.

    The table of weights is marked for broadcast if it was counted to hold few sources.
    """
    held = sources.filter("tokens > 0")
    total, count = held.agg(F.sum("tokens"), F.count("*")).first()
    if not count:
        return 1.0, sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.col("tokens").alias("budget"))
    lp = F.log(F.col("tokens") / F.lit(float(total)))

    def entropy_holds(exponents: list[float]) -> list[bool]:
        z = held.agg(*[x for a in exponents for x in (F.sum(F.exp(lp * a)), F.sum(F.exp(lp * a) * lp))]).first()
        return [math.log(z[2 * i]) - a * z[2 * i + 1] / z[2 * i] >= entropy_share * math.log(count) - 1e-12 for i, a in enumerate(exponents)]

    def repeats_hold(exponents: list[float]) -> list[bool]:
        z = held.agg(*[x for a in exponents for x in (F.sum(F.exp(lp * a)), F.max(F.exp(lp * (a - 1))), F.max(F.exp(lp * (1 - a))))]).first()
        return [z[3 * i + 1] * (z[3 * i + 2] if whole else 1 / z[3 * i]) <= max_repeats + 1e-12 for i, a in enumerate(exponents)]

    by_entropy = 1.0 if entropy_holds([1.0])[0] else _bisect(0.0, 1.0, entropy_holds, True)
    by_repeats = 0.0 if repeats_hold([0.0])[0] else _bisect(0.0, 1.0, repeats_hold, False)
    a = round(max(by_entropy, by_repeats), 6)
    z, least = held.agg(F.sum(F.exp(lp * a)), F.max(F.exp(lp * (1 - a)))).first()
    budget = total * (z * least if whole else 1.0)
    weight = F.when(F.col("tokens") > 0, F.exp(lp * a) / F.lit(z)).otherwise(F.lit(0.0))
    filled = F.floor(weight * F.lit(float(budget)) + 0.5).cast("long")
    out = sources.select("source", "tokens", weight.alias("weight"), (F.greatest(filled, F.col("tokens")) if whole else filled).alias("budget"))
    return a, F.broadcast(out) if sources.count() <= FEW_SOURCES else out


def mix(docs: DataFrame, entropy_share: float = 0.97, max_repeats: float = 4.0, block_tokens: int = 1 << 16, seed: int = 17, whole: bool = False) -> DataFrame:
    """One row per copy taken: ``doc_id, source, n_tokens, epoch, block, start, weight``.

    ``start`` is the copy's token offset in its source's stream; reading all sources by
    ``start / budget`` interleaves them at the target weights. A copy is taken if it starts inside
    the budget, so the last one may reach over its end. ``whole`` raises the token budget until every
    source is read once at least.
    """
    sized = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), token_count().alias("n_tokens"))
    sized = cut(sized)
    sources = cut(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))  # read by every job of the bisection
    _, weights = mixture(sources, entropy_share, max_repeats, whole)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long")
    last = F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens")) - 1).otherwise(F.lit(0) if whole else F.lit(-1)).cast("int")
    weights = weights.withColumn("blocks", blocks).withColumn("last", last).filter("last >= 0")
    copies = sized.join(weights, "source").withColumn("block", F.pmod(_hash(F.lit(seed), F.col("doc_id")), F.col("blocks"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    group = ["source", "epoch", "block"]
    per_block = copies.groupBy(*group).agg(F.sum("n_tokens").alias("held")).withColumn("place", _hash(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block")))
    # Blocks in the order of their places, in two levels: sums of strata of places, and sums inside each.
    stratum = ["source", "epoch", "stratum"]
    per_block = per_block.withColumn("stratum", F.shiftright("place", STRATUM_SHIFT))
    before = Window.partitionBy("source", "epoch").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = per_block.groupBy(*stratum).agg(F.sum("held").alias("held")).select(*stratum, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*stratum).orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(*stratum, "block", F.coalesce(F.sum("held").over(inside), F.lit(0)).alias("above")).join(strata, stratum).select(*group, (F.col("below") + F.col("above")).alias("base"))
    in_block = Window.partitionBy(*group).orderBy(_hash(F.lit(seed), F.col("epoch"), F.col("doc_id")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))).join(per_block, group)
    start = F.col("epoch").cast("long") * F.col("tokens") + F.col("base") + F.col("inside")
    taken = placed.withColumn("start", start).filter((F.col("start") < F.col("budget")) | ((F.col("epoch").cast("long") + 1) * F.col("tokens") <= F.col("budget")))
    return taken.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", "start", F.round("weight", 9).alias("weight"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents themselves, each as often as it is taken; every source at least once over.

    Rows that repeat doc_id, source and length share their copies evenly, rounded up.
    """
    taken = mix(docs, whole=True, **params)
    times = taken.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("k"), F.count_if(F.col("epoch") == 0).alias("c"))
    times = times.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("n_tokens").alias("_n"), F.ceil(F.col("k") / F.col("c")).cast("int").alias("_times"))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), token_count().alias("_tokens"), F.coalesce("source", F.lit("")).alias("_source"))
    joined = sized.join(times, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_source") == F.col("_s")) & (F.col("_tokens") == F.col("_n")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("row.*")


def oracle(entropy_share: float = 0.97, max_repeats: float = 4.0, block_tokens: int = 1 << 16, seed: int = 17) -> str:
    """The same in DuckDB SQL over a view ``documents``."""
    def h(*parts: str) -> str:
        return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + ")), 1, 15) AS BIGINT)"

    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, count(*) AS cnt FROM src),
lps AS (SELECT source, tokens, ln(tokens / total) AS lp, cnt, total FROM src, tot),
ent AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT step, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(exp(lp * ((e.lo + e.hi) / 2)))) - ((e.lo + e.hi) / 2) * sum(exp(lp * ((e.lo + e.hi) / 2)) * lp) / sum(exp(lp * ((e.lo + e.hi) / 2))) >= {entropy_share} * ln(any_value(cnt)) - 1e-12 FROM lps) AS ok
    FROM ent e WHERE step < 40)),
rep AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT step, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT max(exp(lp * ((r.lo + r.hi) / 2 - 1))) / sum(exp(lp * ((r.lo + r.hi) / 2))) <= {max_repeats} + 1e-12 FROM lps) AS ok
    FROM rep r WHERE step < 40)),
expo AS (SELECT round(greatest(
  CASE WHEN (SELECT -sum(exp(lp) * lp) >= {entropy_share} * ln(any_value(cnt)) - 1e-12 FROM lps) THEN 1.0 ELSE (SELECT lo FROM ent WHERE step = 40) END,
  CASE WHEN (SELECT max(exp(-lp)) / count(*) <= {max_repeats} + 1e-12 FROM lps) THEN 0.0 ELSE (SELECT hi FROM rep WHERE step = 40) END), 6) AS a),
z AS (SELECT sum(exp(lp * a)) AS z FROM lps, expo),
w AS (SELECT source, tokens, exp(lp * a) / z AS weight, CAST(floor(exp(lp * a) / z * total + 0.5) AS BIGINT) AS budget FROM lps, expo, z),
w2 AS (SELECT *, CAST(greatest(1, ceil(tokens / {block_tokens})) AS BIGINT) AS blocks, CAST(ceil(budget / tokens) - 1 AS BIGINT) AS last FROM w),
copies AS (SELECT s.*, w2.tokens, w2.weight, w2.budget, {h(str(seed), 's.doc_id')} % blocks AS block, unnest(generate_series(0, last)) AS epoch FROM sized s JOIN w2 ON s.source = w2.source WHERE last >= 0),
per_block AS (SELECT source, epoch, block, sum(n_tokens) AS held FROM copies GROUP BY ALL),
based AS (SELECT source, epoch, block, coalesce(sum(held) OVER (PARTITION BY source, epoch ORDER BY {h(str(seed), 'epoch', 'source', 'block')}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM per_block),
inside AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY {h(str(seed), 'epoch', 'doc_id')}, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM copies),
placed AS (SELECT i.*, CAST(i.epoch * i.tokens + b.base + i.before AS BIGINT) AS start FROM inside i JOIN based b ON i.source = b.source AND i.epoch = b.epoch AND i.block = b.block)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, block, start, round(weight, 9) AS weight FROM placed
WHERE start < budget OR (epoch + 1) * tokens <= budget"""
