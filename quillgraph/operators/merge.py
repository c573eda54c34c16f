"""Deterministic merging of node and edge drafts.

Drafts carry ``seq``, the total order of emission (stage, analyzer, position). Every rule is an
aggregate keyed by id, so Spark combines on the map side and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..vocab import CONFIDENCE_RANK
from .traverse import meeting

EVIDENCE = ("source", "confidence", "method", "file", "line", "matched")


def merge_nodes(drafts: DataFrame) -> DataFrame:
    """First writer wins, by id."""
    rest = [c for c in drafts.columns if c not in ("id", "seq")]
    return drafts.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("_w")).select("id", *[F.col(f"_w.{c}").alias(c) for c in rest])


def enrich(nodes: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Adds metadata keys to ``nodes.metadata`` (a map): a node's own keys win, then the earliest enrichment.

    ``enrichments``: id, key, value, seq. Enrichments of absent nodes are ignored.
    """
    first = enrichments.groupBy("id", "key").agg(F.min_by("value", "seq").alias("value"))
    extra = first.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_more"))
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    added = F.map_filter("_more", lambda k, v: ~F.map_contains_key(own, k))
    return nodes.join(extra, "id", "left").withColumn("metadata", F.when(F.col("_more").isNull(), F.col("metadata")).otherwise(F.map_concat(own, added))).drop("_more")


def _rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in CONFIDENCE_RANK.items()], F.lit(-1))


def merge_edges(drafts: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """One edge per id: occurrences add up, the first writer's ``extra`` stays, evidence is the strongest's.

    Evidence is replaced only by strictly higher confidence; a field that the stronger evidence lacks
    keeps the value before it. So each field is that of the strongest, else of the next draft down
    among those that raised the confidence, else of the first. Columns: id, source_node, relationship,
    target_node, seq, occurrences, extra, and the evidence fields. ``key`` names columns that stand for
    the id, where drafts already lie by them; drafts are dealt by it once, and all grouping is where they lie.
    """
    d = drafts.withColumn("_rank", _rank(F.col("confidence")))
    if key == ("id",):
        d = d.repartition("id")
    # The first draft of each rank, with the first writer's part and the sum, which hold for the whole id once they meet.
    firsts = d.groupBy(*key, "_rank").agg(F.min_by(F.struct("seq", *EVIDENCE, "id", "source_node", "relationship", "target_node", "extra"), "seq").alias("e"), F.sum("occurrences").alias("o"))
    held = F.array_sort(F.collect_list(F.struct(F.col("e.seq").alias("seq"), F.col("_rank").alias("rank"), F.col("o"), F.col("e").alias("e"))))
    chain = firsts.groupBy(*key).agg(held.alias("h"))  # at most one entry per confidence level
    raised = F.filter("h", lambda x, i: ~F.exists(F.slice("h", 1, i), lambda y: y["rank"] >= x["rank"]))
    chain = chain.withColumn("r", F.reverse(raised)).withColumn("w", F.col("h")[0]["e"])
    fields = [F.get(F.filter(F.col(f"r.e.{f}"), lambda v: v.isNotNull()), F.lit(0)).alias(f) for f in EVIDENCE]
    total = F.aggregate("h", F.lit(None).cast(firsts.schema["o"].dataType), lambda acc, x: F.coalesce(acc + x["o"], acc, x["o"])).alias("occurrences")
    return chain.select("w.id", "w.source_node", "w.relationship", "w.target_node", total, *fields, "w.extra", "w.seq").filter("id IS NOT NULL")


def valid_endpoints(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are other nodes known by then (``seq`` not later), and the count of the rest."""
    at = nodes.groupBy("id").agg(F.min("seq").alias("s"))
    a, b = (at.select(F.col("id").alias(f"{x}_node"), F.col("s").alias(f"_{x}")) for x in ("source", "target"))
    kept = edges.join(a, "source_node").join(b, "target_node").filter((F.col("_source") <= F.col("seq")) & (F.col("_target") <= F.col("seq")) & (F.col("source_node") != F.col("target_node"))).select(*edges.columns)
    dropped = edges.agg(F.count("*").alias("all")).join(kept.agg(F.count("*").alias("kept")), F.lit(True)).select((F.col("all") - F.col("kept")).alias("dropped"))
    return kept, dropped


def derive_container_edges(edges: DataFrame, holders: DataFrame, extra: str = "derived") -> DataFrame:
    """Edges lifted from members to their holders, unless the holder has the edge already.

    ``holders``: id, holder. An edge inside one holder is not lifted.
    """
    lifted = edges.join(holders.withColumnRenamed("id", "source_node"), "source_node").filter(F.col("holder") != F.col("target_node")).drop("source_node").withColumnRenamed("holder", "source_node")
    lifted = lifted.groupBy("source_node", "relationship", "target_node").agg(F.sum("occurrences").alias("occurrences"))
    # Only an edge of a holder can be one that is lifted; where holders hold none, nothing of the edges is left to compare.
    own = holders.select(F.col("holder").alias("source_node")).distinct()
    have = meeting(edges.select("source_node", "relationship", "target_node"), "source_node", own, own.count())
    return lifted.join(have, ["source_node", "relationship", "target_node"], "left_anti").withColumn("extra", F.lit(extra))


def merge_slices(a: Graph, b: Graph) -> tuple[Graph, DataFrame]:
    """The union of two slices, first one winning, without dangling edges; and how many nodes are new."""
    nodes = merge_nodes(a.nodes.withColumn("seq", F.lit(0)).unionByName(b.nodes.withColumn("seq", F.lit(1))))
    edges = merge_nodes(a.edges.withColumn("seq", F.lit(0)).unionByName(b.edges.withColumn("seq", F.lit(1))))
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*a.edges.columns)
    new = b.nodes.join(a.nodes.select("id"), "id", "left_anti").agg(F.count_distinct("id").alias("new_nodes"))
    return Graph(nodes.select(*a.nodes.columns), edges), new


def run_counters(results: DataFrame) -> DataFrame:
    """Counters of analyzer runs: ``<analyzer>.<name>`` summed; documents and symbols by maximum.

    ``results``: analyzer, name, value.
    """
    key = F.when(F.col("name").isin("documentCount", "symbolCount"), F.col("name")).otherwise(F.concat_ws(".", "analyzer", "name"))
    value = F.when(F.first("name").isin("documentCount", "symbolCount"), F.max("value")).otherwise(F.sum("value"))
    return results.groupBy(key.alias("counter")).agg(value.alias("value"))
