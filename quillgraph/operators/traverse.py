"""Bounded traversal, overview and shortest paths by frontier loops.

One level is one job: the frontier meets the links in an equi-join, known nodes leave by an anti
join, and the new frontier is checkpointed so plans stay short and a lost executor costs a level.
Links are read where they lie: a small frontier is sent to them, of a large one a bitmap, so that
only links which may leave the frontier are ever shuffled.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..vocab import BEHAVIOURAL, OVERVIEW_TYPES, PROJECTIONS, bounded


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialises in ``spark.checkpoint.dir``, and where it is unset in a folder of the warehouse."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{warehouse}/checkpoints")
    return df.checkpoint(eager=True)


#: Ids up to this number are sent whole to the rows they meet; of more, a bitmap of at most 2**25 bits is.
SENT, BITS = 100_000, 25


def meeting(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """The ``rows`` whose ``column`` is among the one column of ``ids``, some ``n`` of them. Exact: the bitmap only spares rows the join that follows."""
    one = ids.toDF(column)
    if n <= SENT:
        return rows.join(F.broadcast(one), column, "left_semi")
    return sieved(rows, column, ids, n).join(one, column, "left_semi")


def sieved(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``ids``; none that is goes. Nothing is shuffled but a bitmap, some 16 bits an id."""
    bits = 1 << min(BITS, max(10, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = ids.toDF("id").select(place(F.col("id")).alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    words = F.broadcast(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    at = place(rows[column])
    found = (F.shiftright(at, 6) == words["word"]) & (F.call_function("shiftright", words["bits"], at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return rows.join(words, found, "left_semi")


@dataclass(frozen=True)
class GraphResult:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def _start(spark: SparkSession, g: Graph, root: str) -> DataFrame:
    return checkpointed(g.nodes.filter(F.col("id") == root).select("id", F.lit(0).alias("depth")))


def reach(g: Graph, root: str, depth: int, node_types: tuple[str, ...] | None = None, relationships: tuple[str, ...] | None = None, direction: str = "both") -> DataFrame:
    """``(id, depth)`` of all nodes within ``depth`` steps; filters hold on the way, the root is exempt from types."""
    adj = g.steps(direction, relationships).select("src", "dst")
    allowed = None if node_types is None else g.nodes.filter(F.col("node_type").isin(*node_types)).select(F.col("id").alias("dst"))
    seen = frontier = _start(g.nodes.sparkSession, g, root)
    n = frontier.count()
    for d in range(1, depth + 1):
        if not n:
            break
        step = meeting(adj, "src", frontier.select("id"), n).select("dst").distinct()
        if allowed is not None:
            step = step.join(allowed, "dst", "left_semi")
        frontier = checkpointed(step.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id"), F.lit(d).alias("depth")))
        n, seen = frontier.count(), seen.union(frontier)
    return seen


def induced(g: Graph, ids: DataFrame, relationships: tuple[str, ...] | None = None, n: int | None = None) -> DataFrame:
    """Edges with both ends among the ids, ``n`` of them where that is known."""
    e = g.edges if relationships is None else g.edges.filter(F.col("relationship").isin(*relationships))
    a, b = ids.select(F.col("id").alias("source")), ids.select(F.col("id").alias("target"))
    if n is None:
        return e.join(a, "source", "left_semi").join(b, "target", "left_semi").select(*g.edges.columns)
    if n > SENT:
        e = sieved(sieved(e, "source", a, n), "target", b, n)
    return meeting(meeting(e, "source", a, n), "target", b, n).select(*g.edges.columns)


def traverse(g: Graph, root: str, depth: int | None = None, node_types: tuple[str, ...] | None = None, relationships: tuple[str, ...] | None = None, direction: str = "both", limit: int | None = None) -> GraphResult:
    """The nearest ``limit`` nodes by (depth, id) and the edges among them."""
    limit = bounded("limit", limit)
    seen = reach(g, root, bounded("depth", depth), node_types, relationships, direction)
    top = checkpointed(seen.orderBy("depth", "id").limit(limit + 1))
    n = top.count()
    truncated = n > limit
    top = top.orderBy("depth", "id").limit(limit)
    return GraphResult(g.nodes.join(F.broadcast(top), "id").select(*g.nodes.columns, "depth"), induced(g, top, relationships, n), truncated)


def degrees(g: Graph, relationships: tuple[str, ...] | None) -> DataFrame:
    """Edges at each node, both ends counted."""
    return g.ends(relationships).groupBy("id").agg(F.sum("n").alias("degree"))


def overview(g: Graph, node_types: tuple[str, ...] | None = OVERVIEW_TYPES, relationships: tuple[str, ...] | None = BEHAVIOURAL, priority: tuple[str, ...] = (), limit: int | None = None) -> GraphResult:
    """The nodes of highest degree, priority types first; nodes without a qualifying edge never appear."""
    limit = bounded("limit", limit)
    n = g.nodes if node_types is None else g.nodes.filter(F.col("node_type").isin(*node_types))
    first = [F.col("node_type").isin(*priority).desc()] if priority else []
    order = [*first, F.desc("degree"), "name", "id"]
    top = checkpointed(n.select("id", "node_type", "name").join(degrees(g, relationships), "id").orderBy(*order).limit(limit + 1))
    size = top.count()
    top = top.orderBy(*order).limit(limit)
    best = F.broadcast(top.select(F.col("id").alias("_id"), F.col("name").alias("_name"), "degree").distinct())
    ranked = n.join(best, (F.col("id") == F.col("_id")) & F.col("name").eqNullSafe(F.col("_name"))).drop("_id", "_name").orderBy(*order)
    return GraphResult(ranked, induced(g, top, relationships, size), size > limit)


def query(g: Graph, projection: str = "architecture", root: str | None = None, node_types: tuple[str, ...] | None = None, relationships: tuple[str, ...] | None = None, **more) -> GraphResult:
    """A traversal from ``root``, or an overview; explicit filters beat the projection's, empty ones mean none."""
    types, rels, priority = PROJECTIONS[projection]
    types, rels = node_types or types, relationships or rels
    if root is not None:
        return traverse(g, root, node_types=types, relationships=rels, **more)
    return overview(g, types, rels, priority, **more)


@dataclass(frozen=True)
class PathResult:
    found: bool
    truncated: bool
    undirected: bool
    nodes: list[str]
    edges: list[str]


def find_path(g: Graph, source: str, target: str, max_depth: int | None = None, directed: bool = True, relationships: tuple[str, ...] | None = None, node_types: tuple[str, ...] | None = None, budget: int = 20000) -> PathResult:
    """A shortest path, level by level.

    A node's way in is the first candidate by (reversed, relationship, source, target, edge). New
    nodes join in id order while the budget lasts. The type filter holds for all but ``source``.
    Levels stay distributed; only the nodes of the path itself come to the driver. A level is sorted
    only where the budget cuts it, and the last one is not made where the target is met within it.
    """
    if not g.nodes.filter(F.col("id").isin(source, target)).agg(F.count_distinct("id")).first()[0] == (1 if source == target else 2):
        return PathResult(False, False, not directed, [], [])
    if source == target:
        return PathResult(True, False, not directed, [source], [])
    adj = g.steps("out" if directed else "both", relationships)
    allowed = None if node_types is None else g.nodes.filter(F.col("node_type").isin(*node_types)).select(F.col("id").alias("dst"))
    open_to = allowed is None or g.nodes.filter((F.col("id") == target) & F.col("node_type").isin(*node_types)).limit(1).count() > 0
    levels = [_start(g.nodes.sparkSession, g, source)]
    seen, size, n, truncated = levels[0].select("id"), 1, 1, False
    for _ in range(bounded("path_depth", max_depth)):
        near = meeting(adj, "src", levels[-1].select("id"), n)
        # A node's candidates share one end, so the order by source and target is that by ``src``.
        last = near.filter(F.col("dst") == target).agg(F.min(F.struct("reversed", "relationship", "src")).alias("way")).first()["way"] if open_to else None
        step = near.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        if allowed is not None:
            step = step.join(allowed, "dst", "left_semi")
        if last is not None and size + step.count() <= budget:
            return _walked(g, levels, target, last, directed)
        step = step.groupBy("dst").agg(F.min(F.struct("reversed", "relationship", "src")).alias("way"))
        step = checkpointed(step.select(F.col("dst").alias("id"), "way"))
        n = step.count()
        if not n:
            break
        if size + n > budget:
            truncated, n = True, budget - size
            step = checkpointed(step.orderBy("id").limit(n))
        if last is not None and step.filter(F.col("id") == target).limit(1).count():
            return _walked(g, levels, target, last, directed)
        if truncated:
            break
        levels.append(step)
        seen, size = seen.union(step.select("id")), size + n
    return PathResult(False, truncated, not directed, [], [])


def _walked(g: Graph, levels: list[DataFrame], target: str, last: Row, directed: bool) -> PathResult:
    """The path that ends with the way ``last`` into ``target``; a step's edge is the least of those that are alike."""
    nodes, ways = [target], [last]
    for level in reversed(levels[1:]):
        nodes.append(ways[-1]["src"])
        ways.append(level.filter(F.col("id") == nodes[-1]).first()["way"])
    nodes.append(ways[-1]["src"])
    steps = [(w["src"], w["relationship"], at) if not w["reversed"] else (at, w["relationship"], w["src"]) for at, w in zip(nodes, ways, strict=False)]
    alike = functools.reduce(lambda a, b: a | b, [(F.col("source") == a) & (F.col("relationship") == r) & (F.col("target") == b) for a, r, b in steps])
    ids = {(e["source"], e["relationship"], e["target"]): e["edge"] for e in g.edges.filter(alike).groupBy("source", "relationship", "target").agg(F.min("id").alias("edge")).collect()}
    return PathResult(True, False, not directed, nodes[::-1], [ids[s] for s in steps][::-1])


def trace(g: Graph, source: str, target: str, direction: str = "outgoing", **more) -> PathResult:
    """A directed path; where none is found, an undirected one, which then says so."""
    if direction == "both":
        found = find_path(g, source, target, directed=False, **more)
        return PathResult(found.found, found.truncated, found.found, found.nodes, found.edges)
    one = find_path(g, source, target, directed=True, **more)
    if one.found:
        return one
    two = find_path(g, source, target, directed=False, **more)
    return two if two.found else PathResult(False, one.truncated or two.truncated, False, [], [])


def verdict(p: PathResult) -> str:
    """found, none, or inconclusive where the search was cut short."""
    return "found" if p.found else "inconclusive" if p.truncated else "none"


def path_rows(g: Graph, p: PathResult) -> DataFrame:
    """The path's edges in walk order, with direction and evidence."""
    spark = g.nodes.sparkSession
    steps = spark.createDataFrame([(i, a, b, e) for i, (a, b, e) in enumerate(zip(p.nodes, p.nodes[1:], p.edges, strict=False))], "step int, from_id string, to_id string, edge string")
    return F.broadcast(steps).join(g.edges.filter(F.col("id").isin(*p.edges)), F.col("edge") == F.col("id")).select("step", "from_id", "to_id", "relationship", (F.col("source") != F.col("from_id")).alias("reversed"), "confidence", "occurrences")


def ancestors(g: Graph, node_id: str, limit: int = 32) -> DataFrame:
    """The chain of containers, nearest first; stops at a node met before."""
    up = g.edges.filter(F.col("relationship") == "CONTAINS").groupBy(F.col("target").alias("child")).agg(F.min("source").alias("holder"))
    chain, at = [], node_id
    for _ in range(limit):
        r = up.filter(F.col("child") == at).first()
        if r is None or r["holder"] in chain or r["holder"] == node_id:
            break
        at = r["holder"]
        chain.append(at)
    spark = g.nodes.sparkSession
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(chain)], "distance int, id string").join(g.nodes, "id").select("distance", "id", "node_type", "name")


def nearest_holder(g: Graph, wanted: tuple[str, ...] = ("class", "interface"), stop: tuple[str, ...] = ("file", "repository"), most: int = 32) -> DataFrame:
    """For every node, the nearest container of a wanted type; the chain ends at the stop types."""
    up = g.edges.filter(F.col("relationship") == "CONTAINS").groupBy(F.col("target").alias("at")).agg(F.min("source").alias("next"))
    kinds = g.nodes.select(F.col("id").alias("next"), F.col("node_type").alias("kind"))
    found = []
    open_ = g.nodes.select("id", F.col("id").alias("at"))
    for _ in range(most):
        step = checkpointed(open_.join(up, "at").join(kinds, "next").select("id", F.col("next").alias("at"), "kind"))
        found.append(step.filter(F.col("kind").isin(*wanted)).select("id", F.col("at").alias("holder")))
        open_ = step.filter(~F.col("kind").isin(*wanted, *stop)).select("id", "at")
        if not open_.limit(1).count():
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out
