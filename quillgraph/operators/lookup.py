"""Point lookups, ranked search, one-hop sections, the tree and composition counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..vocab import DEPENDENCY, FILE_LIKE, SECTIONS, TREE_TYPES, bounded, types_of


def find_node(g: Graph, node_id: str) -> DataFrame:
    return g.nodes.filter(F.col("id") == node_id)


def find_root(g: Graph, node_type: str = "repository") -> DataFrame:
    """The node of this type with the least id."""
    return g.nodes.filter(F.col("node_type") == node_type).orderBy("id").limit(1)


def find_file(g: Graph, path: str) -> DataFrame:
    """The file-like node of a path, by the declared order of the types, then by id."""
    order = F.array_position(F.array(*[F.lit(t) for t in FILE_LIKE]), F.col("node_type"))
    return g.nodes.filter((F.col("file_path") == path) & F.col("node_type").isin(*FILE_LIKE)).orderBy(order, "id").limit(1)


def definition(g: Graph, node_id: str) -> DataFrame:
    """A node's coordinates and the id of its file's node, null where there is none."""
    order = F.array_position(F.array(*[F.lit(t) for t in FILE_LIKE]), F.col("node_type"))
    files = g.nodes.filter(F.col("node_type").isin(*FILE_LIKE) & F.col("file_path").isNotNull()).groupBy(F.col("file_path").alias("_path")).agg(F.min(F.struct(order.alias("o"), "id")).alias("f"))
    return find_node(g, node_id).join(files, F.col("file_path") == F.col("_path"), "left").select("id", "file_path", "start_line", F.col("f.id").alias("file_node_id"))


def _like_pattern(term: str) -> str:
    return term.lower().replace("\\", "\\\\")


def search_predicate(term: str, literal: bool = False) -> Column:
    """Substring of name, qualified name or path, without case, or the name of a node type.

    % and _ in the term are wildcards unless ``literal``.
    """
    t = term.lower()
    fits = (lambda c: F.lower(c).contains(t)) if literal else (lambda c: F.lower(c).like(f"%{_like_pattern(term)}%"))
    return F.coalesce(fits("name"), F.lit(False)) | F.coalesce(fits("qualified_name"), F.lit(False)) | F.coalesce(fits("file_path"), F.lit(False)) | (F.col("node_type") == t)


def search_rank(term: str) -> Column:
    """0 exact name, 1 exact qualified name, 2 path or file name, 3-5 prefixes of the three, 6 last dotted part, 7 other."""
    t = term.lower()
    name, full, path = F.lower("name"), F.lower("qualified_name"), F.lower("file_path")
    return (
        F.when(name == t, 0).when(full == t, 1).when((path == t) | path.endswith(f"/{t}"), 2).when(name.startswith(t), 3)
        .when(full.startswith(t), 4).when(path.startswith(t), 5).when(F.element_at(F.split(full, r"\."), -1) == t, 6).otherwise(7)
    )


def search(g: Graph, term: str, node_types: tuple[str, ...] | None = None, categories: tuple[str, ...] | None = None, file_prefix: str | None = None, limit: int | None = None, offset: int = 0, literal: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of ranked hits and the one-row exact total."""
    if not term or len(term) > 200:
        raise ValueError("a search term has 1 to 200 characters")
    wanted = types_of(categories, node_types)
    found = g.nodes.filter(search_predicate(term, literal))
    if wanted is not None:
        found = found.filter(F.col("node_type").isin(*wanted)) if wanted else found.limit(0)
    if file_prefix:
        found = found.filter(F.lower("file_path").startswith(file_prefix.strip("/").lower()))
    ranked = found.withColumn("rank", search_rank(term).cast("int"))
    page = ranked.orderBy("rank", F.length("name"), "name", "id").offset(offset).limit(bounded("search", limit))
    return page, found.agg(F.count("*").alias("total"))


def _around(g: Graph, node_id: str, direction: str, relationships: tuple[str, ...] | None) -> DataFrame:
    adj = g.adjacency(direction, relationships).filter(F.col("src") == node_id)
    side = F.when(F.col("reversed") == 1, "in").otherwise("out")
    return adj.select(F.col("dst").alias("_id"), "relationship", side.alias("direction"), "edge").join(g.nodes, F.col("_id") == F.col("id")).drop("_id")


def neighbours(g: Graph, node_id: str, direction: str = "out", relationships: tuple[str, ...] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Distinct neighbours by name and id."""
    return _around(g, node_id, direction, relationships).select(*g.nodes.columns).distinct().orderBy("name", "id").offset(offset).limit(bounded("neighbours", limit))


def related(g: Graph, node_id: str, relationships: tuple[str, ...], direction: str = "both", limit: int | None = None) -> DataFrame:
    """Neighbours with the relationship and direction they are met by, in that order, then name and id."""
    return _around(g, node_id, direction, relationships).select("direction", "relationship", "id", "name").orderBy("direction", "relationship", "name", "id").limit(bounded("neighbours", limit))


def section(g: Graph, node_id: str, name: str, limit: int | None = None) -> DataFrame:
    relationships, direction = SECTIONS[name]
    return related(g, node_id, relationships, direction, limit)


def count_section(g: Graph, node_id: str, name: str) -> DataFrame:
    """The exact size of a section: distinct (neighbour, relationship, direction)."""
    relationships, direction = SECTIONS[name]
    return _around(g, node_id, direction, relationships).agg(F.count_distinct("id", "relationship", "direction").alias("total"))


def _section_of() -> Column:
    rel, side = F.col("relationship"), F.col("direction")
    return (
        F.when((rel == "CALLS") & (side == "in"), "callers").when((rel == "CALLS") & (side == "out"), "callees").when((rel == "REFERENCES") & (side == "in"), "references")
        .when(rel.isin(*DEPENDENCY) & (side == "out"), "dependencies").when(rel.isin(*DEPENDENCY) & (side == "in"), "dependents")
        .when(rel.isin(*SECTIONS["implementations"][0]), "implementations").when(rel.isin(*SECTIONS["apis"][0]), "apis").when(rel.isin(*SECTIONS["databases"][0]), "databases")
        .when(rel.isin(*SECTIONS["documentation"][0]), "documentation").when(rel.isin(*SECTIONS["contracts"][0]), "contracts").when((rel == "CONTAINS") & (side == "out"), "children")
    )


def relationship_totals(g: Graph, node_id: str) -> DataFrame:
    """Distinct neighbours per relationship and direction, with the section that shows them (null for none)."""
    return _around(g, node_id, "both", None).groupBy("relationship", "direction").agg(F.count_distinct("id").alias("total")).withColumn("section", _section_of())


def node_relations(g: Graph, node_id: str, per_section: int = 20) -> DataFrame:
    """Neighbours per section: capped per relationship and direction, then per section across them."""
    rows = _around(g, node_id, "both", None).select("relationship", "direction", "id", "name")
    first = Window.partitionBy("relationship", "direction").orderBy("name", "id")
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_section).withColumn("section", _section_of()).filter("section IS NOT NULL")
    again = Window.partitionBy("section").orderBy("relationship", "name", "id")
    return rows.withColumn("n", F.row_number().over(again)).filter(F.col("n") <= per_section).select("section", "relationship", "direction", "id", "name", F.col("n").cast("int").alias("position"))


def parent(g: Graph, node_id: str) -> DataFrame:
    return _around(g, node_id, "in", ("CONTAINS",)).select(*g.nodes.columns).orderBy("id").limit(1)


def children(g: Graph, node_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    return _around(g, node_id, "out", ("CONTAINS",)).select(*g.nodes.columns).orderBy(F.col("start_line").asc_nulls_last(), "name", "id").offset(offset).limit(bounded("neighbours", limit))


def page_with_total(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the exact number of all rows; one partially aggregated count, no window over all."""
    total = df.agg(F.count("*").alias("total")).first()[0]
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def tree_level(g: Graph, path: str = "", limit: int | None = None) -> DataFrame:
    """Direct children of a directory path, by type, name and id."""
    base = path.strip("/")
    prefix = f"{base}/" if base else ""
    rest = F.substring(F.col("file_path"), len(prefix) + 1, 1 << 30)
    rows = g.nodes.filter(F.col("node_type").isin(*TREE_TYPES) & F.col("file_path").startswith(prefix) & (F.length("file_path") > len(prefix)) & (F.instr(rest, "/") == 0))
    return rows.orderBy("node_type", "name", "id").limit(bounded("limit", limit)).withColumn("parent_path", F.lit(base))


def counts(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count("*").alias("nodes")).join(g.edges.agg(F.count("*").alias("edges")), F.lit(True))


def composition(g: Graph) -> DataFrame:
    """Counts by node type and by relationship; absent groups have no row."""
    n = g.nodes.groupBy(F.col("node_type").alias("value")).agg(F.count("*").alias("total")).select(F.lit("node_type").alias("kind"), "value", "total")
    return n.unionByName(g.edges.groupBy(F.col("relationship").alias("value")).agg(F.count("*").alias("total")).select(F.lit("relationship").alias("kind"), "value", "total"))


def has_relationship(g: Graph, relationship: str, direction: str = "out", members: bool = False) -> DataFrame:
    """Ids of nodes that have the relationship themselves or, with ``members``, through a contained node."""
    end = "source" if direction == "out" else "target"
    own = g.edges.filter(F.col("relationship") == relationship).select(F.col(end).alias("id"))
    if members:
        holds = g.edges.filter(F.col("relationship") == "CONTAINS").select(F.col("source").alias("holder"), F.col("target").alias("id"))
        own = own.union(holds.join(own.distinct(), "id", "left_semi").select("holder"))
    return own.distinct()
