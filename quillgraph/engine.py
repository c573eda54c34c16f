"""One object with a method per graph operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics, code_search, control, evaluate, lookup, merge, traverse
from .plans.graph import Graph, table_graph
from .sources import extract, files, sinks


class GraphEngine:
    """A graph and its queries; every method that gives rows gives a DataFrame."""

    def __init__(self, graph: Graph, sources: DataFrame | None = None):
        self.graph, self.sources = graph, sources

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> GraphEngine:
        return cls(table_graph(spark, folder))

    @classmethod
    def from_source(cls, spark: SparkSession, root: str) -> GraphEngine:
        """Indexes a source tree."""
        texts = files.load(spark, root).persist()
        return cls(extract.assemble(texts)[0], texts)

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, project_id: str) -> GraphEngine:
        return cls(sinks.read_graph(spark, folder, project_id))

    def replace_graph(self, folder: str, project_id: str) -> str:
        return sinks.replace_graph(self.graph, folder, project_id)

    def node(self, node_id: str) -> DataFrame:
        return lookup.find_node(self.graph, node_id)

    def root(self, node_type: str = "repository") -> DataFrame:
        return lookup.find_root(self.graph, node_type)

    def file(self, path: str) -> DataFrame:
        return lookup.find_file(self.graph, path)

    def definition(self, node_id: str) -> DataFrame:
        return lookup.definition(self.graph, node_id)

    def search(self, term: str, **more) -> tuple[DataFrame, DataFrame]:
        return lookup.search(self.graph, term, **more)

    def neighbours(self, node_id: str, direction: str = "out", **more) -> DataFrame:
        return lookup.neighbours(self.graph, node_id, direction, **more)

    def section(self, node_id: str, name: str, limit: int | None = None) -> DataFrame:
        return lookup.section(self.graph, node_id, name, limit)

    def count_section(self, node_id: str, name: str) -> DataFrame:
        return lookup.count_section(self.graph, node_id, name)

    def relationship_totals(self, node_id: str) -> DataFrame:
        return lookup.relationship_totals(self.graph, node_id)

    def node_relations(self, node_id: str, per_section: int = 20) -> DataFrame:
        return lookup.node_relations(self.graph, node_id, per_section)

    def node_detail(self, node_id: str, per_section: int = 20) -> dict[str, DataFrame]:
        """Everything a node's page shows."""
        g = self.graph
        return {
            "node": lookup.find_node(g, node_id), "relations": lookup.node_relations(g, node_id, per_section), "totals": lookup.relationship_totals(g, node_id),
            "parent": lookup.parent(g, node_id), "children": lookup.children(g, node_id), "definition": lookup.definition(g, node_id),
        }

    def parent(self, node_id: str) -> DataFrame:
        return lookup.parent(self.graph, node_id)

    def children(self, node_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        return lookup.children(self.graph, node_id, limit, offset)

    def parents(self, node_id: str, limit: int = 32) -> DataFrame:
        return traverse.ancestors(self.graph, node_id, limit)

    def tree_level(self, path: str = "", limit: int | None = None) -> DataFrame:
        return lookup.tree_level(self.graph, path, limit)

    def counts(self) -> DataFrame:
        return lookup.counts(self.graph)

    def composition(self) -> DataFrame:
        return lookup.composition(self.graph)

    def traverse(self, root: str, **more) -> traverse.GraphResult:
        return traverse.traverse(self.graph, root, **more)

    def overview(self, **more) -> traverse.GraphResult:
        return traverse.overview(self.graph, **more)

    def query(self, projection: str = "architecture", root: str | None = None, **more) -> traverse.GraphResult:
        return traverse.query(self.graph, projection, root, **more)

    def find_path(self, source: str, target: str, **more) -> traverse.PathResult:
        return traverse.find_path(self.graph, source, target, **more)

    def trace(self, source: str, target: str, direction: str = "outgoing", **more) -> tuple[str, traverse.PathResult, DataFrame]:
        """The verdict, the path, and its steps with evidence."""
        p = traverse.trace(self.graph, source, target, direction, **more)
        return traverse.verdict(p), p, traverse.path_rows(self.graph, p)

    def degree_counts(self) -> DataFrame:
        return analytics.degree_counts(self.graph)

    def page_rank(self, **more) -> DataFrame:
        return analytics.page_rank(self.graph, **more)

    def importance(self) -> DataFrame:
        return analytics.importance(self.graph)

    def modules(self, **more) -> DataFrame:
        return analytics.modules(self.graph, **more)

    def communities(self, rounds: int = 10) -> DataFrame:
        return analytics.communities(self.graph, rounds)

    def roles(self) -> DataFrame:
        return extract.roles(self.graph)

    def model(self) -> DataFrame:
        """Nodes with degrees, importance and module."""
        g = self.graph
        return g.nodes.join(self.degree_counts(), "id").join(self.importance(), "id").join(self.modules(), "id")

    def merged_with(self, other: Graph) -> tuple[GraphEngine, DataFrame]:
        g, new = merge.merge_slices(self.graph, other)
        return GraphEngine(g, self.sources), new

    def code_search(self, term: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        return code_search.search_page(self._texts(), term, limit)

    def source_window(self, file: str, **bounds) -> tuple[DataFrame, code_search.Window]:
        return code_search.source_window(self._texts(), code_search.safe_path(file), **bounds)

    def manifest(self) -> DataFrame:
        return self._texts().select("path", F.sha2("text", 256).alias("content_hash"))

    def changed_since(self, before: DataFrame) -> DataFrame:
        return control.manifest_diff(before, self.manifest())

    def evaluate(self, expected: DataFrame, category: str, key: list[str], closed: DataFrame) -> DataFrame:
        return evaluate.evaluate_sets(self.graph.nodes, expected, category, key, closed)

    def _texts(self) -> DataFrame:
        if self.sources is None:
            raise ValueError("this engine was made without source texts")
        return self.sources
