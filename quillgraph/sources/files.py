"""Source trees as DataFrames: scanning, loading, graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.graph import EDGE_COLUMNS, NODE_COLUMNS, Graph


def scan(spark: SparkSession, root: str, max_files: int = 25_000, max_depth: int = 24) -> DataFrame:
    """``path, length, modification_time, category, role, language, extension`` of files under a root.

    Ignored folders and files are left out; the cap falls on the sorted paths, so it is the same on
    every run. Only names are read, never contents. Spark's listing hides names that begin with a
    point or an underscore; such files are not seen.
    """
    base = root.rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modification_time"))
    rows = listed.withColumn("path", F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)).filter(~paths.is_ignored(F.col("path")) & (F.size(F.split("path", "/")) <= max_depth))
    return rows.withColumn("c", paths.classify(F.col("path"))).orderBy("path").limit(max_files).select("path", "length", "modification_time", "c.*")


def load(spark: SparkSession, root: str, max_files: int = 5000, max_bytes: int = 1 << 20, most: int = 64 << 20) -> DataFrame:
    """``path, text`` of indexed sources: files up to a megabyte while the running total in path order stays in bounds.

    Live environment files come with empty text; bytes that are no UTF-8 are replaced.
    """
    base = root.rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = listed.select(F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1).alias("path"), "length", "content")
    rows = rows.filter(paths.is_indexed_source(F.col("path")) & ~paths.is_ignored(F.col("path")) & (F.col("length") <= max_bytes))
    upto = rows.select("path", "length").withColumn("total", F.sum("length").over(Window.orderBy("path"))).withColumn("n", F.row_number().over(Window.orderBy("path")))  # names and sizes only; a tree has max_files of them
    kept = upto.filter((F.col("total") <= most) & (F.col("n") <= max_files)).select("path")
    text = F.when(paths.holds_secrets(F.col("path")), F.lit("")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return rows.join(kept, "path", "left_semi").select("path", text.alias("text"))


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph from a JSON file ``{nodes: [...], edges: [...]}``; other shapes are refused."""
    raw = spark.read.option("multiLine", True).json(path)
    if not {"nodes", "edges"} <= set(raw.columns):
        raise ValueError("a graph file holds nodes and edges")
    nodes, edges = (raw.select(F.explode(c).alias("x")).select("x.*") for c in ("nodes", "edges"))
    pick = lambda df, names: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])
    return Graph(pick(nodes, NODE_COLUMNS), pick(edges, EDGE_COLUMNS))
