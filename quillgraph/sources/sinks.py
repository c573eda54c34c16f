"""Persisting graphs: atomic replacement, stable JSON, deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def replace_graph(g: Graph, folder: str, project_id: str) -> str:
    """Writes a new version beside the old one, then renames a one-line pointer over the old one.

    Readers follow the pointer, so they see the old graph or the new one and never a mix. Rows that
    repeat an id are written once.
    """
    spark = g.nodes.sparkSession
    version = f"{folder}/{project_id}/v-{uuid.uuid4().hex}"
    g.nodes.dropDuplicates(["id"]).write.parquet(f"{version}/nodes")
    g.edges.dropDuplicates(["id"]).write.parquet(f"{version}/edges")
    fs, jvm = _fs(spark, folder)
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fresh, pointer = f"{folder}/{project_id}/.current-{uuid.uuid4().hex}", f"{folder}/{project_id}/CURRENT"
    out = fs.create(path(fresh), True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(path(fresh)), fs.makeQualified(path(pointer)), over)
    return version


def read_graph(spark: SparkSession, folder: str, project_id: str) -> Graph:
    version = spark.read.text(f"{folder}/{project_id}/CURRENT").first()[0]
    return Graph(spark.read.parquet(f"{version}/nodes"), spark.read.parquet(f"{version}/edges"))


def delete_project(spark: SparkSession, folder: str, project_id: str) -> bool:
    """All versions of a project and its pointer."""
    fs, jvm = _fs(spark, folder)
    return bool(fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{project_id}"), True))


def stable_json(df: DataFrame) -> DataFrame:
    """``(id, json)`` with columns in name order and map keys sorted, so equal rows give equal text."""
    def column(c: str, kind: str):
        if kind.startswith("map<"):
            return F.map_from_entries(F.array_sort(F.map_entries(c))).alias(c)
        return F.col(c)

    kinds = dict(df.dtypes)
    return df.select("id", F.to_json(F.struct(*[column(c, kinds[c]) for c in sorted(kinds)])).alias("json")).orderBy("id")
