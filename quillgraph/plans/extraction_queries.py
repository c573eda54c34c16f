"""Extraction queries: source files written from table rows, so that SQL can say what must be found."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import extract, parsers
from .registry import query


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(files: DataFrame, analyzer: str, *relationships: str) -> DataFrame:
    d = extract.drafts(files, analyzer, ("kind", "relationship", "file", "line", "matched")).filter((F.col("kind") == "edge") & F.col("relationship").isin(*relationships))
    return d.select("file", "relationship", "matched", F.col("line").cast("int").alias("line"))


@query("x06_sql_files", """SELECT 'db/p' || p_partkey || '.sql' AS file, relationship, matched, line FROM part, LATERAL (VALUES ('DEFINES', 't_' || p_partkey, 2), ('CONTAINS', 'id', 3), ('CONTAINS', 'size', 4), ('CONTAINS', 'brand_id', 5), ('REFERENCES', 'brands', 5), ('WRITES_TO', 'audit', 7), ('READS_FROM', 't_' || p_partkey, 7)) v(relationship, matched, line)""")
def x06_sql_files(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("-- part, it's one\nCREATE TABLE public.t_"), k, F.lit(" (\n  id INT PRIMARY KEY,\n  size numeric(10, 2) NOT NULL,\n  brand_id INT REFERENCES brands(id)\n);\nINSERT INTO audit SELECT 'FROM ghosts' FROM t_"), k, F.lit(";\n"))
    return _facts(_t(spark, sf_dir, "part").select(F.concat(F.lit("db/p"), k, F.lit(".sql")).alias("path"), body.alias("text")), "sql", "DEFINES", "CONTAINS", "REFERENCES", "WRITES_TO", "READS_FROM")


@query("x13_documents", """SELECT 'd/c' || conv_id || '.md' AS file, 'CONTAINS' AS relationship, CASE WHEN k = 0 THEN 'Talk ' || conv_id ELSE 'Turn ' || (k - 1) END AS matched, CAST(1 + 2 * k AS INTEGER) AS line FROM (SELECT conv_id, unnest(range(0, 1 + count(*))) AS k FROM conversations GROUP BY conv_id)""")
def x13_documents(spark, sf_dir):
    """One document per conversation, a heading for the talk and one for each turn; text in fences and spans is no heading."""
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    turns = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("\n## Turn "), i.cast("string"), F.lit(" ##\nsaid `# no`"))), "")
    files = c.select(F.concat(F.lit("d/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# **Talk** "), F.col("conv_id").cast("string"), F.lit("\n"), turns).alias("text"))
    files = files.withColumn("text", F.regexp_replace("text", "\n\n", "\nx\n"))
    return _facts(files, "document", "CONTAINS")


@query("x13_links", """SELECT 'd/p' || page_id || '.md' AS source, 'd/p' || (page_id - 1) || '.md' AS target FROM pages WHERE page_id > 0""")
def x13_links(spark, sf_dir):
    """Each document links to the one before it, to itself, to a missing file and out of the tree; only the first counts."""
    p = _t(spark, sf_dir, "pages").select("page_id")
    path = lambda c: F.concat(F.lit("d/p"), c.cast("string"), F.lit(".md"))
    body = F.concat(F.lit("[a](../d/./p"), (F.col("page_id") - 1).cast("string"), F.lit(".md?q=1#x) [b](p"), F.col("page_id").cast("string"), F.lit(".md) [c](gone.md) [d](../../up.md) [e](http://h.test/x)"))
    g, _ = extract.assemble(p.select(path(F.col("page_id")).alias("path"), body.alias("text")))
    at = g.nodes.select("id", "file_path")
    e = g.edges.filter("relationship = 'LINKS_TO'").select("source", "target")
    return e.join(at.withColumnRenamed("id", "source").withColumnRenamed("file_path", "a"), "source").join(at.withColumnRenamed("id", "target").withColumnRenamed("file_path", "b"), "target").select(F.col("a").alias("source"), F.col("b").alias("target"))


@query("x03_imports", """SELECT 's/' || n_regionkey || '/n' || n_nationkey || '.ts' AS source, 's/r' || n_regionkey || '.ts' AS target FROM nation""")
def x03_imports(spark, sf_dir):
    """Nations' modules import their region's; packages and missing modules give no such edge."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    rk, nk = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("import { x as y } from '../r"), rk, F.lit(".js';\nimport z from 'zod';\n// import q from './q'\nimport './missing';\n"))
    files = n.select(F.concat(F.lit("s/"), rk, F.lit("/n"), nk, F.lit(".ts")).alias("path"), body.alias("text")).union(r.select(F.concat(F.lit("s/r"), F.col("r_regionkey").cast("string"), F.lit(".ts")), F.lit("export const x = 1;")))
    g, _ = extract.assemble(files)
    at = g.nodes.select("id", "file_path")
    e = g.edges.filter("relationship = 'IMPORTS'").select("source", "target")
    return e.join(at.withColumnRenamed("id", "source").withColumnRenamed("file_path", "a"), "source").join(at.withColumnRenamed("id", "target").withColumnRenamed("file_path", "b"), "target").select(F.col("a").alias("source"), F.col("b").alias("target"))


@query("x09_external_services", """SELECT 's/p' || page_id || '.ts' AS file, 'USES' AS relationship, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS matched, 2 AS line FROM pages""")
def x09_external_services(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    body = F.concat(F.lit("// fetch('http://comment.test')\nfetch('"), F.col("url"), F.lit("'); fetch('http://localhost/x'); fetch(`https://${h}/y`);\n"))
    return _facts(p.select(F.concat(F.lit("s/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), body.alias("text")), "code", "USES")


@query("x05_routes", """SELECT 's/s' || s_suppkey || '.ts' AS file, relationship, CASE relationship WHEN 'CONTAINS' THEN 'GET /s/' || s_suppkey || '/:id' ELSE 'show' END AS matched, 1 AS line FROM supplier, (VALUES ('CONTAINS'), ('ROUTES_TO')) v(relationship)""")
def x05_routes(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("router.get('/s/"), k, F.lit("/:id', auth, show); cache.get('/no'); router.get(path, show);"))
    return _facts(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("s/s"), k, F.lit(".ts")).alias("path"), body.alias("text")), "code", "CONTAINS", "ROUTES_TO")


@query("x12_openapi", """SELECT 'GET /api/s/' || s_suppkey || '/{id}' AS endpoint, 'GET /api/s/' || s_suppkey || '/:key' AS route FROM supplier WHERE s_suppkey % 2 = 0""")
def x12_openapi(spark, sf_dir):
    """Operations of one specification, matched to declared routes; suppliers of odd keys declare another method."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey").cast("string")
    routes = s.select(F.concat(F.lit("s/s"), k, F.lit(".ts")).alias("path"), F.concat(F.lit("router."), F.when(F.col("s_suppkey") % 2 == 0, "get").otherwise("post"), F.lit("('/api/s/"), k, F.lit("/:key', show);")).alias("text"))
    specs = s.select(F.concat(F.lit("specs/"), k, F.lit("/openapi.yaml")).alias("path"), F.concat(F.lit("openapi: 3.0.0\nservers:\n  - url: https://h.test/api\npaths:\n  /s/"), k, F.lit("/{id}:\n    get: {}\n")).alias("text"))
    g, _ = extract.assemble(routes.union(specs))
    names = g.nodes.select("id", "name")
    e = g.edges.filter("relationship = 'IMPLEMENTED_BY'").select("source", "target")
    return e.join(names.withColumnRenamed("id", "source").withColumnRenamed("name", "endpoint"), "source").join(names.withColumnRenamed("id", "target").withColumnRenamed("name", "route"), "target").select("endpoint", "route")


@query("x10_messaging", """SELECT 's/e' || event_type || (user_id % 5) || '.ts' AS file, relationship, CASE relationship WHEN 'PUBLISHES' THEN event_type ELSE 'jobs' END AS matched, 1 AS line FROM (SELECT DISTINCT event_type, user_id % 5 AS user_id FROM events), (VALUES ('PUBLISHES'), ('SUBSCRIBES')) v(relationship)""")
def x10_messaging(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).cast("string").alias("u")).distinct()
    body = F.concat(F.lit("bus.emit('"), F.col("event_type"), F.lit("', 1); new Worker('jobs', run); process.on('exit', f); emit('no');"))
    return _facts(e.select(F.concat(F.lit("s/e"), "event_type", "u", F.lit(".ts")).alias("path"), body.alias("text")), "code", "PUBLISHES", "SUBSCRIBES")


@query("x07_sql_in_code", """SELECT 's/c' || c_custkey || '.ts' AS file, relationship, matched, 1 AS line, confidence FROM customer, LATERAL (VALUES ('READS_FROM', 'orders', 'medium'), ('WRITES_TO', 'log_' || (c_custkey % 3), 'high')) v(relationship, matched, confidence)""")
def x07_sql_in_code(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    body = F.concat(F.lit("db.q(`SELECT a FROM orders WHERE k = ${k}`); db.q(\"DELETE FROM log_"), (F.col("c_custkey") % 3).cast("string"), F.lit("\"); db.q(`SELECT a FROM ${t}`); say('from here');"))
    d = extract.drafts(_t(spark, sf_dir, "customer").select(F.concat(F.lit("s/c"), k, F.lit(".ts")).alias("path"), body.alias("text")), "code", ("kind", "relationship", "confidence", "file", "line", "matched")).filter("kind = 'edge' AND relationship IN ('READS_FROM', 'WRITES_TO')")
    return d.select("file", "relationship", "matched", F.col("line").cast("int").alias("line"), "confidence")


@query("x08_configuration", """SELECT 'c/e' || event_id || '.json' AS file, 'CONTAINS' AS relationship, m AS matched, l AS line FROM events, (VALUES ('k', 1), ('deep.x', 3)) v(m, l)""")
def x08_configuration(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    body = F.concat(F.regexp_replace("props", r"\}$", ', // note\n"deep": {\n"x": [1], "x": 2, "y": {"z": {}}},\n}'), F.lit(""))
    return _facts(e.select(F.concat(F.lit("c/e"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), body.alias("text")), "configuration", "CONTAINS")


@query("p05_json_rows", """SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events""")
def p05_json_rows(spark, sf_dir):
    """Flattened documents as rows, by a table function over the parser."""

    def run(batches):
        for b in batches:
            found = [(i, r[0], r[3]) for i, t in enumerate(b.column("props").to_pylist()) for r in parsers.json_rows(t or "") if r[2] == "number"]
            ids = b.column("event_id").take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["event_id", "path", "value"])

    return _t(spark, sf_dir, "events").select("event_id", "props").mapInArrow(run, "event_id long, path string, value string")


@query("m03_evidence_counts", """SELECT 'code' AS source, 'high' AS confidence, count(*) AS edges FROM supplier""")
def m03_evidence_counts(spark, sf_dir):
    """One import, met three times a file, merges to one edge each."""
    k = F.col("s_suppkey").cast("string")
    files = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), k, F.lit(".ts")).alias("path"), F.lit("import a from 'zod'; import { b } from 'zod'; const c = require('zod');").alias("text"))
    g, _ = extract.assemble(files)
    return g.edges.filter("relationship = 'DEPENDS_ON' AND occurrences = 3").groupBy(F.col("evidence_source").alias("source"), "confidence").agg(F.count("*").alias("edges"))
