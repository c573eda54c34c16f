"""Odd tables and growing tables: what the findings of round 3 named."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import analytics, merge, traverse
from quillgraph.plans import extraction_queries, queries  # noqa: F401
from quillgraph.plans.graph import Graph
from quillgraph.plans.registry import ORACLE, QUERIES
from quillgraph.sources import extract


@pytest.mark.parametrize("text", ["one line", "", None, "a\nb\n", "a\r\nb\r\n\r\nc", "\n\n\n\n\n\n\n\n", "1\n2\n3\n4\n5\n6\n7"])
def test_source_window_of_short_and_odd_texts(spark, tmp_path, text):
    """A range beyond the file holds no line, and lines are parted by line feeds alone, as in the SQL."""
    spark.createDataFrame([(5, text), (6, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["c04_source_window"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE["c04_source_window"]).fetchall())


def test_files_are_dealt_before_they_are_read(spark):
    """A small table of keys in one partition is read by many tasks, and one analyzer's facts are those of all drafts."""
    keys = spark.range(300).coalesce(1)
    files = keys.select(F.concat(F.lit("db/p"), F.col("id").cast("string"), F.lit(".sql")).alias("path"), F.concat(F.lit("CREATE TABLE t_"), F.col("id").cast("string"), F.lit(" (a int);\nSELECT 1 FROM u")).alias("text"))
    d = extract.drafts(files, "sql", ("kind", "analyzer", "relationship", "file", "line", "matched"))
    tasks = d.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("file").alias("n")).collect()
    assert len(tasks) > 4 and max(r["n"] for r in tasks) < 150
    rows = lambda x: sorted(map(tuple, x.select("kind", "relationship", "file", "line", "matched").collect()), key=repr)
    assert rows(d) == rows(extract.drafts(files).filter("analyzer = 'sql'"))


def _random_graph(spark, seed, nodes=40, edges=110):
    r = random.Random(seed)
    kinds = ("CALLS", "USES", "CONTAINS")
    rows = sorted({(f"n{r.randrange(nodes):02}", r.choice(kinds), f"n{r.randrange(nodes):02}") for _ in range(edges)})
    e = spark.createDataFrame([(f"{a}|{k}|{b}", a, k, b, 1, "high") for a, k, b in rows], "id string, source string, relationship string, target string, occurrences long, confidence string")
    n = spark.createDataFrame([(f"n{i:02}", "class" if i % 3 else "method", f"x{i}", None, None, None) for i in range(nodes - 3)], "id string, node_type string, name string, qualified_name string, file_path string, start_line int")
    return Graph(n, e), [f"n{i:02}" for i in range(nodes - 3)], rows


@pytest.mark.parametrize("seed", [1, 2])
def test_page_rank_by_powers_is_page_rank_by_rounds(spark, seed):
    """Cycles, loops, parallel edges, dangling nodes and edges out of the slice."""
    g, ids, rows = _random_graph(spark, seed)
    e = [(a, b) for a, k, b in rows if k != "CONTAINS" and a != b and a in ids and b in ids]
    out = {i: sum(a == i for a, _ in e) for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(30):
        lost = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / len(ids) + 0.85 * (sum(rank[a] / out[a] for a, b in e if b == i) + lost / len(ids)) for i in ids}
    got = {r["id"]: r["rank"] for r in analytics.page_rank(g).collect()}
    assert got == pytest.approx({i: x / max(rank.values()) for i, x in rank.items()}, abs=1e-12)


def test_page_rank_ends_with_the_walks(spark, small, monkeypatch):
    """Walks of the slice have two steps, so a third pass is the last; before, thirty were made."""
    made = []
    monkeypatch.setattr(analytics, "checkpointed", lambda df: made.append(df) or traverse.checkpointed(df))
    assert QUERIES["g01_page_rank"](spark, small).count() > 1000 and len(made) <= 4


def test_queries_read_what_they_need_and_keep_nothing(spark, small):
    """A section without edges in the tables reads no lines; no query leaves a kept graph behind."""
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("n04_implementations", "f07_projection_apis"):
        df = QUERIES[name](spark, small)
        df.collect()
        assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def _brute_path(ids, rows, a, b, depth, directed, budget):
    adj = [(s, t, 0, k) for s, k, t in rows] + ([] if directed else [(t, s, 1, k) for s, k, t in rows])
    seen, front, ways, size = {a}, {a}, {}, 1
    for _ in range(depth):
        new = {}
        for s, t, rev, k in adj:
            if s in front and t not in seen:
                new[t] = min(new.get(t, (9,)), (rev, k, s))
        if not new:
            return None, False
        cut = size + len(new) > budget
        new = dict(sorted(new.items())[: budget - size] if cut else new)
        ways |= new
        if b in new:
            path = [b]
            while path[-1] != a:
                path.append(ways[path[-1]][2])
            return path[::-1], cut
        if cut:
            return None, True
        seen |= set(new)
        front, size = set(new), size + len(new)
    return None, False


def test_paths_with_small_and_large_frontiers_and_budgets(spark, monkeypatch):
    g, ids, rows = _random_graph(spark, 3, edges=60)
    for k, (sent, budget, directed) in enumerate([(100_000, 1000, True), (1, 1000, False), (100_000, 9, False), (0, 14, False), (100_000, 5, False)]):
        monkeypatch.setattr(traverse, "SENT", sent)
        a, b = ids[k], ids[-1 - 2 * k]
        want, cut = _brute_path(ids, rows, a, b, 6, directed, budget)
        p = traverse.find_path(g, a, b, 6, directed, budget=budget)
        assert (p.nodes or None, p.found) == (want, want is not None) and (p.found or p.truncated == cut)
        assert len(p.edges) == max(0, len(p.nodes) - 1) and all({x, y} == set(i.split("|")[::2]) for x, y, i in zip(p.nodes, p.nodes[1:], p.edges, strict=False))


def test_merging_deals_drafts_once(spark, small):
    """One shuffle of the drafts, whatever their number; before, three."""
    plan = QUERIES["m03_merge_edges"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_merging_random_drafts(spark):
    """Sums, first writers and evidence against the rule read line by line."""
    r = random.Random(5)
    rank = {"low": 0, "medium": 1, "high": 2, "odd": -1}
    rows = [(f"e{r.randrange(30)}" if r.random() > 0.02 else None, k, r.choice(list(rank)), r.choice([None, "m", "n"]), r.choice([None, 1, 2]), r.choice(["x", "y"]), r.choice([1, 2, None])) for k in range(400)]
    schema = "id string, seq int, confidence string, method string, line int, extra string, occurrences int"
    d = spark.createDataFrame(rows, schema).select("*", F.lit("s").alias("source_node"), F.lit("R").alias("relationship"), F.lit("t").alias("target_node"), F.lit("z").alias("source"), F.lit("f").alias("file"), F.lit(None).cast("string").alias("matched"))
    want = {}
    for i, k, c, m, n, x, o in rows:
        if i is None:
            continue
        e = want.setdefault(i, {"best": -9, "extra": x, "seq": k, "o": None, "method": None, "line": None})
        e["o"] = e["o"] if o is None else (e["o"] or 0) + o
        if rank[c] > e["best"]:
            e |= {"best": rank[c], "confidence": c, "method": m or e["method"], "line": n or e["line"]}
    got = {r["id"]: (r["occurrences"], r["confidence"], r["method"], r["line"], r["extra"], r["seq"]) for r in merge.merge_edges(d).collect()}
    assert got == {i: (e["o"], e["confidence"], e["method"], e["line"], e["extra"], e["seq"]) for i, e in want.items()}
