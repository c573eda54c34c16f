"""Scores against a ground truth: precision, recall, evidence coverage, retrieval verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def scores(matched: str = "matched", expected: str = "expected", actual: str = "actual", closed: str = "closed") -> list[Column]:
    """Precision (null for open categories), recall and F1 from counts; null where nothing is divided."""
    p = F.when(F.col(closed), _ratio(F.col(matched), F.col(actual)))
    r = _ratio(F.col(matched), F.col(expected))
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def evaluate_sets(actual: DataFrame, expected: DataFrame, category: str, key: list[str], closed: DataFrame) -> DataFrame:
    """Per category: expected, actual, matched and missing counts with their scores.

    ``closed``: one column with the categories whose truth is complete; only they have precision.
    """
    a = actual.select(category, *key).distinct().withColumn("_a", F.lit(1))
    e = expected.select(category, *key).distinct().withColumn("_e", F.lit(1))
    both = a.join(e, [category, *key], "full_outer").groupBy(category).agg(F.count("_e").alias("expected"), F.count("_a").alias("actual"), F.count_if(F.col("_a").isNotNull() & F.col("_e").isNotNull()).alias("matched"))
    marked = both.join(closed.select(category).distinct().withColumn("closed", F.lit(True)), category, "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    return marked.select(category, "expected", "actual", "matched", (F.col("expected") - F.col("matched")).alias("missing"), "closed", *scores())


def micro_average(per_category: DataFrame) -> DataFrame:
    """Recall over all categories, precision over the closed ones."""
    p = _ratio(F.sum(F.when(F.col("closed"), F.col("matched"))), F.sum(F.when(F.col("closed"), F.col("actual"))))
    r = _ratio(F.sum("matched"), F.sum("expected"))
    return per_category.agg(p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision").isNotNull() & F.col("recall").isNotNull(), F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))))


def evidence_coverage(edges: DataFrame) -> DataFrame:
    """Edges with valid evidence (source and a known confidence), those that could be located, and those that are.

    Columns: evidence_source, confidence, method, file, line.
    """
    valid = F.coalesce(F.col("evidence_source").isNotNull() & F.col("confidence").isin("high", "medium", "low"), F.lit(False))
    locatable = valid & ~F.coalesce(F.col("method").isin("scip", "graph"), F.lit(False))
    located = locatable & F.col("file").isNotNull() & F.col("line").isNotNull()
    return edges.agg(F.count("*").alias("edges"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count_if(locatable).alias("locatable"), F.count_if(located).alias("located"))


def retrieval_verdicts(cases: DataFrame) -> DataFrame:
    """pass, partial or fail per case from counts; an empty expectation means the answer must be empty.

    Columns: case_id, category, expected, matched, returned.
    """
    v = F.when(F.col("expected") == 0, F.when(F.col("returned") == 0, "pass").otherwise("fail")).when(F.col("matched") >= F.col("expected"), "pass").when(F.col("matched") > 0, "partial").otherwise("fail")
    return cases.withColumn("verdict", v)


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("category").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "partial", "fail")], F.count("*").alias("cases"))


def ordered_waypoints(path: Column, wanted: Column) -> Column:
    """Whether all wanted ids lie on the path in this order."""
    last = F.aggregate(wanted, F.lit(0).cast("long"), lambda at, w: F.when(at < 0, at).otherwise(
        F.coalesce(F.get(F.filter(F.transform(path, lambda x, i: F.when((x == w) & (i >= at), i.cast("long") + 1)), lambda v: v.isNotNull()), F.lit(0)), F.lit(-1).cast("long"))))
    return last >= 0


def run_statistics(nodes: DataFrame) -> DataFrame:
    """Functions with methods, classes, interfaces and all nodes."""
    kind = F.col("node_type")
    return nodes.agg(F.count_if(kind.isin("function", "method")).alias("functions"), F.count_if(kind == "class").alias("classes"), F.count_if(kind == "interface").alias("interfaces"), F.count("*").alias("nodes"))
