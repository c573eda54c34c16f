"""Projects, runs and freshness: latest runs, manifests, path containment, index decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("QUEUED", "INDEXING", "PARSING", "BUILDING_GRAPH", "PERSISTING")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each project, by creation then id; one partially aggregated maximum."""
    rest = [c for c in runs.columns if c != "project_id"]
    return runs.groupBy("project_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")).select("project_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def run_listing(runs: DataFrame, project_id, limit: int = 20) -> DataFrame:
    return runs.filter(F.col("project_id") == project_id).orderBy(F.desc("created_at"), "id").limit(limit)


def next_queued(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'QUEUED'").orderBy("created_at", "id").limit(1)


def newest_active(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin(*ACTIVE)).orderBy(F.desc("created_at"), "id").limit(1)


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upserts: the last write of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def project_summaries(projects: DataFrame, runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every project with its newest run, its counts, and its node counts by type."""
    by_type = nodes.groupBy("project_id", "node_type").agg(F.count("*").alias("n")).groupBy("project_id").agg(F.sum("n").alias("node_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_type", "n")))).alias("node_types"))
    links = edges.groupBy("project_id").agg(F.count("*").alias("edge_count"))
    newest = latest_runs(runs).select("project_id", F.col("status").alias("run_status"), F.col("id").alias("run_id"))
    out = projects.join(newest, "project_id", "left").join(by_type, "project_id", "left").join(links, "project_id", "left")
    return out.withColumn("node_count", F.coalesce("node_count", F.lit(0))).withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def holding_projects(paths: DataFrame, roots: DataFrame, most: int = 20) -> DataFrame:
    """Projects whose root is a path or above it, deepest root first.

    Each path is joined on its own ancestors, so the join is an equi-join however many roots there are.
    """
    above = F.expr("transform(sequence(1, size(split(path, '/'))), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
    hits = paths.withColumn("root", F.explode(above)).join(roots, "root")
    first = Window.partitionBy("path").orderBy(F.desc(F.length("root")), "id")
    return hits.withColumn("position", F.row_number().over(first)).filter(F.col("position") <= most)


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)``: added, modified or deleted; ``path, content_hash`` on both sides."""
    b, a = before.select("path", F.col("content_hash").alias("was")), after.select("path", F.col("content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return b.join(a, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def manifest_digest(manifest: DataFrame, buckets: int = 256) -> DataFrame:
    """One digest over all (path, hash) pairs in path order, as a two-level tree.

    Paths fall into ranges of their own hash; a range's digest covers its pairs in path order, the
    manifest's digest the ranges in order. No task holds the whole manifest.
    """
    at = F.pmod(F.xxhash64("path"), F.lit(buckets))
    line = F.concat(F.col("path"), F.lit("\0"), F.col("content_hash"), F.lit("\n"))
    ranges = manifest.groupBy(at.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("d"))
    return ranges.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("b").cast("string"), 4, "0"), "d"))), "\n"), 256).alias("digest"), F.count("*").alias("ranges"))


def flat_digest(manifest: DataFrame) -> DataFrame:
    """SHA-256 over ``path NUL hash LF`` lines in path order, as indexes store it; for one project's manifest."""
    return manifest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("path"), F.lit("\0"), F.col("content_hash"), F.lit("\n")))), ""), 256).alias("digest"))


def freshness(indexed: bool, readable: bool, changed: int, head_moved: bool = False) -> str:
    """not_indexed, unknown, stale or current."""
    if not indexed:
        return "not_indexed"
    if not readable:
        return "unknown"
    return "stale" if changed or head_moved else "current"


def index_decision(active: bool, state: str, force: bool = False) -> str:
    """What a request to index does: already_indexing, up_to_date or started."""
    if active:
        return "already_indexing"
    return "up_to_date" if state == "current" and not force else "started"


def index_status(runs: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Per project: its state, whether a graph is usable, and the last success."""
    newest = latest_runs(runs).select("project_id", "status")
    good = runs.filter("status = 'COMPLETED'").groupBy("project_id").agg(F.max("created_at").alias("last_success"))
    out = newest.join(good, "project_id", "left")
    out = out.withColumn("stale", F.lit(False)) if fresh is None else out.join(fresh, "project_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    state = F.when(F.col("status").isin(*ACTIVE), "indexing").when(F.col("status") == "FAILED", "failed").when(F.col("last_success").isNull(), "never_indexed").when(F.col("stale"), "stale").otherwise("ready")
    return out.select("project_id", state.alias("state"), F.col("last_success").isNotNull().alias("usable"), "last_success")


def ensure_project(matches: int, exists: bool, may_create: bool) -> str:
    """What to do for a path: use the project, ask which, create one, or refuse."""
    if matches == 1:
        return "use"
    if matches > 1:
        return "choose"
    return "missing_path" if not exists else "create" if may_create else "refuse"
