"""Text functions: routes, links, slugs, hosts, SQL table references, progress."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import parsers
from ..vocab import CONFIDENCE, PHASES, POLICY

# Hosts that name nothing.
PLACEHOLDER_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "example.com", "www.example.com", "example.org", "example.net", "test.com")
PLACEHOLDER_ENDINGS = (".local", ".localhost", ".invalid")


def table_references(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Tables that SQL text reads and writes: one row per table and access, with the first statement kind that says so.

    Columns ``keep`` come along. Text is read by the SQL tokenizer, so comments and string literals name no table.
    """
    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL("table string, access string, statement string").fields])

    def run(batches):
        for t in batches:
            found = [(i, *x[:3]) for i, body in enumerate(t.column(text).to_pylist()) for x in parsers.table_accesses(body or "")]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(at) for c in keep), *(pa.array([x[k] for x in found], pa.string()) for k in (1, 2, 3))], [*keep, "table", "access", "statement"])

    return df.select(*keep, text).mapInArrow(run, schema)


def normalize_route(path: Column) -> Column:
    """Parameters :x, {x} and * of a route as {}."""
    part = lambda s: F.when(s.startswith(":") | (s == "*") | s.rlike(r"^\{[^}]*\}$"), F.lit("{}")).otherwise(s)
    parts = F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, part), "/"))


def join_route(*parts: Column) -> Column:
    """Route parts as one path with single slashes."""
    split = F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(split, "/"))


def route_label(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), path)


def link_kind(target: Column) -> Column:
    """anchor, external or path."""
    return F.when(target.startswith("#"), "anchor").when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | target.startswith("//"), "external").otherwise("path")


def link_path(target: Column) -> Column:
    """The path of a path link, without query and fragment."""
    return F.when(link_kind(target) == "path", F.regexp_replace(target, r"[?#].*$", ""))


def link_fragment(target: Column) -> Column:
    return F.when(F.instr(target, "#") > 0, F.regexp_extract(target, r"#(.*)$", 1))


def slugify(heading: Column) -> Column:
    """Lower case, without signs, blanks as hyphens."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(heading), r"[^\w\s-]", "")), r"\s+", "-")


def resolve_relative(base_file: Column, target: Column) -> Column:
    """A relative target from a file's directory; null where it climbs over the root."""
    start = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(base_file, "/"), 1, F.greatest(F.size(F.split(base_file, "/")) - 1, F.lit(0))))
    steps = F.filter(F.split(target, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(steps, start, lambda acc, s: F.when(acc.isNull(), acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(walked, "/")


def host_of(url: Column) -> Column:
    """The host of an absolute http(s) URL, in lower case."""
    return F.when(url.rlike(r"(?i)^https?://[^/?#]"), F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]+)", 1)))


def is_placeholder(host: Column) -> Column:
    out = F.lower(host).isin(*PLACEHOLDER_HOSTS)
    for e in PLACEHOLDER_ENDINGS:
        out = out | F.lower(host).endswith(e)
    return out


def confidence_of(basis: Column) -> Column:
    return F.coalesce(*[F.when(basis == k, F.lit(v)) for k, v in POLICY.items()])


def confidence_score(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in CONFIDENCE.items()])


def evidence(source: Column, basis: Column, **more: Column) -> Column:
    """Evidence as a struct, its confidence from the policy."""
    fields = [more.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("method", "string"), ("file", "string"), ("line", "int"), ("matched", "string"))]
    return F.struct(source.alias("source"), confidence_of(basis).alias("confidence"), *fields)


def progress(phase: Column, current: Column, total: Column) -> Column:
    """Share of a run that is done: whole phases before this one and this one's part, 0 to 1."""
    done, before = F.lit(0.0), 0
    for name, weight in PHASES:
        part = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), current / total))).otherwise(0.0)
        done = F.when(phase == name, (before + weight * part) / 100).otherwise(done)
        before += weight
    return F.when(phase == "completed", 1.0).otherwise(done)
