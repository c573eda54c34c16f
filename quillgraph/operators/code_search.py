"""Literal text search with windows, and source windows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 200
MAX_FILE_BYTES = 4 << 20


def _utf16(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def code_search(files: DataFrame, term: str, path: str = "path", text: str = "text") -> DataFrame:
    """Every non-overlapping, case-sensitive occurrence: ``path, line, column, window``, lines from 1, columns from 0.

    Columns count UTF-16 units. Files over 4 MiB are left out (``skipped`` counts them).
    """
    if not term or len(term) > 200 or "\n" in term:
        raise ValueError("a search term has 1 to 200 characters on one line")
    held = files.filter((F.octet_length(text) <= MAX_FILE_BYTES) & F.contains(F.col(text), F.lit(term)))
    lines = held.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\r?\n")).alias("at", "body")).filter(F.contains(F.col("body"), F.lit(term)))
    parts = F.split(F.col("body"), F.lit(re.sub(r"([^\w\s])", r"\\\1", term)), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.aggregate(F.slice(parts, 1, n), F.lit(-len(term)), lambda acc, p: acc + F.length(p) + len(term)))
    hits = lines.select("path", (F.col("at") + 1).alias("line"), "body", F.explode(starts).alias("start"))
    first = F.greatest(F.lit(0), F.least(F.col("start") - (WINDOW - len(term)) / 2, F.length("body") - WINDOW)).cast("int")
    return hits.select("path", F.col("line").cast("int").alias("line"), _utf16(F.substring(F.col("body"), F.lit(1), F.col("start"))).cast("int").alias("column"), F.substring(F.col("body"), first + 1, F.lit(WINDOW)).alias("window"))


def search_page(files: DataFrame, term: str, limit: int = 20, **names: str) -> tuple[DataFrame, DataFrame]:
    """The first matches by path, line and column, and ``(total, files, skipped)``."""
    hits = code_search(files, term, **names)
    text = names.get("text", "text")
    skipped = files.agg(F.count_if(F.octet_length(text) > MAX_FILE_BYTES).alias("skipped"))
    return hits.orderBy("path", "line", "column").limit(limit), hits.agg(F.count("*").alias("total"), F.count_distinct("path").alias("files")).join(skipped, F.lit(True))


def matches_by_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count("*").alias("matches"), F.min("line").alias("first_line"), F.array_sort(F.collect_set("line")).alias("lines"))


@dataclass(frozen=True)
class Window:
    start: int
    end: int
    total: int
    truncated: bool


def window_bounds(total: int, start: int | None = None, end: int | None = None, around: tuple[int, int] | None = None, context: int = 12, most: int = 2000) -> Window:
    """Explicit lines, else a node's lines with context, else the whole file; clamped to the file and to ``most`` lines."""
    if start is None and end is None and around is not None:
        start, end = around[0] - context, around[1] + context
    a = max(1, min(start or 1, max(total, 1)))
    b = max(a, min(end or total, total)) if total else 0
    cut = b - a + 1 > most
    return Window(a, a + most - 1 if cut else b, total, cut)


def source_lines(files: DataFrame, file: str, path: str = "path", text: str = "text") -> DataFrame:
    """``(line, body)`` of one file; a trailing line break makes no line."""
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    return files.filter(F.col(path) == file).select(F.posexplode(F.split(body, "\r?\n")).alias("at", "body")).select((F.col("at") + 1).cast("int").alias("line"), "body")


def line_range(files: DataFrame, file: str, start: int, end: int, path: str = "path", text: str = "text") -> DataFrame:
    """``(line, body)`` of those lines from ``start`` to ``end`` that the file has, parted by line feeds alone; unlike a window, the range is not moved into the file."""
    lines = files.filter(F.col(path) == file).select(F.posexplode(F.split(text, "\n")).alias("at", "body")).select((F.col("at") + 1).cast("int").alias("line"), "body")
    return lines.filter(F.col("line").between(start, end)).orderBy("line")


def source_window(files: DataFrame, file: str, **bounds) -> tuple[DataFrame, Window]:
    lines = source_lines(files, file)
    w = window_bounds(lines.count(), **bounds)
    return lines.filter(F.col("line").between(w.start, w.end)).orderBy("line"), w


def safe_path(path: str) -> str:
    """A relative POSIX path inside the root, or an error."""
    if not path or "\0" in path or "\\" in path or path.startswith("/") or re.match(r"^[A-Za-z]:", path) or ".." in path.split("/"):
        raise ValueError("not a relative path inside the repository")
    return "/".join(p for p in path.split("/") if p not in ("", "."))
