"""Compiler indexes: the protobuf wire format, symbol strings, and the code graph built from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

# ---------------------------------------------------------------- wire format


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field number, value)`` of a message: numbers for varints and fixed widths, bytes for the rest; unknown wire types end it."""
    at, n = 0, len(raw)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while at < n:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value, at
        raise ValueError("the message ends inside a number")

    while at < n:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(raw[at : at + size], "little"), at + size
        elif kind == 2:
            size, at = varint(at)
            if at + size > n:
                raise ValueError("the message ends inside a field")
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError("unknown wire type")
        yield tag >> 3, value


def _numbers(value: int | bytes) -> list[int]:
    """A packed or single repeated number."""
    if isinstance(value, int):
        return [value]
    out, acc, shift = [], 0, 0
    for b in value:
        acc |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(acc)
            acc = shift = 0
    return out


def _range(r: list[int]) -> tuple[int, int, int, int] | None:
    """Lines from 1, characters from 0; three numbers mean one line."""
    if len(r) == 3:
        return r[0] + 1, r[1], r[0] + 1, r[2]
    return (r[0] + 1, r[1], r[2] + 1, r[3]) if len(r) == 4 else None


def decode_index(raw: bytes) -> dict:
    """``metadata`` and ``documents`` (by path) with symbols, relationships and occurrences; embedded source text is skipped."""
    out: dict = {"metadata": {}, "documents": []}
    for number, value in fields(raw):
        if number == 1:
            m = dict(fields(value))
            tool = dict(fields(m.get(2, b"")))
            out["metadata"] = {"project_root": m.get(3, b"").decode(errors="replace"), "tool": tool.get(1, b"").decode(errors="replace"), "tool_version": tool.get(2, b"").decode(errors="replace")}
        elif number == 2:
            d: dict = {"path": "", "language": None, "symbols": [], "occurrences": []}
            for k, v in fields(value):
                if k == 1:
                    d["path"] = v.decode(errors="replace")
                elif k == 4:
                    d["language"] = v.decode(errors="replace") or None
                elif k == 2:
                    o: dict = {"symbol": "", "range": [], "roles": 0, "enclosing": []}
                    for f, x in fields(v):
                        if f == 1:
                            o["range"] += _numbers(x)
                        elif f == 2:
                            o["symbol"] = x.decode(errors="replace")
                        elif f == 3:
                            o["roles"] = x
                        elif f == 7:
                            o["enclosing"] += _numbers(x)
                    d["occurrences"].append(o)
                elif k == 3:
                    s: dict = {"symbol": "", "kind": 0, "name": "", "relations": []}
                    for f, x in fields(v):
                        if f == 1:
                            s["symbol"] = x.decode(errors="replace")
                        elif f == 5:
                            s["kind"] = x
                        elif f == 6:
                            s["name"] = x.decode(errors="replace")
                        elif f == 4:
                            r = dict(fields(x))
                            s["relations"].append((r.get(1, b"").decode(errors="replace"), bool(r.get(3, 0))))
                    d["symbols"].append(s)
            out["documents"].append(d)
    out["documents"].sort(key=lambda d: d["path"])
    return out


# ---------------------------------------------------------------- symbols

_SUFFIXES = (("().", "method"), ("/", "namespace"), ("#", "type"), (".", "term"), (":", "meta"), ("!", "macro"))
#: Kind numbers of the index format that name a node type.
KINDS = {7: "class", 11: "enum", 12: "property", 15: "property", 17: "function", 21: "interface", 26: "method", 29: "module", 30: "module", 41: "property", 49: "class", 54: "type", 55: "type", 61: "variable", 8: "variable", 9: "method"}
_NODE_OF = {"method": "method", "type": "class", "term": "variable"}


def parse_symbol(symbol: str) -> list[tuple[str, str]]:
    """``(name, suffix)`` descriptors of a symbol string; [] for local or malformed ones. Back ticks quote a name, doubled inside it."""
    if symbol.startswith("local "):
        return []
    parts, at = 0, 0
    while parts < 4:  # scheme, manager, package, version; a doubled space stands for one
        m = re.compile(r"(?:[^ ]|  )*").match(symbol, at)
        at = m.end() + 1
        parts += 1
        if at > len(symbol):
            return []
    out = []
    while at < len(symbol):
        if symbol[at] in "([" and (m := re.compile(r"\(([^)]*)\)|\[([^\]]*)\]").match(symbol, at)):
            out.append((m[1] if m[1] is not None else m[2], "parameter" if m[1] is not None else "type-parameter"))
            at = m.end()
            continue
        m = re.compile(r"`((?:[^`]|``)*)`|([\w$+-]+)").match(symbol, at)
        if not m:
            return []
        name, at = (m[1].replace("``", "`") if m[1] is not None else m[2]), m.end()
        overload = re.compile(r"\([\w+-]*\)\.").match(symbol, at)
        if overload:
            out.append((name, "method"))
            at = overload.end()
            continue
        kind = next(((s, k) for s, k in _SUFFIXES if symbol.startswith(s, at)), None)
        if kind is None:
            return []
        out.append((name, kind[1]))
        at += len(kind[0])
    return out


def qualified_name(descriptors: list[tuple[str, str]], path: str) -> str:
    """Names joined by points, without the longest leading namespaces that spell the file's path."""
    names = [n for n, _ in descriptors]
    spaces = next((i for i, (_, k) in enumerate(descriptors) if k != "namespace"), len(descriptors))
    for k in range(spaces, 0, -1):
        if "/".join(names[:k]) == path or path.endswith("/" + "/".join(names[:k])):
            return ".".join(names[k:])
    return ".".join(names[spaces:])


def node_type(kind: int, descriptors: list[tuple[str, str]]) -> str | None:
    """The node type of a symbol: its declared kind, else its last descriptor's; parameters and macros have none."""
    if not descriptors or descriptors[-1][1] in ("parameter", "type-parameter", "macro", "meta"):
        return None
    if kind in KINDS:
        return KINDS[kind]
    last = descriptors[-1][1]
    if last == "namespace":
        return "file"
    if last == "method" and (len(descriptors) < 2 or descriptors[-2][1] != "type"):
        return "function"
    if last == "term" and len(descriptors) > 1 and descriptors[-2][1] == "type":
        return "property"
    return _NODE_OF.get(last)


_ROWS = "path string, language string, symbol string, kind string, node_type string, name string, qualified_name string, start_line int, start_char int, end_line int, end_char int, size long, other string, implementation boolean"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the index files at a path: ``kind`` definition, reference or relation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["content"]:
                for d in decode_index(bytes(raw))["documents"]:
                    info = {s["symbol"]: s for s in d["symbols"]}
                    seen = set()
                    for o in d["occurrences"]:
                        at = _range(o["range"])
                        if at is None or o["symbol"].startswith("local "):
                            continue
                        ds = parse_symbol(o["symbol"])
                        base = {"path": d["path"], "language": d["language"], "symbol": o["symbol"], "start_line": at[0], "start_char": at[1], "end_line": at[2], "end_char": at[3]}
                        if o["roles"] & 1:
                            kind = node_type(info.get(o["symbol"], {}).get("kind", 0), ds)
                            if o["symbol"] in seen or kind is None:
                                continue
                            seen.add(o["symbol"])
                            whole = _range(o["enclosing"]) or at
                            size = (whole[2] - whole[0]) * 10_000 + whole[3] - whole[1]
                            rows.append(base | {"kind": "definition", "node_type": kind, "name": info.get(o["symbol"], {}).get("name") or ds[-1][0], "qualified_name": qualified_name(ds, d["path"]), "start_line": whole[0], "start_char": whole[1], "end_line": whole[2], "end_char": whole[3], "size": size})
                        else:
                            rows.append(base | {"kind": "reference"})
                    for s in d["symbols"]:
                        rows += [{"path": d["path"], "symbol": s["symbol"], "kind": "relation", "other": o, "implementation": i} for o, i in s["relations"] if i]
            names = [c.split(" ")[0] for c in _ROWS.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("start_line", "start_char", "end_line", "end_char")} | {"size": "Int64"})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _ROWS)
    return raw.withColumn("language", F.coalesce("language", paths.language(F.col("path"))))


def _inside(line: Column, char: Column) -> Column:
    """Whether a place lies in the range of the definition, both ends included."""
    after = (F.col("start_line") < line) | ((F.col("start_line") == line) & (F.col("start_char") <= char))
    before = (F.col("end_line") > line) | ((F.col("end_line") == line) & (F.col("end_char") >= char))
    return after & before


def attribute(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each reference with the symbol of the smallest definition around it, null at file level.

    An equi-join on the path with the range as residue, then one partially aggregated minimum.
    """
    r = references.select(F.monotonically_increasing_id().alias("_r"), "path", "symbol", F.col("start_line").alias("line"), F.col("start_char").alias("char"))
    d = definitions.filter("node_type <> 'file'").select("path", F.col("symbol").alias("holder"), "start_line", "start_char", "end_line", "end_char", "size")
    hits = r.join(d, "path", "left").filter(F.col("holder").isNull() | _inside(F.col("line"), F.col("char")))
    best = hits.groupBy("path", "symbol", "line", "char").agg(F.min_by("holder", F.struct("size", "holder")).alias("holder"))
    return r.select("path", "symbol", "line", "char").join(best, ["path", "symbol", "line", "char"], "left")


def code_edges(index: DataFrame) -> DataFrame:
    """``source_symbol, relationship, target_symbol, occurrences`` of an index; a null source is the file's own node (``path``).

    A reference to a function or method from a definition is a call, other references are references; a
    symbol of another file is also an import; implementations extend classes and implement the rest.
    """
    d = index.filter("kind = 'definition'").cache()
    places = attribute(index.filter("kind = 'reference'"), d)
    target = d.select("symbol", F.col("node_type").alias("t_type"), F.col("path").alias("t_path"))
    e = places.join(target, "symbol").filter(~F.col("holder").eqNullSafe(F.col("symbol")))
    rel = F.when(F.col("t_type").isin("function", "method") & F.col("holder").isNotNull(), "CALLS").otherwise("REFERENCES")
    uses = e.select("path", F.col("holder").alias("source_symbol"), rel.alias("relationship"), F.col("symbol").alias("target_symbol"))
    imports = e.filter("path <> t_path").select("path", F.lit(None).cast("string").alias("source_symbol"), F.lit("IMPORTS").alias("relationship"), F.col("t_path").alias("target_symbol")).distinct()
    kinds = d.select(F.col("symbol").alias("other"), F.col("node_type").alias("o_type"))
    inherits = index.filter("kind = 'relation' AND implementation").join(kinds, "other").select("path", F.col("symbol").alias("source_symbol"), F.when(F.col("o_type") == "class", "EXTENDS").otherwise("IMPLEMENTS").alias("relationship"), F.col("other").alias("target_symbol"))
    return uses.union(imports).union(inherits).groupBy("path", "source_symbol", "relationship", "target_symbol").agg(F.count("*").alias("occurrences"))
