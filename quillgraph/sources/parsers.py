"""Text parsers, one document at a time. Each is total: malformed text gives fewer facts, never an error."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import yaml

# ---------------------------------------------------------------- Markdown

_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_STARTS = _WORD - frozenset("0123456789") | {"$"}


def _run(line: str, at: int, mark: str) -> int:
    """How often a character stands there in a row."""
    n = at
    while n < len(line) and line[n] == mark:
        n += 1
    return n - at


def _margin(line: str) -> int:
    """Leading blanks; more than three make a line that is no heading and no fence."""
    return len(line) - len(line.lstrip())


def _fence_of(line: str) -> tuple[str, int, str] | None:
    """Mark, its length and the first word after it, of a line that opens or closes a fence."""
    at = _margin(line)
    if at > 3 or at == len(line) or line[at] not in "`~":
        return None
    n = _run(line, at, line[at])
    return (line[at], n, (line[at + n :].split() or [""])[0]) if n >= 3 else None


def _heading_of(line: str) -> tuple[int, str] | None:
    """Level and text of a heading that begins with number signs."""
    at = _margin(line)
    n = _run(line, at, "#")
    rest = line[at + n :]
    if at > 3 or not 1 <= n <= 6 or rest[:1].strip() or not rest:
        return None
    return n, rest.strip().rstrip("#").rstrip()


def _spans(line: str) -> list[tuple[int, int, str]]:
    """Begin, end and body of code spans: between two runs of as many back ticks."""
    out, at = [], 0
    while (at := line.find("`", at)) >= 0:
        n = _run(line, at, "`")
        close = at + n
        while (close := line.find("`", close)) >= 0 and _run(line, close, "`") != n:
            close += _run(line, close, "`")
        if close < 0:
            at += n
            continue
        out.append((at, close + n, line[at + n : close]))
        at = close + n
    return out


def _links(line: str) -> list[tuple[int, int, str, str]]:
    """Begin, end, text and target of inline links."""
    out, at = [], 0
    while (at := line.find("[", at)) >= 0:
        close = line.find("]", at)
        if close < 0:
            break
        if line[close + 1 : close + 2] != "(":
            at += 1
            continue
        k = close + 2 + _margin(line[close + 2 :])
        k += line[k : k + 1] == "<"
        end = k
        while end < len(line) and line[end] not in ")>" and not line[end].isspace():
            end += 1
        target, rest = line[k:end], line[end + (line[end : end + 1] == ">") :]
        body = rest.lstrip()
        if body[:1] == '"' and rest[:1].isspace() and (stop := body.find('"', 1)) > 0:
            body = body[stop + 1 :].lstrip()  # a title
        if target and body[:1] == ")":
            end = len(line) - len(body) + 1
            out.append((at, end, line[at + 1 : close], target))
            at = end
        else:
            at += 1
    return out


def _plain(text: str) -> str:
    """Text without marks: of code, of links but their text, of stress."""
    for a, b, body in reversed(_spans(text)):
        text = text[:a] + body + text[b:]
    for a, b, body, _ in reversed(_links(text)):
        text = text[:a] + body + text[b:]
    for mark in "*_":
        parts, at = [], 0
        while (k := text.find(mark, at)) >= 0:
            n = min(_run(text, k, mark), 3)
            close = text.find(mark, k + n)
            parts.append(text[at:k])
            if close > k + n:
                parts.append(text[k + n : close])
                at = close + min(_run(text, close, mark), n)
            else:
                parts.append(text[k : k + n])
                at = k + n
        text = "".join(parts) + text[at:]
    return text.strip()


def _member_end(text: str, at: int) -> int:
    """The end of the identifier that begins there; the place itself where none does."""
    if at >= len(text) or text[at] not in _STARTS:
        return at
    while at < len(text) and (text[at] in _WORD or text[at] == "$"):
        at += 1
    return at


def _is_path(name: str) -> bool:
    """Identifiers joined by points, as code names things."""
    at = 0
    while True:
        end = _member_end(name, at)
        if end == at:
            return False
        if end == len(name):
            return True
        if name[end] != ".":
            return False
        at = end + 1


def _distinctive(word: str) -> bool:
    """Capitalised words run together; a single one is too common a word to tell."""
    return len(word) > 2 and word.isalnum() and word[0].isupper() and not word[1].isupper() and any(c.isupper() for c in word[2:])


def _prose_names(text: str) -> Iterator[str]:
    """Distinctive names, with the member that follows a point."""
    at = 0
    while at < len(text):
        if text[at] not in _WORD:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in _WORD:
            end += 1
        if _distinctive(text[at:end]):
            member = _member_end(text, end + 1) if text[end : end + 1] == "." else end
            end = member if member > end + 1 else end
            yield text[at:end]
        at = end


def markdown(text: str) -> dict:
    """``headings (line, level, text), links (line, text, target), mentions (line, name, form), code (line, end, language), lines``."""
    lines = text.split("\n")
    out: dict = {"headings": [], "links": [], "mentions": [], "code": [], "lines": len(lines)}
    body = 0
    if lines[0].strip() == "---":  # front matter, if it ends
        body = next((i + 1 for i, line in enumerate(lines) if i and line.strip() == "---"), 0)
    opened: tuple[str, int, str, int] | None = None
    for n, line in enumerate(lines[body:], body + 1):
        fence = _fence_of(line)
        if opened is not None:
            if fence and fence[0] == opened[0] and fence[1] >= opened[1] and not fence[2]:
                out["code"].append((opened[3], n, opened[2]))
                opened = None
            continue
        if fence:
            opened = (fence[0], fence[1], fence[2].lower(), n)
            continue
        if heading := _heading_of(line):
            out["headings"].append((n, heading[0], _plain(heading[1])))
            continue
        out["links"] += [(n, _plain(label), target) for _, _, label, target in _links(line)]
        prose, at = [], 0
        for a, b, code in _spans(line):
            name = code.strip().removesuffix("()")
            if _is_path(name):
                out["mentions"].append((n, name, "code-span"))
            prose.append(line[at:a])
            at = b
        out["mentions"] += [(n, name, "prose") for name in _prose_names(" ".join([*prose, line[at:]]))]
    if opened is not None:
        out["code"].append((opened[3], len(lines), opened[2]))
    return out


# ---------------------------------------------------------------- SQL

_SQL_TOKEN = re.compile(r"""(?P<skip>--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|\s+)|(?P<name>"[^"]+"|`[^`]+`|\[[A-Za-z_][^\]]*\]|[A-Za-z_][\w$]*)|(?P<num>\d[\w.]*)|(?P<sign>.)""", re.S | re.ASCII)
#: Words that end a column's type, words that begin a table constraint.
_TYPE_ENDS = {"not", "null", "primary", "unique", "default", "references", "check", "constraint", "generated", "collate", "identity", "auto_increment"}
_CONSTRAINTS = {"constraint", "primary", "foreign", "unique", "check", "exclude", "key", "index", "like"}


def blank_noise(text: str) -> str:
    """Comments, single-quoted and back-ticked text as blanks of the same length, line breaks kept."""
    noise = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|\"[^\"]*\"|`(?:[^`]|``)*(?:`|\Z)", re.S)
    return noise.sub(lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), text)


def _tiled(pattern: re.Pattern, text: str) -> tuple[list[tuple[str, str, int]], int]:
    """``(kind, text, line)`` of the matches of a pattern that leaves no gap, without those named ``skip``; and the last match's line."""
    out, line, last = [], 1, 1
    for m in pattern.finditer(text):
        kind, t, last = m.lastgroup, m[0], line
        if kind != "skip":
            out.append((kind, t, line))
        if "\n" in t:
            line += t.count("\n")
    return out, last


@functools.lru_cache(maxsize=1)
def _sql_tokens(text: str) -> list[tuple[str, str, int]]:
    """Tokens of SQL text, read once for the schema and the accesses of a file; nobody changes the list."""
    return _tiled(_SQL_TOKEN, text)[0]


@dataclass
class Table:
    name: str
    line: int
    columns: dict[str, dict] = field(default_factory=dict)
    primary_key: list[str] = field(default_factory=list)


class _Words:
    """A cursor over tokens (kind, text, line, start)."""

    def __init__(self, items: list[tuple]):
        self.items, self.low, self.at = items, [t.lower() for _, t, _ in items], 0

    def peek(self, k: int = 0) -> str:
        return self.low[self.at + k] if self.at + k < len(self.low) else ""

    def line(self) -> int:
        return self.items[min(self.at, len(self.items) - 1)][2]

    def take(self, *words: str) -> bool:
        if self.low[self.at : self.at + len(words)] == list(words):
            self.at += len(words)
            return True
        return False

    def name(self) -> str | None:
        """A possibly qualified identifier; its last part."""
        found = None
        while self.at < len(self.items) and self.items[self.at][0] == "name":
            found = self.items[self.at][1].strip('"`[]')
            self.at += 1
            if not self.take("."):
                break
        return found if found and re.fullmatch(r"[A-Za-z_][\w$]*", found, re.ASCII) else None

    def group(self) -> list[tuple]:
        """Tokens of the bracket that opens here, without its ends."""
        depth, start = 0, self.at
        while self.at < len(self.items):
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            self.at += 1
            if depth == 0:
                return self.items[start + 1 : self.at - 1]
        self.at = start + 1
        return []


def _split(tokens: list[tuple]) -> list[list[tuple]]:
    parts, depth = [[]], 0
    for t in tokens:
        depth += {"(": 1, ")": -1}.get(t[1], 0)
        if t[1] == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _names(w: _Words) -> list[str]:
    return [n for p in _split(w.group()) if (n := _Words(p).name())] if w.peek() == "(" else []


def _type_text(tokens: list[tuple]) -> str | None:
    text = ""
    for kind, t, _ in tokens:
        if t.lower() in _TYPE_ENDS:
            break
        text += t if not text or t in "(),[]" or text[-1] in "([" else f" {t}"
    return text.upper() if text[:1].isalpha() else None


def _column(tokens: list[tuple], table: Table, keys: list[dict]) -> None:
    if not tokens:
        return
    w = _Words(tokens)
    line = w.line()
    if w.peek().strip('"`[]') in _CONSTRAINTS:
        while w.at < len(tokens):
            if w.take("primary", "key"):
                table.primary_key += _names(w)
            elif w.take("foreign", "key"):
                own = _names(w)
                if w.take("references") and (target := w.name()):
                    keys.append({"from_table": table.name, "from_column": (own or [None])[0], "to_table": target, "to_column": (_names(w) or [None])[0], "line": line})
            else:
                w.at += 1
        return
    name = w.name()
    if name is None or w.at >= len(tokens):
        return
    rest = tokens[w.at :]
    words = [t.lower() for _, t, _ in rest]
    pairs = set(zip(words, words[1:], strict=False))
    table.columns.setdefault(name, {"type": _type_text(rest), "not_null": ("not", "null") in pairs, "primary_key": ("primary", "key") in pairs, "unique": "unique" in words, "line": line})
    if ("primary", "key") in pairs:
        table.primary_key.append(name)
    if "references" in words:
        w.at += words.index("references") + 1
        if target := w.name():
            keys.append({"from_table": table.name, "from_column": name, "to_table": target, "to_column": (_names(w) or [None])[0], "line": line})


def sql_schema(text: str) -> dict:
    """``tables`` (by name), ``foreign_keys``, ``indexes`` of DDL text."""
    w = _Words(_sql_tokens(text))
    tables: dict[str, Table] = {}
    keys: list[dict] = []
    indexes: list[dict] = []
    while w.at < len(w.items):
        if w.peek() not in ("create", "alter"):
            w.at += 1
            continue
        line = w.line()
        if w.take("create"):
            while w.peek() in ("or", "replace", "global", "local", "temp", "temporary", "unlogged"):
                w.at += 1
            unique = w.take("unique")
            if w.take("table"):
                w.take("if", "not", "exists")
                name = w.name()
                if name and w.peek() == "(":
                    t = tables.setdefault(name, Table(name, line))
                    for part in _split(w.group()):
                        _column(part, t, keys)
            elif w.take("index"):
                w.take("concurrently")
                w.take("if", "not", "exists")
                name = None if w.peek() == "on" else w.name()
                if w.take("on"):
                    w.take("only")
                    on = w.name()
                    if w.take("using"):
                        w.name()
                    if on:
                        indexes.append({"name": name, "table": on, "columns": _names(w), "unique": unique, "line": line})
        elif w.take("alter", "table"):
            w.take("if", "exists")
            w.take("only")
            name = w.name()
            if name and w.take("add", "column"):
                w.take("if", "not", "exists")
                end = w.at
                while end < len(w.items) and w.items[end][1] != ";":
                    end += 1
                _column(w.items[w.at : end], tables.setdefault(name, Table(name, line)), keys)
        else:
            w.at += 1
    return {"tables": tables, "foreign_keys": keys, "indexes": indexes}


#: Words that a table's access begins with.
_ACCESS = frozenset(("create", "alter", "insert", "delete", "truncate", "update", "from", "join", "select"))
#: Words after FROM that are no tables.
NOT_A_TABLE = ("select", "dual", "unnest", "generate_series", "values", "lateral", "json_table", "table")


def table_accesses(text: str, ddl: bool = True) -> list[tuple[str, str, str, int]]:
    """``(table, access, statement, line)`` of SQL text, the first of each table and access; [] for text without a statement.

    Without ``ddl``, statements that define tables and indexes are stepped over.
    """
    w = _Words(_sql_tokens(text))
    found: dict[tuple[str, str], tuple[str, int]] = {}
    statements = 0

    def note(access: str, statement: str) -> None:
        line, name = w.line(), w.name()
        if name and name.lower() not in NOT_A_TABLE and w.peek() != "\0":
            found.setdefault((name, access), (statement, line))

    while w.at < len(w.items):
        if w.peek() not in _ACCESS:
            w.at += 1
        elif not ddl and w.peek() in ("create", "alter") and any(w.peek(k) in ("table", "index") for k in range(1, 4)):
            while w.at < len(w.items) and w.peek() != ";":
                w.at += 1
        elif w.take("insert", "into"):
            statements += 1
            note("write", "INSERT")
        elif w.take("delete", "from"):
            statements += 1
            note("write", "DELETE")
        elif w.take("create", "table"):
            statements += 1
            w.take("if", "not", "exists")
            note("write", "CREATE TABLE")
        elif w.take("truncate"):
            statements += 1
            w.take("table")
            note("write", "TRUNCATE")
        elif w.take("update"):
            statements += 1
            w.take("only")
            at = w.at
            if w.name() and w.peek() == "set":
                w.at = at
                note("write", "UPDATE")
        elif w.take("from"):
            note("read", "SELECT")
        elif w.take("join"):
            note("read", "JOIN")
        elif w.take("select"):
            statements += 1
        else:
            w.at += 1
    return [(t, a, s, line) for (t, a), (s, line) in found.items()] if statements else []


# ---------------------------------------------------------------- JSON and YAML as flat rows

#: Deepest level that is kept.
DEEP = 64
_JSON_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:[^"\\\n]|\\.)*"?)|(?P<word>[-+\w.]+)|(?P<sign>.)', re.S)
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][-+]?\d+)?")
Row = tuple[str, int, str, str | None, int]  # path, depth, kind, value, line


def json_rows(text: str) -> list[Row]:
    """Flat rows of JSON with comments and trailing commas; a repeated key's last value stands in the first one's place."""
    tokens, line = _tiled(_JSON_TOKEN, text)
    at = 0

    def string(raw: str) -> str:
        if raw[0] == '"' and "\\" not in raw:
            return raw.strip('"')
        try:
            return json.loads(raw)
        except ValueError:
            return raw.strip('"')

    def plain(raw: str) -> tuple[str, str | None]:
        if raw in ("true", "false"):
            return "boolean", raw
        return ("number", raw) if _NUMBER.fullmatch(raw) else ("null", None)

    def value(path: str, depth: int) -> list[Row]:
        nonlocal at
        if at >= len(tokens):
            return [(path, depth, "null", None, line)]
        kind, raw, own = tokens[at]
        at += 1
        if raw == "{":
            members: dict[str, list[Row]] = {}
            while at < len(tokens) and tokens[at][1] != "}":
                if tokens[at][0] in ("str", "word") and at + 1 < len(tokens) and tokens[at + 1][1] == ":":
                    key = string(tokens[at][1])
                    at += 2
                    below = f"{path}.{key}" if path else key
                    if at < len(tokens) and tokens[at][0] == "word":  # most values: no call of their own
                        members[key] = [(below, depth + 1, *plain(tokens[at][1]), tokens[at][2])]
                        at += 1
                    else:
                        members[key] = value(below, depth + 1)
                else:
                    at += 1
            at += 1
            return [(path, depth, "object", None, own)] + [r for rows in members.values() for r in rows if depth < DEEP]
        if raw == "[":
            items: list[Row] = []
            n = 0
            while at < len(tokens) and tokens[at][1] != "]":
                if tokens[at][1] == ",":
                    at += 1
                    continue
                items += value(f"{path}[{n}]", depth + 1)
                n += 1
            at += 1
            return [(path, depth, "array", None, own)] + (items if depth < DEEP else [])
        if kind == "str":
            return [(path, depth, "string", string(raw), own)]
        return [(path, depth, *plain(raw), own)]

    return value("", 0)


_CORE = ((re.compile(r"^(?:|~|null|Null|NULL)$"), "null"), (re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), "boolean"), (re.compile(r"^[-+]?(?:0|[1-9]\d*|0o[0-7]+|0x[0-9a-fA-F]+|(?:\.\d+|\d+(?:\.\d*)?)(?:[eE][-+]?\d+)?|\.(?:inf|nan))$"), "number"))


def yaml_rows(text: str) -> list[Row]:
    """Flat rows of the first YAML document by the core schema of YAML 1.2: ``on``, ``yes`` and dates are text, aliases null, repeated keys all kept."""
    rows: list[Row] = []
    stack: list[dict] = []
    started = False

    def place() -> str:
        if not stack:
            return ""
        top = stack[-1]
        if top["kind"] == "array":
            top["n"] += 1
            return f"{top['path']}[{top['n'] - 1}]"
        key = top.pop("key", None)
        return f"{top['path']}.{key}" if top["path"] else f"{key}"

    def add(kind: str, value: str | None, line: int) -> None:
        if stack and stack[-1]["kind"] == "object" and "key" not in stack[-1]:
            stack[-1]["key"] = "" if value is None else value
            return
        path = place()
        if len(stack) <= DEEP:
            rows.append((path, len(stack), kind, value, line))

    try:
        for e in yaml.parse(text, Loader=yaml.SafeLoader):
            line = e.start_mark.line + 1
            if isinstance(e, yaml.DocumentStartEvent):
                if started:
                    break
                started = True
            elif isinstance(e, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
                kind = "object" if isinstance(e, yaml.MappingStartEvent) else "array"
                path = place() if not (stack and stack[-1]["kind"] == "object" and "key" not in stack[-1]) else stack[-1].setdefault("key", "?") and place()
                if len(stack) <= DEEP:
                    rows.append((path, len(stack), kind, None, line))
                stack.append({"kind": kind, "path": path, "n": 0})
            elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                stack.pop()
            elif isinstance(e, yaml.AliasEvent):
                add("null", None, line)
            elif isinstance(e, yaml.ScalarEvent):
                kind = "string" if not e.implicit[0] else next((k for p, k in _CORE if p.match(e.value)), "string")
                add(kind, None if kind == "null" and not (stack and stack[-1]["kind"] == "object" and "key" not in stack[-1]) else e.value, line)
    except yaml.YAMLError:
        pass
    return rows or [("", 0, "null", None, 1)]


def structured(path: str, text: str) -> list[Row]:
    return yaml_rows(text) if path.lower().endswith((".yml", ".yaml")) else json_rows(text)


# ---------------------------------------------------------------- Prisma

def prisma(text: str) -> dict:
    """``provider`` and ``models`` (name to table name)."""
    provider, models, block = None, {}, None
    for line in text.split("\n"):
        line = re.sub(r"//.*", "", line).strip()
        if m := re.match(r"(datasource|model)\s+(\w+)\s*\{", line):
            block = (m[1], m[2])
            if m[1] == "model":
                models[m[2]] = m[2]
        elif line == "}":
            block = None
        elif block and block[0] == "datasource" and (m := re.match(r'provider\s*=\s*"([^"]+)"', line)):
            provider = m[1]
        elif block and block[0] == "model" and (m := re.match(r'@@map\(\s*(?:name:\s*)?"([^"]+)"', line)):
            models[block[1]] = m[1]
    return {"provider": provider, "models": models}


# ---------------------------------------------------------------- program text

_CODE_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>'(?:[^'\\\n]|\\.)*'?|"(?:[^"\\\n]|\\.)*"?)|(?P<tpl>`(?:[^`\\]|\\.)*(?:`|\Z))|(?P<name>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<sign>=>|\.\.\.|\?\.|.)""",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int

    @property
    def value(self) -> str:
        """The text of a literal; substitutions of a template become a NUL."""
        body = self.text[1:-1] if len(self.text) > 1 and self.text[-1] == self.text[0] else self.text[1:]
        return re.sub(r"\$\{[^}]*\}", "\0", body) if self.kind == "tpl" else body


def code_tokens(text: str) -> list[Token]:
    """Tokens without blanks and comments; strings and templates are one token each."""
    return [Token(*t) for t in _tiled(_CODE_TOKEN, text)[0]]


def calls(tokens: list[Token]) -> Iterator[tuple[list[str], list[list[Token]], int, str]]:
    """Every call ``a.b.c(...)``: the dotted name, its arguments' tokens, its line, and what stands before it (``new``, ``@``)."""
    for names, args, line, before, _ in calls_at(tokens):
        yield names, args, line, before


def calls_at(tokens: list[Token]) -> Iterator[tuple[list[str], list[list[Token]], int, str, int]]:
    """The same with the place of the opening bracket."""
    for i, t in enumerate(tokens):
        if t.text != "(" or not i or tokens[i - 1].kind != "name":
            continue
        names, k = [tokens[i - 1].text], i - 2
        while k >= 1 and tokens[k].text in (".", "?.") and tokens[k - 1].kind == "name":
            names.insert(0, tokens[k - 1].text)
            k -= 2
        if names[-1] in ("if", "for", "while", "switch", "catch", "function", "return"):
            continue
        args, depth, own = [], 0, []
        for t2 in tokens[i + 1 :]:
            if t2.text in "([{" and t2.kind == "sign":
                depth += 1
            elif t2.text in ")]}" and t2.kind == "sign":
                depth -= 1
                if depth < 0:
                    break
            if t2.text == "," and depth == 0:
                args.append(own)
                own = []
            else:
                own.append(t2)
        if own:
            args.append(own)
        yield names, args, tokens[i - 1].line, tokens[k].text if k >= 0 else "", i


def imports(tokens: list[Token]) -> list[dict]:
    """``kind (import, export), module, names [(name, local)], default (local), line`` of import and re-export statements, require() and import()."""
    out = []
    for i, t in enumerate(tokens):
        if t.kind != "name" or t.text not in ("import", "export", "require") or (i and tokens[i - 1].text == "."):
            continue
        if t.text == "require" or tokens[i + 1 : i + 2] and tokens[i + 1].text == "(":
            if i + 2 < len(tokens) and tokens[i + 1].text == "(" and tokens[i + 2].kind == "str":
                out.append({"kind": "import", "module": tokens[i + 2].value, "names": [], "default": None, "line": t.line})
            continue
        names, k, module, default = [], i + 1, None, None
        while k < len(tokens) and tokens[k].text != ";":
            if tokens[k].kind == "str":
                module = tokens[k].value
                break
            if tokens[k].text == "}" and not (tokens[k + 1 : k + 2] and tokens[k + 1].text == "from"):
                break
            if tokens[k].kind == "name" and tokens[k].text in ("const", "let", "var", "function", "class", "interface", "enum", "async", "abstract", "declare", "namespace") or tokens[k].text in ("=", "("):
                break
            if tokens[k].kind == "name" and tokens[k].text not in ("type", "from", "as", "default", "import"):
                if tokens[k - 1].text == "as" and names:
                    names[-1] = (names[-1][0], tokens[k].text)
                elif tokens[k - 2 : k - 1] and tokens[k - 1].text == "as" and tokens[k - 2].text == "*":
                    names.append(("*", tokens[k].text))
                else:
                    names.append((tokens[k].text, tokens[k].text))
                    if k == i + 1 or k == i + 2 and tokens[i + 1].text == "type":
                        default = tokens[k].text
            k += 1
        if module is not None:
            out.append({"kind": t.text, "module": module, "names": names, "default": default, "line": t.line})
    return out
