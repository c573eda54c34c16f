"""The shape of program text: declarations with their extents, signatures, decorators and constants.

One pass over the tokens of a module. Brackets are paired first, so every declaration knows where its
parameters and its body end; ``owner`` then says for each token which declaration it lies in. Like the
other parsers this one is total: what it does not understand it steps over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .parsers import Token

#: Words that stand before a member's name, words that are no member's name, names of built-in types.
MODIFIERS = frozenset(("public", "private", "protected", "static", "async", "readonly", "override", "abstract", "get", "set", "declare", "accessor"))
NO_MEMBER = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "new", "typeof", "await", "throw", "else", "do", "super", "this"))
BUILT_IN = frozenset((
    "string", "number", "boolean", "void", "any", "unknown", "never", "null", "undefined", "object", "symbol", "bigint", "true", "false", "this", "keyof", "typeof", "readonly", "infer", "extends", "is", "asserts", "unique", "new",
    "Promise", "Array", "ReadonlyArray", "Record", "Map", "Set", "Partial", "Required", "Readonly", "Pick", "Omit", "Exclude", "Extract", "NonNullable", "ReturnType", "Date", "Error", "RegExp", "Buffer", "Iterable", "AsyncIterable", "Function",
))


@dataclass
class Decorator:
    name: str
    args: list[list[Token]]
    line: int
    at: int  # its first token


@dataclass
class Declaration:
    kind: str  # class, interface, enum, type, function, method, variable
    name: str
    line: int
    start: int  # first and last token, both included
    end: int
    holder: Declaration | None = None
    params: list[tuple[str, list[str]]] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)
    decorators: list[Decorator] = field(default_factory=list)
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    callable: bool = False
    exported: bool = False
    last_line: int = 0

    @property
    def qualified(self) -> str:
        return f"{self.holder.name}.{self.name}" if self.holder else self.name


class Program:
    """``declarations`` in the order of the text; ``constants``: names of string values; ``owner``: the innermost declaration of each token."""

    def __init__(self, tokens: list[Token]):
        self.tokens = tokens
        self.pair = self._pairs()
        self.declarations: list[Declaration] = []
        self.constants: dict[str, str] = {}
        self.exported: dict[str, str] = {}  # name outside: name inside
        self._pending: list[Decorator] = []
        self._block(0, len(tokens), None)
        self.owner: list[Declaration | None] = [None] * len(tokens)
        for d in self.declarations:  # outer ones come first
            d.last_line = tokens[min(d.end, len(tokens) - 1)].line
            if d.kind not in ("type", "variable") or d.callable:
                self.owner[d.start : d.end + 1] = [d] * (min(d.end, len(tokens) - 1) - d.start + 1)

    # ------------------------------------------------------------ brackets and small steps

    def _pairs(self) -> dict[int, int]:
        opened: list[int] = []
        out: dict[int, int] = {}
        for i, t in enumerate(self.tokens):
            if t.kind != "sign":
                continue
            if t.text in "([{":
                opened.append(i)
            elif t.text in ")]}":
                while opened:
                    a = opened.pop()
                    if self.tokens[a].text + t.text in ("()", "[]", "{}"):
                        out[a] = i
                        break
        return out

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def after(self, i: int) -> int:
        """The place after the bracket that opens at i, or after i."""
        return self.pair.get(i, i if self.text(i) not in "([{" or not self.text(i) else len(self.tokens) - 1) + 1

    def angles(self, i: int) -> int:
        """The place after type parameters that open at i; i where there are none or they never close."""
        if self.text(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.tokens) and self.text(k) not in (";", "{"):
            depth += {"<": 1, ">": -1}.get(self.text(k), 0)
            if depth == 0:
                return k + 1
            k = self.after(k) if self.text(k) in ("(", "[") else k + 1
        return i

    # ------------------------------------------------------------ types and parameters

    def type_names(self, a: int, b: int) -> list[str]:
        """Names of types among tokens a .. b-1, built-in ones and keys of object types left out."""
        out: list[str] = []
        for k in range(a, b):
            if not self.is_name(k) or self.text(k) in BUILT_IN or self.text(k + 1) == ":" or self.text(k - 1) == ".":
                continue
            if self.text(k + 1) == "?" and self.text(k + 2) == ":":
                continue
            if self.text(k) not in out:
                out.append(self.text(k))
        return out

    def parameters(self, a: int) -> list[tuple[str, list[str]]]:
        """Name and type names of the parameters in the bracket that opens at a."""
        end, k, out = self.pair.get(a, a), a + 1, []
        while k < end:
            start = k
            while k < end and self.text(k) != ",":
                k = max(self.angles(k), self.after(k)) if self.text(k) in ("(", "[", "{", "<") else k + 1
            part = range(start, k)
            colon = next((j for j in part if self.text(j) == ":" and not any(x < j < self.pair.get(x, x) for x in part if self.text(x) in "([{")), None)
            stop = next((j for j in range(colon or k, k) if self.text(j) == "="), k)
            name = next((self.text(j) for j in range((colon or stop) - 1, start - 1, -1) if self.is_name(j)), "")
            out.append((name, self.type_names(colon + 1, stop) if colon else []))
            k += 1
        return out

    def signature(self, d: Declaration, a: int) -> int:
        """Reads parameters at a and the type of what is returned; the place of the body or after the head."""
        d.params = self.parameters(a)
        k = self.after(a)
        if self.text(k) == ":":
            start = k = k + 1
            while k < len(self.tokens) and self.text(k) not in (";", "=>", "="):
                if self.text(k) == "{" and k > start and self.text(k - 1) not in ("|", "&", "<", ","):
                    break
                if self.text(k) in (")", "}", ","):
                    break
                k = max(self.angles(k), self.after(k)) if self.text(k) in ("(", "[", "{", "<") else k + 1
            d.returns = self.type_names(start, k)
        return k

    # ------------------------------------------------------------ declarations

    def _decorator(self, i: int) -> int:
        """Reads ``@name(args)`` at i; the place after it."""
        k = i + 1
        while self.is_name(k) and self.text(k + 1) == ".":
            k += 2
        if not self.is_name(k):
            return i + 1
        args: list[list[Token]] = []
        stop = k + 1
        if self.text(k + 1) == "(":
            stop = self.after(k + 1)
            own: list[Token] = []
            j = k + 2
            while j < stop - 1:
                if self.text(j) == ",":
                    args.append(own)
                    own, j = [], j + 1
                    continue
                n = self.after(j) if self.text(j) in ("(", "[", "{") else j + 1
                own += self.tokens[j:n]
                j = n
            if own:
                args.append(own)
        self._pending.append(Decorator(self.text(k), args, self.tokens[i].line, i))
        return stop

    def _put(self, d: Declaration) -> Declaration:
        d.decorators, self._pending = self._pending, []
        self.declarations.append(d)
        return d

    def _exports(self, i: int) -> bool:
        """Whether ``export`` stands before the declaration at i."""
        k = i - 1
        while self.text(k) in ("async", "abstract", "default", "declare"):
            k -= 1
        if self.text(k) != "export":
            return False
        name = next((self.text(j) for j in range(i, i + 4) if self.is_name(j) and self.text(j) not in ("class", "function", "const", "let", "var", "interface", "enum", "type", "async")), "")
        self.exported["default" if self.text(i - 1) == "default" else name] = name
        return True

    def _block(self, a: int, b: int, holder: Declaration | None) -> None:
        """Declarations among tokens a .. b-1, also those inside bodies."""
        k = a
        while k < b:
            t = self.tokens[k]
            if t.text == "@" and self.is_name(k + 1):
                k = self._decorator(k)
            elif t.kind != "name" or self.text(k - 1) in (".", "?."):
                k += 1
            elif t.text in ("class", "interface") and self.is_name(k + 1):
                k = self._type(k)
            elif t.text == "enum" and self.is_name(k + 1) and self.text(k + 2) == "{":
                d = self._put(Declaration("enum", self.text(k + 1), self.tokens[k + 1].line, k, self.after(k + 2) - 1, exported=self._exports(k)))
                k = d.end + 1
            elif t.text == "type" and self.is_name(k + 1) and self.text(self.angles(k + 2)) == "=":
                end = self._statement(self.angles(k + 2) + 1, b)
                self._put(Declaration("type", self.text(k + 1), self.tokens[k + 1].line, k, end - 1, exported=self._exports(k)))
                k = end
            elif t.text == "function" and (self.is_name(k + 1) or self.text(k + 1) == "*" and self.is_name(k + 2)):
                k = self._function(k, k + (2 if self.text(k + 1) == "*" else 1), holder)
            elif t.text in ("const", "let", "var") and self.is_name(k + 1):
                k = self._variable(k, b, holder)
            elif t.text == "export" and self.text(k + 1) == "{" and self.text(self.after(k + 1)) != "from":
                self._export_list(k + 2, self.after(k + 1) - 1)
                k = self.after(k + 1)
            else:
                k += 1

    def _export_list(self, a: int, b: int) -> None:
        k = a
        while k < b:
            if self.is_name(k) and self.text(k) != "type":
                if self.text(k + 1) == "as":
                    self.exported[self.text(k + 2)] = self.text(k)
                    k += 2
                else:
                    self.exported[self.text(k)] = self.text(k)
            k += 1

    def _statement(self, a: int, b: int) -> int:
        """The end of a statement that begins at a: after its semicolon, or where a line ends between brackets."""
        k = a
        while k < b and self.text(k) != ";":
            n = self.after(k) if self.text(k) in ("(", "[", "{") else k + 1
            if n < b and self.tokens[n].line > self.tokens[n - 1].line and self.is_name(n) and self.text(n - 1) not in ("=", "|", "&", ",", "=>", "(", "+", "?", ":", "."):
                return n
            k = n
        return min(k + 1, b)

    def _function(self, k: int, name: int, holder: Declaration | None) -> int:
        paren = self.angles(name + 1)
        if self.text(paren) != "(":
            return k + 1
        d = self._put(Declaration("function", self.text(name), self.tokens[name].line, k, k, callable=True, exported=self._exports(k)))
        body = self.signature(d, paren)
        d.end = self.after(body) - 1 if self.text(body) == "{" else max(body - 1, k)
        if self.text(body) == "{":
            self._block(body + 1, d.end, d)
        return d.end + 1

    def _variable(self, k: int, b: int, holder: Declaration | None) -> int:
        """A variable; its value's extent where that is a function, its text where it is a string."""
        name, at = k + 1, k + 2
        if self.text(at) == ":":
            at += 1
            while at < b and self.text(at) not in ("=", ";"):
                at = max(self.angles(at), self.after(at)) if self.text(at) in ("(", "[", "{", "<") else at + 1
        if self.text(at) != "=":
            return k + 1
        value = at + 1
        head = value + 1 if self.text(value) == "async" else value
        d = Declaration("variable", self.text(name), self.tokens[name].line, k, k, exported=self._exports(k))
        if self.text(head) == "function":
            paren = next((j for j in range(head + 1, min(head + 4, b)) if self.text(j) == "("), head)
        else:
            paren = self.angles(head)
        body = None
        if self.text(paren) == "(":
            body = self.signature(d, paren)
            if self.text(head) != "function":
                body = body + 1 if self.text(body) == "=>" else None
        elif self.is_name(head) and self.text(head + 1) == "=>":
            body = head + 2
        if body is not None:
            d.callable = True
            d.end = (self.after(body) if self.text(body) == "{" else self._statement(body, b)) - 1
            if holder is None:
                self._put(d)
            self._block(body + 1 if self.text(body) == "{" else body, d.end, holder or d)
            return d.end + 1
        d.params, d.returns = [], []
        if holder is None and self.text(value) and self.tokens[value].kind in ("str", "tpl") and self._statement(value, b) <= value + 4 and "\0" not in self.tokens[value].value:
            self.constants[d.name] = self.tokens[value].value
        elif holder is None and self.text(value) == "{":
            j = value + 1
            while j < self.pair.get(value, value):  # strings of a constant object
                if self.is_name(j) and self.text(j + 1) == ":" and j + 2 < len(self.tokens) and self.tokens[j + 2].kind == "str":
                    self.constants[f"{d.name}.{self.text(j)}"] = self.tokens[j + 2].value
                j = self.after(j) if self.text(j) in ("(", "[", "{") else j + 1
        if holder is None:
            d.end = self._statement(value, b) - 1
            self._put(d)
        return value

    def _heritage(self, d: Declaration, a: int) -> int:
        """Names after ``extends`` and ``implements`` up to the body, whose place is returned."""
        k, into = a, None
        while k < len(self.tokens) and self.text(k) not in ("{", ";"):
            word = self.text(k)
            if word in ("extends", "implements") and self.is_name(k):
                into = d.implements if word == "implements" else d.extends
                k += 1
                continue
            if self.is_name(k) and into is not None:
                while self.text(k + 1) == "." and self.is_name(k + 2):
                    k += 2
                into.append(self.text(k))
                k += 1
                k = max(self.angles(k), k)
                while self.text(k) == "(":
                    k = self.after(k)
                continue
            k = max(self.angles(k), k + 1)
        return k

    def _type(self, k: int) -> int:
        """A class or interface with its members."""
        d = self._put(Declaration(self.text(k), self.text(k + 1), self.tokens[k + 1].line, k, k, exported=self._exports(k)))
        body = self._heritage(d, self.angles(k + 2))
        if self.text(body) != "{":
            d.end = min(body, len(self.tokens) - 1)
            return body + 1
        if d.decorators:
            d.start = min(d.start, d.decorators[0].at)
        d.end = self.after(body) - 1
        self._members(body + 1, d.end, d)
        self._pending = []
        return d.end + 1

    def _members(self, a: int, b: int, holder: Declaration) -> None:
        k = a
        while k < b:
            if self.text(k) == "@" and self.is_name(k + 1):
                k = self._decorator(k)
                continue
            start = k
            while self.text(k) in MODIFIERS and (self.is_name(k + 1) or self.text(k + 1) in ("#", "[", "*")):
                k += 1
            k += 1 if self.text(k) in ("#", "*") else 0
            if not self.is_name(k):
                k = self.after(k) if self.text(k) in ("(", "[", "{") else k + 1
                continue
            paren = self.angles(k + 1 + (self.text(k + 1) == "?"))
            if self.text(paren) == "(" and self.text(k) not in NO_MEMBER:
                d = self._put(Declaration("method", self.text(k), self.tokens[k].line, start, start, holder, callable=True))
                body = self.signature(d, paren)
                d.end = (self.after(body) if self.text(body) == "{" else body) - 1
                if d.decorators:
                    d.start = d.decorators[0].at
                if self.text(body) == "{":
                    self._block(body + 1, d.end, d)
                k = d.end + 1
                continue
            k = self._property(start, k, b, holder)

    def _property(self, start: int, name: int, b: int, holder: Declaration) -> int:
        """A property; one that holds a function is a method."""
        at = name + 1
        while at < b and self.text(at) not in ("=", ";", "}") and self.tokens[at].line == self.tokens[name].line:
            at = max(self.angles(at), self.after(at)) if self.text(at) in ("(", "[", "{", "<") else at + 1
        self._pending = []
        if self.text(at) != "=":
            return max(at, name + 1)
        head = at + 2 if self.text(at + 1) == "async" else at + 1
        paren = self.angles(head)
        if self.text(paren) == "(":
            d = Declaration("method", self.text(name), self.tokens[name].line, start, start, holder, callable=True)
            body = self.signature(d, paren)
            if self.text(body) == "=>":
                body += 1
                d.end = (self.after(body) if self.text(body) == "{" else self._statement(body, b)) - 1
                self._put(d)
                self._block(body + 1 if self.text(body) == "{" else body, d.end, d)
                return d.end + 1
        return self._statement(at + 1, b)

    # ------------------------------------------------------------ attribution

    def around(self, at: int) -> tuple[Declaration | None, Declaration | None]:
        """The innermost declaration of a token and the class that holds it."""
        d = self.owner[at] if 0 <= at < len(self.owner) else None
        if d is None:
            return None, None
        return d, d if d.kind in ("class", "interface") else d.holder
