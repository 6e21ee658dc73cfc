"""Whether a check's text is of a finite grammar that can be run as a filter: names, literals, comparisons, AND, OR, NOT, IS tests and plain casts."""

from __future__ import annotations

import re

TOKEN = re.compile(r"""\s*(?:(?P<text>[Ee]?'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")+"|[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<op><=|>=|<>|!=|::|[-=<>().,+]))""")
CASTS = frozenset("smallint integer bigint numeric real text varchar boolean date timestamp timestamptz".split()) | {"double precision"}
DEPTH = 128


class _Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError("unknown token")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = self.depth = 0

    def peek(self) -> str:
        if self.i >= len(self.items):
            return ""
        kind, value = self.items[self.i]
        return value.upper() if kind in ("name", "op") and not value.startswith('"') else ""

    def eat(self, *words: str) -> bool:
        for k, w in enumerate(words):
            if self.i + k >= len(self.items) or self.items[self.i + k][0] == "text" or self.items[self.i + k][1].upper() != w:
                return False
        self.i += len(words)
        return True

    def need(self, word: str) -> None:
        if not self.eat(word):
            raise ValueError(f"expected {word}")

    def either(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise ValueError("too deep")
        self.both()
        while self.eat("OR"):
            self.both()
        self.depth -= 1

    def both(self) -> None:
        self.negated()
        while self.eat("AND"):
            self.negated()

    def negated(self) -> None:
        while self.eat("NOT"):
            pass
        self.test()

    def test(self) -> None:
        self.operand()
        if self.peek() in ("=", "<", ">", "<=", ">=", "<>", "!="):
            self.i += 1
            self.operand()
        elif self.eat("IS"):
            self.eat("NOT")
            if not any(self.eat(w) for w in ("NULL", "TRUE", "FALSE", "UNKNOWN")):
                raise ValueError("unknown test")

    def operand(self) -> None:
        if self.peek() in ("-", "+"):
            self.i += 1
        if self.eat("("):
            self.either()
            self.need(")")
        elif self.i < len(self.items) and self.items[self.i][0] in ("text", "number", "name"):
            if self.peek() in ("AND", "OR", "IS", "SELECT"):
                raise ValueError("misplaced word")
            self.i += 1
            if self.eat("."):
                self.i += 1
            if self.peek() == "(":
                raise ValueError("calls aren't accepted")
        else:
            raise ValueError("expected an operand")
        while self.eat("::"):
            name = self.peek().lower()
            self.i += 1
            if name == "double" and self.eat("PRECISION"):
                name = "double precision"
            if name not in CASTS:
                raise ValueError("cast isn't accepted")
            if self.eat("("):
                while not self.eat(")"):
                    self.i += 1
                    if self.i > len(self.items):
                        raise ValueError("cast isn't closed")


def is_safe(text: str) -> bool:
    try:
        p = _Parser(text)
        p.either()
        return bool(p.items) and p.i == len(p.items)
    except ValueError:
        return False


def to_spark(text: str) -> str:
    """A safe expression as Spark SQL: names in backticks, casts as functions of the same kinds."""
    if not is_safe(text):
        raise ValueError("not a safe expression")
    out = re.sub(r"'(?:[^']|'')*'|\"((?:[^\"]|\"\")+)\"", lambda m: m[0] if m[1] is None else "`" + m[1].replace('""', '"').replace("`", "``") + "`", text)
    return re.sub(r"::\s*(integer|text|varchar(?:\(\d+\))?|double precision|real|numeric)", lambda m: "::" + {"integer": "int", "double precision": "double", "real": "float", "numeric": "decimal(38,18)"}.get(m[1], "string"), out)
