"""Whether two default expressions of a target column give the same value, however they are written.

An expression is read into a value by the reader of the column's kind; values of one kind compare as Python values do. What no
reader takes has no value, and then equality can't be told.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
import struct
from collections.abc import Callable
from decimal import Decimal

from keelson.functions.convert import NUMBER, base_of, size_of
from keelson.functions.json_check import valid
from keelson.plans.model import ColumnPlan, Kind
from keelson.plans.types import normalise

STRING = re.compile(r"(?P<mark>[EeBbXx]?)'(?P<text>(?:[^']|'')*)'")
#: What a backslash and a letter stand for in an escape string.
LETTERS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: Words of the verbose and the ISO style of intervals, in microseconds.
UNITS = {"hour": 3_600_000_000, "min": 60_000_000, "sec": 1_000_000}
ISO_UNITS = {"H": 3_600_000_000, "M": 60_000_000, "S": 1_000_000}


class Unread(ValueError):
    """No reader takes the expression."""


def _bare(expression: str) -> str:
    """Without parentheses around the whole of it."""
    text = expression.strip()
    while text.startswith("(") and text.endswith(")"):
        depth, quoted = 0, False
        for i, c in enumerate(text):
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            if not depth and i < len(text) - 1 and not quoted:
                return text
        text = text[1:-1].strip()
    return text


def _cast(text: str) -> tuple[str, str | None]:
    """(what is cast, the type) of an expression whose last operation is a cast; the type is null without one."""
    quoted, depth, at = False, 0, -1
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if not quoted and not depth and text.startswith("::", i):
            at = i
    return (text, None) if at < 0 else (text[:at], text[at + 2 :].strip())


def _escape(m: re.Match) -> str:
    if m[1] in ("", *"01234567xXuU"):
        raise Unread("numbered escapes, or a backslash at the end")
    return LETTERS.get(m[1], m[1])


def literal(expression: str) -> tuple[str, str, list[str]]:
    """(mark, text, types it is cast to) of a literal: mark is ' for strings, B, X, or empty for bare words and numbers."""
    text, casts = _bare(expression), []
    while (part := _cast(text))[1] is not None:
        casts.append(part[1])
        text = _bare(part[0])
    if m := STRING.fullmatch(text):
        inner = m["text"].replace("''", "'")
        mark = m["mark"].upper()
        if mark == "E":
            inner = re.sub(r"\\(.?)", _escape, inner, flags=re.S)
        return (mark if mark in ("B", "X") else "'"), inner, casts
    if re.fullmatch(r"[+-]?[\w.]+(?:[eE][+-]?\d+)?", text):
        return "", text.lower(), casts
    raise Unread("not a literal")


def _whole(mark: str, text: str, plan: ColumnPlan) -> int:
    if not re.fullmatch(r"[+-]?\d+", text):
        raise Unread("not a whole number")
    return int(text)


def _decimal(mark: str, text: str, plan: ColumnPlan) -> Decimal:
    if not re.fullmatch(NUMBER.replace(r"\A", "").replace(r"\z", ""), text):
        raise Unread("not a number")
    return Decimal(text)


def _float(mark: str, text: str, plan: ColumnPlan) -> bytes:
    """Its bits, so that zeros of both signs differ; not finite values aren't read."""
    if not re.fullmatch(NUMBER.replace(r"\A", "").replace(r"\z", ""), text):
        raise Unread("not a number")
    try:
        bits = struct.pack(">f" if base_of(plan.target_type) == "real" else ">d", float(text))
    except OverflowError as e:
        raise Unread("out of range") from e
    if float(text) in (float("inf"), float("-inf")):
        raise Unread("out of range")
    return bits


def _boolean(mark: str, text: str, plan: ColumnPlan) -> bool:
    words = {"true": True, "t": True, "false": False, "f": False}
    if text.lower() not in words:
        raise Unread("neither true nor false")
    return words[text.lower()]


def _bits(mark: str, text: str, plan: ColumnPlan) -> str:
    if mark == "X":
        text = "".join(format(int(c, 16), "04b") for c in text)
    if mark not in ("B", "X", "'") or not re.fullmatch("[01]*", text):
        raise Unread("not bits")
    return text


def _bytes(mark: str, text: str, plan: ColumnPlan) -> bytes:
    """In hex or in escapes."""
    if text.startswith("\\x"):
        if not re.fullmatch(r"\\x(?:[0-9a-fA-F]{2})*", text):
            raise Unread("not hex")
        return bytes.fromhex(text[2:])
    parts = re.findall(r"\\\\|\\[0-3][0-7]{2}|[^\\]|\\", text, re.S)
    if "\\" in parts:
        raise Unread("a lone backslash")
    return b"".join(b"\\" if p == "\\\\" else bytes([int(p[1:], 8)]) if p[0] == "\\" else p.encode() for p in parts)


def _moment(mark: str, text: str, plan: ColumnPlan) -> datetime.datetime:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:[ T](\d\d:\d\d(?::\d\d)?)(?:\.(\d{1,6}))?\s*(Z|[+-]\d\d(?::?\d\d)?)?)?", text)
    if not m or (m[4] and plan.kind != Kind.TIMESTAMP) or (m[2] and plan.kind == Kind.DATE) or (plan.kind == Kind.TIMESTAMP and m[2] and not m[4]):
        raise Unread("not a date or time in full")
    try:
        made = datetime.datetime.fromisoformat(f"{m[1]} {m[2] or '00:00'}").replace(microsecond=int((m[3] or "").ljust(6, "0")))
    except ValueError as e:
        raise Unread("not a calendar date") from e
    zone = (m[4] or "Z").replace("Z", "+00").replace(":", "").ljust(5, "0")
    shift = datetime.timedelta(hours=int(zone[1:3]), minutes=int(zone[3:]))
    made = made - shift if zone[0] == "+" else made + shift
    n = size_of(plan.target_type)
    if n and plan.kind != Kind.DATE and made.microsecond % 10 ** (6 - n[0]):
        raise Unread("more digits than the column keeps")
    return made


def _clock(text: str) -> int | None:
    m = re.fullmatch(r"([+-]?)(\d{1,6}):([0-5]\d)(?::([0-5]\d)(?:\.(\d{1,6}))?)?", text)
    if not m:
        return None
    size = (int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4] or 0)) * 1_000_000 + int((m[5] or "").ljust(6, "0"))
    return -size if m[1] == "-" else size


def _amounts(pairs: list[tuple[str, str]], units: dict[str, int]) -> int:
    """The sum of amounts of units, each once and the greatest first; only the least has a fraction."""
    order = list(units)
    places = [order.index(unit) for _, unit in pairs]
    if places != sorted(set(places)) or any("." in amount and unit != order[-1] for amount, unit in pairs):
        raise Unread("units out of order")
    return sum(int(Decimal(amount) * units[unit]) for amount, unit in pairs)


def _interval(mark: str, text: str, plan: ColumnPlan) -> int:
    """Microseconds, in the plain, the verbose or the ISO style."""
    amount = r"[+-]?\d{1,12}(?:\.\d{1,6})?"
    if (size := _clock(text)) is not None:
        return size
    if text in ("0", "@ 0", "PT0S"):
        return 0
    if m := re.fullmatch(rf"@((?: {amount} (?:hour|min|sec)s?)+)( ago)?", text):
        size = _amounts([(a, u) for a, u in re.findall(rf"({amount}) (hour|min|sec)", m[1])], UNITS)
        return -size if m[2] else size
    if re.fullmatch(rf"PT(?:{amount}[HMS])+", text):
        return _amounts(re.findall(rf"({amount})([HMS])", text), ISO_UNITS)
    raise Unread("not a time of day or a duration")


def _json(mark: str, text: str, plan: ColumnPlan) -> object:
    from keelson.plans.defaults import json_form

    if not valid(text):
        raise Unread("not JSON")
    return json_form(text)


def _network(mark: str, text: str, plan: ColumnPlan) -> object:
    try:
        return ipaddress.ip_interface(text)
    except ValueError as e:
        raise Unread("not an address") from e


def array(text: str) -> tuple[str | None, ...]:
    """The elements of an array in its text form."""
    item = r'\s*(?:"((?:[^"\\]|\\.)*)"|([^{}",\\\s](?:[^{}",\\]|\\.)*?))\s*'
    inner = text.strip()
    if not (inner.startswith("{") and inner.endswith("}")):
        raise Unread("not an array")
    inner, out, at = inner[1:-1], [], 0
    while inner.strip():
        m = re.compile(item + r"(,|\Z)", re.S).match(inner, at)
        if not m:
            raise Unread("not an array")
        bare = re.sub(r"\\(.)", r"\1", m[1] if m[1] is not None else m[2], flags=re.S)
        out.append(None if m[1] is None and m[2].lower() == "null" else bare)
        at = m.end()
        if not m[3]:
            break
        if at == len(inner):
            raise Unread("a comma has nothing after it")
    return tuple(out)


def _labels(expression: str, plan: ColumnPlan) -> tuple[str | None, ...]:
    found = array_literal(expression)
    if not all(x in plan.set_labels for x in found):
        raise Unread("not the column's labels")
    return found


def array_literal(expression: str) -> tuple[str | None, ...]:
    """The elements of an array of literals, in its text form or listed, with casts or without."""
    text = _bare(expression)
    while (part := _cast(text))[1] is not None:
        text = _bare(part[0])
    if m := re.fullmatch(r"ARRAY\[(.*)\]", text, re.I | re.S):
        parts = re.findall(r"\s*((?:[Ee]?'(?:[^']|'')*')(?:::[\w \"()]+)?)\s*(,|\Z)", m[1])
        if "".join(a + b for a, b in parts).replace(" ", "") != m[1].replace(" ", ""):
            raise Unread("not an array of literals")
        return tuple(literal(a)[1] for a, _ in parts)
    return array(literal(text)[1])


def membership(check: str) -> tuple[str, frozenset] | None:
    """(column, labels) of a check that a column's labels are among some; None for any other check."""
    text = _bare(re.sub(r"\ACHECK\s*", "", check.strip(), flags=re.I))
    left, found, right = text.partition("<@")
    column = _bare(left)
    while found and (part := _cast(column))[1] in ("text[]", "pg_catalog.text[]"):
        column = _bare(part[0])
    if not re.fullmatch(r'"(?:[^"]|"")+"|[a-z_][a-z0-9_$]*', column):
        return None
    try:
        labels = array_literal(right)
    except Unread:
        return None
    name = column[1:-1].replace('""', '"') if column.startswith('"') else column
    return None if None in labels else (name, frozenset(labels))


def same_check(want, expression: str | None) -> bool:
    """Whether a planned check and an observed expression are the same: membership by its labels in any order, others word by word."""
    if expression is None:
        return False
    if want.set_labels is None:
        return expression == want.expression
    return membership(expression) == (want.set_column, frozenset(want.set_labels))


def _text(mark: str, text: str, plan: ColumnPlan) -> str:
    if mark != "'":
        raise Unread("not a string")
    return text


READERS: dict[Kind, Callable] = {
    Kind.SIGNED: _whole, Kind.UNSIGNED: _whole, Kind.DECIMAL: _decimal, Kind.FLOAT: _float, Kind.BOOLEAN: _boolean, Kind.BIT: _bits, Kind.BINARY: _bytes,
    Kind.DATE: _moment, Kind.DATETIME: _moment, Kind.TIMESTAMP: _moment, Kind.INTERVAL: _interval, Kind.JSON: _json, Kind.TEXT: _text, Kind.ENUM: _text,
}


def _now(expression: str, plan: ColumnPlan) -> int | None:
    """The digits that the current time keeps in the column, if the expression is that."""
    text = _bare(expression)
    while (part := _cast(text))[1] is not None and plan.kind in (Kind.DATETIME, Kind.TIMESTAMP):
        text = _bare(part[0])
    m = re.fullmatch(r"CURRENT_TIMESTAMP(?:\((\d)\))?|(?:pg_catalog\.)?now\(\)", text.strip(), re.I)
    if not m:
        return None
    kept = (size_of(plan.target_type) or [6])[0]
    return min(kept, int(m[1]) if m[1] else 6)


def value(expression: str, plan: ColumnPlan) -> object:
    """What an expression gives in its column. Casts to other types than the column's, or to text, aren't read."""
    if plan.kind in (Kind.DATETIME, Kind.TIMESTAMP) and (digits := _now(expression, plan)) is not None:
        return "now", digits
    if plan.kind == Kind.SET:
        return _labels(expression, plan)
    mark, text, casts = literal(expression)
    if mark == "" and text == "null":
        return None
    for kind in casts:
        bare = kind.strip('"') if kind.startswith('"') and "." not in kind else kind
        plain = ("text", "character varying", "varchar", "bpchar", "character", "unknown", base_of(plan.target_type), "bit" if plan.kind == Kind.BIT else "text")
        numbers = ("integer", "bigint", "smallint", "numeric", "double precision", "real") if mark == "" else ()
        if not (base_of(bare) in plain or base_of(bare) in numbers or base_of(normalise(bare) or "?") == base_of(normalise(plan.target_type) or "") or kind == plan.target_type):
            raise Unread(f"a cast to {kind}")
    if plan.target_type == "inet":
        return _network(mark, text, plan)
    if plan.kind not in READERS:
        raise Unread(f"{plan.kind} has no reader")
    return READERS[plan.kind](mark, text, plan)


def same_default(planned: str | None, observed: str | None, plan: ColumnPlan) -> str:
    """equal, different or unsupported: whether two default expressions give the same value. Unknown forms are never equal."""
    if planned is None or observed is None:
        return "equal" if planned is observed else "different"
    try:
        return "equal" if value(planned, plan) == value(observed, plan) else "different"
    except Unread:
        return "unsupported"
