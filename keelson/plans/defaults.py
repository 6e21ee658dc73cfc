"""Source defaults as target literals, each checked as strictly as a stored value would be."""

from __future__ import annotations

import datetime
import math
import re
import struct

from keelson.functions.convert import LIMITS, NUMBER, base_of, size_of
from keelson.functions.json_check import valid
from keelson.plans.model import ColumnPlan, Kind, SourceColumn
from keelson.plans.names import literal


class DefaultError(ValueError):
    pass


def _e(text: str) -> str:
    return "E" + literal(text)


def _whole(value: str, plan: ColumnPlan) -> str:
    if not re.fullmatch(r"[+-]?[0-9]+", value):
        raise DefaultError("not a whole number")
    n = int(value)
    if (plan.kind == Kind.UNSIGNED or "unsigned" in plan.source_type.lower()) and value.startswith("-"):
        raise DefaultError("an unsigned default can't be negative")
    top = LIMITS.get(base_of(plan.target_type))
    if (top and not -top <= n < top) or (plan.source_type.lower().startswith("year") and n and not 1901 <= n <= 2155):
        raise DefaultError("out of range")
    return str(n)


def _decimal(value: str, plan: ColumnPlan) -> str:
    m = re.fullmatch(r"([+-]?)0*([0-9]*?)(?:\.([0-9]+))?", value)
    if not m or not re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", value):
        raise DefaultError("not an exact decimal")
    whole, part = len(m[2]), len(m[3] or "")
    n = size_of(plan.target_type)
    room = n and (whole > n[0] - (n[1] if len(n) > 1 else 0) or part > (n[1] if len(n) > 1 else 0))
    if whole + part > 65 or part > 30 or room or ("unsigned" in plan.source_type.lower() and m[1] == "-"):
        raise DefaultError("out of range")
    return value


def _float(value: str, plan: ColumnPlan, column: SourceColumn) -> str:
    if not re.match(NUMBER.replace(r"\z", r"\Z"), value):
        raise DefaultError("not a number")
    x = float(value)
    if not math.isfinite(x):
        raise DefaultError("out of range")
    if column.data_type.lower() == "float" or base_of(plan.target_type) == "real":
        try:
            near = struct.unpack("f", struct.pack("f", x))[0]
        except OverflowError as e:
            raise DefaultError("out of range") from e
        if column.data_type.lower() != "float" and near != x:
            raise DefaultError("not exact in single precision")
    return value


def moment(value: str, plan: ColumnPlan) -> str:
    """A date or time literal in the target's form."""
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:[ T](\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?)?", value)
    if not m:
        raise DefaultError("not a date or time")
    zero = [int(x or 0) for x in m.groups()]
    if plan.transform == "zero-dates-to-epoch" and not any(zero):
        zero = [1970, 1, 1, 0, 0, 0, 0]
    else:
        zero[6] = int((m[7] or "").ljust(6, "0"))
    try:
        t = datetime.datetime(*zero)
    except ValueError as e:
        raise DefaultError("not a calendar date or time") from e
    if plan.kind == Kind.DATE:
        if any(zero[3:]):
            raise DefaultError("a date has no time")
        return f"{t:%Y-%m-%d}".rjust(10, "0")
    n = size_of(plan.target_type)
    if n and t.microsecond % 10 ** (6 - n[0]):
        raise DefaultError("more fraction digits than the target keeps")
    return f"{t.year:04d}-{t:%m-%d %H:%M:%S.%f}" + ("+00" if plan.kind == Kind.TIMESTAMP else "")


def span(value: str, plan: ColumnPlan) -> str:
    m = re.fullmatch(r"(-?)(\d{1,3}):([0-5]\d):([0-5]\d)(?:\.(\d{1,6}))?", value)
    if not m or int(m[2]) > 838:
        raise DefaultError("not a time")
    micros = int((m[5] or "").ljust(6, "0"))
    n = size_of(plan.target_type)
    if (n and micros % 10 ** (6 - n[0])) or (base_of(plan.target_type).startswith("time") and (m[1] or int(m[2]) > 23)):
        raise DefaultError("out of range")
    return f"{m[1]}{int(m[2]):02d}:{m[3]}:{m[4]}.{micros:06d}"


def _bits(value: str) -> int:
    if m := re.fullmatch(r"b'([01]{1,64})'", value):
        return int(m[1], 2)
    if re.fullmatch(r"[0-9]+", value):
        return int(value)
    raise DefaultError("not a bit or boolean value")


def _text(value: str, plan: ColumnPlan) -> str | None:
    if plan.transform == "right-trim":
        while value and value[-1].isspace() and value[-1] not in "\x1c\x1d\x1e\x1f":
            value = value[:-1]
    elif plan.transform == "remove-null-characters":
        value = value.replace("\0", "")
    elif plan.transform == "empty-string-to-null" and not value:
        if plan.nullable:
            return None
        raise DefaultError("null contradicts NOT NULL")
    n = size_of(plan.target_type)
    if "\0" in value or (n and base_of(plan.target_type) in ("varchar", "character varying", "char", "character") and len(value) > n[0]):
        raise DefaultError("too long, or holds NUL")
    return _e(value)


def _bytes(value: str, column: SourceColumn, plan: ColumnPlan) -> str:
    kind = column.data_type.lower()
    if kind in ("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob"):
        if not value.startswith("0x"):
            raise DefaultError("a binary default needs hex metadata")
        digits = value[2:]
    elif kind in ("char", "varchar", "tinytext", "text", "mediumtext", "longtext"):
        if column.default_bytes_hex is None:
            raise DefaultError("needs the default's original bytes")
        digits = column.default_bytes_hex
    else:
        digits = value.encode().hex()
    if not re.fullmatch(r"(?:[0-9A-Fa-f]{2})*", digits):
        raise DefaultError("invalid hex")
    if kind == "binary":
        n = column.character_length
        if n is None or n > 255 or len(digits) > 2 * n:
            raise DefaultError("longer than the column")
        digits = digits.ljust(2 * n, "0")
    if plan.transform == "hex-to-bytea":
        inner = re.sub(r"\A(0x|\\x)", "", bytes.fromhex(digits).decode("ascii", "replace"))
        if not re.fullmatch(r"(?:[0-9A-Fa-f]{2})*", inner):
            raise DefaultError("invalid hex")
        digits = inner
    return _e("\\x" + digits.lower())


def default_sql(column: SourceColumn, plan: ColumnPlan) -> str | None:
    """The target's DEFAULT; None without one. DefaultError where it can't be carried over exactly."""
    value = column.default
    if value is None:
        return None
    if column.default_is_expression or value.upper().startswith("CURRENT_TIMESTAMP"):
        if re.fullmatch(r"CURRENT_TIMESTAMP(\([0-6]\))?", value.upper()) and plan.kind in (Kind.DATETIME, Kind.TIMESTAMP):
            return value.upper()
        raise DefaultError("an expression default needs an override")
    if plan.enum_labels:
        if value not in plan.enum_labels:
            raise DefaultError("not a declared label")
        return _text(value, plan)
    k = plan.kind
    if k in (Kind.SIGNED, Kind.UNSIGNED):
        return _whole(value, plan)
    if k == Kind.DECIMAL:
        return _decimal(value, plan)
    if k == Kind.FLOAT:
        return _float(value, plan, column)
    if k == Kind.TEXT:
        if plan.transform == "int-to-ip":
            if not re.fullmatch(r"[0-9]+", value) or int(value) >= 2**32:
                raise DefaultError("not an IPv4 number")
            return _e(".".join(str(int(value) >> s & 255) for s in (24, 16, 8, 0)))
        return _text(value, plan)
    if k == Kind.JSON:
        if not valid(value):
            raise DefaultError("not JSON")
        return _e(value)
    if k in (Kind.DATE, Kind.DATETIME, Kind.TIMESTAMP):
        return _e(moment(value, plan))
    if k == Kind.INTERVAL:
        return _e(span(value, plan))
    if k == Kind.BOOLEAN:
        n = int(value) if re.fullmatch(r"[+-]?[0-9]+", value) else _bits(value)
        if n not in (0, 1) and plan.transform != "tinyint-to-boolean":
            raise DefaultError("neither 0 nor 1")
        return "true" if n else "false"
    if k == Kind.BIT:
        n = _bits(value)
        if n >= 1 << (plan.bits or 1):
            raise DefaultError("wider than the column")
        return "B" + literal(format(n, f"0{plan.bits or 1}b"))
    if k == Kind.BINARY:
        return _bytes(value, column, plan)
    if k == Kind.SET:
        chosen = value.split(",") if value else []
        if any(x not in plan.set_labels for x in chosen):
            raise DefaultError("not a declared label")
        inner = ",".join('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in plan.set_labels if x in chosen)
        return _e("{" + inner + "}")
    raise DefaultError("needs a typed override")


def json_form(text: str) -> object:
    """A JSON document with numbers as (sign, digits, exponent), so that equal numbers are equal however they are written."""
    import json

    def number(x: str) -> tuple:
        sign, whole, part, power = re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?", x).groups()
        digits = (whole + (part or "")).lstrip("0")
        bare = digits.rstrip("0")
        return ("n", "", "0", 0) if not bare else ("n", sign, bare, int(power or 0) - len(part or "") + len(digits) - len(bare))

    def freeze(x: object) -> object:
        if isinstance(x, dict):
            return ("o", tuple(sorted((k, freeze(v)) for k, v in x.items())))
        if isinstance(x, list):
            return ("a", tuple(map(freeze, x)))
        return x if isinstance(x, tuple) else (type(x).__name__, x)

    return freeze(json.loads(text, parse_int=number, parse_float=number))
