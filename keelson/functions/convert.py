"""Exact conversion of staged values, as column expressions.

For a planned column `convert` gives three expressions: the value, the problem that makes its row a
reject (null if none), and whether a named transform changed it. Nothing casts in a way that can raise: grammar
first, then try_cast. Problems are codes of the row-error classes below.

Staging types: integers and bit or set masks as integral, decimal(20,0), digit text or (bit, set) up
to 8 big-endian bytes; decimals, JSON, text and geometry as text or binary; binaries as binary; dates
and times as text where zero dates can occur, else native; enums as ordinals from 1.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions import text as text_functions
from keelson.functions.json_check import is_json
from keelson.plans.model import ColumnPlan, Kind

#: Row-error classes and the SQLSTATE each stands for.
PROBLEMS = {
    "length": "22001", "range": "22003", "datetime": "22007", "field_overflow": "22008", "charset": "22021",
    "format": "22P02", "not_null": "23502", "unique": "23505", "check": "23514",
}

#: The named transforms.
TRANSFORMS = (
    "zero-dates-to-null", "zero-dates-to-epoch", "tinyint-to-boolean", "bits-to-boolean", "empty-string-to-null",
    "remove-null-characters", "right-trim", "byte-vector-to-bytea", "binary-to-bytea", "bytes-to-pg-bytea",
    "hex-to-bytea", "set-to-array", "year-to-integer", "tinyint-to-integer", "int-to-ip",
)

LIMITS = {"smallint": 2**15, "integer": 2**31, "int": 2**31, "bigint": 2**63}
SPARK_INTEGERS = {"smallint": "smallint", "integer": "int", "int": "int", "bigint": "bigint"}


class Converted(NamedTuple):
    value: Column
    problem: Column
    changed: Column


def _none() -> Column:
    return F.lit(None).cast("string")


def _first(*problems: Column) -> Column:
    return F.coalesce(*problems, _none())


def _flag(bad: Column, problem: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(problem))


def size_of(target: str) -> list[int]:
    """The numbers in a type's parentheses."""
    inner = target.partition("(")[2].partition(")")[0]
    return [int(x) for x in inner.split(",") if x.strip().isdigit()]


def base_of(target: str) -> str:
    return target.partition("(")[0].strip()


#: Spark types of whole numbers, and the first magnitude that each can't hold.
INTEGRAL = {"tinyint": 2**7, "smallint": 2**15, "int": 2**31, "bigint": 2**63}
#: Fixed value: the grammar of a finite number in text.
NUMBER = r"\A[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\z"


def is_whole(dtype: str) -> bool:
    return dtype in INTEGRAL or (dtype.startswith("decimal") and dtype.endswith(",0)"))


def whole_number(raw: Column, dtype: str = "") -> tuple[Column, Column]:
    """(decimal(38,0), problem) of an integer in any staging type; native numbers need no text."""
    if is_whole(dtype):
        return raw.cast("decimal(38,0)"), _none()
    digits = raw.cast("string")
    number = digits.try_cast("decimal(38,0)")
    return number, _first(_flag(~digits.rlike(r"\A[+-]?[0-9]+\z"), "format"), _flag(number.isNull(), "range"))


def bits_number(raw: Column, dtype: str) -> tuple[Column, Column]:
    """As whole_number; binary values of up to 8 bytes are big-endian numbers."""
    if dtype != "binary":
        return whole_number(raw, dtype)
    number = F.conv(F.hex(raw), 16, 10).try_cast("decimal(38,0)")
    bad = F.octet_length(raw) > 8
    return F.when(F.octet_length(raw) == 0, F.lit(0).cast("decimal(38,0)")).otherwise(number), _flag(bad, "range")


def _integer(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    unsigned = plan.kind == Kind.UNSIGNED or "unsigned" in plan.source_type.lower()
    year, base = plan.source_type.lower().startswith("year"), base_of(plan.target_type)
    kind = SPARK_INTEGERS.get(base, "decimal(20,0)")
    if dtype in INTEGRAL:  # compared as it is, where the types leave anything to compare
        bad = [raw < 0] if unsigned else []
        bad += [~((raw == 0) | raw.between(1901, 2155))] if year else []
        if (top := LIMITS.get(base, 2**63)) < INTEGRAL[dtype]:
            bad.append((raw < -top) | (raw >= top))
        return Converted(raw if kind == dtype else raw.try_cast(kind), _first(*(F.when(b, F.lit("range")) for b in bad)), F.lit(False))
    number, problem = whole_number(raw, dtype)
    checks = [problem]
    if unsigned:
        checks.append(_flag(number < 0, "range"))
    if year:
        checks.append(_flag(~((number == 0) | number.between(1901, 2155)), "range"))
    if base in LIMITS:
        top = F.lit(str(LIMITS[base])).cast("decimal(38,0)")
        checks.append(_flag((number < -top) | (number >= top), "range"))
    if kind == "decimal(20,0)":
        checks.append(_flag(F.abs(number) >= F.lit("1" + "0" * 20).cast("decimal(38,0)"), "range"))
    return Converted(number.try_cast(kind), _first(*checks), F.lit(False))


def canonical_decimal(text: Column) -> Column:
    """Without a plus sign, leading zeros, trailing zeros of the fraction, and minus zero."""
    out = F.regexp_replace(text, r"\A\+", "")
    out = F.regexp_replace(out, r"\A(-?)0+(?=[0-9])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    return F.when(out == "-0", F.lit("0")).otherwise(out)


def _decimal(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    digits = raw.cast("string")
    bare = F.ltrim(digits, F.lit("+-"))
    point = F.instr(bare, ".")
    n_whole = F.char_length(F.ltrim(F.substring_index(bare, ".", 1), F.lit("0")))
    n_part = F.when(point > 0, F.char_length(bare) - point).otherwise(0)
    checks = [_flag(~digits.rlike(r"\A[+-]?[0-9]+([.][0-9]+)?\z"), "format")]
    if "unsigned" in plan.source_type.lower():
        checks.append(_flag(digits.startswith("-"), "range"))
    checks.append(_flag((n_whole + n_part > 65) | (n_part > 30), "range"))
    sizes = size_of(plan.target_type)
    if sizes:
        precision, scale = sizes[0], sizes[1] if len(sizes) > 1 else 0
        checks.append(_flag((n_whole > precision - scale) | (n_part > scale), "range"))
        if precision <= 38:
            return Converted(digits.try_cast(f"decimal({precision},{scale})"), _first(*checks), F.lit(False))
    return Converted(canonical_decimal(digits), _first(*checks), F.lit(False))


def _float(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    number = raw.try_cast("double")
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    wrong = ~raw.rlike(NUMBER) if dtype == "string" else number.isNull()
    checks = [_flag(wrong, "format"), _flag(bad, "range")]
    if dtype in ("tinyint", "smallint", "int", "bigint") or dtype.startswith("decimal"):
        checks.append(_flag(number.cast("decimal(38,0)") != raw.cast("decimal(38,0)"), "range"))
    if base_of(plan.target_type) == "real":
        checks.append(_flag(number.cast("float").cast("double") != number, "range"))
        return Converted(number.cast("float"), _first(*checks), F.lit(False))
    return Converted(number, _first(*checks), F.lit(False))


def _binary(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    if plan.transform != "hex-to-bytea":
        problem = _none() if dtype == "binary" else F.lit("format")
        return Converted(raw.cast("binary"), problem, F.lit(False))
    digits = F.regexp_replace(raw.cast("string"), r"\A(0x|\\x)", "")
    bad = ~digits.rlike(r"\A([0-9A-Fa-f]{2})*\z")
    return Converted(F.when(~bad, F.unhex(digits)), _flag(bad, "format"), F.lit(True))


def bytea_text(value: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(value)))


MOMENT = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?)?\z"


def _moment(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    if dtype in ("date", "timestamp_ntz") or (dtype == "timestamp" and plan.kind != Kind.DATE):
        return _native_moment(raw, plan, dtype)
    shown = raw.cast("string")
    fits = shown.rlike(MOMENT)  # so every part has its place
    changed, zero = F.lit(False), None
    if plan.transform in ("zero-dates-to-null", "zero-dates-to-epoch"):
        part = lambda at, size: F.substring(shown, at, size)
        zero = fits & ((part(1, 4) == "0000") | (part(6, 2) == "00") | (part(9, 2) == "00"))
        if plan.transform == "zero-dates-to-null":
            changed = zero
        else:
            changed = fits & (F.ltrim(shown, F.lit("0-: T.")) == "")
            shown = F.when(changed, F.lit("1970-01-01 00:00:00")).otherwise(shown)
    checks = [_flag(~fits, "datetime")]
    if plan.kind == Kind.DATE:
        value = F.substring(shown, 1, 10).try_cast("date")
        timed = F.ltrim(F.substring(raw.cast("string"), 11, 16), F.lit("0: T.")) != ""
        checks += [_flag(fits & timed, "datetime"), _flag(value.isNull(), "field_overflow")]
    else:
        kind = "timestamp_ntz" if plan.kind == Kind.DATETIME else "timestamp"
        text = shown if kind == "timestamp_ntz" else F.concat(shown, F.when(F.char_length(shown) > 10, F.lit("+00:00")).otherwise(F.lit(" 00:00:00+00:00")))
        value = text.try_cast(kind)
        sizes = size_of(plan.target_type)
        checks.append(_flag(value.isNull(), "field_overflow"))
        if sizes and sizes[0] < 6:  # the fraction begins at the 21st character
            checks.append(_flag(F.ltrim(F.substring(shown, 21 + sizes[0], 6), F.lit("0")) != "", "field_overflow"))
    problem = _first(*checks)
    if plan.transform == "zero-dates-to-null":
        value, problem = F.when(~zero, value), F.when(~F.coalesce(zero, F.lit(False)), problem)
    return Converted(value, problem, F.coalesce(changed, F.lit(False)))


def _native_moment(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    """Dates and times that are staged as such; they can't be zero dates. Times without a zone are in UTC, as everywhere."""
    if plan.kind == Kind.DATE:
        day = raw.cast("date")
        timed = _none() if dtype == "date" else _flag(day.cast("timestamp_ntz") != raw, "datetime")
        return Converted(day, timed, F.lit(False))
    kind = "timestamp_ntz" if plan.kind == Kind.DATETIME else "timestamp"
    value = raw if dtype == kind else raw.cast(kind) if kind == "timestamp_ntz" else F.concat(raw.cast("timestamp_ntz").cast("string"), F.lit("+00:00")).try_cast("timestamp")
    sizes, problem = size_of(plan.target_type), _none()
    if sizes and sizes[0] < 6 and dtype != "date":
        micros = F.pmod((F.extract(F.lit("SECOND"), raw) * 1_000_000).cast("bigint"), F.lit(1_000_000))
        problem = _flag(micros % 10 ** (6 - sizes[0]) != 0, "field_overflow")
    return Converted(value, problem, F.lit(False))


SPAN = r"\A(-?)([0-9]{1,3}):([0-5][0-9]):([0-5][0-9])(?:\.([0-9]{1,6}))?\z"


def _interval(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    if dtype.startswith("interval"):
        return Converted(raw, _none(), F.lit(False))
    shown = raw.cast("string")
    part = lambda i: F.regexp_extract(shown, SPAN, i).try_cast("int")
    micros = F.rpad(F.regexp_extract(shown, SPAN, 5), 6, "0").try_cast("int")
    micros = F.coalesce(micros, F.lit(0))
    fits = shown.rlike(SPAN)
    hours = part(2)
    days, rest = F.floor(hours / 24).cast("int"), hours % 24
    seconds = (part(4) + micros / F.lit(1e6)).cast("decimal(18,6)")
    length = F.make_dt_interval(days, rest, part(3), seconds)
    minus = F.regexp_extract(shown, SPAN, 1) == "-"
    value = F.when(fits & (hours <= 838), F.when(minus, -length).otherwise(length))
    checks = [_flag(~fits, "datetime"), _flag(hours > 838, "field_overflow")]
    if base_of(plan.target_type).startswith("time"):
        checks.append(_flag(minus | (hours >= 24), "field_overflow"))
    sizes = size_of(plan.target_type)
    if sizes and sizes[0] < 6:
        checks.append(_flag(micros % 10 ** (6 - sizes[0]) != 0, "field_overflow"))
    return Converted(value, _first(*checks), F.lit(False))


def _boolean(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    number, problem = bits_number(raw, dtype)
    two = number.isin(0, 1)
    if plan.transform == "tinyint-to-boolean":
        return Converted(number != 0, problem, problem.isNull() & ~two)
    return Converted(F.when(two, number == 1), _first(problem, _flag(~two, "range")), F.lit(False))


def _bit(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    width = plan.bits or (size_of(plan.target_type) or [1])[0]
    number, problem = bits_number(raw, dtype)
    top = F.lit(str(2**width)).cast("decimal(38,0)")
    shown = F.lpad(F.conv(number.cast("string"), 10, 2), width, "0")
    return Converted(shown, _first(problem, _flag((number < 0) | (number >= top), "range")), F.lit(False))


def _text(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    if plan.transform == "int-to-ip":
        number, problem = whole_number(raw, dtype)
        inside = number.between(0, 2**32 - 1)
        bits = F.when(inside, number.cast("bigint"))
        octet = lambda n: F.shiftright(bits, n).bitwiseAND(F.lit(255)).cast("string")
        return Converted(F.concat_ws(".", *(octet(n) for n in (24, 16, 8, 0))), _first(problem, _flag(~inside, "range")), F.lit(True))
    if plan.enum_labels:
        label, problem = enum_label(raw, plan, dtype)
    else:
        label, problem = text_functions.decode(raw, plan.charset)
    return _finish_text(label, problem, plan)


def _finish_text(label: Column, problem: Column, plan: ColumnPlan) -> Converted:
    out, changed = label, F.lit(False)
    if plan.transform == "right-trim":
        out = text_functions.right_trim(label)
        changed = F.char_length(out) != F.char_length(label)
    elif plan.transform == "remove-null-characters":
        out = text_functions.remove_nul(label)
        changed = text_functions.has_nul(label)
    elif plan.transform == "empty-string-to-null":
        changed = label == ""
        out = F.when(label != "", label)
    checks = [problem, F.when(text_functions.has_nul(out), F.lit("charset"))]
    if base_of(plan.target_type) in ("varchar", "character varying", "char", "character") and (sizes := size_of(plan.target_type)):
        checks.append(F.when(F.char_length(out) > sizes[0], F.lit("length")))
    return Converted(out, _first(*checks), F.coalesce(changed, F.lit(False)))


def enum_label(raw: Column, plan: ColumnPlan, dtype: str) -> tuple[Column, Column]:
    number, problem = whole_number(raw, dtype)
    known = number.between(1, len(plan.enum_labels))
    label = F.try_element_at(F.array(*map(F.lit, plan.enum_labels)), F.when(known, number.cast("int")))
    return label, _first(problem, _flag(~known, "range"))


def _enum(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    label, problem = enum_label(raw, plan, dtype)
    return _finish_text(label, problem, plan)


def _set(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    number, problem = bits_number(raw, dtype)
    n = len(plan.set_labels)
    top = F.lit(str(2**n)).cast("decimal(38,0)")
    inside = (number >= 0) & (number < top)
    mask = F.conv(F.when(inside, number).cast("string"), 10, -10).try_cast("bigint")
    labels = F.array(*map(F.lit, plan.set_labels)) if n else F.array().cast("array<string>")
    chosen = F.filter(F.transform(labels, lambda x, i: F.when(F.getbit(mask, i) == 1, x)), lambda x: x.isNotNull())
    return Converted(F.when(inside, chosen), _first(problem, _flag(~inside, "range")), F.lit(False))


def _json(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    text, problem = text_functions.decode(raw, "utf8mb4")
    return Converted(text, _first(problem, _flag(~is_json(text), "format")), F.lit(False))


def _geometry(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    text, problem = text_functions.decode(raw, "utf8mb4")
    return Converted(text, _first(problem, _flag(~text.rlike(r"(?s)\ASRID=[0-9]+;.+\z"), "format")), F.lit(False))


BY_KIND = {
    Kind.SIGNED: _integer, Kind.UNSIGNED: _integer, Kind.DECIMAL: _decimal, Kind.FLOAT: _float, Kind.TEXT: _text,
    Kind.BINARY: _binary, Kind.DATE: _moment, Kind.DATETIME: _moment, Kind.TIMESTAMP: _moment, Kind.INTERVAL: _interval,
    Kind.BOOLEAN: _boolean, Kind.BIT: _bit, Kind.JSON: _json, Kind.ENUM: _enum, Kind.SET: _set, Kind.GEOMETRY: _geometry,
}


def parse(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    """As convert, but where there is a problem the value can be anything."""
    if plan.transform is not None and plan.transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {plan.transform}")
    made = BY_KIND[plan.kind](raw, plan, dtype)
    given = raw.isNotNull()
    problem = F.when(given, made.problem)
    if not plan.nullable:
        missing = ~given
        if plan.transform in ("zero-dates-to-null", "empty-string-to-null"):
            missing = missing | F.coalesce(made.problem.isNull() & made.changed, F.lit(False))
        problem = F.when(missing, F.lit("not_null")).otherwise(problem)
    return Converted(made.value, problem, given & F.coalesce(made.changed, F.lit(False)))


def convert(raw: Column, plan: ColumnPlan, dtype: str) -> Converted:
    """The value, problem and change of a staged column of a Spark type (simple string) under its plan.

    Null is kept where the plan allows it and is the problem not_null elsewhere, also where a transform makes it.
    """
    made = parse(raw, plan, dtype)
    return Converted(F.when(made.problem.isNull(), made.value), made.problem, made.changed)
