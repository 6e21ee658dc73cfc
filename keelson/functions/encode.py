"""The copy-text form of rows: byte accounting, reject files and canonical digests use it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.convert import bytea_text
from keelson.plans.model import Kind

#: Characters of the format and how each is written; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v"))


def escape(text: Column) -> Column:
    for raw, shown in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def array_text(labels: Column) -> Column:
    """{"a","b"} with quotes and backslashes escaped."""
    quoted = F.transform(labels, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def field(value: Column, kind: Kind) -> Column:
    """A converted value as unescaped text; null stays null."""
    if kind == Kind.BINARY:
        return bytea_text(value)
    if kind == Kind.SET:
        return array_text(value)
    if kind == Kind.BOOLEAN:
        return F.when(value, F.lit("t")).otherwise(F.when(value.isNotNull(), F.lit("f")))
    if kind == Kind.DATETIME:
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if kind == Kind.TIMESTAMP:
        return F.concat(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))
    if kind == Kind.INTERVAL:
        return interval_text(value)
    return value.cast("string")


def interval_text(value: Column) -> Column:
    """[-]HH:MM:SS.ffffff"""
    part = lambda name: F.extract(F.lit(name), value)
    hours = part("DAY").cast("long") * 24 + part("HOUR")
    micros = hours * 3_600_000_000 + part("MINUTE").cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")
    size = F.abs(micros)
    digits = lambda n, w: F.lpad(n.cast("string"), w, "0")
    hours = F.floor(size / 3_600_000_000)
    return F.concat(
        F.when(micros < 0, F.lit("-")).otherwise(F.lit("")),
        F.when(hours < 100, digits(hours, 2)).otherwise(hours.cast("string")), F.lit(":"),
        digits(F.floor(size / 60_000_000) % 60, 2), F.lit(":"), digits(F.floor(size / 1_000_000) % 60, 2), F.lit("."), digits(size % 1_000_000, 6),
    )


def row_text(fields: list[Column]) -> Column:
    """One line: tabs between fields, backslash-N for null, a newline at the end."""
    return F.concat(F.concat_ws("\t", *(F.coalesce(escape(f), F.lit("\\N")) for f in fields)), F.lit("\n"))


#: Kinds whose text can hold a character that has to be escaped.
ESCAPED = (Kind.TEXT, Kind.ENUM, Kind.SET, Kind.JSON, Kind.GEOMETRY, Kind.BINARY)


def field_bytes(value: Column, kind: Kind) -> Column:
    """Bytes of a field's escaped text, or of the mark of a null, without making the text where the kind says enough."""
    if kind == Kind.BINARY:  # the prefix's backslash is doubled
        size = F.octet_length(value) * 2 + 3
    elif kind == Kind.BOOLEAN:
        size = F.when(value.isNotNull(), F.lit(1))
    elif kind == Kind.DATETIME:
        size = F.when(value.isNotNull(), F.lit(26))
    elif kind == Kind.TIMESTAMP:
        size = F.when(value.isNotNull(), F.lit(29))
    elif kind in ESCAPED:
        text = field(value, kind)
        marks = "".join(raw for raw, _ in ESCAPES)
        size = 2 * F.octet_length(text) - F.octet_length(F.translate(text, marks, ""))  # each of them takes a byte more
    else:
        size = F.octet_length(field(value, kind))
    return F.coalesce(size, F.lit(2))


def row_bytes(fields: list[tuple[Column, Kind]]) -> Column:
    """Bytes of a row's line: as the length of row_text."""
    out = F.lit(max(1, len(fields)))
    for value, kind in fields:
        out = out + field_bytes(value, kind)
    return out.cast("long")
