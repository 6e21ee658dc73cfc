"""Closed integer ranges that cover a key without gaps, for partitioned scans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.model import ColumnPlan, Diagnostic, Kind, Severity, SourceTable, TablePlan

INTEGERS = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint")
WIDE = "decimal(38,0)"


class RangeError(ValueError):
    """code: zero_span, incomplete_bounds, mixed_signedness or reversed_bounds."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Bound:
    value: int
    unsigned: bool = False


def integer_ranges(low: Bound | None, high: Bound | None, span: int) -> Iterator[tuple[int, int]]:
    """(first, last) of at most span integers each, in order; none if both bounds are missing.

    Python integers have no largest value, so a range may end at the largest 64-bit one. The checks happen at once.
    """
    if span <= 0:
        raise RangeError("zero_span")
    if (low is None) != (high is None):
        raise RangeError("incomplete_bounds")
    if low is None:
        return iter(())
    if low.unsigned != high.unsigned:
        raise RangeError("mixed_signedness")
    if low.value > high.value:
        raise RangeError("reversed_bounds")
    return ((a, min(a + span - 1, high.value)) for a in range(low.value, high.value + 1, span))


def key_bounds(rows: DataFrame, key: str) -> tuple[int, int] | None:
    """Exact least and greatest key; None for an empty table."""
    low, high = rows.agg(F.min(F.col(key).cast(WIDE)), F.max(F.col(key).cast(WIDE))).first()
    return None if low is None else (int(low), int(high))


def in_range(key: str, first: int, last: int) -> Column:
    return F.col(key).between(F.lit(str(first)).cast(WIDE), F.lit(str(last)).cast(WIDE)) if max(abs(first), abs(last)) >= 2**63 else F.col(key).between(first, last)


def range_number(key: Column, low: int, span: int) -> Column:
    """Which range of a plan a key falls in, from 0."""
    return F.floor((key.cast(WIDE) - F.lit(str(low)).cast(WIDE)) / F.lit(str(span)).cast(WIDE))


def jdbc_predicates(key: str, ranges: Iterator[tuple[int, int]]) -> list[str]:
    return [f"`{key.replace('`', '``')}` >= {a} AND `{key.replace('`', '``')}` <= {b}" for a, b in ranges]


def range_key(table: TablePlan, source: SourceTable) -> ColumnPlan | None:
    """The column to split a table by: its only key column, copied, never null, an integer; None if there is none."""
    if table.is_view or len(table.primary_key) != 1:
        return None
    if sum(len(i.parts) for i in source.indexes if i.primary) != 1:
        return None
    column = next((c for c in table.columns if c.source_name == table.primary_key[0]), None)
    kind = column.source_type.lower().split("(")[0].split()[0] if column else ""
    fits = column and column.copy and not column.nullable and column.kind in (Kind.SIGNED, Kind.UNSIGNED) and kind in INTEGERS
    return column if fits else None


def ranged_scan(rows: DataFrame, table: TablePlan, source: SourceTable, span: int) -> tuple[list[DataFrame], list[Diagnostic]]:
    """A scan of a DataFrame for each range, or one full scan and a RANGE_FALLBACK warning where ranges don't apply; a server's table is read by predicates instead."""
    column = range_key(table, source)
    bounds = key_bounds(rows, column.source_name) if column else None
    ranges = list(integer_ranges(Bound(bounds[0]), Bound(bounds[1]), span)) if bounds else []
    if len(ranges) < 2:
        why = "no single non-null integer primary key" if not column else "empty table" if not bounds else "a single range"
        return [rows], [Diagnostic("RANGE_FALLBACK", table.source_name, f"full scan: {why}", Severity.WARNING, "copy")]
    return [rows.where(in_range(column.source_name, a, b)) for a, b in ranges], []
