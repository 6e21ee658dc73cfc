"""Data checks that stand for keys, foreign keys, checks and sequences, which file tables can't enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.model import ColumnPlan, Kind, TablePlan

INTEGER_MAX = {"smallint": 2**15 - 1, "integer": 2**31 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}


def _cols(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys]


def unique_violations(rows: DataFrame, keys: list[str], primary: bool = False) -> DataFrame:
    """Keys that occur more than once, with their counts. Rows with a null part don't count, unless the key is primary: then each is a violation."""
    cols = _cols(keys)
    if not primary:
        rows = rows.where(reduce(lambda a, b: a & b, (c.isNotNull() for c in cols)))
    counts = rows.groupBy(*cols).agg(F.count("*").alias("n_rows"))
    null = reduce(lambda a, b: a | b, (c.isNull() for c in cols))
    return counts.where((F.col("n_rows") > 1) | (null if primary else F.lit(False)))


def unique_keys(table: TablePlan) -> list[tuple[list[str], bool]]:
    """(target columns, whether it is the primary one) of a table's keys; those on expressions are left out."""
    target = {c.source_name: c.target_name for c in table.columns}
    out = [([target[k] for k in table.primary_key], True)] if table.primary_key else []
    for i in table.structure.indexes:
        if (i.unique or i.primary) and not any(i.expressions) and i.columns and all(i.columns) and i.columns not in [k for k, _ in out]:
            out.append((list(i.columns), i.primary))
    return out


def fk_orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Child rows without a parent; a null part exempts a row. Parents are reduced to their keys; the join may be broadcast only as Spark's size estimate allows."""
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in _cols(keys)))
    known = parent.select(*(F.col(f"`{p}`").alias(f"_p{i}") for i, p in enumerate(parent_keys)))
    on = reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"_p{i}") for i, k in enumerate(keys)))
    return child.where(whole).join(known, on, "left_anti")


def check_violations(rows: DataFrame, expression: str | Column) -> DataFrame:
    """Rows for which a check is false; unknown passes."""
    e = F.expr(expression) if isinstance(expression, str) else expression
    return rows.where(~F.coalesce(e, F.lit(True)))


def set_violations(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    known = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    return check_violations(rows, F.size(F.array_except(F.col(f"`{column}`"), known)) == 0)


def sequence_floor(rows: DataFrame, column: str, next_source: int = 1, minimum: int = 1, current_next: int = 1) -> int:
    """The least value a sequence may give next: never below what it would give now, and above every stored one."""
    top = rows.agg(F.max(F.col(f"`{column}`").cast("decimal(38,0)"))).first()[0]
    return max(current_next, minimum, next_source, int(top) + 1 if top is not None else 1)


def sequence_exhausted(floor: int, target_type: str) -> bool:
    return floor > INTEGER_MAX.get(target_type, 0)


#: Families of types whose values compare exactly with each other in a foreign key.
FK_FAMILIES = [frozenset(x.split("|")) for x in (
    "smallint|integer|bigint", "numeric", "real", "double precision", "boolean", "bytea", "text", "varchar", "character", "date", "timestamp", "timestamptz",
    "time", "timetz", "interval", "uuid", "inet", "money", "bit", "varbit", "jsonb", "text[]")]
#: Fixed value: the one widening, of a child's integers to a parent's decimals.
FK_WIDENING = (FK_FAMILIES[0], FK_FAMILIES[1])


def _family(column: ColumnPlan) -> object:
    """What a column's values compare exactly with: a family of types, or an enum with its labels; None for nothing."""
    from keelson.plans.types import normalise

    kind = normalise(column.target_type)
    if kind is None:
        return None
    if column.kind == Kind.ENUM:
        return (kind, *column.enum_labels) if column.enum_labels else None
    bare = kind.partition("(")[0] + "[]" * kind.endswith("[]") * ("(" in kind)
    return next((f for f in FK_FAMILIES if bare in f), None)


def fk_types_agree(child: ColumnPlan, parent: ColumnPlan) -> bool:
    """Whether equality between two planned columns is exact."""
    sides = _family(child), _family(parent)
    return None not in sides and (sides[0] == sides[1] or sides == FK_WIDENING)
