"""Comparison of tables as multisets of rows, repeats counted and nulls equal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.convert import INTEGRAL, canonical_decimal
from keelson.plans.model import ColumnPlan, Kind, TablePlan, Verified


@dataclass
class Comparison:
    status: Verified
    source_rows: int = 0
    target_rows: int = 0
    reason: str = ""


def multiset_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose multiplicities differ, and by how much; one shuffle, with partial sums before it."""
    cols = source.columns
    both = source.withColumn("_n", F.lit(1)).unionByName(target.select(*(f"`{c}`" for c in cols)).withColumn("_n", F.lit(-1)))
    return both.groupBy(*(f"`{c}`" for c in cols)).agg(F.sum("_n").cast("long").alias("surplus")).where("surplus <> 0")


def multiset_equal(source: DataFrame, target: DataFrame) -> tuple[bool, int, int]:
    """(equal, source rows, target rows) in one pass."""
    cols = source.columns
    both = source.withColumns({"_s": F.lit(1), "_t": F.lit(0)}).unionByName(target.select(*(f"`{c}`" for c in cols)).withColumns({"_s": F.lit(0), "_t": F.lit(1)}))
    counts = both.groupBy(*(f"`{c}`" for c in cols)).agg(F.sum("_s").alias("s"), F.sum("_t").alias("t"))
    s, t, bad = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0)), F.count_if(F.col("s") != F.col("t"))).first()
    return bad == 0, s, t


def multiset_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Kinds that can be compared, and the transforms whose results still can.
COMPARABLE = {
    Kind.SIGNED: {"year-to-integer", "tinyint-to-integer"},
    Kind.UNSIGNED: {"year-to-integer", "tinyint-to-integer"},
    Kind.DECIMAL: set(),
    Kind.TEXT: {"empty-string-to-null", "remove-null-characters", "right-trim"},
    Kind.BOOLEAN: {"tinyint-to-boolean", "bits-to-boolean"},
    Kind.BINARY: {"byte-vector-to-bytea", "binary-to-bytea", "bytes-to-pg-bytea", "hex-to-bytea"},
    Kind.DATE: {"zero-dates-to-null", "zero-dates-to-epoch"},
    Kind.DATETIME: {"zero-dates-to-null", "zero-dates-to-epoch"},
    Kind.TIMESTAMP: {"zero-dates-to-null", "zero-dates-to-epoch"},
}


def unsupported(column: ColumnPlan) -> str | None:
    """Why a column's values can't be compared exactly; None if they can."""
    if column.kind not in COMPARABLE or column.enum_labels:
        return f"{column.source_name}: {column.kind} has no canonical form"
    if column.transform and column.transform not in COMPARABLE[column.kind]:
        return f"{column.source_name}: {column.transform} has no canonical form"
    return None


def unsupported_plan(mode: str, tables: list[TablePlan]) -> str | None:
    if mode == "schema_only":
        return "content verification needs copied rows"
    if not tables:
        return "content verification needs a table"
    for t in tables:
        if t.is_view or t.engine != "InnoDB":
            return f"{t.source_name}: content verification needs an InnoDB base table"
        if not t.copied:
            return f"{t.source_name}: no column is copied"
        for c in t.copied:
            if why := unsupported(c):
                return f"{t.source_name}.{why}"
    return None


def common_type(kind: Kind, types: set[str]) -> str | None:
    """The Spark type in which values of some types compare as numbers; None where they have to be canonical text, or as they are."""
    if kind in (Kind.SIGNED, Kind.UNSIGNED):
        return "bigint" if types <= set(INTEGRAL) else "decimal(38,0)"
    if kind == Kind.DECIMAL and all(t.startswith("decimal(") for t in types):
        sizes = [tuple(map(int, t[8:-1].split(","))) for t in types]
        whole, part = max(p - s for p, s in sizes), max(s for _, s in sizes)
        return f"decimal({whole + part},{part})" if whole + part <= 38 else None
    return None


def canonical_rows(columns: list[ColumnPlan], *frames: DataFrame) -> list[DataFrame]:
    """Frames of the same columns with values in the form in which equal ones are equal."""
    known = [dict(f.dtypes) for f in frames]
    to = {c.target_name: common_type(c.kind, {k[c.target_name] for k in known}) for c in columns}

    def canonical(c: ColumnPlan) -> Column:
        value, kind = F.col(f"`{c.target_name}`"), to[c.target_name]
        if kind:
            return value.cast(kind)
        return canonical_decimal(value.cast("string")) if c.kind == Kind.DECIMAL else value

    return [f.select(*(canonical(c).alias(c.target_name) for c in columns)) for f in frames]


#: Tags of kinds in the framed form of a row, the flags before a null and before a payload, and the bytes of a length.
TAGS = {Kind.SIGNED: 1, Kind.UNSIGNED: 2, Kind.DECIMAL: 3, Kind.TEXT: 4, Kind.BOOLEAN: 5, Kind.BINARY: 6, Kind.DATE: 7, Kind.DATETIME: 8, Kind.TIMESTAMP: 9}
NULL, GIVEN = "00", "01"


def framed(fields: list[tuple[Kind, Column]]) -> Column:
    """A row as bytes from which its fields can be told apart: tag, flag, length of 8 bytes (the greatest first), payload."""
    parts = []
    for kind, payload in fields:
        tag, payload = f"{TAGS[kind]:02X}", payload.cast("binary")
        size = F.unhex(F.lpad(F.hex(F.octet_length(payload).cast("long")), 16, "0"))
        parts.append(F.when(payload.isNull(), F.unhex(F.lit(tag + NULL))).otherwise(F.concat(F.unhex(F.lit(tag + GIVEN)), size, payload)))
    return F.concat(*parts)


def row_digest(fields: list[tuple[Kind, Column]]) -> Column:
    return F.sha2(framed(fields), 256)


def stream_digest(rows: DataFrame, order: list[str], line: str) -> DataFrame:
    """sha256 and n_rows: the digest of all lines in their order, a newline after each.

    Sorting is distributed; a digest of a stream has no parts, so one task reads the sorted runs, a batch at a time.
    """

    def digest(batches):
        import hashlib

        import pyarrow as pa

        made, n = hashlib.sha256(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                made.update(x.encode() + b"\n")
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([made.hexdigest()]), pa.array([n], pa.int64())], names=["sha256", "n_rows"])

    return rows.orderBy(*order).select(F.coalesce(F.col(line), F.lit("")).alias("line")).coalesce(1).mapInArrow(digest, "sha256 string, n_rows long")


def compare_content(source: DataFrame, target: DataFrame, columns: list[ColumnPlan], baseline: DataFrame | None = None) -> Comparison:
    """Converted source rows, on top of what the target held before, against the target's rows."""
    for c in columns:
        if why := unsupported(c):
            return Comparison(Verified.UNSUPPORTED, reason=why)
    theirs, *parts = canonical_rows(columns, target, source, *([baseline] if baseline is not None else []))
    equal, s, t = multiset_equal(multiset_union(*parts), theirs)
    return Comparison(Verified.COMPLETE if equal else Verified.DIFFERENT, s, t, "" if equal else "rows differ")
