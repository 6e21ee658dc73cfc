"""Source and target catalogues as JSON text or as flat fact tables; and how staged files stand for source tables."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.plans.model import IndexPart, SourceCatalog, SourceCheck, SourceColumn, SourceForeignKey, SourceIndex, SourceTable, UnsupportedObject, from_dict, to_json
from keelson.plans.target import TargetCatalog


def load_source(text: str) -> SourceCatalog:
    return from_dict(SourceCatalog, json.loads(text))


def load_target(text: str) -> TargetCatalog:
    return from_dict(TargetCatalog, json.loads(text))


def fingerprint(source: SourceCatalog, target: TargetCatalog, tables: list[str]) -> str:
    """Of all selected facts, without row estimates and counters that change by themselves."""
    s = json.loads(to_json(source))
    s["tables"] = [{k: v for k, v in t.items() if k not in ("estimated_rows", "next_auto_increment")} for t in s["tables"] if t["name"] in tables]
    return hashlib.sha256(json.dumps([s, dataclasses.asdict(target)], sort_keys=True, default=str).encode()).hexdigest()


def facts(spark: SparkSession, source: SourceCatalog) -> dict[str, DataFrame]:
    """Flat tables of facts: tables, columns, index parts, foreign key parts, checks."""
    t = source.tables
    rows = {
        "tables": ("table_name string, engine string, is_view boolean, estimated_rows long", [(x.name, x.engine, x.is_view, x.estimated_rows) for x in t]),
        "columns": ("table_name string, ordinal int, column_name string, data_type string, column_type string, nullable boolean", [(x.name, c.ordinal, c.name, c.data_type, c.column_type, c.nullable) for x in t for c in x.columns]),
        "index_parts": ("table_name string, index_name string, position int, column_name string, is_unique boolean, is_primary boolean, kind string", [(x.name, i.name, k, p.column, i.unique or i.primary, i.primary, i.kind) for x in t for i in x.indexes for k, p in enumerate(i.parts, 1)]),
        "fk_parts": ("table_name string, constraint_name string, position int, column_name string, referenced_table string, referenced_column string", [(x.name, f.name, k, a, f.referenced_table, b) for x in t for f in x.foreign_keys for k, (a, b) in enumerate(zip(f.columns, f.referenced_columns, strict=True), 1)]),
        "checks": ("table_name string, constraint_name string, expression string, enforced boolean", [(x.name, c.name, c.expression, c.enforced) for x in t for c in x.checks]),
    }
    return {k: spark.createDataFrame(data, kind) for k, (kind, data) in rows.items()}


class FactError(ValueError):
    """Facts that contradict each other."""


def _in_order(parts: list[int], what: str) -> None:
    if parts != list(range(1, len(parts) + 1)):
        raise FactError(f"{what}: its parts are numbered {parts}")


def from_facts(database: str, columns: DataFrame, index_parts: DataFrame | None = None, fk_parts: DataFrame | None = None, checks: DataFrame | None = None, tables: DataFrame | None = None, unsupported: DataFrame | None = None) -> SourceCatalog:
    """A catalogue from flat facts, as information_schema queries give them; names and numbers only, so small.

    Facts have to agree: parts are numbered from 1 without gaps, and belong to columns and tables that are there.
    """
    found = _tables(columns, tables)
    out = _structure(database, found, index_parts, fk_parts, checks)
    for t in out.tables:
        names = [c.name for c in t.columns]
        _in_order(sorted(c.ordinal for c in t.columns), t.name)
        if len(set(names)) != len(names):
            raise FactError(f"{t.name}: a column is named twice")
        for what, used in [(i.name, [p.column for p in i.parts]) for i in t.indexes] + [(f.name, f.columns) for f in t.foreign_keys]:
            if unknown := [u for u in used if u is not None and u not in names]:
                raise FactError(f"{t.name}.{what}: no columns {unknown}")
    if unsupported is not None:
        out.unsupported_objects = [UnsupportedObject(r.kind, r.object, r.reason) for r in unsupported_objects(unsupported).collect()]
    return out


def _tables(columns: DataFrame, facts: DataFrame | None) -> dict[str, SourceTable]:
    tables: dict[str, SourceTable] = {}
    for r in columns.orderBy("table_name", "ordinal").collect():
        d = r.asDict()
        extra = {k: d[k] for k in d if k in {f.name for f in dataclasses.fields(SourceColumn)} and k not in ("name", "ordinal")}
        tables.setdefault(r.table_name, SourceTable(r.table_name, [])).columns.append(SourceColumn(r.column_name, r.ordinal, **extra))
    for r in facts.collect() if facts is not None else ():
        if r.table_name not in tables:
            raise FactError(f"{r.table_name}: a table without columns")
        known = {k: v for k, v in r.asDict().items() if k in ("engine", "is_view", "estimated_rows", "next_auto_increment", "comment") and v is not None}
        known["is_view"] = bool(known.get("is_view"))
        for k, v in known.items():
            setattr(tables[r.table_name], k, v)
    return tables


def _structure(database: str, tables: dict[str, SourceTable], index_parts: DataFrame | None, fk_parts: DataFrame | None, checks: DataFrame | None) -> SourceCatalog:
    def owner(name: str) -> SourceTable:
        if name not in tables:
            raise FactError(f"{name}: facts of an unknown table")
        return tables[name]

    parts: dict[tuple, list] = defaultdict(list)
    for r in index_parts.orderBy("table_name", "index_name", "position").collect() if index_parts is not None else ():
        key = (r.table_name, r.index_name, bool(r.is_unique), bool(r.is_primary), r.kind)
        parts[key].append(IndexPart(r.column_name, prefix_length=r.asDict().get("prefix_length")))
        _in_order([*range(1, len(parts[key])), r.position], r.index_name)
    for (t, name, unique, primary, kind), p in parts.items():
        owner(t).indexes.append(SourceIndex(name, p, unique and not primary, primary, kind))
    keys: dict[tuple, list] = defaultdict(list)
    for r in fk_parts.orderBy("table_name", "constraint_name", "position").collect() if fk_parts is not None else ():
        d = r.asDict()
        key = (r.table_name, r.constraint_name, d.get("referenced_schema") or database, r.referenced_table, d.get("on_update") or "RESTRICT", d.get("on_delete") or "RESTRICT")
        keys[key].append((r.column_name, r.referenced_column))
        _in_order([*range(1, len(keys[key])), r.position], r.constraint_name)
    for (t, name, schema, parent, update, delete), pairs in keys.items():
        owner(t).foreign_keys.append(SourceForeignKey(name, [a for a, _ in pairs], schema, parent, [b for _, b in pairs], update, delete))
    for r in checks.collect() if checks is not None else ():
        owner(r.table_name).checks.append(SourceCheck(r.constraint_name, r.expression, bool(r.enforced)))
    return SourceCatalog(database, [tables[k] for k in sorted(tables)])


def staged(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Staged rows of a source table. CSV is read as text only, with backslash-N for null; conversion decides what a field means."""
    if kind == "csv":
        return spark.read.option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    return spark.read.format(kind).load(path)


def unsupported_objects(*inventories: DataFrame) -> DataFrame:
    """kind, object and reason of everything that isn't migrated, from several inventories."""
    out = inventories[0].select("kind", "object", "reason")
    for i in inventories[1:]:
        out = out.unionAll(i.select("kind", "object", "reason"))
    return out.distinct().orderBy(F.col("object"), F.col("kind"))
