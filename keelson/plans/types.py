"""Names of target types: one normal form for each, or None for what isn't known; and the source types' default mapping."""

from __future__ import annotations

import re

from keelson.plans.model import Kind, SourceColumn

#: Other names of types.
ALIASES = {
    "int2": "smallint", "int": "integer", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision",
    "bool": "boolean", "character varying": "varchar", "char": "character", "bpchar": "character", "decimal": "numeric",
    "bit varying": "varbit", "timestamp with time zone": "timestamptz", "timestamp without time zone": "timestamp",
    "time with time zone": "timetz", "time without time zone": "time",
}
#: Types without a modifier, and those with one.
BARE = frozenset("smallint|integer|bigint|real|double precision|boolean|bytea|text|json|jsonb|uuid|inet|money|date|geometry".split("|"))
SIZED = frozenset("character|varchar|bit|varbit".split("|"))
TIMED = frozenset("timestamp|timestamptz|time|timetz|interval".split("|"))
QUOTED = re.compile(r'\s*(?:"((?:[^"]|"")+)"|([A-Za-z_][\w$]*))\s*(?:\.\s*(?:"((?:[^"]|"")+)"|([A-Za-z_][\w$]*))\s*)?\Z')


def normalise(name: str) -> str | None:
    """The normal form of a type name of a finite grammar; None for anything else, which then equals nothing."""
    if "\0" in name or not name.strip():
        return None
    head, arrays = re.fullmatch(r"\s*(.*?)((?:\s*\[\])*)\s*", name, re.S).groups()
    suffix = "[]" * arrays.count("[]")
    if '"' in head or "." in head:
        m = QUOTED.match(head)
        if not m:
            return None
        parts = [(q.replace('""', '"') if q else p.lower()) for q, p in (m.groups()[:2], m.groups()[2:]) if q or p]
        return ".".join('"' + p.replace('"', '""') + '"' for p in parts) + suffix
    m = re.fullmatch(r"([^()]*)(?:\(([^()]*)\)([^()]*))?", head.lower())
    if not m:
        return None
    base, numbers, tail = (" ".join((x or "").split()) for x in m.groups())
    given = m[2] is not None
    if base.endswith("time zone") and given:
        return None
    if tail:  # words about time zones stand after the modifier
        base = f"{base} {tail}"
        if not re.fullmatch(r"(timestamp|time) with(out)? time zone", base):
            return None
    base = ALIASES.get(base, base)
    sizes = [x.strip() for x in numbers.split(",")] if given else []
    if not all(re.fullmatch(r"[0-9]{1,10}", x) for x in sizes):
        return None
    n = [int(x) for x in sizes]
    if base == "numeric":
        fits = not n or (len(n) <= 2 and 1 <= n[0] <= 1000 and (len(n) == 1 or n[1] <= n[0]))
        n = [*n, 0] if len(n) == 1 else n
    elif base in SIZED:
        fits = not n or (len(n) == 1 and n[0] > 0)
    elif base in TIMED:
        fits = not n or (len(n) == 1 and n[0] <= 6)
    else:
        fits = base in BARE and not n
    return f"{base}({','.join(map(str, n))}){suffix}" if fits and n else f"{base}{suffix}" if fits else None


def same_type(a: str, b: str) -> bool:
    x, y = normalise(a), normalise(b)
    return x is not None and x == y


GEOMETRIES = frozenset("geometry point linestring polygon multipoint multilinestring multipolygon geometrycollection".split())


def source_name(kind: str) -> str:
    """One name for source types that have several."""
    kind = kind.strip().lower()
    return {"integer": "int", "numeric": "decimal", "dec": "decimal", "double precision": "double"}.get(kind, kind)


def default_type(column: SourceColumn) -> tuple[str, Kind, int | None] | None:
    """(target type, kind, bit width) of a source column without a rule; None if it has no mapping."""
    name, unsigned = column.data_type.lower(), column.unsigned
    whole = Kind.UNSIGNED if unsigned else Kind.SIGNED
    wider = {"tinyint": ("smallint", "smallint"), "smallint": ("smallint", "integer"), "mediumint": ("integer", "integer"), "int": ("integer", "bigint"), "integer": ("integer", "bigint"), "bigint": ("bigint", "numeric(20,0)")}
    if name in wider:
        return wider[name][unsigned], whole, None
    if name in ("decimal", "numeric"):
        p, s = column.numeric_precision, column.numeric_scale
        if p is None or s is None or not 1 <= p <= 65 or s > min(30, p):
            return None
        return f"numeric({p},{s})", Kind.DECIMAL, None
    if name == "bit":
        m = re.search(r"\(\s*(\d+)\s*\)", column.column_type)
        width = int(m[1]) if m else 0
        return (f"bit({width})", Kind.BIT, width) if 1 <= width <= 64 else None
    if name in ("char", "varchar"):
        n = column.character_length or 0
        return (f"varchar({n})", Kind.TEXT, None) if n > 0 else None
    digits = column.datetime_precision or 0
    if name in ("datetime", "timestamp", "time"):
        shapes = {"datetime": ("timestamp({}) without time zone", Kind.DATETIME), "timestamp": ("timestamptz({})", Kind.TIMESTAMP), "time": ("interval({})", Kind.INTERVAL)}
        return (shapes[name][0].format(digits), shapes[name][1], None) if digits <= 6 else None
    if name in GEOMETRIES:
        return "geometry", Kind.GEOMETRY, None
    plain = {"float": ("real", Kind.FLOAT), "double": ("double precision", Kind.FLOAT), "real": ("double precision", Kind.FLOAT), "date": ("date", Kind.DATE), "year": ("smallint", Kind.UNSIGNED), "json": ("jsonb", Kind.JSON), "enum": ("enum", Kind.ENUM), "set": ("text[]", Kind.SET)}
    plain |= dict.fromkeys(("tinytext", "text", "mediumtext", "longtext"), ("text", Kind.TEXT))
    plain |= dict.fromkeys(("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob"), ("bytea", Kind.BINARY))
    return (*plain[name], None) if name in plain else None


def chosen_kind(target: str) -> tuple[Kind, int | None] | None:
    """(kind, bit width) of a target type that a rule chose; None for one that can't be written to."""
    target = target.strip().lower()
    base = target.partition("(")[0].strip()
    if base in ("timestamp", "timestamp without time zone"):
        return (Kind.TIMESTAMP if "with time zone" in target and "without" not in target else Kind.DATETIME), None
    if base == "bit":
        m = re.search(r"\((\d+)\)", target)
        return (Kind.BIT, int(m[1])) if m else None
    by_kind = {
        Kind.SIGNED: "smallint|integer|bigint", Kind.DECIMAL: "numeric|decimal", Kind.FLOAT: "real|double precision",
        Kind.TEXT: "text|varchar|character varying|char|character|inet", Kind.SET: "text[]", Kind.BINARY: "bytea", Kind.DATE: "date",
        Kind.TIMESTAMP: "timestamptz|timestamp with time zone", Kind.INTERVAL: "interval|time|time without time zone",
        Kind.BOOLEAN: "boolean|bool", Kind.JSON: "json|jsonb", Kind.GEOMETRY: "geometry",
    }
    return next(((k, None) for k, names in by_kind.items() if base in names.split("|")), None)


def spark_type(column_kind: Kind, target: str) -> str:
    """The Spark type that a column's converted values have."""
    from keelson.functions.convert import SPARK_INTEGERS, base_of, size_of

    if column_kind in (Kind.SIGNED, Kind.UNSIGNED):
        return SPARK_INTEGERS.get(base_of(target), "decimal(20,0)")
    if column_kind == Kind.DECIMAL:
        n = size_of(target)
        return f"decimal({n[0]},{n[1] if len(n) > 1 else 0})" if n and n[0] <= 38 else "string"
    if column_kind == Kind.FLOAT:
        return "float" if base_of(target) == "real" else "double"
    return {Kind.BINARY: "binary", Kind.DATE: "date", Kind.DATETIME: "timestamp_ntz", Kind.TIMESTAMP: "timestamp", Kind.INTERVAL: "interval day to second", Kind.BOOLEAN: "boolean", Kind.SET: "array<string>"}.get(column_kind, "string")


def parse_labels(column_type: str) -> list[str]:
    """The labels of enum('a','b') or set(...), in order; ValueError for anything malformed, NUL, or a repeat."""
    m = re.fullmatch(r"[^(]*\((.*)\)", column_type, re.S)
    one = r"\s*'((?:[^'\\]|''|\\.)*)'\s*"
    if not m or not re.fullmatch(rf"{one}(?:,{one})*", m[1], re.S):
        raise ValueError("malformed labels")
    plain = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
    labels = [re.sub(r"''|\\(.)", lambda x: plain.get(x[1], x[1]) if x[1] else "'", raw, flags=re.S) for raw in re.findall(one, m[1], re.S)]
    if any("\0" in x for x in labels) or len(set(labels)) != len(labels):
        raise ValueError("NUL or repeated label")
    return labels
