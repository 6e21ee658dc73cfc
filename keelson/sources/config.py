"""The configuration of a run: TOML text to checked dataclasses. Unknown fields and contradictions are errors."""

from __future__ import annotations

import dataclasses
import os
import re
import tomllib
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Literal

from keelson.functions.convert import TRANSFORMS
from keelson.functions.text import SUPPORTED

MAX_HOOK_BYTES = 1 << 20
Choice = Literal


class ConfigError(ValueError):
    def __init__(self, where: str, why: str):
        super().__init__(f"{where}: {why}")
        self.field = where


@dataclass
class Endpoint:
    url_env: str | None = None
    url_file: str | None = None
    tls_mode: Choice["verify_full", "disable"] = "verify_full"
    ca_file: str | None = None
    client_cert: str | None = None
    client_key: str | None = None
    session: dict = field(default_factory=dict)


@dataclass
class Source(Endpoint):
    consistency: Choice["frozen", "single_snapshot"] = None  # required


@dataclass
class Target(Endpoint):
    schema: str = None  # required
    passfile: str | None = None
    on_existing: Choice["error", "recreate", "truncate", "append"] = "error"


@dataclass
class Migration:
    mode: Choice["full", "schema_only", "data_only"] = "full"
    identifiers: Choice["preserve", "downcase", "snake_case"] = "preserve"
    table_workers: int = 1
    readers_per_table: int = 1
    index_workers: int = 1
    batch_rows: int = 25_000
    batch_bytes: int = 16 << 20
    queue_batches: int = 2
    memory_bytes: int = 512 << 20
    max_row_bytes: int = 16 << 20
    on_row_error: Choice["stop", "reject"] = "stop"
    max_rejected_rows: int = 0
    reset_sequences: bool = True
    fulltext: Choice["require_decision", "simple_gin"] = "require_decision"
    rows_per_range: int = 100_000
    max_key_span: int | None = None


@dataclass
class Rename:
    source: str
    target: str
    schema: str | None = None


@dataclass
class Tables:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    include_regex: list[str] = field(default_factory=list)
    exclude_regex: list[str] = field(default_factory=list)
    rename: list[Rename] = field(default_factory=list)
    views: list[str] = field(default_factory=list)


@dataclass
class Guard:
    op: Choice["eq", "lt", "le", "gt", "ge"]
    value: int

    def holds(self, x: int | None) -> bool:
        return x is not None and {"eq": x == self.value, "lt": x < self.value, "le": x <= self.value, "gt": x > self.value, "ge": x >= self.value}[self.op]


@dataclass
class Cast:
    source_type: str | None = None
    source_table: str | None = None
    source_column: str | None = None
    target_type: str | None = None
    transform: str | None = None
    drop_default: bool = False
    drop_not_null: bool = False
    drop_typemod: bool = False
    unsigned: bool | None = None
    not_null: bool | None = None
    auto_increment: bool | None = None
    default: str | None = None
    precision: Guard | None = None
    scale: Guard | None = None
    charset: str | None = None


@dataclass
class Override:
    object: str
    omit: bool = False
    target_expression: str | None = None
    target_sql: str | None = None
    materialize: bool | None = None


@dataclass
class Hooks:
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)


@dataclass
class Verification:
    mode: Choice["counts_and_schema", "content", "none"] = "counts_and_schema"


@dataclass
class Report:
    directory: str = "runs"
    console: Choice["text", "json"] = "text"
    progress: Choice["auto", "always", "never"] = "auto"


@dataclass
class Config:
    version: int
    source: Source
    target: Target
    migration: Migration = field(default_factory=Migration)
    tables: Tables = field(default_factory=Tables)
    cast: list[Cast] = field(default_factory=list)
    overrides: list[Override] = field(default_factory=list)
    hooks: Hooks = field(default_factory=Hooks)
    verification: Verification = field(default_factory=Verification)
    report: Report = field(default_factory=Report)

    def override(self, name: str) -> Override | None:
        return next((o for o in self.overrides if o.object == name), None)

    def omitted(self, name: str) -> bool:
        return (o := self.override(name)) is not None and o.omit


def _build(kind: object, value: object, where: str) -> object:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (types.UnionType, typing.Union):
        return _build(next(a for a in args if a is not type(None)), value, where)
    if origin is Literal:
        if value not in args:
            raise ConfigError(where, f"must be one of {', '.join(args)}")
        return value
    if origin is list:
        if not isinstance(value, list):
            raise ConfigError(where, "must be a list")
        return [_build(args[0], v, where) for v in value]
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ConfigError(where, "must be a table")
        hints = typing.get_type_hints(kind)
        for k in value:
            if k not in hints:
                raise ConfigError(f"{where}.{k}".lstrip("."), "unknown field")
        made = {k: _build(hints[k], v, f"{where}.{k}".lstrip(".")) for k, v in value.items()}
        for f in dataclasses.fields(kind):
            needed = (f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING) or (f.default is None and "None" not in str(hints[f.name]))
            if needed and f.name not in made:
                raise ConfigError(f"{where}.{f.name}".lstrip("."), "is required")
        return kind(**made)
    if kind is int and (not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < 2**63):
        raise ConfigError(where, "must be a whole number, not negative")
    if kind in (bool, str, dict) and not isinstance(value, kind):
        raise ConfigError(where, f"must be of type {kind.__name__}")
    if kind is dict and not all(isinstance(v, str) for v in value.values()):
        raise ConfigError(where, "values must be strings")
    return value


def parse(text: str) -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError("configuration", str(e)) from e
    made = _build(Config, data, "")
    validate(made)
    return made


def load(path: str | Path) -> Config:
    """Read a file; relative paths in it count from its folder."""
    path = Path(path)
    made = parse(path.read_text("utf-8"))
    base = path.parent
    at = lambda p: p if p is None or os.path.isabs(p) else str(base / p)
    for e in (made.source, made.target):
        for name in ("url_file", "ca_file", "client_cert", "client_key", "passfile"):
            if hasattr(e, name):
                setattr(e, name, at(getattr(e, name)))
    made.hooks.before, made.hooks.after = [at(p) for p in made.hooks.before], [at(p) for p in made.hooks.after]
    made.report.directory = at(made.report.directory)
    return made


def _name(name: str, where: str, target: bool = False) -> None:
    if not name or "\0" in name:
        raise ConfigError(where, "needs a name without NUL")
    if target and len(name.encode()) > 63:
        raise ConfigError(where, "target names have 63 bytes at most")


def _schema(name: str, where: str) -> None:
    _name(name, where, True)
    if not name.strip() or name.startswith("pg_") or name == "information_schema":
        raise ConfigError(where, "choose a schema outside the system's own")


#: Session settings that may be given.
SOURCE_SESSION = frozenset("time_zone sql_mode net_read_timeout net_write_timeout wait_timeout interactive_timeout group_concat_max_len".split())
TARGET_SESSION = frozenset(
    "application_name timezone statement_timeout lock_timeout idle_in_transaction_session_timeout work_mem maintenance_work_mem client_min_messages standard_conforming_strings datestyle".split()
)
FIXED_SESSION = {("source", "time_zone"): "+00:00", ("target", "timezone"): "UTC", ("target", "standard_conforming_strings"): "on", ("target", "datestyle"): "ISO, YMD"}


def _endpoint(e: Endpoint, side: str) -> None:
    if (e.url_env is None) == (e.url_file is None):
        raise ConfigError(f"{side}.url_env", "set exactly one of url_env and url_file")
    if e.url_env is not None and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", e.url_env):
        raise ConfigError(f"{side}.url_env", "not a name of an environment variable")
    if e.url_file == "":
        raise ConfigError(f"{side}.url_file", "needs a path")
    if (e.client_cert is None) != (e.client_key is None):
        raise ConfigError(f"{side}.client_cert", "certificate and key go together")
    if e.tls_mode == "disable" and (e.ca_file or e.client_cert):
        raise ConfigError(f"{side}.tls_mode", "certificates contradict disable")
    for key, value in e.session.items():
        where = f"{side}.session.{key}"
        if key not in (SOURCE_SESSION if side == "source" else TARGET_SESSION):
            raise ConfigError(f"{side}.session", f"{key} can't be set")
        if not value or "\0" in value or len(value.encode()) > 1024:
            raise ConfigError(where, "must have 1 to 1024 bytes, without NUL")
        if FIXED_SESSION.get((side, key), value) != value:
            raise ConfigError(where, f"must be {FIXED_SESSION[side, key]}")
        if side == "source" and key not in ("time_zone", "sql_mode") and not re.fullmatch(r"\+?\d+", value):
            raise ConfigError(where, "must be a whole number")


#: Target types that a rule may name.
TARGET_TYPE = re.compile(
    r"(?:(smallint|integer|int|bigint|real|double precision|boolean|bool|bytea|text|jsonb|uuid|inet|date|money|numeric|decimal"
    r"|char|character|varchar|character varying|bit|bit varying|varbit|timestamptz|timetz|interval)(\(\d+(,\d+)?\))?"
    r"|(?:timestamp|time)(?:\(\d+\))?(?: (?:with|without) time zone)?)(\[\])?", re.I)  # fmt: skip


def check_target_type(name: str) -> None:
    """A built-in target type, with a modifier in range if it takes one."""
    text = name.strip().lower()
    if not TARGET_TYPE.fullmatch(text):
        raise ConfigError("cast.target_type", "not a known target type")
    base, _, rest = text.partition("(")
    if not rest:
        return
    n = [int(x) for x in rest.partition(")")[0].split(",")]
    if base in ("numeric", "decimal"):
        fits = 1 <= n[0] <= 1000 and (len(n) == 1 or n[1] <= n[0])
    elif base in ("char", "character", "varchar", "character varying", "bit", "bit varying", "varbit"):
        fits = len(n) == 1 and 1 <= n[0] <= 10_485_760
    else:
        fits = base in ("timestamp", "timestamptz", "time", "timetz", "interval") and len(n) == 1 and n[0] <= 6
    if not fits:
        raise ConfigError("cast.target_type", "modifier out of range")


def check_fragment(text: str, where: str) -> None:
    """One SQL expression: no statement end, comment, dollar sign or open quote."""
    if not text.strip() or "\0" in text:
        raise ConfigError(where, "needs an expression without NUL")
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", " ", text)
    if "'" in bare or '"' in bare:
        raise ConfigError(where, "a quote isn't closed")
    if re.search(r";|--|/\*|\$", bare):
        raise ConfigError(where, "must be one expression without comments or dollar quotes")


#: Types of the source.
SOURCE_TYPES = frozenset(
    "tinyint smallint mediumint int integer bigint decimal numeric float double real bit boolean bool char varchar tinytext text mediumtext longtext"
    " binary varbinary tinyblob blob mediumblob longblob date datetime timestamp time year enum set json geometry point linestring polygon"
    " multipoint multilinestring multipolygon geometrycollection".split()
)


def _cast(rule: Cast) -> None:
    if rule.source_type is None and rule.source_column is None:
        raise ConfigError("cast", "needs source_type or source_column")
    if (rule.source_table is None) != (rule.source_column is None):
        raise ConfigError("cast.source_column", "table and column selectors go together")
    for f in ("source_type", "source_table", "source_column"):
        if getattr(rule, f) is not None:
            _name(getattr(rule, f), f"cast.{f}")
    if rule.source_type is not None and rule.source_type.lower() not in SOURCE_TYPES:
        raise ConfigError("cast.source_type", "not a known source type")
    if not (rule.target_type or rule.transform or rule.charset or rule.drop_default or rule.drop_not_null or rule.drop_typemod):
        raise ConfigError("cast", "has no effect")
    if rule.transform is not None and rule.transform not in TRANSFORMS:
        raise ConfigError("cast.transform", "not a named transform")
    if rule.target_type is not None:
        check_target_type(rule.target_type)
    for f, most in (("precision", 65), ("scale", 30)):
        if (g := getattr(rule, f)) is not None and g.value > most:
            raise ConfigError(f"cast.{f}", f"must be {most} at most")
    if rule.charset is not None and rule.charset not in SUPPORTED:
        raise ConfigError("cast.charset", "has no strict decoder")


def validate(c: Config) -> None:
    if c.version != 1:
        raise ConfigError("version", "must be 1")
    _endpoint(c.source, "source")
    _endpoint(c.target, "target")
    _schema(c.target.schema, "target.schema")
    m = c.migration
    for f in ("table_workers", "readers_per_table", "index_workers", "batch_rows", "batch_bytes", "queue_batches", "memory_bytes", "max_row_bytes", "rows_per_range"):
        if getattr(m, f) == 0:
            raise ConfigError(f"migration.{f}", "must be positive")
    if m.max_key_span == 0:
        raise ConfigError("migration.max_key_span", "must be positive")
    if m.readers_per_table > 1 and m.max_key_span is None:
        raise ConfigError("migration.max_key_span", "several readers need a key span")
    if m.readers_per_table > 1 and c.source.consistency != "frozen":
        raise ConfigError("source.consistency", "several readers need a frozen source")
    if c.source.consistency == "single_snapshot" and (m.table_workers, m.readers_per_table) != (1, 1):
        raise ConfigError("migration.table_workers", "a single snapshot has one worker and one reader")
    if m.max_row_bytes > m.batch_bytes:
        raise ConfigError("migration.max_row_bytes", "must not exceed batch_bytes")
    from keelson.plans.admission import reservation

    if m.mode != "schema_only" and m.memory_bytes < reservation(m):
        raise ConfigError("migration.memory_bytes", "too small for the batches in flight")
    if (m.on_row_error == "reject") != (m.max_rejected_rows > 0):
        raise ConfigError("migration.max_rejected_rows", "positive with reject, zero with stop")
    wrong = {("error", "data_only"): "data_only needs append or truncate", ("recreate", "data_only"): "recreate contradicts data_only", ("truncate", "schema_only"): "truncate contradicts schema_only"}
    if why := wrong.get((c.target.on_existing, m.mode)):
        raise ConfigError("target.on_existing", why)
    if c.target.on_existing == "append" and m.mode != "data_only":
        raise ConfigError("target.on_existing", "append needs data_only")
    t = c.tables
    for f in ("include", "exclude", "views"):
        for n in getattr(t, f):
            _name(n, f"tables.{f}")
        if len(set(getattr(t, f))) != len(getattr(t, f)):
            raise ConfigError(f"tables.{f}", "a name is repeated")
    for f in ("include_regex", "exclude_regex"):
        for p in getattr(t, f):
            if re.search(r"\(\?[=!<]|\\[1-9]|\(\?P=", p):
                raise ConfigError(f"tables.{f}", "look-around and back-references aren't allowed")
            try:
                re.compile(p)
            except re.error as e:
                raise ConfigError(f"tables.{f}", "not a regular expression") from e
    for r in t.rename:
        _name(r.source, "tables.rename.source")
        _name(r.target, "tables.rename.target", True)
        if r.schema is not None:
            _schema(r.schema, "tables.rename.schema")
    if len({r.source for r in t.rename}) != len(t.rename):
        raise ConfigError("tables.rename.source", "a table is renamed twice")
    for rule in c.cast:
        _cast(rule)
    for o in c.overrides:
        if not o.object.strip() or "\0" in o.object:
            raise ConfigError("overrides.object", "needs an object without NUL")
        if o.omit + (o.target_expression is not None) + (o.target_sql is not None) + (o.materialize is not None) != 1:
            raise ConfigError("overrides", "choose one of omit, target_expression, target_sql and materialize")
        if o.target_expression is not None:
            check_fragment(o.target_expression, "overrides.target_expression")
        if o.target_sql is not None and (not o.target_sql.strip() or "\0" in o.target_sql):
            raise ConfigError("overrides.target_sql", "needs SQL without NUL")
    if len({o.object for o in c.overrides}) != len(c.overrides):
        raise ConfigError("overrides.object", "an object has two overrides")
    if not c.report.directory:
        raise ConfigError("report.directory", "needs a path")
