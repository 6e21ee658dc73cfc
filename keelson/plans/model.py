"""Plain data that a migration passes around: catalogues, plans and reports. All of it serialises to JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any


class Kind(StrEnum):
    """What a value is, whatever the source calls its type."""

    SIGNED = "signed_integer"
    UNSIGNED = "unsigned_integer"
    DECIMAL = "decimal"
    FLOAT = "float"
    TEXT = "text"
    BINARY = "binary"
    DATE = "date"
    DATETIME = "datetime"
    TIMESTAMP = "timestamp"
    INTERVAL = "interval"
    BIT = "bit"
    BOOLEAN = "boolean"
    JSON = "json"
    ENUM = "enum"
    SET = "set"
    GEOMETRY = "geometry"


class Severity(StrEnum):
    WARNING = "warning"
    ERROR = "error"


class Phase(StrEnum):
    PREPARE = "prepare"
    FINALIZE = "finalize"
    SEQUENCE = "sequence"


class Status(StrEnum):
    RUNNING = "running"
    COMPLETE = "complete"
    PARTIAL = "partial"
    FAILED = "failed"
    CANCELLED = "cancelled"
    INDETERMINATE = "indeterminate"


class Verified(StrEnum):
    NOT_RUN = "not_run"
    COMPLETE = "complete"
    DIFFERENT = "different"
    UNSUPPORTED = "unsupported"
    ERROR = "error"


@dataclass
class SourceColumn:
    name: str
    ordinal: int
    data_type: str
    column_type: str
    nullable: bool = True
    default: str | None = None
    default_is_expression: bool = False
    default_bytes_hex: str | None = None
    extra: str = ""
    charset: str | None = None
    collation: str | None = None
    generation_expression: str | None = None
    numeric_precision: int | None = None
    numeric_scale: int | None = None
    datetime_precision: int | None = None
    character_length: int | None = None
    comment: str = ""

    @property
    def unsigned(self) -> bool:
        return "unsigned" in self.column_type.lower()

    @property
    def auto_increment(self) -> bool:
        return "auto_increment" in self.extra.lower()


@dataclass
class IndexPart:
    column: str | None = None
    expression: str | None = None
    prefix_length: int | None = None
    descending: bool = False


@dataclass
class SourceIndex:
    name: str
    parts: list[IndexPart]
    unique: bool = False
    primary: bool = False
    kind: str = "BTREE"


@dataclass
class SourceForeignKey:
    name: str
    columns: list[str]
    referenced_schema: str
    referenced_table: str
    referenced_columns: list[str]
    on_update: str = "RESTRICT"
    on_delete: str = "RESTRICT"


@dataclass
class SourceCheck:
    name: str
    expression: str
    enforced: bool = True


@dataclass
class SourceTable:
    name: str
    columns: list[SourceColumn]
    engine: str = "InnoDB"
    is_view: bool = False
    charset: str | None = None
    estimated_rows: int | None = None
    next_auto_increment: int | None = None
    indexes: list[SourceIndex] = field(default_factory=list)
    foreign_keys: list[SourceForeignKey] = field(default_factory=list)
    checks: list[SourceCheck] = field(default_factory=list)
    comment: str = ""


@dataclass
class UnsupportedObject:
    kind: str
    object: str
    reason: str


@dataclass
class SourceCatalog:
    database: str
    tables: list[SourceTable]
    server_version: str = "8.4.0"
    auto_increment_increment: int = 1
    auto_increment_offset: int = 1
    unsupported_objects: list[UnsupportedObject] = field(default_factory=list)


@dataclass
class ColumnPlan:
    source_name: str
    target_name: str
    source_type: str
    target_type: str
    kind: Kind
    bits: int | None = None
    nullable: bool = True
    default_sql: str | None = None
    identity: bool = False
    generated_expression: str | None = None
    copy: bool = True
    transform: str | None = None
    charset: str | None = None
    enum_labels: list[str] = field(default_factory=list)
    set_labels: list[str] = field(default_factory=list)
    comment: str | None = None


@dataclass
class IndexExpectation:
    name: str
    columns: list[str]
    expressions: list[str | None]
    unique: bool
    primary: bool
    descending: list[bool]
    fulltext_columns: list[str] | None = None


@dataclass
class ForeignKeyExpectation:
    name: str
    columns: list[str]
    referenced_schema: str
    referenced_table: str
    referenced_columns: list[str]
    on_update: str
    on_delete: str


@dataclass
class CheckExpectation:
    name: str
    expression: str
    set_column: str | None = None
    set_labels: list[str] | None = None


@dataclass
class SequenceExpectation:
    column: str
    max_value: int
    next_minimum: int
    increment: int = 1
    min_value: int = 1
    cycle: bool = False
    preserved_state: dict | None = None


@dataclass
class Expectations:
    complete: bool = False
    comment: str | None = None
    indexes: list[IndexExpectation] = field(default_factory=list)
    foreign_keys: list[ForeignKeyExpectation] = field(default_factory=list)
    checks: list[CheckExpectation] = field(default_factory=list)
    sequences: list[SequenceExpectation] = field(default_factory=list)


@dataclass
class TablePlan:
    id: str
    source_name: str
    target_schema: str
    target_name: str
    columns: list[ColumnPlan] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    engine: str = "InnoDB"
    is_view: bool = False
    estimated_rows: int | None = None
    next_auto_increment: int | None = None
    structure: Expectations = field(default_factory=Expectations)

    @property
    def copied(self) -> list[ColumnPlan]:
        return [c for c in self.columns if c.copy]


@dataclass
class Diagnostic:
    code: str
    object: str | None
    message: str
    severity: Severity = Severity.ERROR
    stage: str = "plan"


@dataclass
class DdlStep:
    phase: Phase
    object: str
    sql: str
    table_id: str | None = None


@dataclass
class HookPlan:
    before: bool
    path: str
    sha256: str


@dataclass
class MigrationPlan:
    source_database: str
    source_version: str
    target_schema: str
    target_version: str | None
    consistency: str
    mode: str
    verification: str
    on_existing: str
    reset_sequences: bool = True
    version: int = 1
    tables: list[TablePlan] = field(default_factory=list)
    ddl: list[DdlStep] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    transformations: list[str] = field(default_factory=list)
    hooks: list[HookPlan] = field(default_factory=list)
    max_row_bytes: int | None = None


@dataclass
class Baseline:
    """What a table held before a run appended to it."""

    rows: int
    files: list[str]


@dataclass
class TableReport:
    id: str
    source_name: str
    target_schema: str
    target_name: str
    status: Status = Status.RUNNING
    rows_read: int = 0
    committed_rows: int = 0
    committed_bytes: int = 0
    copy_elapsed_millis: int = 0
    rejected_rows: int = 0
    unresolved_rows: int = 0
    indeterminate_rows: int = 0
    transformations: dict[str, int] = field(default_factory=dict)

    @property
    def accounted_rows(self) -> int:
        return self.committed_rows + self.rejected_rows + self.unresolved_rows + self.indeterminate_rows


@dataclass
class VerificationReport:
    mode: str
    status: Verified = Verified.NOT_RUN
    tables_checked: int = 0
    differences: list[str] = field(default_factory=list)


@dataclass
class RunReport:
    run_id: str
    consistency: str
    mode: str
    verification: VerificationReport
    status: Status = Status.RUNNING
    version: int = 1
    plan_sha256: str = ""
    source_endpoint_sha256: str = ""
    target_endpoint_sha256: str = ""
    tables: list[TableReport] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    failed_steps: list[str] = field(default_factory=list)
    baselines: dict[str, Baseline] = field(default_factory=dict)
    sequences: dict[str, dict[str, int]] = field(default_factory=dict)
    phases: list[list] = field(default_factory=list)  # name, first and last millisecond
    elapsed_millis: int = 0
    artifact_dir: str = ""

    def exit_code(self) -> int:
        """1 failure or unclear outcome, 130 cancelled, 4 verification, 3 rejected rows, 0 all well; the first that holds."""
        unsettled = {Status.FAILED, Status.INDETERMINATE, Status.RUNNING}
        settled = {Status.COMPLETE, Status.PARTIAL}
        broken = (
            self.status in unsettled
            or any(d.severity == Severity.ERROR for d in self.diagnostics)
            or any(t.status in unsettled or t.indeterminate_rows for t in self.tables)
            or any(t.status in settled and (t.unresolved_rows or t.accounted_rows != t.rows_read) for t in self.tables)
            or bool(self.failed_steps)
            or self.verification.status == Verified.ERROR
        )
        if broken:
            return 1
        if Status.CANCELLED in (self.status, *(t.status for t in self.tables)):
            return 130
        v = self.verification
        if v.mode != "none" and (v.status != Verified.COMPLETE or v.differences or v.tables_checked != len(self.tables)):
            return 4
        if self.status == Status.PARTIAL or any(t.rejected_rows or t.status == Status.PARTIAL for t in self.tables):
            return 3
        return 0


def to_json(value: Any, **kw: Any) -> str:
    return json.dumps(dataclasses.asdict(value), ensure_ascii=False, **kw)


def from_dict(cls: type, data: Any) -> Any:
    """Rebuild a dataclass (nested ones too) from what to_json wrote; unknown fields are errors."""
    import types
    import typing

    def build(kind: Any, x: Any) -> Any:
        origin, args = typing.get_origin(kind), typing.get_args(kind)
        if origin in (typing.Union, types.UnionType):
            return None if x is None else build(next(a for a in args if a is not type(None)), x)
        if origin is list:
            return [build(args[0], i) for i in x]
        if origin is dict:
            return {k: build(args[1], v) for k, v in x.items()}
        if dataclasses.is_dataclass(kind):
            return from_dict(kind, x)
        if isinstance(kind, type) and issubclass(kind, StrEnum):
            return kind(x)
        return x

    hints = typing.get_type_hints(cls)
    if extra := set(data) - {f.name for f in dataclasses.fields(cls)}:
        raise ValueError(f"unknown fields of {cls.__name__}: {sorted(extra)}")
    return cls(**{k: build(hints[k], v) for k, v in data.items()})
