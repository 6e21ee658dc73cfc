"""A whole run over source tables: plan, prepare, stage, publish, check keys, verify, report.

The target is a folder for each schema with a Parquet table in it. Tables are staged side by side, as
many as the configuration admits; each is one lazy frame that Spark schedules. Nothing is published before the
rejects of all tables are known to be within the bound of the run.
"""

from __future__ import annotations

import dataclasses
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from keelson.operators import constraints, load
from keelson.operators.verify import enforced_keys, verify
from keelson.plans.admission import Admission, admit
from keelson.plans.model import Baseline, Diagnostic, Kind, MigrationPlan, Phase, RunReport, Severity, Status, TablePlan, TableReport, VerificationReport, Verified, from_dict
from keelson.plans.target import EnumType, Namespace, Observed, ObservedColumn, TargetCatalog, TargetTable, graph_of, observed_of
from keelson.sources import artifacts
from keelson.sources.config import Config

SAVE_MODE = {"error": "errorifexists", "recreate": "overwrite", "truncate": "overwrite", "append": "append"}


class FinalizeError(RuntimeError):
    """A key can't be built on the loaded rows."""


@dataclass
class FileTarget:
    """Tables as Parquet folders below a root, which every executor can reach; the next values of their sequences beside them."""

    spark: SparkSession
    root: str

    def path(self, schema: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{schema}/{name}"

    def exists(self, schema: str, name: str) -> bool:
        path, files = load.path_of(self.spark, self.path(schema, name))
        return files.exists(path)

    def read(self, schema: str, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self.path(schema, name)) if self.exists(schema, name) else None

    def baseline(self, schema: str, name: str) -> Baseline | None:
        """What a table holds now: its rows, and the files by which they can be read later on."""
        rows = self.read(schema, name)
        return None if rows is None else Baseline(rows.count(), sorted(rows.inputFiles()))

    def held(self, known: Baseline | None) -> DataFrame | None:
        return self.spark.read.parquet(*known.files) if known and known.files else None

    def _saved(self, schema: str, name: str, what: str) -> object:
        path, files = load.path_of(self.spark, f"{self.path(schema, name)}.{what}.json")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0]) if files.exists(path) else None

    def _save(self, schema: str, name: str, what: str, value: object) -> None:
        path, files = load.path_of(self.spark, f"{self.path(schema, name)}.{what}.json")
        out = files.create(path, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def states(self, schema: str, name: str) -> dict[str, int]:
        """Next values of a table's sequences, by column."""
        return self._saved(schema, name, "sequences") or {}

    def set_states(self, schema: str, name: str, states: dict[str, int]) -> None:
        self._save(schema, name, "sequences", states)

    def prepare(self, plan: MigrationPlan) -> None:
        """Folders need no statements."""

    def complete(self, plan: MigrationPlan, phase: Phase) -> None:
        """Keys are checks of the rows here, and sequences are kept beside them."""

    def publish(self, staged: load.Staged, mode: str, reject_dir: str | None) -> load.Loaded:
        return staged.publish(mode, reject_dir)

    def record(self, t: TablePlan) -> None:
        """Keep the structure of a table that a run has made, which its files don't hold."""
        enums = [[c.target_type, c.enum_labels] for c in t.columns if c.kind == Kind.ENUM]
        self._save(t.target_schema, t.target_name, "structure", {"observed": dataclasses.asdict(observed_of(t, 1, {})), "enums": enums})

    def table(self, schema: str, name: str, oid: int) -> tuple[TargetTable, list[EnumType]] | None:
        """A table as it is: by its record where the files still agree with it, else by its columns alone."""
        rows = self.read(schema, name)
        if rows is None:
            return None
        known, enums = self._saved(schema, name, "structure"), []
        plain = [ObservedColumn(f.name, f.dataType.simpleString(), not f.metadata.get(load.NEVER_NULL, False)) for f in rows.schema]
        seen = Observed(oid, plain)
        if known and [c["name"] for c in known["observed"]["columns"]] == rows.columns:
            seen = from_dict(Observed, known["observed"])
            seen.oid = oid
            for q in seen.sequences:
                q.last_value = self.states(schema, name).get(q.column, q.minimum)
            for kind, labels in known["enums"]:
                space, own = (x.replace('""', '"') for x in re.fullmatch(r'"((?:[^"]|"")*)"\."((?:[^"]|"")*)"', kind).groups())
                enums.append(EnumType(space, own, labels))
        return TargetTable(schema, name, seen), enums

    def names(self, schema: str) -> list[str]:
        """The tables of a schema."""
        path, files = load.path_of(self.spark, f"{self.root.rstrip('/')}/{schema}")
        return sorted(f.getPath().getName() for f in files.listStatus(path) if f.isDirectory() and not re.search(r"^\.|\.(staging|replaced)-[0-9a-f]+$", f.getPath().getName())) if files.exists(path) else []

    def catalog(self, schemas: list[str], tables: list[tuple[str, str]] | None = None) -> TargetCatalog:
        """What a plan needs to know of the tables of some schemas, or of some of them; dependencies are those of all."""
        found, enums = [], []
        for schema, name in ((s, n) for s in schemas for n in self.names(s)):
            made, kinds = self.table(schema, name, len(found) + 1)
            found.append(made)
            enums += kinds
        chosen = [t for t in found if tables is None or (t.schema, t.name) in tables]
        return TargetCatalog(None, True, [Namespace(s, True) for s in schemas], chosen, enums, ["postgis"], graph_of(found))


@dataclass
class Run:
    spark: SparkSession
    config: Config
    plan: MigrationPlan
    source: Callable[[TablePlan], DataFrame]
    target: FileTarget
    events: Callable[[dict], None] = lambda e: None
    report: RunReport = field(init=False)
    admission: Admission | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.began, self.id = time.time(), uuid.uuid4().hex
        p, c = self.plan, self.config
        self.report = RunReport(self.id, p.consistency, p.mode, VerificationReport(p.verification), diagnostics=list(p.diagnostics), exclusions=list(p.exclusions))
        self.report.source_endpoint_sha256, self.report.target_endpoint_sha256 = artifacts.known_digest(c.source), artifacts.known_digest(c.target)
        self.pinned: dict[str, DataFrame] = {}

    def tell(self, kind: str, phase: str, table: TableReport | None = None, **more: object) -> None:
        done = [table] if table else self.report.tables
        self.events(
            {"version": 1, "kind": kind, "run_id": self.id, "table": table.source_name if table else None, "phase": phase, "elapsed_millis": self.elapsed(),
             "committed_rows": sum(t.committed_rows for t in done), "committed_bytes": sum(t.committed_bytes for t in done), "rejected_rows": sum(t.rejected_rows for t in done), **more}
        )

    def elapsed(self) -> int:
        return int((time.time() - self.began) * 1000)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Tell of a phase and keep its interval, whether it ends well or not."""
        self.tell("phase", name)
        first = self.elapsed()
        try:
            yield
        finally:
            self.report.phases.append([name, first, self.elapsed()])

    def go(self) -> RunReport:
        """Admission comes before anything is written but the run's own folder."""
        folder = artifacts.new_run_dir(self.config.report.directory, self.id)
        self.report.artifact_dir, self.report.plan_sha256 = str(folder), artifacts.write_plan(folder, self.plan)
        artifacts.write_report(folder, self.report)
        try:
            indexes = sum(d.phase == Phase.FINALIZE for d in self.plan.ddl)
            self.admission = admit(self.config.migration, self.plan.consistency, len(self.plan.tables), indexes)
            with artifacts.schema_locks(f"{self.config.report.directory}/locks", [t.target_schema for t in self.plan.tables]):
                self.steps(folder)
        except KeyboardInterrupt:
            self.spark.sparkContext.cancelAllJobs()
            self.report.status = Status.CANCELLED
        except Exception as e:
            self.report.failed_steps.append(artifacts.safe(f"{type(e).__name__}: {e}"))
            self.report.status = Status.INDETERMINATE if any(t.status == Status.INDETERMINATE for t in self.report.tables) else Status.FAILED
        finally:
            load.remove(self.spark, self.snapshot_folder())
        self.report.elapsed_millis = self.elapsed()
        artifacts.write_report(folder, self.report)
        self.tell("run", "finished")
        return self.report

    def snapshot_folder(self) -> str:
        return f"{self.target.root.rstrip('/')}/.snapshot-{self.id}"

    def rows(self, t: TablePlan) -> DataFrame:
        """A table's source rows, the same in every pass: a list of files is taken once, and what isn't files is written once where the plan asks for a snapshot."""
        if t.id not in self.pinned:
            rows = self.source(t)
            if self.plan.consistency == "single_snapshot" and not rows.inputFiles():
                where = f"{self.snapshot_folder()}/{t.id}"
                rows.write.parquet(where)
                rows = self.spark.read.parquet(where)
            self.pinned[t.id] = rows
        return self.pinned[t.id]

    def steps(self, folder) -> None:
        p = self.plan
        artifacts.run_hooks(self.spark, p.hooks, True)
        self.report.tables = [TableReport(t.id, t.source_name, t.target_schema, t.target_name) for t in p.tables]
        if p.on_existing == "append":
            self.report.baselines = {t.id: b for t in p.tables if (b := self.target.baseline(t.target_schema, t.target_name)) is not None}
        if p.mode == "schema_only":
            self.target.prepare(p)
            self.target.complete(p, Phase.FINALIZE)
            for r in self.report.tables:
                r.status = Status.COMPLETE
        else:
            with self.phase("copy"):
                self.copy(str(folder))
            with self.phase("index_constraints"):
                self.finalize()
        bad = sum(t.rejected_rows for t in self.report.tables)
        if bad and any(not h.before for h in p.hooks):
            self.report.diagnostics.append(Diagnostic("AFTER_HOOK_SUPPRESSED", None, "rows were rejected", Severity.WARNING, "hooks"))
        else:
            artifacts.run_hooks(self.spark, p.hooks, False)
        with self.phase("verify"):
            if p.mode == "schema_only":
                self.report.verification = VerificationReport(p.verification, Verified.NOT_RUN if p.verification == "none" else Verified.COMPLETE, len(p.tables))
            else:
                self.report.verification = verify(p, self.report, self.rows, self.target.read, held=self.target.held, states=self.report.sequences, observed=self.observed)
        self.report.status = Status.PARTIAL if bad else Status.COMPLETE

    def observed(self, t: TablePlan) -> Observed | None:
        made = self.target.table(t.target_schema, t.target_name, 1)
        return made[0].observed if made else None

    def copy(self, folder: str) -> None:
        """Stage every table, hold all rejects against the run's bound, then publish."""
        p, m = self.plan, self.config.migration
        staged: list[load.Staged | None] = [None] * len(p.tables)

        def stage(i: int) -> None:
            t = p.tables[i]
            held = self.target.held(self.report.baselines.get(t.id))
            try:
                staged[i] = load.stage_table(
                    self.rows(t), t, self.target.path(t.target_schema, t.target_name), on_row_error=m.on_row_error, max_rejected=m.max_rejected_rows,
                    max_row_bytes=p.max_row_bytes, keys=enforced_keys(p, t, held), held=held,
                )
                self.report.tables[i] = staged[i].report
            except Exception:
                self.report.tables[i].status = Status.FAILED
                raise

        try:
            with ThreadPoolExecutor(max(1, self.admission.table_workers)) as pool:
                list(pool.map(stage, range(len(p.tables))))
            if (bad := sum(s.bad for s in staged)) > m.max_rejected_rows:
                for s in staged:
                    s.report.status, s.report.unresolved_rows = Status.FAILED, s.total
                raise load.RejectLimit(f"{bad} rejected rows exceed {m.max_rejected_rows}")
            self.target.prepare(p)
            for s in staged:
                made = self.target.publish(s, SAVE_MODE[p.on_existing], folder)
                self.report.diagnostics += made.diagnostics
                if p.mode == "full":
                    self.target.record(s.table)
                self.tell("table", "copy", made.report)
        finally:
            for s in staged:
                if s is not None:
                    s.discard()

    def finalize(self) -> None:
        """Unique keys that this run makes must hold; sequences continue after what they and the rows have reached."""
        p = self.plan
        for t in p.tables if p.mode == "full" else ():
            rows = self.target.read(t.target_schema, t.target_name)
            for key, primary in constraints.unique_keys(t):
                if bad := constraints.unique_violations(rows, key, primary).limit(1).count():
                    raise FinalizeError(f"{t.target_name}: a unique key on {', '.join(key)} can't be built: {bad} or more violations")
        self.target.complete(p, Phase.FINALIZE)
        self.target.complete(p, Phase.SEQUENCE)
        for t in p.tables:
            if not p.reset_sequences or not t.structure.sequences:
                continue
            rows = self.target.read(t.target_schema, t.target_name)
            known = self.target.states(t.target_schema, t.target_name) if p.on_existing in ("append", "truncate") else {}
            for s in t.structure.sequences:
                floor = constraints.sequence_floor(rows, s.column, s.next_minimum, s.min_value, known.get(s.column, 1))
                if floor > s.max_value:
                    raise FinalizeError(f"{t.target_name}.{s.column}: no value of the sequence is left")
                known[s.column] = floor
            self.target.set_states(t.target_schema, t.target_name, known)
            self.report.sequences[t.id] = known


def totals(report: RunReport) -> dict[str, int]:
    names = ("rows_read", "committed_rows", "committed_bytes", "rejected_rows", "unresolved_rows", "indeterminate_rows")
    return {n: sum(getattr(t, n) for t in report.tables) for n in names}


def rate(total: int, millis: int) -> int:
    """Per second; 0 if no time passed."""
    return total * 1000 // millis if millis > 0 else 0


def summary(report: RunReport) -> str:
    n = totals(report)
    lines = [f"run {report.run_id}: {report.status}", f"rows read {n['rows_read']}, committed {n['committed_rows']}, rejected {n['rejected_rows']}, unresolved {n['unresolved_rows']}, indeterminate {n['indeterminate_rows']}",
             f"bytes {n['committed_bytes']}, {rate(n['committed_bytes'], report.elapsed_millis)} bytes/s", f"verification {report.verification.mode}: {report.verification.status}"]
    lines += [f"  {d}" for d in report.verification.differences]
    lines += [f"{d.severity}: {d.code} {d.object or ''}: {d.message}" for d in report.diagnostics]
    return "\n".join(map(artifacts.safe, lines))
