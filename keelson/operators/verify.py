"""Checks of a finished run: counts, accounts, schema, keys, structure, sequences and content. What can't be proven is unsupported, never passed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import constraints, multiset
from keelson.plans.model import Baseline, Kind, MigrationPlan, RunReport, TablePlan, TableReport, VerificationReport, Verified
from keelson.plans.safe_expression import is_safe, to_spark
from keelson.plans.target import Observed
from keelson.plans.types import same_type, spark_type

#: The graver verdict first.
GRAVITY = (Verified.DIFFERENT, Verified.ERROR, Verified.UNSUPPORTED, Verified.COMPLETE)


def graver(*verdicts: Verified) -> Verified:
    return next((g for g in GRAVITY if g in verdicts), Verified.COMPLETE)


def schema_differences(table: TablePlan, target: DataFrame) -> list[str]:
    want = [(c.target_name, spark_type(c.kind, c.target_type)) for c in table.columns if c.copy or c.generated_expression]
    have = target.dtypes
    out = [f"{table.target_name}: columns {[n for n, _ in have]} instead of {[n for n, _ in want]}"] if [n for n, _ in want] != [n for n, _ in have] else []
    known = {c.target_name: c for c in table.columns}
    return out + [f"{table.target_name}.{n}: {h} instead of {w}" for (n, w), (m, h) in zip(want, have, strict=False) if n == m and w != h and known[n].copy]


def null_differences(table: TablePlan, target: DataFrame) -> list[str]:
    solid = [c.target_name for c in table.copied if not c.nullable and c.target_name in target.columns]
    if not solid:
        return []
    counts = target.agg(*(F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in solid)).first()
    return [f"{table.target_name}.{n}: {counts[n]} nulls" for n in solid if counts[n]]


def primary_key_check(table: TablePlan, target: DataFrame) -> tuple[Verified, list[str]]:
    keys = [c.target_name for s in table.primary_key for c in table.columns if c.source_name == s]
    expected = [i.columns for i in table.structure.indexes if i.primary]
    if len(expected) > 1 or (expected and expected[0] != keys):
        return Verified.UNSUPPORTED, [f"{table.target_name}: ambiguous primary key"]
    if not keys:
        return Verified.COMPLETE, []
    bad = constraints.unique_violations(target, keys, primary=True).count()
    return (Verified.DIFFERENT, [f"{table.target_name}: {bad} primary key violations"]) if bad else (Verified.COMPLETE, [])


def structure_check(table: TablePlan, target: DataFrame, parent: Callable[[str, str], DataFrame | None]) -> tuple[Verified, list[str]]:
    """Unique indexes, foreign keys and checks hold in the data."""
    verdicts, out = [Verified.COMPLETE], []

    def found(n: int, what: str) -> None:
        if n:
            verdicts.append(Verified.DIFFERENT)
            out.append(f"{table.target_name}: {n} {what}")

    for i in (i for i in table.structure.indexes if i.unique and not i.primary):
        if any(i.expressions):
            verdicts.append(Verified.UNSUPPORTED)
            out.append(f"{table.target_name}.{i.name}: an index on an expression can't be checked")
        else:
            found(constraints.unique_violations(target, i.columns).count(), f"keys repeat in {i.name}")
    for fk in table.structure.foreign_keys:
        theirs = parent(fk.referenced_schema, fk.referenced_table)
        if theirs is None:
            verdicts.append(Verified.ERROR)
            out.append(f"{table.target_name}.{fk.name}: the parent can't be read")
        else:
            found(constraints.fk_orphans(target, fk.columns, theirs, fk.referenced_columns).count(), f"rows without a parent in {fk.name}")
    for c in table.structure.checks:
        if c.set_labels is not None:
            found(constraints.set_violations(target, c.set_column, c.set_labels).count(), f"rows outside the labels of {c.set_column}")
        elif is_safe(c.expression):
            found(constraints.check_violations(target, to_spark(c.expression)).count(), f"rows against {c.name}")
        else:
            verdicts.append(Verified.UNSUPPORTED)
            out.append(f"{table.target_name}.{c.name}: the check can't be run")
    return graver(*verdicts), out


def sequence_check(table: TablePlan, target: DataFrame, states: dict[str, int]) -> tuple[Verified, list[str]]:
    """states: the next value of each identity column; without one the floor can't be confirmed."""
    verdicts, out = [Verified.COMPLETE], []
    for s in table.structure.sequences:
        floor = constraints.sequence_floor(target, s.column, s.next_minimum, s.min_value)
        if floor > s.max_value:
            verdicts.append(Verified.DIFFERENT)
            out.append(f"{table.target_name}.{s.column}: no value is left")
        elif s.column not in states:
            verdicts.append(Verified.UNSUPPORTED)
            out.append(f"{table.target_name}.{s.column}: the sequence's state isn't known")
        elif s.preserved_state is None and not floor <= states[s.column] <= s.max_value:
            verdicts.append(Verified.DIFFERENT)
            out.append(f"{table.target_name}.{s.column}: next value {states[s.column]} is below {floor}")
    return graver(*verdicts), out


def counts_check(t: TableReport, source_rows: int, target_rows: int, baseline: int = 0) -> list[str]:
    out = []
    if t.accounted_rows != t.rows_read:
        out.append(f"{t.source_name}: {t.rows_read} rows read, {t.accounted_rows} accounted for")
    if source_rows != t.rows_read:
        out.append(f"{t.source_name}: {source_rows} rows at the source, {t.rows_read} read")
    if target_rows != baseline + t.committed_rows:
        out.append(f"{t.source_name}: {target_rows} rows at the target instead of {baseline + t.committed_rows}")
    return out


def column_differences(table: TablePlan, seen: Observed) -> tuple[list[str], list[str]]:
    """(differences, what can't be told) between the planned columns and the observed ones: name, type, nullability, identity, generation, default, comment."""
    from keelson.plans.default_values import same_default

    out, unknown = [], []
    if [c.target_name for c in table.columns] != [c.name for c in seen.columns]:
        return [f"{table.target_name}: other columns than planned"], []
    for want, have in zip(table.columns, seen.columns, strict=True):
        name = f"{table.target_name}.{want.target_name}"
        pairs = {
            "nullability": (want.nullable, have.nullable), "identity": ("by_default" if want.identity else "", have.identity),
            "generation": (want.generated_expression, have.generated), "comment": (want.comment or None, have.comment or None),
        }
        typed = want.target_type == have.type if want.kind == Kind.ENUM else same_type(want.target_type, have.type)
        out += [f"{name}: another type"] if not typed else []
        out += [f"{name}: another {what}" for what, (a, b) in pairs.items() if a != b]
        if not want.identity and want.generated_expression is None:
            verdict = same_default(want.default_sql, have.default, want)
            (out if verdict == "different" else unknown).extend([f"{name}: the default is {verdict}"] if verdict != "equal" else [])
    return out, unknown


def object_differences(table: TablePlan, seen: Observed) -> list[str]:
    """Planned indexes, foreign keys, checks, sequences and comment that weren't observed."""
    from keelson.plans.default_values import same_check

    want, name, out = table.structure, table.target_name, []
    indexes = [(i.columns, i.unique or i.primary, i.primary, i.descending) for i in seen.indexes]
    out += [f"{name}.{i.name}: no index has these keys" for i in want.indexes if (i.columns, i.unique or i.primary, i.primary, i.descending) not in indexes]
    keys = [(c.columns, tuple(c.referenced or ()), c.referenced_columns, c.on_update, c.on_delete) for c in seen.constraints if c.kind == "f"]
    out += [f"{name}.{f.name}: no foreign key is the same" for f in want.foreign_keys if (f.columns, (f.referenced_schema, f.referenced_table), f.referenced_columns, f.on_update, f.on_delete) not in keys]
    checks = [c.expression for c in seen.constraints if c.kind == "c"]
    out += [f"{name}.{c.name}: no check is the same" for c in want.checks if not any(same_check(c, e) for e in checks)]
    sequences = [(q.column, q.increment, q.minimum, q.maximum, q.cache, q.cycle) for q in seen.sequences]
    out += [f"{name}.{q.column}: the sequence has other options" for q in want.sequences if (q.column, q.increment, q.min_value, q.max_value, 1, q.cycle) not in sequences]
    return out + ([f"{name}: another comment"] if want.comment and want.comment != seen.comment else [])


def enforced_keys(plan: MigrationPlan, table: TablePlan, held: DataFrame | None) -> list[list[str]]:
    """Keys that a table has while it is loaded: those of a table that stays and isn't made by the run. Rows that they refuse are rejects."""
    there = plan.on_existing == "truncate" or (plan.on_existing == "append" and held is not None)
    return [k for k, _ in constraints.unique_keys(table)] if there and plan.mode == "data_only" else []


def loaded_rows(made: DataFrame, plan: MigrationPlan, table: TablePlan, held: DataFrame | None) -> DataFrame:
    """What a run keeps of converted rows."""
    from keelson.operators.load import ORDINAL, PROBLEMS, duplicates, good

    if keys := enforced_keys(plan, table, held):
        names = [c.target_name for c in table.columns if c.target_name in made.columns]
        kept, _ = duplicates(made.where(F.size(PROBLEMS) == 0).select(*(f"`{n}`" for n in names), ORDINAL), table, keys, held)
        return kept.drop(ORDINAL)
    return good(made, table)


def verify(plan: MigrationPlan, report: RunReport, source: Callable[[TablePlan], DataFrame], target: Callable[[str, str], DataFrame | None], *, held: Callable[[Baseline | None], DataFrame | None] = lambda b: None, states: dict[str, dict[str, int]] | None = None, observed: Callable[[TablePlan], Observed | None] = lambda t: None) -> VerificationReport:
    """Counts and schema of every table, and its rows too if the plan asks for content. Plan and report must name the same tables, once each.

    held: the rows that a baseline of the report stands for; states: the next values of each table's sequences; observed: the
    structure of the target's table where one is known, which is then held against the plan's beside what the rows themselves show.
    """
    from keelson.operators.load import converted

    out = VerificationReport(plan.verification)
    if plan.verification == "none":
        return out
    verdicts: list[Verified] = []
    reports = {t.id: t for t in report.tables}
    if len(reports) != len(report.tables) or set(reports) != {t.id for t in plan.tables}:
        out.status, out.differences = Verified.UNSUPPORTED, ["plan and report name other tables"]
        return out
    if plan.verification == "content" and (why := multiset.unsupported_plan(plan.mode, plan.tables)):
        out.status, out.differences = Verified.UNSUPPORTED, [why]
        return out
    for t in plan.tables:
        rows = target(t.target_schema, t.target_name)
        if rows is None or not t.structure.complete:
            verdicts.append(Verified.DIFFERENT if rows is None else Verified.UNSUPPORTED)
            out.differences.append(f"{t.target_name}: {'missing' if rows is None else 'its expected structure is incomplete'}")
            continue
        before = report.baselines.get(t.id)
        found = schema_differences(t, rows)
        if plan.mode != "schema_only":
            found += null_differences(t, rows) + counts_check(reports[t.id], source(t).count(), rows.count(), before.rows if before else 0)
        verdicts.append(Verified.DIFFERENT if found else Verified.COMPLETE)
        out.differences += found
        checks = [primary_key_check(t, rows), structure_check(t, rows, target)]
        if t.structure.sequences and plan.reset_sequences and states is not None:
            checks.append(sequence_check(t, rows, states.get(t.id, {})))
        if plan.mode == "full" and (seen := observed(t)) is not None:
            wrong, unknown = column_differences(t, seen)
            wrong += object_differences(t, seen)
            checks += [(Verified.DIFFERENT if wrong else Verified.UNSUPPORTED if unknown else Verified.COMPLETE, wrong + unknown)]
        for verdict, said in checks:
            verdicts.append(verdict)
            out.differences += said
        if plan.verification == "content":
            made, theirs = converted(source(t), t, plan.max_row_bytes), held(before)
            if reports[t.id].rejected_rows == 0 and made.where(F.size("_problems") > 0).limit(1).count():
                verdicts.append(Verified.DIFFERENT)
                out.differences.append(f"{t.source_name}: the source has rows that can't be converted")
            elif before and before.rows and theirs is None:
                verdicts.append(Verified.UNSUPPORTED)
                out.differences.append(f"{t.source_name}: what the target held before can't be read")
            else:
                c = multiset.compare_content(loaded_rows(made, plan, t, theirs), rows, t.copied, theirs)
                verdicts.append(c.status)
                out.differences += [f"{t.source_name}: {c.reason}"] if c.reason else []
        out.tables_checked += 1
    out.status = graver(*verdicts)
    return out
