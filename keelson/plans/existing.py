"""Policies for what a target holds already: whether the plan may use, empty or replace it. What isn't proven is an error."""

from __future__ import annotations

from typing import TYPE_CHECKING

from keelson.operators import fulltext
from keelson.plans.default_values import same_check, same_default
from keelson.plans.model import Kind, Severity, TablePlan
from keelson.plans.target import Graph, Observed, ObservedConstraint, ObservedIndex
from keelson.plans.types import same_type

if TYPE_CHECKING:
    from keelson.plans.planner import _Planner

OWN_CLASSES = ("class", "type", "attrdef", "constraint", "trigger")


def table_policy(p: _Planner, t: TablePlan) -> None:
    """Namespace, privileges and existence, before any structure is compared."""
    config, target = p.config, p.target
    there, creates = target.table(t.target_schema, t.target_name), p.creates(t)
    space = target.namespace(t.target_schema)
    if there is None and space and t.target_name in space.relations:
        p.say("TARGET_RELATION_COLLISION", t.source_name, "another relation has the name")
    if space is None:
        p.say("TARGET_SCHEMA_UNINSPECTED", t.target_schema, "nothing certain is known about the schema")
    elif not space.exists:
        if not creates:
            p.say("TARGET_SCHEMA_USAGE_DENIED", t.target_schema, "the schema doesn't exist")
        elif not target.can_create_schema:
            p.say("TARGET_CREATE_SCHEMA_DENIED", t.target_schema, "the schema can't be created")
    elif not space.can_use or (creates and not space.can_create):
        p.say("TARGET_SCHEMA_PRIVILEGE" if creates else "TARGET_SCHEMA_USAGE_DENIED", t.target_schema, "privileges on the schema are missing")
    mode, policy = config.migration.mode, config.target.on_existing
    if there is None:
        if mode == "data_only":
            p.say("TARGET_TABLE_MISSING", t.source_name, "data_only needs an existing table")
        return
    if not there.ordinary_standalone:
        p.say("TARGET_TABLE_TOPOLOGY", t.source_name, "partitions and inheritance aren't supported")
    recreate, copies, checked = policy == "recreate", mode != "schema_only", config.verification.mode != "none"
    resets = config.migration.reset_sequences and any(c.identity for c in t.columns)
    denied = {
        "TARGET_INSERT_DENIED": not recreate and copies and not there.can_insert,
        "TARGET_SELECT_DENIED": not recreate and (resets or checked) and not there.can_select,
        "TARGET_OWNERSHIP_DENIED": (recreate or resets) and not there.can_alter,
        "TARGET_TRUNCATE_DENIED": policy == "truncate" and not there.can_truncate,
        "TARGET_ROW_SECURITY": not recreate and (copies or checked) and there.row_security,
    }
    for code in (c for c, bad in denied.items() if bad):
        p.say(code, t.source_name, "privileges or row security contradict the run")
    if mode != "data_only" and policy == "error":
        p.say("TARGET_EXISTS", t.source_name, "the table exists")


def replaced(p: _Planner, schema: str, relation: str) -> bool:
    """Whether a relation goes with one of the tables that are recreated."""
    for t in p.plan.tables:
        there = p.target.table(t.target_schema, t.target_name)
        if there and there.observed and t.target_schema == schema and any(i.name == relation for i in there.observed.indexes):
            return True
    return False


def apply(p: _Planner) -> None:
    policy = p.config.target.on_existing
    for t in p.plan.tables:
        there = p.target.table(t.target_schema, t.target_name)
        if there is None or (policy == "error" and p.config.migration.mode != "data_only"):
            continue
        seen = there.observed
        if seen is None:
            p.say("TARGET_OBSERVATION_REQUIRED", t.source_name, "the table wasn't inspected")
        elif not seen.oid or not seen.ordinary:
            p.say("TARGET_TABLE_UNSUPPORTED", t.source_name, "not an ordinary permanent table")
        elif policy == "recreate":
            inventory(p, t, seen)
        else:
            columns(p, t, seen)
            indexes(p, t, seen)
            constraints(p, t, seen)
            sequences(p, t, seen)
            triggers(p, t, seen)
    if policy in ("recreate", "truncate"):
        destructive(p)


def inventory(p: _Planner, t: TablePlan, seen: Observed) -> None:
    for i in seen.indexes:
        p.say("TARGET_OBJECT_REMOVED", f"{t.source_name}.{i.name}", "the index goes with its table", Severity.WARNING)
    for c in seen.constraints:
        known = c.kind in ("p", "u", "f", "c", "n", "t")
        p.say("TARGET_OBJECT_REMOVED" if known else "TARGET_CONSTRAINT_UNSUPPORTED", f"{t.source_name}.{c.name}", "the constraint goes with its table", Severity.WARNING if known else Severity.ERROR)
    for g in (g for g in seen.triggers if not g.internal):
        p.say("TARGET_OBJECT_REMOVED", f"{t.source_name}.{g.name}", "the trigger goes with its table", Severity.WARNING)


def columns(p: _Planner, t: TablePlan, seen: Observed) -> None:
    if len(seen.columns) != len(t.columns):
        p.say("TARGET_EXTRA_COLUMNS", t.source_name, "the table has other columns")
    for want, have in zip(t.columns, seen.columns, strict=False):
        name = f"{t.source_name}.{want.source_name}"
        typed = bool(p.target.enum(have.type, want.enum_labels)) if want.kind == Kind.ENUM else same_type(have.type, want.target_type)
        identity = have.identity == ("by_default" if want.identity else "")
        if want.target_name != have.name or not typed or have.nullable != want.nullable or not identity or have.generated != want.generated_expression:
            p.say("TARGET_COLUMN_INCOMPATIBLE", name, "name, type, nullability, identity or generation differ")
        if want.comment is not None and want.comment != have.comment:
            p.say("TARGET_COMMENT_INCOMPATIBLE", name, "the comment differs")
        if not want.identity and want.generated_expression is None:
            verdict = same_default(want.default_sql, have.default, want)
            if verdict == "unsupported" and want.kind == Kind.INTERVAL:
                p.say("TARGET_DEFAULT_CONTEXT_REQUIRED", name, "the interval style of the default isn't known")
            elif verdict != "equal":
                p.say("TARGET_DEFAULT_INCOMPATIBLE", name, "the default differs or can't be compared")
    if t.structure.comment is not None and t.structure.comment != seen.comment:
        p.say("TARGET_COMMENT_INCOMPATIBLE", t.source_name, "the comment differs")


def _fits(want, have: ObservedIndex) -> bool:
    if not have.plain or (want.unique, want.primary) != (have.unique, have.primary):
        return False
    if want.fulltext_columns:
        return have.method == "gin" and len(have.expressions) == 1 and fulltext.is_expression(have.expressions[0] or "", want.fulltext_columns)
    keys = [c for c in have.columns if c is not None]
    return have.method == "btree" and keys == want.columns and have.descending == want.descending and [e for e in have.expressions if e] == [e for e in want.expressions if e]


def indexes(p: _Planner, t: TablePlan, seen: Observed) -> None:
    """Bind every expected index to one observed; its real name replaces the planned one."""
    free = list(seen.indexes)
    for i in free:
        if not i.plain or i.method not in ("btree", "gin"):
            p.say("TARGET_INDEX_UNSUPPORTED", f"{t.source_name}.{i.name}", "the index has properties that can't be checked")
    for want in t.structure.indexes:
        found = next((i for i in free if _fits(want, i)), None)
        if found is None:
            p.say("TARGET_INDEX_INCOMPATIBLE", f"{t.source_name}.{want.name}", "no index has these keys")
        else:
            free.remove(found)
            want.name = found.name
    keys = [c.target_name for s in t.primary_key for c in t.columns if c.source_name == s]
    primary = next((i for i in seen.indexes if i.primary), None)
    if (primary.columns if primary else []) != keys:
        p.say("TARGET_PRIMARY_KEY_INCOMPATIBLE", t.source_name, "the primary key differs")


def constraints(p: _Planner, t: TablePlan, seen: Observed) -> None:
    solid = {c.target_name for c in t.columns if not c.nullable}
    known: list[ObservedConstraint] = []
    for c in seen.constraints:
        good = c.kind in ("p", "u", "f", "c") and c.validated and not (c.deferrable and c.kind in ("f", "c"))
        good = good or (c.kind == "n" and set(c.columns) <= solid) or (c.kind == "t" and any(g.name == c.name for g in seen.triggers))
        if good:
            known.append(c)
        else:
            p.say("TARGET_CONSTRAINT_UNSUPPORTED", f"{t.source_name}.{c.name}", "the constraint can't be checked")
    for want in t.structure.foreign_keys:
        key = (want.columns, (want.referenced_schema, want.referenced_table), want.referenced_columns, want.on_update, want.on_delete)
        if not any(c.kind == "f" and (c.columns, tuple(c.referenced or ()), c.referenced_columns, c.on_update, c.on_delete) == key for c in known):
            p.say("TARGET_FK_INCOMPATIBLE", f"{t.source_name}.{want.name}", "no foreign key is the same")
    for want in t.structure.checks:
        if not any(c.kind == "c" and same_check(want, c.expression) for c in known):
            p.say("TARGET_CHECK_INCOMPATIBLE", f"{t.source_name}.{want.name}", "no check is the same")


def sequences(p: _Planner, t: TablePlan, seen: Observed) -> None:
    from keelson.operators.constraints import INTEGER_MAX

    for c in (c for c in t.columns if c.identity):
        name = f"{t.source_name}.{c.source_name}"
        s = next((s for s in seen.sequences if s.column == c.target_name), None)
        top = INTEGER_MAX.get(c.target_type)
        if s is None or (s.increment, s.minimum, s.maximum, s.cache, s.cycle) != (1, 1, top, 1, False):
            p.say("TARGET_SEQUENCE_INCOMPATIBLE", name, "the sequence has other options")
        elif s.last_value is None or s.is_called is None:
            p.say("TARGET_SEQUENCE_STATE_UNKNOWN", name, "the sequence's state isn't known")
        elif s.last_value + s.is_called > top:
            p.say("TARGET_SEQUENCE_EXHAUSTED", name, "the sequence has no value left")
        if s is not None and p.config.migration.reset_sequences and not s.can_lock:
            p.say("TARGET_SEQUENCE_LOCK_PRIVILEGE", name, "the table can't be locked to set its sequence")


def triggers(p: _Planner, t: TablePlan, seen: Observed) -> None:
    for g in seen.triggers:
        name = f"{t.source_name}.{g.name}"
        if g.enabled not in ("O", "D", "R", "A"):
            p.say("TARGET_TRIGGER_UNKNOWN", name, "the trigger's state isn't known")
        elif not g.internal:
            if p.config.target.on_existing == "truncate" and g.on_truncate and g.enabled != "D":
                p.say("TARGET_TRUNCATE_TRIGGER", name, "a trigger runs on truncate")
            p.say("TARGET_TRIGGER_PRESERVED", name, "the trigger stays", Severity.WARNING)


def automatic_closure(graph: Graph, roots: set[str]) -> set[str]:
    """Roots and what goes with them: everything tied by automatic or internal dependencies."""
    users: dict[str, list[str]] = {}
    for e in graph.edges:
        if not e.shared and e.kind in ("a", "i"):
            users.setdefault(e.reference, []).append(e.dependent)
    seen, todo = set(roots), list(roots)
    while todo:
        for d in users.get(todo.pop(), ()):
            if d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def destructive(p: _Planner) -> None:
    """Whether dropping or emptying the selected tables touches anything else."""
    recreate = p.config.target.on_existing == "recreate"
    tables = {there.observed.oid: there.observed for t in p.plan.tables if (there := p.target.table(t.target_schema, t.target_name)) and there.observed}
    if not tables:
        return
    graph = p.target.graph
    if graph is None:
        p.say("TARGET_DEPENDENCY_METADATA_REQUIRED", "target", "dependencies weren't inspected")
        return
    if not graph.valid():
        p.say("TARGET_DEPENDENCY_MALFORMED", "target", "the dependency graph contradicts itself")
        return
    nodes = {n.id: n for n in graph.nodes}
    roots = {n.id for n in graph.nodes if n.catalog == "class" and n.relation_root and n.owner_table in tables}
    for oid in tables:
        if not any(nodes[r].owner_table == oid for r in roots):
            p.say("TARGET_DEPENDENCY_ROOT_MISSING", str(oid), "the table has no inspected root")
    owned = automatic_closure(graph, roots)
    for n in (nodes[i] for i in sorted(owned)):
        if n.extension:
            p.say("TARGET_EXTENSION_MEMBER", n.label or n.id, "the object belongs to an extension")
        if n.catalog not in OWN_CLASSES:
            p.say("TARGET_OWNED_OBJECT_UNSUPPORTED", n.label or n.id, "the table owns an object of another class")
            if recreate:
                p.say("TARGET_DROP_OBJECT_UNSUPPORTED", n.label or n.id, "the object can't be dropped with its table")
    for e in graph.edges:
        inside = {e.dependent, e.reference} & owned
        if inside and e.kind not in (("o", "a") if e.shared else ("n", "a", "i")):
            p.say("TARGET_DEPENDENCY_UNSUPPORTED", e.dependent, "a dependency of an unknown kind")
        user = nodes.get(e.dependent)
        if recreate and not e.shared and e.reference in owned and e.dependent not in owned:
            p.say("TARGET_DEPENDENCY_OUTSIDE_SELECTION", e.dependent, "an object outside the selection uses the table")
        if not recreate and user and user.constraint_kind == "f" and user.owner_table not in tables and e.reference in roots:
            p.say("TARGET_DEPENDENCY_OUTSIDE_SELECTION", e.dependent, "a foreign key outside the selection refers to the table")
    if not recreate:
        return
    for n in graph.nodes:
        if n.event_trigger and n.enabled != "D":
            p.say("TARGET_EVENT_TRIGGER", n.label or n.id, "an event trigger would see the drop")
    for oid, seen in tables.items():
        for name in [*(i.name for i in seen.indexes), *(c.name for c in seen.constraints), *(g.name for g in seen.triggers)]:
            if not any(n.label == name and n.owner_table == oid and n.id in owned and not n.extension for n in graph.nodes):
                p.say("TARGET_OWNED_OBJECT_PROOF_MISSING", name, "nothing proves that the object goes with its table")
