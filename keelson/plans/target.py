"""What was observed at a target before a run. None means not inspected, an empty list inspected and empty; the two differ."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Namespace:
    name: str
    exists: bool
    can_use: bool = True
    can_create: bool = True
    relations: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


@dataclass
class EnumType:
    schema: str
    name: str
    labels: list[str]
    usable: bool = True


@dataclass
class ObservedColumn:
    name: str
    type: str
    nullable: bool
    default: str | None = None
    identity: str = ""  # "", by_default or always
    generated: str | None = None
    comment: str | None = None


@dataclass
class ObservedIndex:
    name: str
    columns: list[str | None]
    descending: list[bool]
    unique: bool = False
    primary: bool = False
    expressions: list[str | None] = field(default_factory=list)
    method: str = "btree"
    plain: bool = True  # valid, ready, live, no predicate or included columns, default operator classes and null order


@dataclass
class ObservedConstraint:
    name: str
    kind: str  # p, u, f, c, n, t
    columns: list[str] = field(default_factory=list)
    expression: str | None = None
    referenced: tuple[str, str] | None = None
    referenced_columns: list[str] = field(default_factory=list)
    on_update: str = "NO ACTION"
    on_delete: str = "NO ACTION"
    validated: bool = True
    deferrable: bool = False


@dataclass
class ObservedSequence:
    column: str
    last_value: int | None
    is_called: bool | None
    increment: int = 1
    minimum: int = 1
    maximum: int = 2**63 - 1
    cache: int = 1
    cycle: bool = False
    can_lock: bool = True


@dataclass
class ObservedTrigger:
    name: str
    enabled: str = "O"
    internal: bool = False
    on_truncate: bool = False


@dataclass
class Observed:
    oid: int
    columns: list[ObservedColumn] = field(default_factory=list)
    indexes: list[ObservedIndex] = field(default_factory=list)
    constraints: list[ObservedConstraint] = field(default_factory=list)
    sequences: list[ObservedSequence] = field(default_factory=list)
    triggers: list[ObservedTrigger] = field(default_factory=list)
    comment: str | None = None
    ordinary: bool = True


@dataclass
class TargetTable:
    schema: str
    name: str
    observed: Observed | None = None
    ordinary_standalone: bool = True
    can_insert: bool = True
    can_select: bool = True
    can_alter: bool = True
    can_truncate: bool = True
    row_security: bool = False


@dataclass
class Node:
    """An object of the dependency graph; owner_table is the oid of the table that it belongs to."""

    id: str
    catalog: str  # class, type, attrdef, constraint, trigger or another
    label: str = ""
    owner_table: int | None = None
    extension: bool = False
    relation_root: bool = False
    constraint_kind: str | None = None
    event_trigger: bool = False
    enabled: str = "O"


@dataclass
class Edge:
    """dependent needs reference. kind: n normal, a automatic, i internal, o owner; anything else is unknown."""

    dependent: str
    reference: str
    kind: str
    shared: bool = False


@dataclass
class Graph:
    nodes: list[Node]
    edges: list[Edge]

    def valid(self) -> bool:
        ids = [n.id for n in self.nodes]
        return len(set(ids)) == len(ids) and all(e.shared or (e.dependent in set(ids) and e.reference in set(ids)) for e in self.edges)


def observed_of(table, oid: int, states: dict[str, int]) -> Observed:
    """What a table that was made by its plan looks like; states: next values of its sequences."""
    target = {c.source_name: c.target_name for c in table.columns}
    primary = [target[k] for k in table.primary_key]
    want = table.structure
    columns = [ObservedColumn(c.target_name, c.target_type, c.nullable, c.default_sql, "by_default" if c.identity else "", c.generated_expression, c.comment) for c in table.columns]
    indexes = [ObservedIndex(i.name, list(i.columns), list(i.descending), i.unique, i.primary, list(i.expressions), "gin" if i.fulltext_columns else "btree") for i in want.indexes]
    if primary and not any(i.primary for i in indexes):
        indexes.append(ObservedIndex(f"{table.target_name}_pkey", primary, [False] * len(primary), True, True))
    constraints = [ObservedConstraint(i.name, "p" if i.primary else "u", [c for c in i.columns if c]) for i in indexes if i.primary]
    constraints += [ObservedConstraint(f.name, "f", f.columns, None, (f.referenced_schema, f.referenced_table), f.referenced_columns, f.on_update, f.on_delete) for f in want.foreign_keys]
    constraints += [ObservedConstraint(c.name, "c", [], c.expression) for c in want.checks]
    sequences = [ObservedSequence(q.column, states.get(q.column, q.min_value), False, q.increment, q.min_value, q.max_value) for q in want.sequences]
    return Observed(oid, columns, indexes, constraints, sequences, comment=want.comment)


def graph_of(tables: list[TargetTable]) -> Graph:
    """The dependencies of tables that have only what was observed of them: indexes and constraints go with their table, foreign keys need their parent."""
    roots = {(t.schema, t.name): f"class:{t.observed.oid}" for t in tables}
    nodes, edges = [], []
    for t in tables:
        root, oid = roots[t.schema, t.name], t.observed.oid
        nodes.append(Node(root, "class", t.name, oid, relation_root=True))
        parts = [("class", i.name, None) for i in t.observed.indexes] + [("constraint", c.name, c) for c in t.observed.constraints]
        for kind, name, constraint in parts:
            node = Node(f"{kind}:{oid}:{name}", kind, name, oid, constraint_kind=constraint.kind if constraint else None)
            nodes.append(node)
            edges.append(Edge(node.id, root, "a"))
            if constraint and constraint.kind == "f" and (parent := roots.get(tuple(constraint.referenced))):
                edges.append(Edge(node.id, parent, "n"))
    return Graph(nodes, edges)


@dataclass
class TargetCatalog:
    server_version: str | None = "17.0"
    can_create_schema: bool = True
    namespaces: list[Namespace] | None = None
    tables: list[TargetTable] = field(default_factory=list)
    enums: list[EnumType] | None = None
    extensions: list[str] = field(default_factory=list)
    graph: Graph | None = None

    def table(self, schema: str, name: str) -> TargetTable | None:
        return next((t for t in self.tables if (t.schema, t.name) == (schema, name)), None)

    def namespace(self, schema: str) -> Namespace | None:
        """The one set of facts about a schema; None if there are none, or contradicting ones."""
        found = [n for n in self.namespaces or () if n.name == schema]
        return found[0] if len(found) == 1 else None

    def enum(self, qualified_name: str, labels: list[str]) -> EnumType | None:
        from keelson.plans.names import qualified

        return next((e for e in self.enums or () if qualified(e.schema, e.name) == qualified_name and e.usable and e.labels == labels), None)
