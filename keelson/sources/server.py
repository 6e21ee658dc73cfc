"""A database server as the target of a run: what it holds, its statements, and rows written over JDBC.

Facts come by one query of each sort for all schemas, flat and in a fixed order, and are put together here; contradictions are errors.
Rows are staged in the shared folder like those of a file target, so rejects are known before anything is written to the server.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from keelson.operators import load
from keelson.plans.model import Baseline, MigrationPlan, Phase, Status, TablePlan
from keelson.plans.names import quote
from keelson.plans.target import Edge, EnumType, Graph, Namespace, Node, Observed, ObservedColumn, ObservedConstraint, ObservedIndex, ObservedSequence, ObservedTrigger, TargetCatalog, TargetTable
from keelson.sources.catalog import FactError
from keelson.sources.jdbc import Query, ServerRefused, retried, write_columns

#: Major versions of the target that are known.
VERSIONS = (16, 17, 18)
#: How the server marks identity columns and what a foreign key does, by its letters.
IDENTITY = {"": "", "d": "by_default", "a": "always"}
ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}


def target_queries(schemas: list[str]) -> dict[str, str]:
    """Statements for the facts of some schemas; the names are literals in them."""
    chosen = "n.nspname IN (" + ", ".join("'" + s.replace("'", "''") + "'" for s in schemas) + ")"
    spaces = "pg_catalog.pg_namespace n"
    own = f"pg_catalog.pg_class t JOIN {spaces} ON n.oid = t.relnamespace"
    at = "n.nspname::text AS table_schema, t.relname::text AS table_name"
    rows = f"{chosen} AND t.relkind IN ('r', 'p', 'f', 'v', 'm')"
    return {
        "version": "SELECT current_setting('server_version') AS version",
        "namespaces": f"SELECT n.nspname::text AS name, has_schema_privilege(n.oid, 'USAGE') AS can_use, has_schema_privilege(n.oid, 'CREATE') AS can_create FROM {spaces} WHERE {chosen} ORDER BY 1",
        "relations": f"SELECT n.nspname::text AS table_schema, t.relname::text AS name, 'relation' AS sort FROM {own} WHERE {chosen} UNION ALL SELECT n.nspname::text, y.typname::text, 'type' FROM pg_catalog.pg_type y JOIN {spaces} ON n.oid = y.typnamespace WHERE {chosen} ORDER BY 1, 3, 2",
        "tables": f"SELECT {at}, t.oid::bigint AS oid, t.relkind = 'r' AND t.relpersistence = 'p' AS ordinary, NOT t.relispartition AND NOT EXISTS (SELECT 1 FROM pg_catalog.pg_inherits i WHERE t.oid IN (i.inhrelid, i.inhparent)) AS standalone,"
        " has_table_privilege(t.oid, 'INSERT') AS can_insert, has_table_privilege(t.oid, 'SELECT') AS can_select, has_table_privilege(t.oid, 'TRUNCATE') AS can_truncate, pg_has_role(t.relowner, 'USAGE') AS can_alter,"
        f" t.relrowsecurity AS row_security, obj_description(t.oid, 'pg_class') AS comment FROM {own} WHERE {rows} ORDER BY 1, 2",
        "columns": f"SELECT {at}, a.attnum::int AS position, a.attname::text AS name, format_type(a.atttypid, a.atttypmod) AS type, NOT a.attnotnull AS nullable, a.attidentity::text AS identity, a.attgenerated <> '' AS generated,"
        f" pg_get_expr(d.adbin, d.adrelid) AS expression, col_description(t.oid, a.attnum) AS comment FROM {own} JOIN pg_catalog.pg_attribute a ON a.attrelid = t.oid AND a.attnum > 0 AND NOT a.attisdropped"
        f" LEFT JOIN pg_catalog.pg_attrdef d ON d.adrelid = t.oid AND d.adnum = a.attnum WHERE {rows} ORDER BY 1, 2, 3",
        "index_parts": f"SELECT {at}, c.relname::text AS name, k.position::int AS position, a.attname::text AS column_name, CASE WHEN k.number = 0 THEN pg_get_indexdef(i.indexrelid, k.position::int, true) END AS expression,"
        " (i.indoption[k.position - 1] & 1) = 1 AS descending, i.indisunique AS is_unique, i.indisprimary AS is_primary, m.amname::text AS method,"
        " i.indisvalid AND i.indisready AND i.indislive AND i.indpred IS NULL AND i.indnkeyatts = i.indnatts AND NOT i.indnullsnotdistinct AND NOT EXISTS (SELECT 1 FROM unnest(i.indclass) o(id)"
        " JOIN pg_catalog.pg_opclass p ON p.oid = o.id WHERE NOT p.opcdefault) AND NOT EXISTS (SELECT 1 FROM unnest(i.indoption) o(flags) WHERE m.amname = 'btree' AND o.flags NOT IN (0, 3)) AS plain"
        f" FROM {own} JOIN pg_catalog.pg_index i ON i.indrelid = t.oid JOIN pg_catalog.pg_class c ON c.oid = i.indexrelid JOIN pg_catalog.pg_am m ON m.oid = c.relam"
        " CROSS JOIN LATERAL unnest(i.indkey::int[]) WITH ORDINALITY k(number, position) LEFT JOIN pg_catalog.pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.number AND k.number > 0"
        f" WHERE {rows} ORDER BY 1, 2, 3, 4",
        "constraint_parts": f"SELECT {at}, c.conname::text AS name, c.contype::text AS kind, coalesce(k.position, 0)::int AS position, a.attname::text AS column_name, CASE WHEN c.contype = 'c' THEN pg_get_expr(c.conbin, c.conrelid) END AS expression,"
        " rn.nspname::text AS referenced_schema, r.relname::text AS referenced_table, ra.attname::text AS referenced_column, c.confupdtype::text AS on_update, c.confdeltype::text AS on_delete, c.convalidated AS validated, c.condeferrable AS deferrable"
        f" FROM {own} JOIN pg_catalog.pg_constraint c ON c.conrelid = t.oid LEFT JOIN LATERAL unnest(c.conkey, c.confkey) WITH ORDINALITY k(own, theirs, position) ON true LEFT JOIN pg_catalog.pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.own"
        " LEFT JOIN pg_catalog.pg_class r ON r.oid = c.confrelid LEFT JOIN pg_catalog.pg_namespace rn ON rn.oid = r.relnamespace LEFT JOIN pg_catalog.pg_attribute ra ON ra.attrelid = r.oid AND ra.attnum = k.theirs"
        f" WHERE {rows} ORDER BY 1, 2, 3, 5",
        "sequences": f"SELECT {at}, a.attname::text AS column_name, v.last_value, v.last_value IS NOT NULL AS is_called, q.seqstart AS first_value, q.seqincrement AS increment, q.seqmin AS minimum, q.seqmax AS maximum, q.seqcache::int AS cache, q.seqcycle AS cycle,"
        f" pg_has_role(t.relowner, 'USAGE') AS can_lock FROM {own} JOIN pg_catalog.pg_depend d ON d.refobjid = t.oid AND d.refobjsubid > 0 AND d.deptype IN ('i', 'a') AND d.classid = 'pg_catalog.pg_class'::regclass JOIN pg_catalog.pg_class s ON s.oid = d.objid AND s.relkind = 'S'"
        " JOIN pg_catalog.pg_namespace sn ON sn.oid = s.relnamespace JOIN pg_catalog.pg_sequence q ON q.seqrelid = s.oid JOIN pg_catalog.pg_sequences v ON v.schemaname = sn.nspname AND v.sequencename = s.relname JOIN pg_catalog.pg_attribute a ON a.attrelid = t.oid AND a.attnum = d.refobjsubid"
        f" WHERE {rows} ORDER BY 1, 2, 3",
        "triggers": f"SELECT {at}, g.tgname::text AS name, g.tgenabled::text AS enabled, g.tgisinternal AS internal, (g.tgtype & 32) <> 0 AS on_truncate FROM {own} JOIN pg_catalog.pg_trigger g ON g.tgrelid = t.oid WHERE {rows} ORDER BY 1, 2, 3",
        "enum_labels": f"SELECT n.nspname::text AS table_schema, y.typname::text AS name, row_number() OVER (PARTITION BY y.oid ORDER BY e.enumsortorder)::int AS position, e.enumlabel::text AS label, has_type_privilege(y.oid, 'USAGE') AS usable FROM pg_catalog.pg_type y JOIN {spaces} ON n.oid = y.typnamespace JOIN pg_catalog.pg_enum e ON e.enumtypid = y.oid WHERE {chosen} ORDER BY 1, 2, 3",
        "event_triggers": "SELECT evtname::text AS name, evtenabled::text AS enabled FROM pg_catalog.pg_event_trigger ORDER BY 1",
        "dependencies": "SELECT d.classid::regclass::text AS dependent_class, d.objid::bigint AS dependent, d.refclassid::regclass::text AS reference_class, d.refobjid::bigint AS reference, d.deptype::text AS kind,"
        f" coalesce(pg_describe_object(d.classid, d.objid, 0), '') AS label FROM pg_catalog.pg_depend d JOIN pg_catalog.pg_class t ON t.oid = d.refobjid AND d.refclassid = 'pg_catalog.pg_class'::regclass JOIN {spaces} ON n.oid = t.relnamespace WHERE {rows} ORDER BY 1, 2, 3, 4, 5",
        "extensions": "SELECT extname::text AS name FROM pg_catalog.pg_extension ORDER BY 1",
    }


def _grouped(rows: list, *names: str) -> dict[tuple, list]:
    out: dict[tuple, list] = defaultdict(list)
    for r in rows:
        out[tuple(r[n] for n in names)].append(r)
    return out


def _whole(parts: list, what: str) -> list:
    """Parts of one object, which are numbered without gaps and agree on what they have in common."""
    if [p["position"] for p in parts] != list(range(1, len(parts) + 1)):
        raise FactError(f"{what}: its parts are numbered {[p['position'] for p in parts]}")
    return parts


def decode(facts: dict[str, list], schemas: list[str]) -> TargetCatalog:
    """Facts as lists of rows to a catalogue."""
    version = facts["version"][0]["version"]
    if int(re.match(r"\d+", version)[0]) not in VERSIONS:
        raise ServerRefused(f"target version {version} isn't supported")
    places = {(r["table_schema"], r["table_name"]) for r in facts["tables"]}
    for name in ("columns", "index_parts", "constraint_parts", "sequences", "triggers"):
        if unknown := {(r["table_schema"], r["table_name"]) for r in facts[name]} - places:
            raise FactError(f"{name} of unknown tables: {sorted(unknown)}")
    columns, triggers, sequences = (_grouped(facts[n], "table_schema", "table_name") for n in ("columns", "triggers", "sequences"))
    indexes, constraints = (_grouped(facts[n], "table_schema", "table_name", "name") for n in ("index_parts", "constraint_parts"))
    tables, nodes, edges = [], [], []
    for r in facts["tables"]:
        place, oid = (r["table_schema"], r["table_name"]), r["oid"]
        seen = Observed(oid, ordinary=r["ordinary"], comment=r["comment"])
        positions = [c["position"] for c in columns[place]]
        if positions != sorted(set(positions)):
            raise FactError(f"{r['table_name']}: columns out of order")
        seen.columns = [ObservedColumn(c["name"], c["type"], c["nullable"], None if c["generated"] else c["expression"], IDENTITY[c["identity"]], c["expression"] if c["generated"] else None, c["comment"]) for c in columns[place]]
        for (schema, table, name), parts in indexes.items():
            if (schema, table) == place:
                p = _whole(parts, name)
                seen.indexes.append(ObservedIndex(name, [x["column_name"] for x in p], [x["descending"] for x in p], p[0]["is_unique"], p[0]["is_primary"], [x["expression"] for x in p], p[0]["method"], p[0]["plain"]))
        for (schema, table, name), parts in constraints.items():
            if (schema, table) == place:
                p = parts if parts[0]["position"] == 0 else _whole(parts, name)
                one = p[0]
                to = (one["referenced_schema"], one["referenced_table"]) if one["referenced_table"] else None
                seen.constraints.append(ObservedConstraint(name, one["kind"], [x["column_name"] for x in p if x["column_name"]], one["expression"], to, [x["referenced_column"] for x in p if x["referenced_column"]], ACTIONS.get(one["on_update"], "NO ACTION"), ACTIONS.get(one["on_delete"], "NO ACTION"), one["validated"], one["deferrable"]))
        seen.sequences = [ObservedSequence(q["column_name"], q["last_value"] if q["is_called"] else q["first_value"], q["is_called"], q["increment"], q["minimum"], q["maximum"], q["cache"], q["cycle"], q["can_lock"]) for q in sequences[place]]
        seen.triggers = [ObservedTrigger(g["name"], g["enabled"], g["internal"], g["on_truncate"]) for g in triggers[place]]
        tables.append(TargetTable(*place, seen, r["standalone"], r["can_insert"], r["can_select"], r["can_alter"], r["can_truncate"], r["row_security"]))
        nodes.append(Node(f"pg_class:{oid}", "class", r["table_name"], oid, relation_root=True))
        nodes += [Node(f"trigger:{oid}:{g.name}", "trigger", g.name, oid, enabled=g.enabled) for g in seen.triggers]
        edges += [Edge(f"trigger:{oid}:{g.name}", f"pg_class:{oid}", "a") for g in seen.triggers]
    known = {n.id: n for n in nodes}
    classes = {"pg_class": "class", "pg_type": "type", "pg_attrdef": "attrdef", "pg_constraint": "constraint", "pg_trigger": "trigger"}
    kinds = {c.name: c.kind for t in tables for c in t.observed.constraints}
    for d in facts["dependencies"]:
        ends = [f"{d[f'{side}_class'].removeprefix('pg_catalog.')}:{d[side]}" for side in ("dependent", "reference")]
        if ends[1] not in known or ends[0].startswith("pg_trigger:"):
            continue  # triggers are known by their names
        if ends[0] not in known:
            kind, label = ends[0].partition(":")[0], d["label"].split(" on ")[0].split(" ")[-1].strip('"')
            owner = known[ends[1]].owner_table if d["kind"] in ("a", "i") else None
            known[ends[0]] = Node(ends[0], classes.get(kind, kind), label, owner, constraint_kind=kinds.get(label) if kind == "pg_constraint" else None)
            nodes.append(known[ends[0]])
        edges.append(Edge(*ends, d["kind"]))
    nodes += [Node(f"event:{r['name']}", "event trigger", r["name"], event_trigger=True, enabled=r["enabled"]) for r in facts["event_triggers"]]
    enums = [EnumType(schema, name, [x["label"] for x in _whole(parts, name)], parts[0]["usable"]) for (schema, name), parts in _grouped(facts["enum_labels"], "table_schema", "name").items()]
    there = {r["name"]: r for r in facts["namespaces"]}
    named = _grouped(facts["relations"], "table_schema", "sort")
    spaces = [Namespace(s, s in there, bool(s in there and there[s]["can_use"]), bool(s not in there or there[s]["can_create"]), [r["name"] for r in named[s, "relation"]], [r["name"] for r in named[s, "type"]]) for s in schemas]
    return TargetCatalog(version, True, spaces, tables, enums, [r["name"] for r in facts["extensions"]], Graph(nodes, edges))


def inspect(query: Query, schemas: list[str]) -> TargetCatalog:
    """The catalogue of some schemas; names and numbers only, so small."""
    return decode({k: [r.asDict() for r in query(text).collect()] for k, text in target_queries(schemas).items()}, schemas)


def executor(spark: SparkSession, options: dict[str, str]) -> Callable[[list[str]], None]:
    """Runs statements in one transaction on the driver's connection; a failed one undoes all."""

    def run(statements: list[str]) -> None:
        jvm = spark._jvm
        known = jvm.java.util.Properties()
        for name in ("user", "password"):
            if options.get(name):
                known.setProperty(name, options[name])
        if options.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(options["url"], known)
        try:
            connection.setAutoCommit(False)
            for text in statements:
                statement = connection.createStatement()
                statement.execute(text.rstrip().removesuffix(";"))
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return run


@dataclass
class ServerTarget:
    """Tables of a server, as keelson.plans.run.FileTarget stands for those of a folder. staging: a folder that every executor reaches."""

    spark: SparkSession
    options: dict[str, str]
    staging: str
    query: Query
    execute: Callable[[list[str]], None]

    @property
    def root(self) -> str:
        return self.staging

    def path(self, schema: str, name: str) -> str:
        return f"{self.staging.rstrip('/')}/{schema}/{name}"

    def read(self, schema: str, name: str) -> DataFrame | None:
        known = {k: v for k, v in self.options.items() if k not in ("dbtable", "isolationLevel", "batchsize")}
        try:
            return self.spark.read.format("jdbc").options(**known).option("dbtable", f"{quote(schema)}.{quote(name)}").load()
        except Exception as e:
            if re.search(r"does not exist|42P01|42X05|42Y07", str(e)):
                return None
            raise

    def baseline(self, schema: str, name: str) -> Baseline | None:
        """What a table holds now, as a copy in the staging folder, since a server's rows can't be read as of then later on."""
        rows = self.read(schema, name)
        if rows is None:
            return None
        where = f"{self.path(schema, name)}.before"
        rows.write.mode("overwrite").parquet(where)
        held = self.spark.read.parquet(where)
        return Baseline(held.count(), sorted(held.inputFiles()))

    def held(self, known: Baseline | None) -> DataFrame | None:
        return self.spark.read.parquet(*known.files) if known and known.files else None

    def prepare(self, plan: MigrationPlan) -> None:
        self.execute([d.sql for d in plan.ddl if d.phase == Phase.PREPARE])

    def complete(self, plan: MigrationPlan, phase: Phase) -> None:
        """The statements of a phase, one transaction for each, as keys of a table don't depend on another's."""
        for d in (d for d in plan.ddl if d.phase == phase):
            self.execute([d.sql])

    def publish(self, staged: load.Staged, mode: str, reject_dir: str | None) -> load.Loaded:
        """Write staged rows to the server; a write that breaks off leaves the table indeterminate, as tasks commit by themselves."""
        r, t = staged.report, staged.table
        try:
            if staged.bad and reject_dir:
                load.save_rejects(self.spark, staged.folder, reject_dir, t.id)
            rows = self.spark.read.parquet(staged.rows)
            out = rows.select(*(value.alias(name) for name, value in write_columns(t)))
            known = self.options | {"dbtable": f"{quote(t.target_schema)}.{quote(t.target_name)}"}
            try:
                retried(lambda: out.write.format("jdbc").options(**known).mode("append").save())
            except Exception:
                r.status, r.indeterminate_rows, r.rejected_rows = Status.INDETERMINATE, staged.total - staged.bad, staged.bad
                raise
        finally:
            staged.discard()
        return staged.settled()

    def states(self, schema: str, name: str) -> dict[str, int]:
        found = decode_sequences([r.asDict() for r in self.query(target_queries([schema])["sequences"]).collect()])
        return found.get((schema, name), {})

    def set_states(self, schema: str, name: str, states: dict[str, int]) -> None:
        """The plan's own statements have set them."""

    def record(self, t: TablePlan) -> None:
        """The server keeps a table's structure itself."""

    def catalog(self, schemas: list[str]) -> TargetCatalog:
        return inspect(self.query, schemas)

    def table(self, schema: str, name: str, oid: int) -> tuple[TargetTable, list[EnumType]] | None:
        made = self.catalog([schema])
        found = made.table(schema, name)
        return (found, made.enums or []) if found else None


def decode_sequences(rows: list[dict]) -> dict[tuple, dict[str, int]]:
    """Next values by table and column."""
    out: dict[tuple, dict[str, int]] = defaultdict(dict)
    for q in rows:
        out[q["table_schema"], q["table_name"]][q["column_name"]] = q["last_value"] + q["increment"] if q["is_called"] else q["first_value"]
    return dict(out)

