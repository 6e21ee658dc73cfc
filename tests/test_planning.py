import dataclasses

import pytest

from keelson.plans import existing
from keelson.plans.admission import admit, reservation
from keelson.plans.model import IndexPart, MigrationPlan, SourceCatalog, SourceCheck, SourceColumn, SourceForeignKey, SourceIndex, SourceTable, UnsupportedObject, from_dict, to_json
from keelson.plans.planner import Blocked, build
from keelson.plans.target import Edge, Graph, Namespace, Node, Observed, ObservedColumn, ObservedConstraint, ObservedIndex, ObservedSequence, ObservedTrigger, TargetCatalog, TargetTable
from keelson.sources import load_import
from keelson.sources.config import ConfigError, parse
from keelson.sources.load_import import ImportRefused, Options, import_load

BASE = """version = 1
[source]
url_env = "S"
consistency = "frozen"
[target]
url_env = "T"
schema = "app"
"""


def config(more="", base=BASE):
    return parse(base + more)


def col(name, kind="int", full=None, i=1, **more):
    return SourceColumn(name, i, kind, full or kind, **more)


def table(name, *columns, **more):
    return SourceTable(name, [dataclasses.replace(c, ordinal=i) for i, c in enumerate(columns, 1)], **more)


def pk(*names):
    return SourceIndex("PRIMARY", [IndexPart(n) for n in names], primary=True)


TARGET = TargetCatalog(namespaces=[Namespace("app", True)], enums=[])


def codes(tables, more="", target=TARGET, **catalog):
    try:
        plan = build(config(more), SourceCatalog("db", tables, **catalog), target)
    except Blocked as e:
        return {d.code for d in e.diagnostics}
    return {d.code for d in plan.diagnostics}


def plan(tables, more="", target=TARGET, **catalog) -> MigrationPlan:
    return build(config(more), SourceCatalog("db", tables, **catalog), target)


USERS = table("users", col("id", nullable=False, extra="auto_increment"), col("name", "varchar", "varchar(20)", character_length=20, nullable=False), indexes=[pk("id")], next_auto_increment=42, comment="people")


def test_a_plain_table():
    p = plan([USERS])
    t = p.tables[0]
    assert [c.target_type for c in t.columns] == ["integer", "varchar(20)"] and t.primary_key == ["id"] and t.columns[0].identity
    sql = [d.sql for d in p.ddl]
    assert sql[0] == 'CREATE TABLE "app"."users" ("id" integer GENERATED BY DEFAULT AS IDENTITY NOT NULL, "name" varchar(20) NOT NULL);'
    assert "PRIMARY KEY" in sql[1] and sql[2].startswith("COMMENT ON TABLE") and "setval" in sql[-1]
    assert from_dict(MigrationPlan, __import__("json").loads(to_json(p))) == p
    assert to_json(p) == to_json(plan([USERS]))


def test_foreign_keys_come_after_keys():
    child = table("child", col("user_id", nullable=True), foreign_keys=[SourceForeignKey("fk", ["user_id"], "db", "users", ["id"], on_delete="CASCADE")], indexes=[SourceIndex("k", [IndexPart("user_id", descending=True)])])
    sql = [d.sql for d in plan([child, USERS]).ddl if d.phase == "finalize"]
    assert "FOREIGN KEY" in sql[-1] and 'DESC' in sql[0]


@pytest.mark.parametrize("tables,more,code", [
    ([table("t", col("a", "odd"))], "", "COLUMN_TYPE_UNSUPPORTED"), ([USERS], '[tables]\ninclude = ["none"]', "SOURCE_TABLE_MISSING"),
    ([table("A", col("a")), table("a", col("a"))], '[migration]\nidentifiers = "downcase"', "TABLE_NAME_COLLISION"), ([table("t", col("A"), col("a"))], '[migration]\nidentifiers = "downcase"', "COLUMN_NAME_COLLISION"),
    ([table("t", col("e", "enum", "enum('a"))], "", "CATALOG_LABELS_INVALID"), ([table("t", col("e", "enum", "enum('a?')", charset="utf8mb4"))], "", "LOSSY_LABEL_METADATA"),
    ([table("t", col("g", "geometry"))], "", "POSTGIS_REQUIRED"), ([table("t", col("e", "enum", f"enum('{'x' * 64}')", charset="latin1"))], "", "ENUM_LABEL_TOO_LONG"),
    ([table("t", col("e", "enum", "enum('a')", charset="latin1"))], '[[cast]]\nsource_type = "enum"\ntarget_type = "integer"', "ENUM_TARGET_UNSUPPORTED"), ([table("t", col("s", "set", "set('a')", charset="latin1"))], '[[cast]]\nsource_type = "set"\ntarget_type = "text"', "SET_TARGET_UNSUPPORTED"),
    ([table("t", col("a", "text", charset="koi8r"))], "", "CHARSET_UNSUPPORTED"), ([table("t", col("a", "int"))], '[[cast]]\nsource_type = "int"\ntransform = "right-trim"', "TRANSFORM_TARGET_MISMATCH"),
    ([table("t", col("a", "date", nullable=False))], '[[cast]]\nsource_type = "date"\ntransform = "zero-dates-to-null"', "ZERO_DATE_POLICY"), ([table("t", col("a", "bigint", "bigint unsigned", extra="auto_increment"))], "", "IDENTITY_RANGE"),
    ([table("t", col("a", generation_expression="1"))], "", "GENERATED_POLICY"), ([table("t", col("a", "timestamp", extra="on update CURRENT_TIMESTAMP"))], "", "ON_UPDATE_POLICY"),
    ([table("t", col("a", "varchar", character_length=3, collation="utf8mb4_ci"), indexes=[SourceIndex("u", [IndexPart("a")], unique=True)])], "", "COLLATION_SEMANTICS"), ([table("t", col("a", default="x"))], "", "DEFAULT_UNSUPPORTED"),
    ([table("t", col("a"), indexes=[pk("a")])], "", "PRIMARY_KEY_NULLABLE"), ([table("t", col("a", "text"), indexes=[SourceIndex("f", [IndexPart("a")], kind="FULLTEXT")])], "", "INDEX_UNSUPPORTED"),
    ([table("t", col("a", "text"), indexes=[SourceIndex("f", [IndexPart("a")], kind="FULLTEXT")])], '[migration]\nfulltext = "simple_gin"', "FULLTEXT_REPLACED"), ([table("t", col("a"), indexes=[SourceIndex("f", [IndexPart("a")], kind="FULLTEXT")])], '[migration]\nfulltext = "simple_gin"', "FULLTEXT_MAPPING_UNSUPPORTED"),
    ([table("t", col("a"), indexes=[SourceIndex("f", [IndexPart(expression="a+1")])])], "", "INDEX_EXPRESSION_POLICY"), ([table("t", col("a"), indexes=[SourceIndex("f", [IndexPart("b")])])], "", "INDEX_COLUMN_MISSING"), ([table("t", col("a"), indexes=[SourceIndex("f", [IndexPart("a", prefix_length=3)])])], "", "INDEX_UNSUPPORTED"),
    ([table("t", col("a"), foreign_keys=[SourceForeignKey("f", ["a"], "db", "none", ["x"])])], "", "FK_PARENT_MISSING"), ([USERS, table("t", col("a"), foreign_keys=[SourceForeignKey("f", ["a"], "db", "users", ["id"], on_delete="SET DEFAULT")])], "", "FK_UNSUPPORTED"),
    ([USERS, table("t", col("a", "text"), foreign_keys=[SourceForeignKey("f", ["a"], "db", "users", ["id"])])], "", "FK_TYPE_INCOMPATIBLE"), ([table("t", col("a"), checks=[SourceCheck("c", "a > 0")])], "", "CHECK_NOT_IMPLEMENTED"),
    ([table("t", col("a"), checks=[SourceCheck("c", "a > 0", False)])], '[[overrides]]\nobject = "db.t.c"\ntarget_expression = "a > 0"', "CHECK_ENFORCEMENT_MISMATCH"), ([table("t", col("a", "float"))], '[verification]\nmode = "content"', "CONTENT_VERIFICATION_UNSUPPORTED"),
    ([USERS], '[hooks]\nbefore = ["/none.sql"]', "HOOK_UNREADABLE"), ([USERS], "[migration]\nreset_sequences = false", "SEQUENCE_STATE_PRESERVED"),
])
def test_diagnostics(tables, more, code):
    assert code in codes(tables, more)


def test_catalogue_level_diagnostics():
    assert "IDENTITY_INCREMENT_OFFSET" in codes([USERS], auto_increment_increment=2)
    u = [UnsupportedObject("trigger", "users.t1", "x"), UnsupportedObject("partition", "users", "y"), UnsupportedObject("event", "other", "z")]
    assert "SOURCE_UNSUPPORTED_OBJECT" in codes([USERS], unsupported_objects=u)
    p = plan([USERS], '[[overrides]]\nobject = "users"\nomit = true', unsupported_objects=u)
    assert "users" in p.exclusions and {d.severity for d in p.diagnostics if d.code == "SOURCE_UNSUPPORTED_OBJECT"} == {"warning"}
    base = BASE.replace("frozen", "single_snapshot")
    with pytest.raises(Blocked) as e:
        build(config(base=base), SourceCatalog("db", [table("t", col("a"), engine="MyISAM")]), TARGET)
    assert str(e.value) == "SNAPSHOT_ENGINE"


def test_rules_pick_the_first_match():
    more = '[[cast]]\nsource_type = "decimal"\nprecision = { op = "le", value = 9 }\nscale = { op = "eq", value = 0 }\ntarget_type = "integer"\n[[cast]]\nsource_type = "numeric"\ntarget_type = "text"\ndrop_not_null = true'
    t = table("t", col("a", "decimal", numeric_precision=9, numeric_scale=0), col("b", "decimal", numeric_precision=10, numeric_scale=0, nullable=False))
    a, b = plan([t], more).tables[0].columns
    assert (a.target_type, b.target_type, b.nullable) == ("integer", "text", True)


def test_generated_and_set_columns():
    t = table("t", col("a"), col("g", generation_expression="a+1"), col("s", "set", "set('x','y')", charset="ascii"))
    p = plan([t], '[[overrides]]\nobject = "db.t.g"\ntarget_expression = "a + 1"')
    assert [c.copy for c in p.tables[0].columns] == [True, False, True] and "GENERATED ALWAYS AS (a + 1) STORED" in p.ddl[0].sql
    assert p.tables[0].structure.checks[0].set_labels == ["x", "y"] and "<@ ARRAY[E'x', E'y']::text[]" in p.ddl[1].sql


# Existing targets

SEEN = Observed(
    10, [ObservedColumn("id", "int4", False, identity="by_default"), ObservedColumn("name", "character varying(20)", False)], [ObservedIndex("users_pkey", ["id"], [False], True, True)],
    [ObservedConstraint("users_pkey", "p", ["id"])], [ObservedSequence("id", 5, True, maximum=2**31 - 1)], [], "people",
)
APPEND = '[migration]\nmode = "data_only"\n[verification]\nmode = "none"'
APPEND_BASE = BASE + 'on_existing = "append"\n'


def against(seen, policy="append", graph=None, more=None, **facts):
    target = TargetCatalog(namespaces=[Namespace("app", True)], enums=[], tables=[TargetTable("app", "users", seen, **facts)], graph=graph)
    base = BASE + f'on_existing = "{policy}"\n'
    extra = more if more is not None else APPEND if policy == "append" else ""
    try:
        return {d.code for d in build(config(extra, base), SourceCatalog("db", [USERS]), target).diagnostics}
    except Blocked as e:
        return {d.code for d in e.diagnostics}


def change(**more):
    return dataclasses.replace(SEEN, **more)


def test_a_matching_table_is_accepted():
    assert against(SEEN) == {"SEQUENCE_NONTRANSACTIONAL"}


@pytest.mark.parametrize("seen,code", [
    (None, "TARGET_OBSERVATION_REQUIRED"), (change(oid=0), "TARGET_TABLE_UNSUPPORTED"), (change(columns=SEEN.columns[:1]), "TARGET_EXTRA_COLUMNS"),
    (change(columns=[SEEN.columns[0], ObservedColumn("name", "text", False)]), "TARGET_COLUMN_INCOMPATIBLE"), (change(comment="x"), "TARGET_COMMENT_INCOMPATIBLE"),
    (change(columns=[SEEN.columns[0], ObservedColumn("name", "varchar(20)", False, "'x'::text")]), "TARGET_DEFAULT_INCOMPATIBLE"), (change(indexes=[]), "TARGET_INDEX_INCOMPATIBLE"),
    (change(indexes=[dataclasses.replace(SEEN.indexes[0], plain=False)]), "TARGET_INDEX_UNSUPPORTED"), (change(indexes=[ObservedIndex("p", ["name"], [False], True, True)]), "TARGET_PRIMARY_KEY_INCOMPATIBLE"),
    (change(constraints=[ObservedConstraint("x", "x")]), "TARGET_CONSTRAINT_UNSUPPORTED"), (change(sequences=[]), "TARGET_SEQUENCE_INCOMPATIBLE"), (change(sequences=[ObservedSequence("id", None, None, maximum=2**31 - 1)]), "TARGET_SEQUENCE_STATE_UNKNOWN"),
    (change(sequences=[ObservedSequence("id", 2**31 - 1, True, maximum=2**31 - 1)]), "TARGET_SEQUENCE_EXHAUSTED"), (change(triggers=[ObservedTrigger("t", "?")]), "TARGET_TRIGGER_UNKNOWN"), (change(triggers=[ObservedTrigger("t")]), "TARGET_TRIGGER_PRESERVED"),
])
def test_structure_of_existing_tables(seen, code):
    assert code in against(seen)


def test_privileges_of_existing_tables():
    assert "TARGET_INSERT_DENIED" in against(SEEN, can_insert=False)
    assert "TARGET_ROW_SECURITY" in against(SEEN, row_security=True)
    assert "TARGET_TABLE_TOPOLOGY" in against(SEEN, ordinary_standalone=False)
    assert "TARGET_EXISTS" in against(SEEN, "error")


NODES = [Node("t", "class", "users", 10, relation_root=True), Node("p", "constraint", "users_pkey", 10), Node("i", "class", "users_pkey", 10), Node("v", "rewrite", "a view")]
EDGES = [Edge("p", "t", "a"), Edge("i", "p", "i")]


@pytest.mark.parametrize("graph,policy,code", [
    (None, "recreate", "TARGET_DEPENDENCY_METADATA_REQUIRED"), (Graph([*NODES, NODES[0]], EDGES), "recreate", "TARGET_DEPENDENCY_MALFORMED"), (Graph(NODES[1:], []), "recreate", "TARGET_DEPENDENCY_ROOT_MISSING"),
    (Graph(NODES, [*EDGES, Edge("v", "t", "n")]), "recreate", "TARGET_DEPENDENCY_OUTSIDE_SELECTION"), (Graph(NODES, [*EDGES, Edge("v", "t", "a")]), "recreate", "TARGET_DROP_OBJECT_UNSUPPORTED"), (Graph(NODES, [*EDGES, Edge("t", "v", "e")]), "recreate", "TARGET_DEPENDENCY_UNSUPPORTED"),
    (Graph([dataclasses.replace(NODES[0], extension=True), *NODES[1:]], EDGES), "recreate", "TARGET_EXTENSION_MEMBER"), (Graph([*NODES, Node("e", "event_trigger", "ev", event_trigger=True)], EDGES), "recreate", "TARGET_EVENT_TRIGGER"), (Graph(NODES, EDGES[1:]), "recreate", "TARGET_OWNED_OBJECT_PROOF_MISSING"),
    (Graph([*NODES, Node("f", "constraint", "fk", 99, constraint_kind="f")], [*EDGES, Edge("f", "t", "n")]), "truncate", "TARGET_DEPENDENCY_OUTSIDE_SELECTION"),
])
def test_destructive_scope(graph, policy, code):
    assert code in against(SEEN, policy, graph, "" if policy == "recreate" else '[migration]\nmode = "data_only"')


def test_recreate_lists_what_goes():
    assert "TARGET_OBJECT_REMOVED" in against(SEEN, "recreate", Graph(NODES, EDGES), "")
    assert existing.automatic_closure(Graph(NODES, [*EDGES, Edge("t", "i", "a")]), {"t"}) == {"t", "p", "i"}


# Configuration


@pytest.mark.parametrize("more", [
    "[odd]\nx = 1", "[migration]\nodd = 1", '[migration]\nmode = "other"', "[migration]\nbatch_rows = 0", "[migration]\nreaders_per_table = 2", "[migration]\nmax_row_bytes = 99999999", "[migration]\nmemory_bytes = 1000",
    '[migration]\non_row_error = "reject"', "[migration]\nmax_rejected_rows = 3", '[migration]\nmode = "data_only"', '[tables]\ninclude = ["a", "a"]', '[tables]\ninclude_regex = ["("]', '[tables]\ninclude_regex = ["(?=a)"]',
    '[[cast]]\ntarget_type = "text"', '[[cast]]\nsource_type = "int"', '[[cast]]\nsource_type = "int"\ntransform = "x"', '[[cast]]\nsource_type = "int"\ntarget_type = "numeric(2,3)"', '[[cast]]\nsource_type = "decimal"\ntarget_type = "text"\nscale = { op = "eq", value = 31 }',
    '[[overrides]]\nobject = "a"', '[[overrides]]\nobject = "a"\ntarget_expression = "a; b"', '[[overrides]]\nobject = "a"\ntarget_expression = "\'a"', '[report]\ndirectory = ""',
])
def test_refused_configurations(more):
    with pytest.raises(ConfigError):
        config(more)


def test_accepted_configuration_and_admission():
    c = config('[migration]\ntable_workers = 4\nreaders_per_table = 2\nmax_key_span = 1000\n[[overrides]]\nobject = "a"\ntarget_expression = "x = \'a;b\'"')
    a = admit(c.migration, "frozen", 3, 5)
    assert (a.table_workers, a.reader_workers, a.source_connections, a.peak_target_connections) == (1, 2, 3, 6)
    assert reservation(c.migration) == 4 * (16 * 2**20 + 48 * 25_000) + 3 * 2**24 + 2 * (2**24 + 4) + 2 * 2**24 + 65_536


# Legacy import

LOAD = """-- a comment /* x
LOAD DATABASE FROM mysql://u:p@h/shop INTO pgsql://h/db
 WITH include drop, batch rows = 1000, batch size = 32 MB, snake_case identifiers, workers = 2 /* a /* nested */ b */
 CAST TYPE decimal WHEN (and (<= precision 18) (or (= scale 0) (> 3 scale))) TO bigint DROP TYPEMOD,
      COLUMN users.name TO text USING right-trim, TYPE date DROP DEFAULT DROP NOT NULL USING zero-dates-to-null
 INCLUDING ONLY TABLE NAMES MATCHING 'users', ~/^ord/
 EXCLUDING TABLE NAMES MATCHING ~<tmp$>
 SET MySQL PARAMETERS net_read_timeout = '31'
 ALTER SCHEMA 'shop' RENAME TO 'app' ALTER TABLE NAMES MATCHING 'users' RENAME TO 'people';
"""


def test_import():
    c = import_load(LOAD, Options(reviewed_defaults=True)).config
    assert (c.target.schema, c.target.on_existing, c.migration.batch_bytes, c.migration.identifiers, c.migration.table_workers) == ("app", "recreate", 32 << 20, "snake_case", 2)
    assert [(r.precision.op, r.scale.op, r.scale.value) for r in c.cast[:2]] == [("le", "eq", 0), ("le", "lt", 3)] and c.cast[0].auto_increment is False
    assert c.tables.include == ["users"] and c.tables.include_regex == ["^ord"] and c.tables.rename[0].target == "people" and c.source.session == {"net_read_timeout": "31"}
    made = import_load(LOAD, Options(reviewed_defaults=True))
    assert parse(made.toml) == made.config and "u:p" not in made.toml


@pytest.mark.parametrize("change,code", [
    (("include drop", "include drop, truncate"), "IMPORT_CONFLICT"), (("include drop", "data only"), "IMPORT_CONFLICT"), (("workers = 2", "workers = 0"), "IMPORT_NUMBER"), (("workers = 2", "prefetch rows = 2"), "IMPORT_UNIT_POLICY"),
    (("workers = 2", "concurrency = 2"), "IMPORT_READER_POLICY"), (("workers = 2", "odd thing"), "IMPORT_OPTION"), (("right-trim", "some-code"), "IMPORT_TRANSFORM"), (("~/^ord/", "~/(?i)a/"), "IMPORT_REGEX"), (("'shop'", "'other'"), "IMPORT_SCHEMA"),
    (("ALTER SCHEMA 'shop' RENAME TO 'app'", ""), "IMPORT_SCHEMA_REQUIRED"), ((";", "; LOAD"), "IMPORT_COMMANDS"), (("SET MySQL", "BEFORE LOAD DO SET MySQL"), "IMPORT_CAPABILITY"), (("mysql://u:p@h/shop", "mysql://u:p@@h/shop"), "IMPORT_URI"),
    (("(= scale 0)", "(= precision 1)"), "IMPORT_GUARD"), (("'users', ", "'us\\ers', "), "IMPORT_ESCAPE"), (("/* a", "/* /* a"), "IMPORT_SYNTAX"), (("COLUMN users.name", "COLUMN users.name WHEN NOT NULL"), "IMPORT_GUARD"),
])
def test_refused_imports(change, code):
    with pytest.raises(ImportRefused) as e:
        import_load(LOAD.replace(*change, 1), Options(reviewed_defaults=True))
    assert e.value.code == code


def test_import_needs_acknowledgement_and_never_crashes():
    import random

    with pytest.raises(ImportRefused) as e:
        import_load(LOAD, Options())
    assert e.value.code == "IMPORT_DEFAULT_POLICY"
    r = random.Random(3)
    for _ in range(400):
        text = list(LOAD)
        for _ in range(r.randint(1, 6)):
            i = r.randrange(len(text))
            text[i : i + r.randint(0, 3)] = r.choice(["", "'", "(", ";", "~", "x", "/*", ","])
        try:
            import_load("".join(text), Options(reviewed_defaults=True))
        except ImportRefused:
            pass
    assert load_import.plain_regex("a\\.b[c-d]+") and not load_import.plain_regex("\\d")
