"""Named queries that go through plans, runs, verification and the rules around them; tables of the sample folders stand for source and target.

Whole runs write below the folder that keelson.operators.closure.shared_folder gives, and remove what they wrote.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import constraints, fulltext, load, multiset, verify
from keelson.operators.closure import shared_folder
from keelson.plans.catalogue import dirty_lineitem, lineitem_plan, n, one, plan, query, table, values
from keelson.plans.model import CheckExpectation, Expectations, ForeignKeyExpectation, IndexExpectation, IndexPart, Kind, SequenceExpectation, SourceCatalog, SourceColumn, SourceIndex, SourceTable, TablePlan

CONFIG = """version = 1
source = {{ url_env = "SOURCE_URL", consistency = "frozen" }}
target = {{ url_env = "TARGET_URL", schema = "app", on_existing = "{existing}" }}
migration = {{ mode = "{mode}", on_row_error = "reject", max_rejected_rows = {cap}, table_workers = 2 }}
verification = {{ mode = "content" }}
report = {{ directory = "{folder}/runs" }}
"""


@contextmanager
def workspace(spark: SparkSession) -> Iterator[tuple[str, str]]:
    """(folder for run reports on the driver, folder for tables that every executor reaches), both removed in the end."""
    local, shared = tempfile.mkdtemp(prefix="keelson-run-"), f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    try:
        yield local, shared
    finally:
        shutil.rmtree(local, ignore_errors=True)
        load.remove(spark, shared)


def migrate(spark: SparkSession, folders: tuple[str, str], source: SourceCatalog, rows: dict[str, DataFrame], *, existing: str = "error", mode: str = "full", cap: int = 10**12):
    """The report of one run."""
    from keelson.plans.planner import build
    from keelson.plans.run import FileTarget, Run
    from keelson.sources.config import parse

    c, target = parse(CONFIG.format(existing=existing, mode=mode, cap=cap, folder=folders[0])), FileTarget(spark, folders[1])
    made = build(c, source, target.catalog(["app"]))
    return Run(spark, c, made, lambda t: rows[t.source_name], target).go()


REPORT = "table_name string, rows_read long, committed_rows long, rejected_rows long, committed_bytes long, verification string, exit_code int"


def told(spark: SparkSession, report) -> DataFrame:
    done = [(t.source_name, t.rows_read, t.committed_rows, t.rejected_rows, t.committed_bytes, str(report.verification.status), report.exit_code()) for t in report.tables]
    return values(spark, REPORT, done)


def orders_and_customers() -> SourceCatalog:
    c = lambda name, i, kind, full, **more: SourceColumn(name, i, kind, full, **more)
    key = lambda name: [SourceIndex("PRIMARY", [IndexPart(name)], primary=True)]
    return SourceCatalog("shop", [
        SourceTable("orders", [c("o_orderkey", 1, "bigint", "bigint", nullable=False), c("o_custkey", 2, "bigint", "bigint"), c("o_orderstatus", 3, "varchar", "varchar(1)", character_length=1)], indexes=key("o_orderkey")),
        SourceTable("customer", [c("c_custkey", 1, "bigint", "bigint", nullable=False), c("c_mktsegment", 2, "varchar", "varchar(9)", character_length=9)], indexes=key("c_custkey"))])


def _both(spark, sf_dir) -> dict[str, DataFrame]:
    return {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")}


SIZE = {
    "orders": "sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(CAST(o_custkey AS VARCHAR)) + strlen(o_orderstatus) + 3)",
    "customer": "sum(strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_mktsegment) + 2)",
}


@query(f"""
SELECT 'orders' AS table_name, count(*) AS rows_read, count(*) AS committed_rows, CAST(0 AS BIGINT) AS rejected_rows, CAST({SIZE["orders"]} AS BIGINT) AS committed_bytes, 'complete' AS verification, 3 AS exit_code FROM orders
UNION ALL SELECT 'customer', count(*), count(*) FILTER (length(c_mktsegment) <= 9), count(*) FILTER (length(c_mktsegment) > 9), CAST({SIZE["customer"]} FILTER (length(c_mktsegment) <= 9) AS BIGINT), 'complete', 3 FROM customer""")
def run_with_rejects(spark, sf_dir):
    """Two tables loaded into a new target; segments longer than the target takes are rejects; content is verified."""
    with workspace(spark) as folders:
        return told(spark, migrate(spark, folders, orders_and_customers(), _both(spark, sf_dir)))


@query(f"SELECT 'orders' AS table_name, count(*) AS rows_read, count(*) AS committed_rows, CAST(0 AS BIGINT) AS rejected_rows, CAST({SIZE['orders']} AS BIGINT) AS committed_bytes, 'complete' AS verification, 0 AS exit_code FROM orders WHERE o_orderkey % 3 <> 0")
def run_append(spark, sf_dir):
    """A third of the orders first, then the others on top of them; the second run is verified against its baseline."""
    source = orders_and_customers()
    source.tables = source.tables[:1]
    rows = _both(spark, sf_dir)["orders"]
    with workspace(spark) as folders:
        first = migrate(spark, folders, source, {"orders": rows.where("o_orderkey % 3 = 0")})
        assert first.exit_code() == 0, first
        return told(spark, migrate(spark, folders, source, {"orders": rows.where("o_orderkey % 3 <> 0")}, existing="append", mode="data_only"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderkey) AS nth FROM (SELECT o_orderkey % 5000 + 1 AS k, * FROM orders))
SELECT 'orders' AS table_name, count(*) AS rows_read, count(*) FILTER (nth = 1 AND k > 10) AS committed_rows, count(*) FILTER (nth > 1 OR k <= 10) AS rejected_rows,
  CAST({SIZE['orders'].replace('CAST(o_orderkey AS', 'CAST(k AS')} FILTER (nth = 1 AND k > 10) AS BIGINT) AS committed_bytes, 'complete' AS verification, CASE WHEN count(*) FILTER (nth > 1 OR k <= 10) > 0 THEN 3 ELSE 0 END AS exit_code FROM r""")
def run_existing_key(spark, sf_dir):
    """Appending rows that repeat a key: the earliest row of a key stays, and none whose key is there already."""
    source = orders_and_customers()
    source.tables = source.tables[:1]
    rows = _both(spark, sf_dir)["orders"]
    keyed = rows.orderBy("o_orderkey").withColumn("o_orderkey", F.col("o_orderkey") % 5000 + 1)
    held = spark.range(1, 11).select(F.col("id").alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.lit("X").alias("o_orderstatus"))
    with workspace(spark) as folders:
        first = migrate(spark, folders, source, {"orders": held})
        assert first.exit_code() == 0, first
        return told(spark, migrate(spark, folders, source, {"orders": keyed}, existing="append", mode="data_only"))


@query("SELECT count(*) FILTER (length(c_mktsegment) > 9) > 7 AS refused, CASE WHEN count(*) FILTER (length(c_mktsegment) > 9) > 7 THEN CAST(0 AS BIGINT) ELSE count(*) FILTER (length(c_mktsegment) <= 9) END AS published FROM customer")
def run_reject_cap(spark, sf_dir):
    """More rejects over all tables than the run allows: nothing is published."""
    with workspace(spark) as folders:
        report = migrate(spark, folders, orders_and_customers(), _both(spark, sf_dir), cap=7)
        return values(spark, "refused boolean, published long", [(report.exit_code() == 1, sum(t.committed_rows for t in report.tables if t.source_name == "customer"))])


@query("""
SELECT kind, reason, count(*) AS n_rows, min(shown) AS least FROM (SELECT 'conversion' AS kind, CASE l_orderkey % 10 WHEN 1 THEN 'l_orderkey: range' WHEN 2 THEN 'l_quantity: not_null' WHEN 3 THEN 'l_quantity: range'
  WHEN 4 THEN 'l_returnflag: length' ELSE 'l_shipdate: field_overflow' END AS reason, CAST(CASE WHEN l_orderkey % 10 = 1 THEN -l_orderkey ELSE l_orderkey END AS VARCHAR) AS shown FROM lineitem WHERE l_orderkey % 10 BETWEEN 1 AND 5) GROUP BY ALL""")
def reject_records(spark, sf_dir):
    """Records of rejected rows keep the raw values as they came."""
    t = lineitem_plan()
    records = load.rejects(load.converted(dirty_lineitem(spark, sf_dir), t), t)
    return records.groupBy("kind", "reason").agg(F.count("*").alias("n_rows"), F.min("values.l_orderkey").alias("least"))


@query("SELECT n_nationkey, length(n_name) + n_regionkey AS g, upper(n_name) AS name FROM nation")
def generated_columns(spark, sf_dir):
    t = TablePlan("t", "nation", "app", "nation", [
        plan("n_nationkey", "int", "integer", Kind.SIGNED), plan("n_regionkey", "int", "integer", Kind.SIGNED), plan("n_name", "text", "text", Kind.TEXT),
        plan("g", "int", "integer", Kind.SIGNED, copy=False, generated_expression="length(n_name) + n_regionkey"), plan("name", "text", "text", Kind.TEXT, copy=False, generated_expression="upper(n_name)")])
    return load.good(load.converted(table(spark, sf_dir, "nation"), t), t).select(n(F.col("n_nationkey")).cast("int").alias("n_nationkey"), n(F.col("g")).alias("g"), "name")


@query("SELECT doc_id, quality = 1 AS value, CASE WHEN quality NOT IN (0, 1) THEN 'range' END AS problem FROM labels")
def bits_to_boolean(spark, sf_dir):
    raw = F.unhex(F.lpad(F.hex("quality"), 2, "0"))
    out = one(table(spark, sf_dir, "labels"), raw, plan("q", "bit(1)", "boolean", Kind.BOOLEAN, transform="bits-to-boolean"), ["doc_id"])
    return out.drop("changed")


@query("SELECT 'byte-vector-to-bytea' AS transform, n_nationkey AS key, lower(hex(encode(n_name))) AS value FROM nation UNION ALL SELECT 'bytes-to-pg-bytea', n_nationkey, lower(hex(encode(n_name))) FROM nation")
def bytes_to_bytea(spark, sf_dir):
    out = None
    for name in ("byte-vector-to-bytea", "bytes-to-pg-bytea"):
        made = one(table(spark, sf_dir, "nation"), F.encode("n_name", "UTF-8"), plan("b", "varbinary(99)", "bytea", Kind.BINARY, transform=name), ["n_nationkey"])
        made = made.select(F.lit(name).alias("transform"), F.col("n_nationkey").alias("key"), F.lower(F.hex("value")).alias("value"))
        out = made if out is None else out.unionAll(made)
    return out


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity <= 40 THEN l_quantity - 20 END AS SMALLINT) AS value, CASE WHEN l_quantity > 40 THEN 'format' END AS problem FROM lineitem")
def tinyint_to_integer(spark, sf_dir):
    q = n(F.col("l_quantity"))
    raw = F.when(q > 40, F.lit("x1")).otherwise((q - 20).cast("string"))
    p = plan("q", "tinyint", "smallint", Kind.SIGNED, transform="tinyint-to-integer")
    return one(table(spark, sf_dir, "lineitem"), raw, p, ["l_orderkey", "l_linenumber"]).drop("changed")


@query("SELECT * FROM (VALUES " + ", ".join(f"({b}, {b})" for b in range(256)) + ") t(byte, code_point)")
def charset_iso_8859_1(spark, sf_dir):
    rows = spark.range(256).select(F.col("id").cast("int").alias("byte"))
    shown, _ = text.decode(F.unhex(F.lpad(F.hex(F.col("byte").cast("long")), 2, "0")), "iso-8859-1")
    return rows.select("byte", F.conv(F.hex(F.encode(shown, "UTF-16BE")), 16, 10).cast("int").alias("code_point"))


@query("SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE NOT coalesce((l_quantity >= 10 AND l_returnflag <> 'R') OR NOT l_discount > 0.02, true) GROUP BY 1")
def safe_expression_check(spark, sf_dir):
    """A check of the source, proven safe and run on the target's rows."""
    from keelson.plans.safe_expression import is_safe, to_spark

    check = "(l_quantity >= 10 AND \"l_returnflag\" <> 'R') OR NOT l_discount > 0.02"
    assert is_safe(check) and not is_safe("f(l_quantity) > 0")
    return constraints.check_violations(table(spark, sf_dir, "lineitem"), to_spark(check)).groupBy("l_returnflag").agg(F.count("*").alias("n_rows"))


@query("SELECT DISTINCT * FROM (SELECT 'trigger' AS kind, n_name AS object, 'triggers are not migrated' AS reason FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'event', r_name, 'events are not migrated' FROM region UNION ALL SELECT 'event', r_name, 'events are not migrated' FROM region)")
def unsupported_inventory(spark, sf_dir):
    from keelson.sources.catalog import unsupported_objects

    triggers = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.lit("trigger").alias("kind"), F.col("n_name").alias("object"), F.lit("triggers are not migrated").alias("reason"))
    events = table(spark, sf_dir, "region").select(F.lit("event").alias("kind"), F.col("r_name").alias("object"), F.lit("events are not migrated").alias("reason"))
    return unsupported_objects(triggers, events, events)


def lineitem_target() -> TablePlan:
    """A plan of lineitem's keys and checks, some of which its rows break."""
    big = lambda name, **more: plan(name, "bigint", "bigint", Kind.SIGNED, **more)
    want = Expectations(True, indexes=[IndexExpectation("u_part", ["l_partkey", "l_suppkey"], [None, None], True, False, [False, False])])
    want.foreign_keys = [ForeignKeyExpectation("fk_order", ["l_orderkey"], "app", "orders", ["o_orderkey"], "RESTRICT", "RESTRICT")]
    want.checks = [CheckExpectation("few", "l_linenumber < 7")]
    want.sequences = [SequenceExpectation("l_orderkey", 2**63 - 1, 5)]
    return TablePlan("t", "lineitem", "app", "lineitem", [big("l_orderkey", nullable=False), big("l_linenumber"), big("l_partkey"), big("l_suppkey", nullable=False)], ["l_orderkey", "l_linenumber"], structure=want)


def lineitem_rows(spark, sf_dir) -> DataFrame:
    """Lineitem with suppliers lost in some rows."""
    lost = F.when(F.col("l_orderkey") % 50 != 0, F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(n(F.col("l_orderkey")).alias("l_orderkey"), n(F.col("l_linenumber")).alias("l_linenumber"), n(F.col("l_partkey")).alias("l_partkey"), n(lost).alias("l_suppkey"))


LOST = "(SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 50 <> 0 THEN l_suppkey END AS l_suppkey FROM lineitem)"


@query(f"""
SELECT 'primary key' AS what, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_bad
UNION ALL SELECT 'nulls of l_suppkey', (SELECT count(*) FROM {LOST} WHERE l_suppkey IS NULL)
UNION ALL SELECT 'keys repeat in u_part', (SELECT count(*) FROM (SELECT 1 FROM {LOST} WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY l_partkey, l_suppkey HAVING count(*) > 1))
UNION ALL SELECT 'rows without a parent in fk_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0))
UNION ALL SELECT 'rows against few', (SELECT count(*) FROM lineitem WHERE NOT l_linenumber < 7)""")
def verify_structure(spark, sf_dir):
    """Nulls, primary key, unique index, foreign key and check, as verification counts them in the rows."""
    import re

    t, rows = lineitem_target(), lineitem_rows(spark, sf_dir)
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0")
    said = verify.null_differences(t, rows) + verify.primary_key_check(t, rows)[1] + verify.structure_check(t, rows, lambda schema, name: parents)[1]
    found = {"primary key": 0, "nulls of l_suppkey": 0, "keys repeat in u_part": 0, "rows without a parent in fk_order": 0, "rows against few": 0}
    for line in said:
        if m := re.fullmatch(r"lineitem: (\d+) primary key violations", line):
            found["primary key"] = int(m[1])
        elif m := re.fullmatch(r"lineitem\.(\w+): (\d+) nulls", line):
            found[f"nulls of {m[1]}"] = int(m[2])
        elif m := re.fullmatch(r"lineitem: (\d+) (.+)", line):
            found[m[2]] = int(m[1])
    return values(spark, "what string, n_bad long", list(found.items()))


@query("SELECT column_name, state, CASE WHEN state IS NULL THEN 'unsupported' WHEN state >= top THEN 'complete' ELSE 'different' END AS verdict FROM (SELECT 'l_orderkey' AS column_name, greatest(max(l_orderkey) + 1, 5) AS top FROM lineitem), (VALUES (CAST(NULL AS BIGINT)), (3), (1000000000)) s(state)")
def verify_sequences(spark, sf_dir):
    t, rows = lineitem_target(), lineitem_rows(spark, sf_dir)
    verdict = lambda state: str(verify.sequence_check(t, rows, {} if state is None else {"l_orderkey": state})[0])
    return values(spark, "column_name string, state long, verdict string", [("l_orderkey", s, verdict(s)) for s in (None, 3, 10**9)])


@query("""
SELECT * FROM (VALUES ('as planned', 0), ('another type', 1), ('another nullability', 1), ('another comment', 1), ('another identity', 1), ('another default', 1), ('no index', 1), ('no foreign key', 1), ('no check', 1), ('another sequence', 1)) t(change, n_found)""")
def verify_observed_structure(spark, sf_dir):
    """Every change of a table's recorded structure is found, and only that."""
    import copy

    from keelson.plans.target import observed_of

    t = lineitem_target()
    first = observed_of(t, 1, {})
    changes = {
        "as planned": lambda o: None, "another type": lambda o: setattr(o.columns[0], "type", "integer"), "another nullability": lambda o: setattr(o.columns[0], "nullable", True),
        "another comment": lambda o: setattr(o.columns[1], "comment", "x"), "another identity": lambda o: setattr(o.columns[1], "identity", "always"), "another default": lambda o: setattr(o.columns[2], "default", "7"),
        "no index": lambda o: o.indexes.pop(0), "no foreign key": lambda o: setattr(o, "constraints", [c for c in o.constraints if c.kind != "f"]),
        "no check": lambda o: setattr(o, "constraints", [c for c in o.constraints if c.kind != "c"]), "another sequence": lambda o: setattr(o.sequences[0], "cycle", True),
    }
    rows = []
    for name, change in changes.items():
        seen = copy.deepcopy(first)
        change(seen)
        wrong, unknown = verify.column_differences(t, seen)
        rows.append((name, len(wrong) + len(unknown) + len(verify.object_differences(t, seen))))
    return values(spark, "change string, n_found int", rows)


@query("SELECT sha256(string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS sha256, count(*) AS n_rows FROM orders")
def canonical_stream_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("line"))
    return multiset.stream_digest(rows, ["o_orderkey"], "line")


COUNTED = ("customer", "orders", "supplier")


@query("SELECT CAST(sum(n) AS BIGINT) AS rows_read, CAST(sum(n - n % 7) AS BIGINT) AS committed_rows, CAST(sum(n % 7) AS BIGINT) AS rejected_rows, CAST(sum(n - n % 7) * 1000 // 250 AS BIGINT) AS rows_a_second FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in COUNTED) + ")")
def run_totals(spark, sf_dir):
    """Totals of a run's tables, and the rate."""
    from keelson.plans.model import RunReport, TableReport, VerificationReport
    from keelson.plans.run import rate, totals

    counts = [table(spark, sf_dir, t).count() for t in COUNTED]
    report = RunReport("r", "frozen", "full", VerificationReport("none"), tables=[TableReport(t, t, "app", t, rows_read=c, committed_rows=c - c % 7, rejected_rows=c % 7) for t, c in zip(COUNTED, counts, strict=True)])
    found = totals(report)
    return values(spark, "rows_read long, committed_rows long, rejected_rows long, rows_a_second long", [(found["rows_read"], found["committed_rows"], found["rejected_rows"], rate(found["committed_rows"], 250))])


@query("SELECT r_name AS database_name, sha256('mysql://u@h:' || (3306 + r_regionkey) || '/' || r_name) AS digest FROM region")
def endpoint_digests(spark, sf_dir):
    """Of addresses without password, query and fragment."""
    from keelson.sources.artifacts import endpoint_digest

    known = [(r.r_name, endpoint_digest(f"mysql://u:secret{r.r_regionkey}@h:{3306 + r.r_regionkey}/{r.r_name}?a=1#x")) for r in table(spark, sf_dir, "region").collect()]
    return values(spark, "database_name string, digest string", known)


@query("SELECT column_name, '\"' || replace(column_name, '\"', '\"\"') || '\"' AS quoted, '`' || replace(column_name, '`', '``') || '`' AS source_quoted FROM (DESCRIBE lineitem) UNION ALL SELECT 'a\"b`c', '\"a\"\"b`c\"', '`a\"b``c`'")
def quoted_identifiers(spark, sf_dir):
    from keelson.plans.names import quote, spark_quote

    names = [*table(spark, sf_dir, "lineitem").columns, 'a"b`c']
    return values(spark, "column_name string, quoted string, source_quoted string", [(x, quote(x), spark_quote(x)) for x in names])


@query("SELECT table_name, column_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS INTEGER) AS ordinal FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, row_number() OVER () AS ordinal FROM (DESCRIBE {t})" for t in ("nation", "region", "supplier")) + ")")
def catalogue_order(spark, sf_dir):
    """Flat facts of three tables to a catalogue, whose tables and columns come in their order."""
    from keelson.sources.catalog import facts, from_facts

    made = SourceCatalog("db", [SourceTable(t, [SourceColumn(c, i, "int", "int") for i, c in enumerate(table(spark, sf_dir, t).columns, 1)]) for t in ("supplier", "region", "nation")])
    back = from_facts("db", facts(spark, made)["columns"].orderBy(F.rand(1)))
    assert [t.name for t in back.tables] == ["nation", "region", "supplier"]
    return values(spark, "table_name string, column_name string, ordinal int", [(t.name, c.name, c.ordinal) for t in back.tables for c in t.columns])


@query("SELECT workers, CAST(least(workers, 3, greatest(0, 512 * 1048576 // (4 * (16 * 1048576 + 48 * 25000) + 3 * 16777216 + 2 * (16777216 + 4) + 2 * 16777216 + 65536))) AS INTEGER) AS table_workers FROM (VALUES (1), (2), (3), (9)) t(workers)")
def admitted_workers(spark, sf_dir):
    """How many tables a run's memory lets it work on at once."""
    from keelson.plans.admission import admit
    from keelson.sources.config import Migration

    rows = [(w, admit(Migration(table_workers=w), "frozen", 3, 1).table_workers) for w in (1, 2, 3, 9)]
    return values(spark, "workers int, table_workers int", rows)


@query("SELECT name, lower(name) AS downcase FROM (SELECT n_name || '_Key' AS name FROM nation)")
def identifier_downcase(spark, sf_dir):
    from keelson.plans.names import mapped_name

    names = [f"{r.n_name}_Key" for r in table(spark, sf_dir, "nation").collect()]
    return values(spark, "name string, downcase string", [(x, mapped_name(x, "downcase", x)) for x in names])


@query("SELECT kind, element FROM (VALUES ('integer', 'bigint'), ('integer', 'numeric(20,0)'), ('bigint', 'smallint'), ('varchar(3)', 'varchar(9)'), ('text[]', 'text[]'), ('date', 'date'), ('timestamp(3)', 'timestamp(0)')) t(kind, element)")
def fk_types(spark, sf_dir):
    """Pairs of types whose equality in a foreign key is exact, out of some that aren't."""
    pairs = [("integer", "bigint"), ("integer", "numeric(20,0)"), ("bigint", "smallint"), ("varchar(3)", "varchar(9)"), ("text[]", "text[]"), ("date", "date"), ("timestamp(3)", "timestamp(0)"),
             ("numeric(9,0)", "integer"), ("integer[]", "integer[]"), ("text", "varchar(3)"), ("date", "timestamp"), ("integer", "odd")]
    fits = [(a, b) for a, b in pairs if constraints.fk_types_agree(plan("a", "x", a, Kind.TEXT), plan("b", "x", b, Kind.TEXT))]
    return values(spark, "kind string, element string", fits)


@query(r"""SELECT * FROM (VALUES ('7', 'integer', '7'), ('2.50', 'numeric(5,2)', '2.50'), ('it''s', 'text', 'E''it''''s'''), ('2024-01-02 03:04:05', 'timestamp(0) without time zone', 'E''2024-01-02 03:04:05.000000'''), ('0x0102', 'bytea', 'E''\\x0102'''), ('a,c', 'text[]', 'E''{"a","c"}''')) t(source, kind, target)""")
def default_rendering(spark, sf_dir):
    """Literal defaults of the source as the target's."""
    from keelson.plans.defaults import default_sql

    known = [
        ("7", "int", plan("c", "int", "integer", Kind.SIGNED)), ("2.50", "decimal", plan("c", "decimal", "numeric(5,2)", Kind.DECIMAL)), ("it's", "text", plan("c", "text", "text", Kind.TEXT)),
        ("2024-01-02 03:04:05", "datetime", plan("c", "datetime", "timestamp(0) without time zone", Kind.DATETIME)), ("0x0102", "varbinary", plan("c", "varbinary", "bytea", Kind.BINARY)),
        ("a,c", "set", plan("c", "set", "text[]", Kind.SET, set_labels=["a", "b", "c"])),
    ]
    return values(spark, "source string, kind string, target string", [(d, p.target_type, default_sql(SourceColumn("c", 1, k, k, default=d), p)) for d, k, p in known])


@query("SELECT expression, CAST(expression NOT LIKE '%english%' AND expression LIKE '%lang%' AS BOOLEAN) AS known FROM (VALUES ('to_tsvector(''simple''::regconfig, COALESCE(lang, ''''::text))'), ('to_tsvector(''english''::regconfig, COALESCE(lang, ''''::text))'), ('pg_catalog.to_tsvector(''pg_catalog.simple''::pg_catalog.regconfig, (COALESCE((\"lang\")::text, ''''::text)))'), ('to_tsvector(''simple''::regconfig, COALESCE(body, ''''::text))')) t(expression)")
def fulltext_expressions(spark, sf_dir):
    """Index expressions that are the one over a column, however a server shows them."""
    shown = ["to_tsvector('simple'::regconfig, COALESCE(lang, ''::text))", "to_tsvector('english'::regconfig, COALESCE(lang, ''::text))",
             "pg_catalog.to_tsvector('pg_catalog.simple'::pg_catalog.regconfig, (COALESCE((\"lang\")::text, ''::text)))", "to_tsvector('simple'::regconfig, COALESCE(body, ''::text))"]
    return values(spark, "expression string, known boolean", [(x, fulltext.is_expression(x, ["lang"])) for x in shown])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN CAST(n_nationkey AS DOUBLE) END AS value, CASE WHEN n_nationkey % 5 > 1 THEN 'format' END AS problem FROM nation")
def float_text(spark, sf_dir):
    """Text that the platform's own cast would take for a number, and that isn't one."""
    k, shown = F.col("n_nationkey") % 5, F.col("n_nationkey").cast("string")
    raw = F.when(k == 1, shown).when(k == 2, F.concat(shown, F.lit("d"))).when(k == 3, F.concat(F.lit(" "), shown)).when(k == 4, F.lit("0x1p3"))
    return one(table(spark, sf_dir, "nation"), raw, plan("f", "double", "double precision", Kind.FLOAT), ["n_nationkey"]).drop("changed")


@query("SELECT count(*) AS n_rows, count(*) FILTER (n > 1) AS n_repeated FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)")
def distinct_pairs(spark, sf_dir):
    """Distinct key pairs, and those that come more than once."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    repeated = constraints.unique_violations(rows, ["l_partkey", "l_suppkey"]).select(F.lit(1).alias("repeated"), F.lit(0).alias("one"))
    both = repeated.unionAll(rows.distinct().select(F.lit(0), F.lit(1)))
    return both.agg(n(F.sum("one")).alias("n_rows"), n(F.sum("repeated")).alias("n_repeated"))
