"""Named queries over the sample tables, each with its DuckDB counterpart.

Every query goes through the library's own operators. Inputs that the sample tables lack
(trailing blanks, zero dates, NUL) are derived by the same arithmetic on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import encode, text
from keelson.functions.convert import bytea_text, canonical_decimal, convert
from keelson.functions.json_check import is_json
from keelson.operators import closure, constraints, fulltext, load, multiset, ranges
from keelson.plans.model import ColumnPlan, Kind, SourceCatalog, SourceColumn, SourceIndex, SourceTable, TablePlan
from keelson.plans.names import mapped_name
from keelson.plans.planner import select

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its DuckDB statement."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan(name: str, source: str, target: str, kind: Kind, **more: object) -> ColumnPlan:
    return ColumnPlan(name, name, source, target, kind, **more)


def one(rows: DataFrame, raw: Column | str, p: ColumnPlan, keys: list[str]) -> DataFrame:
    """A single converted column beside keys: value, problem and changed."""
    staged = rows.select(*keys, (F.col(raw) if isinstance(raw, str) else raw).alias(p.source_name))
    made = convert(F.col(p.source_name), p, dict(staged.dtypes)[p.source_name])
    return staged.select(*keys, made.value.alias("value"), made.problem.alias("problem"), made.changed.alias("changed"))


def n(c: Column) -> Column:
    return c.cast("long")


# Scans, ranges and selection


@query("SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(*) AS n_rows FROM orders")
def key_bounds(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"), F.count("*").alias("n_rows"))


@query("""
WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
SELECT CAST((o_orderkey - lo) // 1000 AS BIGINT) AS range_id, CAST(min(lo) + ((o_orderkey - lo) // 1000) * 1000 AS BIGINT) AS first_key,
  CAST(least(min(lo) + ((o_orderkey - lo) // 1000) * 1000 + 999, min(hi)) AS BIGINT) AS last_key, count(*) AS n_rows
FROM orders, b GROUP BY (o_orderkey - lo) // 1000""")
def range_partition_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    low, high = ranges.key_bounds(rows, "o_orderkey")
    counted = rows.groupBy(n(ranges.range_number(F.col("o_orderkey"), low, 1000)).alias("range_id")).count()
    first = F.lit(low) + F.col("range_id") * 1000
    return counted.select("range_id", n(first).alias("first_key"), n(F.least(first + 999, F.lit(high))).alias("last_key"), F.col("count").alias("n_rows"))


@query("SELECT range_id, count(*) AS n_rows, sum(o_totalprice) > 0 AS any_price FROM (SELECT *, CAST(o_orderkey // 5000 AS INTEGER) AS range_id FROM orders WHERE o_orderkey BETWEEN 0 AND 14999) GROUP BY range_id")
def range_scan_union(spark, sf_dir):
    """Separate scans of closed ranges of 5000 keys that cover the whole table; each is a pushed-down filter."""
    rows = table(spark, sf_dir, "orders")
    low, high = ranges.key_bounds(rows, "o_orderkey") or (0, 0)
    out = None
    for a, b in ranges.integer_ranges(ranges.Bound(low // 5000 * 5000), ranges.Bound(high), 5000):
        part = rows.where(ranges.in_range("o_orderkey", a, b)).select(F.lit(a // 5000).alias("range_id"), "o_totalprice")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("range_id").agg(F.count("*").alias("n_rows"), (F.sum("o_totalprice") > 0).alias("any_price"))


NAMES = ["orders", "order_items", "audit_log", "users", "UsersArchive", "tmp_load", "v_sales"]


@query("""
SELECT name, CAST(name IN ('users') OR regexp_matches(name, '^order') AS BOOLEAN) AND NOT (name = 'tmp_load' OR regexp_matches(name, 'items$')) AND name <> 'v_sales' AS selected
FROM (VALUES ('orders'), ('order_items'), ('audit_log'), ('users'), ('UsersArchive'), ('tmp_load'), ('v_sales')) t(name)""")
def table_selection(spark, sf_dir):
    from keelson.sources.config import Config, Source, Tables, Target

    c = Config(1, Source("A", consistency="frozen"), Target("B", schema="app"), tables=Tables(["users"], ["tmp_load"], ["^order"], ["items$"]))
    chosen, _ = select(c, SourceCatalog("db", [SourceTable(x, [], is_view=x.startswith("v_")) for x in NAMES]))
    names = {t.name for t in chosen}
    return spark.createDataFrame([(x, x in names) for x in NAMES], "name string, selected boolean")


@query("SELECT * FROM (VALUES ('CamelCase', 'camel_case'), ('HTTPServer', 'http_server'), ('already_snake', 'already_snake'), ('Order2Items', 'order2_items'), ('ID', 'id')) t(source_name, target_name)")
def identifier_snake_case(spark, sf_dir):
    names = ["CamelCase", "HTTPServer", "already_snake", "Order2Items", "ID"]
    return spark.createDataFrame([(x, mapped_name(x, "snake_case", x)) for x in names], "source_name string, target_name string")


# Scalar conversions


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS problem FROM lineitem")
def convert_unsigned_bigint(spark, sf_dir):
    p = plan("l_orderkey_raw", "bigint unsigned", "numeric(20,0)", Kind.UNSIGNED)
    return one(table(spark, sf_dir, "lineitem"), F.col("l_orderkey").cast("string"), p, ["l_orderkey", "l_linenumber"]).drop("changed").withColumn("value", F.col("value").cast("string"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey - 100 BETWEEN -32768 AND 32767 AND l_partkey >= 100 THEN CAST(l_partkey - 100 AS SMALLINT) END AS value,
  CASE WHEN l_partkey < 100 OR l_partkey - 100 > 32767 THEN 'range' END AS problem FROM lineitem""")
def convert_integer_ranges(spark, sf_dir):
    p = plan("k", "smallint unsigned", "smallint", Kind.UNSIGNED)
    return one(table(spark, sf_dir, "lineitem"), F.col("l_partkey") - 100, p, ["l_orderkey", "l_linenumber"]).drop("changed")


@query("""
SELECT s_suppkey, CAST(y AS SMALLINT) AS value, CASE WHEN y IS NULL THEN 'range' END AS problem
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 400 = 0 OR (s_suppkey % 400) + 1800 BETWEEN 1901 AND 2155 THEN CASE WHEN s_suppkey % 400 = 0 THEN 0 ELSE (s_suppkey % 400) + 1800 END END AS y FROM supplier)""")
def convert_year(spark, sf_dir):
    p = plan("y", "year", "smallint", Kind.UNSIGNED, transform="year-to-integer")
    k = F.col("s_suppkey") % 400
    return one(table(spark, sf_dir, "supplier"), F.when(k == 0, 0).otherwise(k + 1800), p, ["s_suppkey"]).drop("changed")


DIRTY_DECIMAL = "CASE WHEN p_partkey % 5 = 0 THEN {c} || '5' WHEN p_partkey % 7 = 0 THEN '+' || {c} WHEN p_partkey % 11 = 0 THEN '.5' WHEN p_partkey % 13 = 0 THEN '1e3' ELSE {c} END"


@query(f"""
WITH r AS (SELECT p_partkey, {DIRTY_DECIMAL.format(c="CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)")} AS raw FROM part)
SELECT p_partkey, CASE WHEN NOT regexp_full_match(raw, '[+-]?[0-9]+([.][0-9]+)?') THEN 'format' WHEN length(split_part(raw, '.', 2)) > 2 THEN 'range' END AS problem,
  CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+([.][0-9]+)?') AND length(split_part(raw, '.', 2)) <= 2 THEN CAST(CAST(replace(raw, '+', '') AS DECIMAL(12,2)) AS VARCHAR) END AS value FROM r""")
def convert_decimal_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(DIRTY_DECIMAL.format(c="CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)")).alias("raw"))
    out = one(rows, "raw", plan("raw", "decimal(12,2)", "numeric(12,2)", Kind.DECIMAL), ["p_partkey"])
    return out.select("p_partkey", "problem", F.col("value").cast("string").alias("value"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN CAST(CAST(l_discount AS FLOAT) AS DOUBLE) = l_discount THEN l_discount END AS value, CASE WHEN CAST(CAST(l_discount AS FLOAT) AS DOUBLE) <> l_discount THEN 'range' END AS problem FROM lineitem")
def convert_float_narrow(spark, sf_dir):
    out = one(table(spark, sf_dir, "lineitem"), "l_discount", plan("l_discount", "double", "real", Kind.FLOAT), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.col("value").cast("double").alias("value"), "problem")


@query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000 = 0 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') END AS value, CASE WHEN epoch_us(ts) % 1000 <> 0 THEN 'field_overflow' END AS problem FROM events")
def convert_datetime_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    out = one(rows, "ts", plan("ts", "datetime(6)", "timestamp(3) without time zone", Kind.DATETIME), ["event_id"])
    return out.select("event_id", encode.field(F.col("value"), Kind.DATETIME).alias("value"), "problem")


SECONDS = "(CAST(event_id AS BIGINT) * 977 % 4000000)"


@query(f"""
WITH r AS (SELECT event_id, {SECONDS} AS s FROM events)
SELECT event_id, CASE WHEN s // 3600 <= 838 THEN (CASE WHEN event_id % 2 = 1 AND s > 0 THEN '-' ELSE '' END) || CASE WHEN s // 3600 < 100 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') ELSE CAST(s // 3600 AS VARCHAR) END
  || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '.250000' END AS value,
  CASE WHEN s // 3600 > 999 THEN 'datetime' WHEN s // 3600 > 838 THEN 'field_overflow' END AS problem FROM r""")
def convert_time_interval(spark, sf_dir):
    s = F.expr(SECONDS)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    raw = F.concat(F.when((F.col("event_id") % 2 == 1) & (s > 0), F.lit("-")).otherwise(F.lit("")), F.when(hours < 100, pad(hours)).otherwise(hours.cast("string")), F.lit(":"), pad(F.floor(s % 3600 / 60)), F.lit(":"), pad(s % 60), F.lit(".25"))
    out = one(table(spark, sf_dir, "events"), raw, plan("t", "time(6)", "interval(6)", Kind.INTERVAL), ["event_id"])
    return out.select("event_id", encode.interval_text(F.col("value")).alias("value"), "problem")


@query("SELECT p_partkey, CASE WHEN p_size < 32 THEN " + " || ".join(f"CAST((p_size >> {i}) & 1 AS VARCHAR)" for i in (4, 3, 2, 1, 0)) + " END AS value, CASE WHEN p_size >= 32 THEN 'range' END AS problem FROM part")
def convert_bit(spark, sf_dir):
    return one(table(spark, sf_dir, "part"), "p_size", plan("p_size", "bit(5)", "bit(5)", Kind.BIT, bits=5), ["p_partkey"]).drop("changed")


@query("SELECT doc_id, (quality + 2 * toxic) <> 0 AS value, (quality + 2 * toxic) NOT IN (0, 1) AS changed FROM labels")
def convert_boolean(spark, sf_dir):
    p = plan("flag", "tinyint(1)", "boolean", Kind.BOOLEAN, transform="tinyint-to-boolean")
    return one(table(spark, sf_dir, "labels"), F.col("quality") + 2 * F.col("toxic"), p, ["doc_id"]).drop("problem")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 7 BETWEEN 1 AND 5 THEN ({SEGMENTS})[CAST(c_custkey % 7 AS INTEGER)] END AS value, CASE WHEN c_custkey % 7 NOT BETWEEN 1 AND 5 THEN 'range' END AS problem FROM customer")
def convert_enum(spark, sf_dir):
    p = plan("segment", "enum", "enum", Kind.ENUM, enum_labels=SEGMENTS)
    return one(table(spark, sf_dir, "customer"), F.col("c_custkey") % 7, p, ["c_custkey"]).drop("changed")


@query("SELECT p_partkey, CASE WHEN p_size < 32 THEN array_to_string(list_filter(['a', 'b', 'c', 'd', 'e'], lambda x, i: (p_size >> CAST(i - 1 AS INTEGER)) & 1 = 1), '|') END AS value, CASE WHEN p_size >= 32 THEN 'range' END AS problem FROM part")
def convert_set_mask(spark, sf_dir):
    out = one(table(spark, sf_dir, "part"), "p_size", plan("flags", "set", "text[]", Kind.SET, set_labels=list("abcde"), transform="set-to-array"), ["p_partkey"])
    return out.select("p_partkey", F.array_join("value", "|").alias("value"), "problem")


@query("SELECT c_custkey, CAST((ip >> 24) & 255 AS VARCHAR) || '.' || CAST((ip >> 16) & 255 AS VARCHAR) || '.' || CAST((ip >> 8) & 255 AS VARCHAR) || '.' || CAST(ip & 255 AS VARCHAR) AS value FROM (SELECT c_custkey, c_custkey * 2654435 % 4294967296 AS ip FROM customer)")
def int_to_ip(spark, sf_dir):
    p = plan("ip", "int unsigned", "inet", Kind.TEXT, transform="int-to-ip")
    return one(table(spark, sf_dir, "customer"), F.col("c_custkey") * 2654435 % 4294967296, p, ["c_custkey"]).select("c_custkey", "value")


@query(r"SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 2 THEN '\x' || lower(hex(encode(n_name))) END AS value, CASE WHEN n_nationkey % 3 = 2 THEN 'format' END AS problem FROM nation")
def hex_to_bytea(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    raw = F.concat(F.when(k == 0, F.lit("0x")).when(k == 1, F.lit("\\x")).otherwise(F.lit("f")), F.hex("n_name"))
    out = one(table(spark, sf_dir, "nation"), raw, plan("h", "varchar(255)", "bytea", Kind.BINARY, transform="hex-to-bytea"), ["n_nationkey"])
    return out.select("n_nationkey", bytea_text(F.col("value")).alias("value"), "problem")


@query("SELECT * FROM (VALUES " + ", ".join(f"({b}, {ord(bytes([b]).decode('cp1252', 'ignore') or chr(b))})" for b in range(256)) + ") t(byte, code_point)")
def charset_cp1252(spark, sf_dir):
    rows = spark.range(256).select(F.col("id").cast("int").alias("byte"))
    shown, _ = text.decode(F.unhex(F.lpad(F.hex(F.col("byte").cast("long")), 2, "0")), "latin1")
    return rows.select("byte", F.conv(F.hex(F.encode(shown, "UTF-16BE")), 16, 10).cast("int").alias("code_point"))


BLANKS = "CASE WHEN doc_id % 7 = 0 THEN text || '  ' WHEN doc_id % 7 = 1 THEN text || chr(9) || chr(10) ELSE text END"


@query("SELECT doc_id, md5(text) AS value_md5, doc_id % 7 IN (0, 1) AS changed FROM documents")
def right_trim(spark, sf_dir):
    out = one(table(spark, sf_dir, "documents"), F.expr(BLANKS), plan("t", "text", "text", Kind.TEXT, transform="right-trim"), ["doc_id"])
    return out.select("doc_id", F.md5("value").alias("value_md5"), "changed")


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS value, doc_id % 5 = 0 AS changed FROM documents")
def empty_to_null(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("lang"))
    return one(table(spark, sf_dir, "documents"), raw, plan("l", "varchar(8)", "varchar(8)", Kind.TEXT, transform="empty-string-to-null"), ["doc_id"]).drop("problem")


@query("SELECT doc_id, source AS value, doc_id % 4 = 0 AS changed FROM documents")
def remove_nul(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.substring("source", 1, 2), F.lit("\0"), F.expr("substring(source, 3)"))).otherwise(F.col("source"))
    return one(table(spark, sf_dir, "documents"), raw, plan("s", "text", "text", Kind.TEXT, transform="remove-null-characters"), ["doc_id"]).drop("problem")


def _dates(spark, sf_dir, transform, nullable=True):
    k = F.col("o_orderkey") % 9
    raw = F.when(k == 0, F.lit("0000-00-00")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-'00'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = one(table(spark, sf_dir, "orders"), raw, plan("d", "date", "date", Kind.DATE, transform=transform, nullable=nullable), ["o_orderkey"])
    return out.withColumn("value", encode.field(F.col("value"), Kind.DATE))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value, CAST(NULL AS VARCHAR) AS problem, o_orderkey % 9 < 2 AS changed FROM orders")
def zero_dates_to_null(spark, sf_dir):
    return _dates(spark, sf_dir, "zero-dates-to-null")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '1970-01-01' WHEN o_orderkey % 9 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value, CASE WHEN o_orderkey % 9 = 1 THEN 'field_overflow' END AS problem, o_orderkey % 9 = 0 AS changed FROM orders")
def zero_dates_to_epoch(spark, sf_dir):
    return _dates(spark, sf_dir, "zero-dates-to-epoch")


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN props || ',' WHEN event_id % 6 = 1 THEN replace(props, ':', '=') ELSE props END AS doc FROM events)
SELECT event_id % 6 AS variant, count(*) AS n_rows, count(*) FILTER (json_valid(doc)) AS n_valid FROM r GROUP BY 1""")
def json_validate(spark, sf_dir):
    k = F.col("event_id") % 6
    doc = F.when(k == 0, F.concat("props", F.lit(","))).when(k == 1, F.replace(F.col("props"), F.lit(":"), F.lit("="))).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(k.alias("variant"), is_json(doc).alias("ok"))
    return rows.groupBy("variant").agg(F.count("*").alias("n_rows"), F.count_if("ok").alias("n_valid"))


@query("SELECT s_suppkey, 'SRID=' || CAST(s_nationkey AS VARCHAR) || ';POINT(' || CAST(s_suppkey AS VARCHAR) || ' 2)' AS value, CASE WHEN s_suppkey % 4 = 0 THEN 'format' END AS problem FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, NULL, 'format' FROM supplier WHERE s_suppkey % 4 = 0")
def convert_geometry(spark, sf_dir):
    shape = F.concat(F.lit(";POINT("), F.col("s_suppkey").cast("string"), F.lit(" 2)"))
    raw = F.concat(F.when(F.col("s_suppkey") % 4 == 0, F.lit("SRID=x")).otherwise(F.concat(F.lit("SRID="), F.col("s_nationkey").cast("string"))), shape)
    return one(table(spark, sf_dir, "supplier"), raw, plan("g", "point", "geometry", Kind.GEOMETRY), ["s_suppkey"]).drop("changed")


COPY = r"replace(replace(replace(replace(x, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')"


@query(rf"""
WITH r AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN n_name || chr(9) || '\' || chr(10) ELSE n_name END AS x FROM nation)
SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || chr(9) || coalesce({COPY}, '\N') || chr(10) AS line, strlen(CAST(n_nationkey AS VARCHAR) || chr(9) || coalesce({COPY}, '\N') || chr(10)) AS n_bytes FROM r""")
def copy_text_encode(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    x = F.when(k == 1, F.concat("n_name", F.lit("\t\\\n"))).when(k != 0, F.col("n_name"))
    line = encode.row_text([F.col("n_nationkey").cast("string"), x])
    return table(spark, sf_dir, "nation").select("n_nationkey", line.alias("line"), n(F.octet_length(line)).alias("n_bytes"))


@query("""SELECT p_partkey, CASE WHEN p_size < 16 THEN '{' || array_to_string(list_filter(['"a"', '"b\\"c"', '"d\\\\e"', '"f"'], lambda x, i: (p_size >> CAST(i - 1 AS INTEGER)) & 1 = 1), ',') || '}' END AS value FROM part""")
def array_text(spark, sf_dir):
    out = one(table(spark, sf_dir, "part"), "p_size", plan("s", "set", "text[]", Kind.SET, set_labels=["a", 'b"c', "d\\e", "f"]), ["p_partkey"])
    return out.select("p_partkey", encode.array_text(F.col("value")).alias("value"))


# Load and reject accounting


def documents_plan() -> TablePlan:
    return TablePlan("t_documents", "documents", "app", "documents", [
        plan("doc_id", "bigint", "bigint", Kind.SIGNED, nullable=False), plan("text", "text", "text", Kind.TEXT, transform="right-trim"),
        plan("lang", "varchar(8)", "varchar(8)", Kind.TEXT, transform="empty-string-to-null"), plan("source", "text", "text", Kind.TEXT, transform="remove-null-characters")])


@query("""
SELECT 'text' AS column_name, count(*) FILTER (doc_id % 7 IN (0, 1)) AS n_changed FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (doc_id % 5 = 0) FROM documents UNION ALL SELECT 'source', count(*) FILTER (doc_id % 4 = 0) FROM documents""")
def transformation_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nul = F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("\0"))).otherwise(F.col("source"))
    rows = d.select("doc_id", F.expr(BLANKS).alias("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("lang")).alias("lang"), nul.alias("source"))
    made = load.converted(rows, documents_plan())
    return made.select(F.explode(load.CHANGED).alias("column_name")).groupBy("column_name").agg(F.count("*").alias("n_changed"))


def lineitem_plan() -> TablePlan:
    return TablePlan("t_lineitem", "lineitem", "app", "lineitem", [
        plan("l_orderkey", "int unsigned", "bigint", Kind.UNSIGNED, nullable=False), plan("l_quantity", "decimal(3,1)", "numeric(3,1)", Kind.DECIMAL, nullable=False),
        plan("l_returnflag", "varchar(1)", "varchar(1)", Kind.TEXT), plan("l_shipdate", "datetime", "timestamp(0) without time zone", Kind.DATETIME)])


def dirty_lineitem(spark, sf_dir) -> DataFrame:
    k = F.col("l_orderkey") % 10
    return table(spark, sf_dir, "lineitem").select(
        F.when(k == 1, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("l_orderkey"),
        F.when(k != 2, F.when(k == 3, F.lit("12.25")).otherwise(F.col("l_quantity").cast("decimal(3,1)").cast("string"))).alias("l_quantity"),
        F.when(k == 4, F.lit("RR")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(k == 5, F.lit("2024-02-30 00:00:00")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("l_shipdate"),
    )


@query("""
SELECT reason, count(*) AS n_rows FROM (SELECT CASE l_orderkey % 10 WHEN 1 THEN 'l_orderkey: range' WHEN 2 THEN 'l_quantity: not_null' WHEN 3 THEN 'l_quantity: range'
  WHEN 4 THEN 'l_returnflag: length' WHEN 5 THEN 'l_shipdate: field_overflow' ELSE 'good' END AS reason FROM lineitem) GROUP BY reason""")
def reject_split(spark, sf_dir):
    made = load.converted(dirty_lineitem(spark, sf_dir), lineitem_plan())
    return made.groupBy(F.coalesce(F.get(load.PROBLEMS, 0), F.lit("good")).alias("reason")).agg(F.count("*").alias("n_rows"))


@query("SELECT count(*) AS rows_read, count(*) FILTER (l_orderkey % 10 NOT BETWEEN 1 AND 5) AS committed_rows, count(*) FILTER (l_orderkey % 10 BETWEEN 1 AND 5) AS rejected_rows FROM lineitem")
def row_accounting(spark, sf_dir):
    made = load.converted(dirty_lineitem(spark, sf_dir), lineitem_plan())
    ok = F.size(load.PROBLEMS) == 0
    return made.agg(F.count("*").alias("rows_read"), F.count_if(ok).alias("committed_rows"), F.count_if(~ok).alias("rejected_rows"))


@query("SELECT event_id % 10 AS bucket, count(*) FILTER (strlen(props) + strlen(event_type) + 32 > 80) AS n_too_large FROM events GROUP BY 1")
def row_size_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("bad", load.size_problem(rows.select("props", "event_type"), 80)).groupBy((F.col("event_id") % 10).alias("bucket")).agg(F.count_if(F.col("bad").isNotNull()).alias("n_too_large"))


@query("""
SELECT count(*) FILTER (rn = 1) AS n_kept, count(*) FILTER (rn > 1) AS n_duplicates, CAST(sum(CASE WHEN rn = 1 THEN ord END) AS BIGINT) AS kept_ordinals
FROM (SELECT ord, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ord) AS rn FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 + l_partkey % 10000 AS ord FROM lineitem))""")
def duplicate_key_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n(n(F.round(F.col("l_extendedprice") * 100)) * 10000 + F.col("l_partkey") % 10000).alias("ord"))
    kept, late = load.first_wins(rows, ["l_orderkey", "l_linenumber"], "ord")
    both = kept.withColumn("kept", F.lit(True)).unionAll(late.withColumn("kept", F.lit(False)))
    return both.agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_duplicates"), F.sum(F.when(F.col("kept"), F.col("ord"))).alias("kept_ordinals"))


# Keys, foreign keys, checks and sequences


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return constraints.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, count(*) AS n_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) GROUP BY l_orderkey")
def fk_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 3")
    return constraints.fk_orphans(table(spark, sf_dir, "lineitem"), ["l_orderkey"], parents, ["o_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n_rows"))


@query("SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE NOT coalesce(l_quantity <= 45 AND l_discount < 0.09, true) GROUP BY l_returnflag")
def check_violations(spark, sf_dir):
    bad = constraints.check_violations(table(spark, sf_dir, "lineitem"), "l_quantity <= 45 AND l_discount < 0.09")
    return bad.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"))


@query("SELECT p_partkey FROM part WHERE p_size < 32 AND (p_size & 24) <> 0")
def set_membership(spark, sf_dir):
    out = one(table(spark, sf_dir, "part"), "p_size", plan("s", "set", "text[]", Kind.SET, set_labels=list("abcde")), ["p_partkey"]).where("problem IS NULL")
    return constraints.set_violations(out, "value", ["a", "b", "c"]).select("p_partkey")


@query("SELECT CAST(greatest(42, max(o_orderkey) + 1, 1) AS BIGINT) AS next_value FROM orders")
def identity_floor(spark, sf_dir):
    return spark.createDataFrame([(constraints.sequence_floor(table(spark, sf_dir, "orders"), "o_orderkey", 42),)], "next_value long")


# Multisets and content


FACTS = "SELECT o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 10000) AS INTEGER) AS band FROM orders"


@query(f"""
WITH s AS ({FACTS}), t AS ({FACTS} WHERE o_orderkey % 100 <> 7 UNION ALL {FACTS} WHERE o_orderkey % 100 = 8)
SELECT (SELECT count(*) FROM (FROM s EXCEPT ALL FROM t)) + (SELECT count(*) FROM (FROM t EXCEPT ALL FROM s)) = 0 AS equal, (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows""")
def multiset_equal(spark, sf_dir):
    s, t = _two(spark, sf_dir)
    return spark.createDataFrame([multiset.multiset_equal(s, t)], "equal boolean, source_rows long, target_rows long")


def _two(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 10000).cast("int").alias("band"))
    k = F.col("o_orderkey") % 100
    return rows.drop("o_orderkey"), rows.where(k != 7).unionAll(rows.where(k == 8)).drop("o_orderkey")


@query(f"""
WITH s AS ({FACTS}), t AS ({FACTS} WHERE o_orderkey % 100 <> 7 UNION ALL {FACTS} WHERE o_orderkey % 100 = 8)
SELECT o_orderstatus, o_orderpriority, band, CAST(sum(d) AS BIGINT) AS surplus FROM (SELECT *, 1 AS d FROM s UNION ALL SELECT *, -1 FROM t) GROUP BY ALL HAVING sum(d) <> 0""")
def multiset_diff(spark, sf_dir):
    return multiset.multiset_diff(*_two(spark, sf_dir))


@query("SELECT count(*) = 0 AS equal, (SELECT count(*) FROM orders) AS expected_rows FROM ((FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) EXCEPT ALL SELECT o_orderkey FROM orders))")
def append_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    c = multiset.compare_content(rows.where("o_orderkey % 3 <> 0"), rows, [plan("o_orderkey", "bigint", "bigint", Kind.SIGNED)], rows.where("o_orderkey % 3 = 0"))
    return spark.createDataFrame([(c.status == "complete", c.source_rows)], "equal boolean, expected_rows long")


@query("""
WITH r AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS x FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '0' ELSE regexp_replace(regexp_replace(x, '0+$', ''), '[.]$', '') END AS value FROM r""")
def canonical_decimals(spark, sf_dir):
    x = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    k = F.col("p_partkey")
    raw = F.when(k % 50 == 0, F.lit("-00.000")).when(k % 2 == 0, F.concat(F.lit("+00"), x)).otherwise(F.concat(x, F.lit("000")))
    return table(spark, sf_dir, "part").select("p_partkey", canonical_decimal(raw).alias("value"))


FRAME = "'{tag}01' || format('{{:016X}}', strlen({x})) || hex(encode({x}))"


def _digest_sql(table: str, key: str, name: str) -> str:
    shown = FRAME.format(tag="01", x=f"CAST({key} AS VARCHAR)") + " || " + FRAME.format(tag="04", x=name)
    return f"SELECT '{table}' AS table_name, CAST({key} AS BIGINT) AS key, sha256(unhex({shown})) AS digest FROM {table}"


@query(_digest_sql("region", "r_regionkey", "r_name") + " UNION ALL " + _digest_sql("nation", "n_nationkey", "n_name"))
def canonical_row_digest(spark, sf_dir):
    def of(name, key, label):
        d = multiset.row_digest([(Kind.SIGNED, F.col(key).cast("string")), (Kind.TEXT, F.col(label))])
        return table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), n(F.col(key)).alias("key"), d.alias("digest"))

    return of("region", "r_regionkey", "r_name").unionAll(of("nation", "n_nationkey", "n_name"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns" for t in TABLES))
def counts_and_schema(spark, sf_dir):
    out = None
    for t in TABLES:
        rows = table(spark, sf_dir, t)
        one_row = rows.agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"), n(F.lit(len(rows.columns))).alias("n_columns"))
        out = one_row if out is None else out.unionAll(one_row)
    return out


@query("SELECT doc_id, lang FROM documents WHERE list_contains(regexp_split_to_array(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), 'license')")
def fulltext_term(spark, sf_dir):
    return fulltext.matching(table(spark, sf_dir, "documents"), ["source", "text"], "License").select("doc_id", "lang")


@query("WITH RECURSIVE r AS (SELECT 0 AS node UNION SELECT e.child FROM r JOIN (SELECT n_nationkey AS parent, (n_nationkey * 7 + 3) % 25 AS child FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation) e ON e.parent = r.node) SELECT CAST(node AS BIGINT) AS node FROM r")
def dependency_closure(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(n(F.col("n_nationkey")).alias("parent"), n(F.col("n_regionkey")).alias("region"))
    edges = nation.select("parent", ((F.col("parent") * 7 + 3) % 25).alias("child")).unionAll(nation.select("parent", F.col("region").alias("child")))
    return closure.closure(spark.range(1).select(F.col("id").alias("node")), edges)


@query("SELECT count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS sum_key, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, CAST(sum(strlen(l_returnflag) + strlen(l_linestatus)) AS BIGINT) AS text_bytes FROM lineitem")
def benchmark_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("sum_key"), F.min("l_orderkey").alias("min_key"), F.max("l_orderkey").alias("max_key"),
        n(F.sum(F.octet_length("l_returnflag") + F.octet_length("l_linestatus"))).alias("text_bytes"),
    )


# Catalogue joins


def sample_catalog() -> SourceCatalog:
    from keelson.plans.model import IndexPart, SourceCheck, SourceForeignKey

    c = lambda name, i, kind, full, **more: SourceColumn(name, i, kind, full, **more)
    return SourceCatalog("shop", [
        SourceTable("orders", [c("o_orderkey", 1, "bigint", "bigint unsigned", nullable=False), c("o_custkey", 2, "bigint", "bigint")], indexes=[SourceIndex("PRIMARY", [IndexPart("o_orderkey")], primary=True)]),
        SourceTable("lineitem", [c("l_orderkey", 1, "bigint", "bigint unsigned", nullable=False), c("l_linenumber", 2, "int", "int", nullable=False)],
                    indexes=[SourceIndex("u_line", [IndexPart("l_orderkey"), IndexPart("l_linenumber")], unique=True)],
                    foreign_keys=[SourceForeignKey("fk_order", ["l_orderkey"], "shop", "orders", ["o_orderkey"])], checks=[SourceCheck("positive", "l_linenumber > 0")])])


@query("SELECT * FROM (VALUES ('lineitem', 'fk_order', 'l_orderkey', 'orders', 'o_orderkey', true)) t(table_name, constraint_name, column_name, referenced_table, referenced_column, parent_is_key)")
def catalog_joins(spark, sf_dir):
    """Foreign key parts with whether the parent column is in a unique key; inner and left joins over flat facts."""
    from keelson.sources.catalog import facts

    f = facts(spark, sample_catalog())
    keys = f["index_parts"].where("is_unique").select(F.col("table_name").alias("referenced_table"), F.col("column_name").alias("referenced_column"), F.lit(True).alias("known"))
    out = f["fk_parts"].join(f["tables"].select("table_name"), "table_name").join(keys, ["referenced_table", "referenced_column"], "left")
    return out.select("table_name", "constraint_name", "column_name", "referenced_table", "referenced_column", F.coalesce("known", F.lit(False)).alias("parent_is_key"))


# The flagship: plan, convert, split, compare


def orders_slice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TablePlan]:
    """Orders staged as a source would give them, and their resolved plan."""
    from keelson.plans.planner import build
    from keelson.plans.target import Namespace, TargetCatalog
    from keelson.sources.config import Config, Source, Target

    columns = [
        SourceColumn("o_orderkey", 1, "bigint", "bigint unsigned", nullable=False), SourceColumn("o_totalprice", 2, "decimal", "decimal(15,2)", numeric_precision=15, numeric_scale=2),
        SourceColumn("o_orderdate", 3, "datetime", "datetime(6)", datetime_precision=6), SourceColumn("o_orderstatus", 4, "enum", "enum('F','O','P')", charset="ascii"),
    ]
    from keelson.plans.model import IndexPart

    source = SourceCatalog("shop", [SourceTable("orders", columns, indexes=[SourceIndex("PRIMARY", [IndexPart("o_orderkey")], primary=True)])])
    made = build(Config(1, Source("A", consistency="frozen"), Target("B", schema="app")), source, TargetCatalog(namespaces=[Namespace("app", True)]))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("o_orderdate"),
        F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return rows, made.tables[0]


@query("SELECT count(*) AS rows_read, count(*) AS committed_rows, CAST(0 AS BIGINT) AS rejected_rows, true AS equal FROM orders")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row of the migration of orders: converted, split, and compared with the original values as multisets."""
    rows, p = orders_slice(spark, sf_dir)
    made = load.converted(rows, p)
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("decimal(20,0)").alias("o_orderkey"), F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderstatus")
    # one conversion gives the accounts and one side of the comparison: rejected rows are told by their problems
    names = [c.target_name for c in p.copied]
    ours = made.select(*names, (F.size(load.PROBLEMS) > 0).alias("bad"), F.lit(1).alias("n"))
    both = ours.unionAll(truth.select(*names, F.lit(False), F.lit(-1)))
    groups = both.groupBy(*names, "bad").agg(F.sum("n").alias("surplus"), F.count_if(F.col("n") == 1).alias("n_read"))
    read = n(F.coalesce(F.sum("n_read"), F.lit(0)))
    bad = n(F.coalesce(F.sum(F.when(F.col("bad"), F.col("n_read"))), F.lit(0)))
    equal = F.count_if(~F.col("bad") & (F.col("surplus") != 0)) == 0
    return groups.agg(read.alias("rows_read"), (read - bad).alias("committed_rows"), bad.alias("rejected_rows"), equal.alias("equal"))


# Plans, keys and reports as tables


def values(spark: SparkSession, kind: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, kind)


TYPES = [
    ("tinyint", "tinyint", {}, "smallint"), ("smallint", "smallint unsigned", {}, "integer"), ("mediumint", "mediumint", {}, "integer"), ("int", "int unsigned", {}, "bigint"), ("bigint", "bigint unsigned", {}, "numeric(20,0)"),
    ("decimal", "decimal(65,30)", {"numeric_precision": 65, "numeric_scale": 30}, "numeric(65,30)"), ("float", "float", {}, "real"), ("varchar", "varchar(20)", {"character_length": 20}, "varchar(20)"), ("longtext", "longtext", {}, "text"),
    ("varbinary", "varbinary(9)", {}, "bytea"), ("datetime", "datetime(3)", {"datetime_precision": 3}, "timestamp(3) without time zone"), ("timestamp", "timestamp", {}, "timestamptz(0)"), ("time", "time(6)", {"datetime_precision": 6}, "interval(6)"),
    ("year", "year", {}, "smallint"), ("bit", "bit(12)", {}, "bit(12)"), ("json", "json", {}, "jsonb"), ("set", "set('a')", {}, "text[]"), ("point", "point", {}, "geometry"), ("odd", "odd", {}, None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"""('{k}', '{full.replace("'", "''")}', {"NULL" if t is None else repr(t)})""" for k, full, _, t in TYPES) + ") t(data_type, column_type, target_type)")
def type_mapping(spark, sf_dir):
    from keelson.plans.types import default_type

    found = [(k, full, (default_type(SourceColumn("c", 1, k, full, **more)) or (None,))[0]) for k, full, more, _ in TYPES]
    return values(spark, "data_type string, column_type string, target_type string", found)


@query("SELECT * FROM (VALUES ('int4', 'integer'), ('numeric(20)', 'numeric(20,0)'), ('character varying(5)', 'varchar(5)'), ('timestamp(3) with time zone', 'timestamptz(3)'), ('int8[]', 'bigint[]'), ('varchar(0)', NULL), ('other', NULL)) t(name, normal)")
def type_normaliser(spark, sf_dir):
    from keelson.plans.types import normalise

    names = ["int4", "numeric(20)", "character varying(5)", "timestamp(3) with time zone", "int8[]", "varchar(0)", "other"]
    return values(spark, "name string, normal string", [(x, normalise(x)) for x in names])


@query("SELECT * FROM (VALUES ('a', 9, 0, 'integer'), ('b', 10, 0, 'bigint'), ('c', 18, 2, 'numeric(18,2)'), ('d', 30, 2, 'text')) t(column_name, digits, places, target_type)")
def cast_rule_matching(spark, sf_dir):
    """The first rule whose guards hold wins; without one the default mapping applies."""
    from keelson.plans.planner import matches
    from keelson.plans.types import default_type
    from keelson.sources.config import Cast, Guard

    rules = [Cast("decimal", precision=Guard("le", 9), scale=Guard("eq", 0), target_type="integer"), Cast("numeric", scale=Guard("lt", 1), target_type="bigint"), Cast("dec", precision=Guard("gt", 20), target_type="text")]
    columns = [SourceColumn(n, i, "decimal", "decimal", numeric_precision=p, numeric_scale=s) for i, (n, p, s) in enumerate([("a", 9, 0), ("b", 10, 0), ("c", 18, 2), ("d", 30, 2)])]
    pick = lambda c: next((r.target_type for r in rules if matches(r, "t", c)), None) or default_type(c)[0]
    return values(spark, "column_name string, digits int, places int, target_type string", [(c.name, c.numeric_precision, c.numeric_scale, pick(c)) for c in columns])


@query("SELECT * FROM (VALUES ('absent'), ('gone')) t(name)")
def selection_missing(spark, sf_dir):
    """Configured names that the catalogue lacks, as the planner tells them."""
    from keelson.plans.planner import Blocked, build
    from keelson.plans.target import Namespace, TargetCatalog
    from keelson.sources.config import Config, Source, Tables, Target

    c = Config(1, Source("A", consistency="frozen"), Target("B", schema="app"), tables=Tables(["orders", "absent", "users", "gone"]))
    columns = [SourceColumn("id", 1, "int", "int")]
    try:
        build(c, SourceCatalog("db", [SourceTable(x, columns) for x in NAMES]), TargetCatalog(namespaces=[Namespace("app", True)]))
        said = []
    except Blocked as e:
        said = e.diagnostics
    return values(spark, "name string", [(d.object,) for d in said if d.code == "SOURCE_TABLE_MISSING"])


@query("SELECT * FROM (VALUES ('u_line', 1, 'l_orderkey'), ('u_line', 2, 'l_linenumber')) t(index_name, position, column_name)")
def key_parts_in_order(spark, sf_dir):
    """Key arrays to ordered rows."""
    rows = values(spark, "index_name string, keys array<string>", [(i.name, [p.column for p in i.parts]) for t in sample_catalog().tables for i in t.indexes if not i.primary])
    return rows.select("index_name", F.posexplode("keys").alias("at", "column_name")).select("index_name", (F.col("at") + 1).alias("position"), "column_name")


@query("SELECT n_name, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS has_rich FROM nation")
def catalog_semi_anti(spark, sf_dir):
    """EXISTS and NOT EXISTS as semi and anti joins."""
    nation, rich = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    yes = nation.join(rich, "n_nationkey", "left_semi").select("n_name", F.lit(True).alias("has_rich"))
    return yes.unionAll(nation.join(rich, "n_nationkey", "left_anti").select("n_name", F.lit(False).alias("has_rich")))


@query("SELECT o_orderpriority, count(*) AS n_rows FROM (SELECT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def multiset_union(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    both = multiset.multiset_union(rows.where("o_orderkey % 2 = 0").select("o_orderpriority"), rows.where("o_orderkey % 3 = 0").select("o_orderpriority"))
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"))


@query("SELECT * FROM (VALUES (0, 'prepare', 'CREATE TABLE'), (1, 'prepare', 'CREATE TABLE'), (2, 'finalize', 'ALTER TABLE'), (3, 'finalize', 'CREATE UNIQUE'), (4, 'finalize', 'ALTER TABLE')) t(step, phase, statement)")
def ddl_order(spark, sf_dir):
    """The target's statements: tables, keys and indexes, then foreign keys."""
    from keelson.plans.planner import build
    from keelson.plans.target import Namespace, TargetCatalog
    from keelson.sources.config import Config, Override, Source, Target

    c = Config(1, Source("A", consistency="frozen"), Target("B", schema="app"), overrides=[Override("shop.lineitem.positive", omit=True)])
    made = build(c, sample_catalog(), TargetCatalog(namespaces=[Namespace("app", True)]))
    return values(spark, "step int, phase string, statement string", [(i, str(d.phase), " ".join(d.sql.split()[:2])) for i, d in enumerate(made.ddl)])


@query("SELECT * FROM (VALUES ('all well', 0), ('rejected rows', 3), ('different content', 4), ('cancelled', 130), ('lost rows', 1)) t(outcome, exit_code)")
def exit_codes(spark, sf_dir):
    from keelson.plans.model import RunReport, Status, TableReport, VerificationReport, Verified

    def report(status=Status.COMPLETE, verified=Verified.COMPLETE, **t):
        rows = TableReport("t", "s", "a", "b", Status.COMPLETE, **{"rows_read": 2, "committed_rows": 2, **t})
        return RunReport("r", "frozen", "full", VerificationReport("content", verified, 1), status, tables=[rows]).exit_code()

    rows = [("all well", report()), ("rejected rows", report(committed_rows=1, rejected_rows=1)), ("different content", report(verified=Verified.DIFFERENT)), ("cancelled", report(Status.CANCELLED)), ("lost rows", report(committed_rows=1))]
    return values(spark, "outcome string, exit_code int", rows)


@query(r"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) FILTER (p IS NULL) AS n_bad FROM r""")
def not_null_policy(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    out = one(table(spark, sf_dir, "orders"), raw, plan("p", "double", "double precision", Kind.FLOAT, nullable=False), ["o_orderkey"])
    return out.agg(F.count("*").alias("n_rows"), F.count_if(F.col("problem") == "not_null").alias("n_bad"))


@query("SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') || '+00' AS value FROM events")
def convert_timestamp_utc(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    out = one(rows, "ts", plan("ts", "timestamp(6)", "timestamptz(6)", Kind.TIMESTAMP), ["event_id"])
    return out.select("event_id", encode.field(F.col("value"), Kind.TIMESTAMP).alias("value"))


@query("SELECT n_nationkey, lower(hex(encode(n_name))) AS value FROM nation")
def convert_binary(spark, sf_dir):
    out = one(table(spark, sf_dir, "nation"), F.col("n_name").cast("binary"), plan("b", "blob", "bytea", Kind.BINARY, transform="binary-to-bytea"), ["n_nationkey"])
    return out.select("n_nationkey", F.lower(F.hex("value")).alias("value"))


@query("SELECT doc_id, length(lang) > 1 AS is_long, CASE WHEN length(source) > 4 THEN 'length' END AS problem FROM documents")
def text_length_check(spark, sf_dir):
    out = one(table(spark, sf_dir, "documents"), "source", plan("s", "varchar(4)", "varchar(4)", Kind.TEXT), ["doc_id", "lang"])
    return out.select("doc_id", (F.char_length("lang") > 1).alias("is_long"), "problem")
