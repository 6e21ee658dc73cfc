"""Reading from and writing to database servers by Spark's JDBC source.

No server or driver is at hand where this is tested: statements, options and partition predicates are, and reading through a
reader that stands in for Spark's.
"""

from __future__ import annotations

import os
import re
import stat
import time
from collections.abc import Callable
from urllib.parse import unquote, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import encode
from keelson.operators import ranges
from keelson.plans.model import ColumnPlan, Diagnostic, Kind, Severity, SourceCatalog, SourceColumn, SourceTable, TablePlan
from keelson.plans.names import spark_quote
from keelson.sources.config import Config, Endpoint


class ServerRefused(ValueError):
    pass


def check_server(version: str, comment: str) -> tuple[int, int]:
    """Only the maker's own community or enterprise servers of 5.7, 8.0 and 8.4."""
    m = re.match(r"(\d+)\.(\d+)(?:\.\d+)?(?:[-+]|\Z)", version)
    found = (int(m[1]), int(m[2])) if m else None
    text = comment.lower()
    if "mysql" not in text or not ("community" in text or "enterprise" in text) or "mariadb" in (version + comment).lower() or "percona" in text:
        raise ServerRefused("another maker's server")
    if found not in ((5, 7), (8, 0), (8, 4)):
        raise ServerRefused(f"version {version} isn't supported")
    return found


def projection(columns: list[SourceColumn]) -> list[str]:
    """Select items that keep values exact: ordinals and masks of labels, bytes of text, shapes as text with their reference system."""
    out = []
    for c in columns:
        q, kind = spark_quote(c.name), c.data_type.lower()
        if kind in ("enum", "set"):
            out.append(f"CAST({q} AS UNSIGNED) AS {q}")
        elif kind in ("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection"):
            out.append(f"CONCAT('SRID=', ST_SRID({q}), ';', ST_AsText({q})) AS {q}")
        elif c.charset is not None:
            out.append(f"CAST({q} AS BINARY) AS {q}")
        else:
            out.append(q)
    return out


def select_sql(database: str, table: str, columns: list[SourceColumn], where: str = "") -> str:
    tail = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(projection(columns))} FROM {spark_quote(database)}.{spark_quote(table)}{tail}"


#: Key stores that the source's driver reads, by the ending of their names.
STORES = {".p12": "PKCS12", ".pfx": "PKCS12", ".jks": "JKS"}


def _store(path: str) -> tuple[str, str]:
    kind = STORES.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ServerRefused(f"{os.path.basename(path)}: the source's driver reads certificates from .p12, .pfx or .jks files")
    return f"file:{path}", kind


def _source_tls(e: Endpoint) -> dict[str, str]:
    if e.tls_mode != "verify_full":
        return {"sslMode": "DISABLED"}
    out = {"sslMode": "VERIFY_IDENTITY"}
    for path, name in ((e.ca_file, "trust"), (e.client_cert, "client")):
        if path:
            out[f"{name}CertificateKeyStoreUrl"], out[f"{name}CertificateKeyStoreType"] = _store(path)
    return out


def packet_bytes(max_row_bytes: int) -> int:
    """A row's bound and 64 KiB, from 1 KiB to 1 GiB."""
    return min(max(max_row_bytes + (64 << 10), 1 << 10), 1 << 30)


def read_options(url: str, config: Config) -> dict[str, str]:
    """Options of the reader: address, encryption, ten seconds to connect, UTC session, packet limit."""
    u = urlsplit(url)
    session = {"time_zone": "+00:00", **config.source.session}
    given = ", ".join(f"SESSION {k} = {v if v.isdigit() else repr(v)}" for k, v in sorted(session.items()))
    more = {
        **_source_tls(config.source), "connectTimeout": "10000", "maxAllowedPacket": str(packet_bytes(config.migration.max_row_bytes)),
        "zeroDateTimeBehavior": "ROUND", "tinyInt1isBit": "false", "yearIsDateType": "false", "useCursorFetch": "true",
    }
    return {
        "url": f"jdbc:mysql://{u.hostname}:{u.port or 3306}{u.path}?{urlencode(more)}",
        "user": unquote(u.username or ""), "password": unquote(u.password or ""), "sessionInitStatement": f"SET {given}", "fetchsize": str(config.migration.batch_rows),
    }


Query = Callable[[str], DataFrame]


def reader(spark: SparkSession, options: dict[str, str]) -> Query:
    """A query of the server as a DataFrame."""
    return lambda text: spark.read.format("jdbc").options(**options).option("query", text).load()


def table_reader(spark: SparkSession, options: dict[str, str]) -> Callable[[str, list[str]], DataFrame]:
    """A query as a table with a partition for each predicate, in one scan; in one partition without any."""
    known = {k: v for k, v in options.items() if k != "url"}

    def read(query: str, predicates: list[str]) -> DataFrame:
        return spark.read.jdbc(options["url"], f"({query}) AS source_rows", predicates=predicates or ["1 = 1"], properties=known)

    return read


def scan(query: Query, read: Callable[[str, list[str]], DataFrame], database: str, table: TablePlan, source: SourceTable, readers: int, span: int | None) -> tuple[DataFrame, list[Diagnostic]]:
    """A table's rows in one scan: by closed ranges of its key where several readers are asked for and the key allows it, else whole, with a warning.

    Ranges are predicates of partitions, so the server's key index serves each, and Spark decides when each is read.
    """
    columns = [c for c in source.columns if any(p.source_name == c.name for p in table.copied)]
    text = select_sql(database, source.name, columns)
    if readers < 2:
        return read(text, []), []
    key, bounds = ranges.range_key(table, source), None
    if key is not None:
        low, high = query(bounds_sql(database, source.name, key.source_name)).first()
        bounds = None if low is None else (ranges.Bound(int(low), key.kind == Kind.UNSIGNED), ranges.Bound(int(high), key.kind == Kind.UNSIGNED))
    parts = list(ranges.integer_ranges(*bounds, span)) if bounds else []
    if len(parts) < 2:
        why = "no single non-null integer primary key" if key is None else "empty table" if not bounds else "a single range"
        return read(text, []), [Diagnostic("RANGE_FALLBACK", table.source_name, f"full scan: {why}", Severity.WARNING, "copy")]
    return read(text, ranges.jdbc_predicates(key.source_name, iter(parts))), []


def source_tables(spark: SparkSession, url: str, config: Config, catalog: SourceCatalog, say: Callable[[Diagnostic], None]) -> Callable[[TablePlan], DataFrame]:
    """What a run reads its tables with."""
    options, m = read_options(url, config), config.migration
    known = {t.name: t for t in catalog.tables}

    def rows(table: TablePlan) -> DataFrame:
        made, said = scan(reader(spark, options), table_reader(spark, options), catalog.database, table, known[table.source_name], m.readers_per_table, m.max_key_span)
        for d in said:
            say(d)
        return made

    return rows


def write_columns(table: TablePlan) -> list[tuple[str, object]]:
    """(column, expression) to give the target what its driver takes as text."""

    def one(c: ColumnPlan):
        value = F.col(spark_quote(c.target_name))
        return encode.field(value, c.kind) if c.kind in (Kind.SET, Kind.INTERVAL) else value

    return [(c.target_name, one(c)) for c in table.copied]


def passfile_password(path: str, host: str, port: int, database: str, user: str) -> str | None:
    """The password of the first line (host:port:database:user:password, a star for any) that fits; the file must be its owner's alone."""
    if os.stat(path).st_mode & (stat.S_IRWXG | stat.S_IRWXO):
        raise ServerRefused("a passfile must be readable by its owner only")
    with open(path, encoding="utf-8") as f:
        for line in f:
            fields = [re.sub(r"\\(.)", r"\1", x) for x in re.findall(r"((?:\\.|[^:\\])*)(?::|$)", line.rstrip("\n"))][:5]
            if not line.startswith("#") and len(fields) == 5 and all(x in ("*", y) for x, y in zip(fields, (host, str(port), database, user), strict=False)):
                return fields[4]
    return None


def write_options(url: str, config: Config, table: TablePlan) -> dict[str, str]:
    """Options of the writer of one table."""
    quoted = ".".join('"' + x.replace('"', '""') + '"' for x in (table.target_schema, table.target_name))
    return connection_options(url, config) | {"dbtable": quoted}


def connection_options(url: str, config: Config) -> dict[str, str]:
    """Options of connections to the target: address, encryption, ten seconds to connect, a session in UTC with fixed formats."""
    u, e = urlsplit(url), config.target
    port, user, database = u.port or 5432, unquote(u.username or ""), unquote(u.path.lstrip("/"))
    if not u.hostname or "," in u.netloc:
        raise ServerRefused("the target needs one TCP host")
    more = {"sslmode": "verify-full" if e.tls_mode == "verify_full" else "disable", "connectTimeout": "10", "stringtype": "unspecified"}
    more |= {k: v for k, v in (("sslrootcert", e.ca_file), ("sslcert", e.client_cert), ("sslkey", e.client_key)) if v}
    session = {"TimeZone": "UTC", "DateStyle": "ISO,YMD", "standard_conforming_strings": "on", **{k: v for k, v in e.session.items() if k not in ("timezone", "datestyle", "standard_conforming_strings")}}
    more["options"] = " ".join(f"-c {k}={v}" for k, v in session.items())
    password = unquote(u.password) if u.password is not None else passfile_password(e.passfile, u.hostname, port, database, user) if e.passfile else ""
    return {
        "url": f"jdbc:postgresql://{u.hostname}:{port}/{database}?{urlencode(more)}", "user": user, "password": password or "", "batchsize": str(config.migration.batch_rows),
        "isolationLevel": "READ_COMMITTED",
    }


#: States in which a transaction may be tried again, how often, and the pause before each try in seconds for each earlier one.
TRANSIENT, ATTEMPTS, PAUSE = ("40001", "40P01"), 3, 0.02


def retried(write: Callable[[], None], sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a write again while the server says that it may be; returns the attempts."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            write()
            return attempt
        except Exception as e:
            if attempt == ATTEMPTS or not any(re.search(rf"\b{code}\b", str(e)) for code in TRANSIENT):
                raise
            sleep(PAUSE * attempt)
    raise AssertionError


def write_table(rows: DataFrame, url: str, config: Config, table: TablePlan) -> int:
    """Append converted rows to a table of the target server."""
    out = rows.select(*(value.alias(name) for name, value in write_columns(table)))
    return retried(lambda: out.write.format("jdbc").options(**write_options(url, config, table)).mode("append").save())


LITERAL_DEFAULTS = ("char", "varchar", "enum", "set")


def default_probe(database: str, table: str, column: SourceColumn) -> str | None:
    """The statement that reads a column's literal default as it is, since the catalogue cuts it at NUL and replaces rare characters; None where it needn't be read.

    An aggregate gives a row for an empty table too.
    """
    kind = column.data_type.lower()
    binary = kind in ("binary", "varbinary")
    if column.default is None or column.default_is_expression or column.generation_expression or not (binary or kind in LITERAL_DEFAULTS):
        return None
    value = f"DEFAULT(probed.{spark_quote(column.name)})"
    shown = "NULL AS text" if binary else f"CONVERT({value} USING utf8mb4) AS text"
    source = f"{spark_quote(database)}.{spark_quote(table)} AS probed"
    return f"(SELECT {shown}, HEX({value}) AS bytes FROM {source} LIMIT 1) UNION ALL (SELECT {shown}, HEX({value}) AS bytes FROM {source} HAVING COUNT(*) = 0) LIMIT 1"


def recover_defaults(query: Query, catalog: SourceCatalog) -> None:
    """Put the true literal defaults into a catalogue."""
    for t in catalog.tables:
        for c in t.columns if not t.is_view else ():
            if (text := default_probe(catalog.database, t.name, c)) is not None:
                row = query(text).first()
                if row is None or row["bytes"] is None:
                    raise ServerRefused(f"{t.name}.{c.name}: the default can't be read")
                if row["text"] is None:
                    c.default = f"0x{row['bytes']}"
                else:
                    c.default, c.default_bytes_hex = row["text"], row["bytes"]


def inspect(query: Query) -> SourceCatalog:
    """The catalogue of the database that a reader is connected to."""
    from keelson.sources.catalog import from_facts

    version, comment, database = query("SELECT VERSION() AS version, @@version_comment AS comment, DATABASE() AS db").first()
    check_server(version, comment)
    numbers = tuple(int(x) for x in re.findall(r"\d+", version)[:3])
    facts = {k: query(text) for k, text in catalog_queries(database, numbers).items()}
    made = from_facts(database, **facts)
    made.server_version = version
    recover_defaults(query, made)
    return made


def catalog_queries(database: str, version: tuple[int, int, int]) -> dict[str, str]:
    """Statements for the flat facts of one database, in a fixed order of rows; checks exist from 8.0.16 on."""
    db = "'" + database.replace("\\", "\\\\").replace("'", "''") + "'"
    info = "information_schema"
    out = {
        "tables": f"SELECT TABLE_NAME AS table_name, ENGINE AS engine, TABLE_TYPE = 'VIEW' AS is_view, TABLE_ROWS AS estimated_rows, AUTO_INCREMENT AS next_auto_increment, TABLE_COMMENT AS comment FROM {info}.TABLES WHERE TABLE_SCHEMA = {db} ORDER BY BINARY TABLE_NAME",
        "columns": "SELECT TABLE_NAME AS table_name, ORDINAL_POSITION AS ordinal, COLUMN_NAME AS column_name, DATA_TYPE AS data_type, COLUMN_TYPE AS column_type, IS_NULLABLE = 'YES' AS nullable, COLUMN_DEFAULT AS `default`,"
        " EXTRA AS extra, CHARACTER_SET_NAME AS charset, COLLATION_NAME AS collation, NULLIF(GENERATION_EXPRESSION, '') AS generation_expression, NUMERIC_PRECISION AS numeric_precision, NUMERIC_SCALE AS numeric_scale,"
        f" DATETIME_PRECISION AS datetime_precision, CHARACTER_MAXIMUM_LENGTH AS character_length, COLUMN_COMMENT AS comment FROM {info}.COLUMNS WHERE TABLE_SCHEMA = {db} ORDER BY BINARY TABLE_NAME, ORDINAL_POSITION",
        "index_parts": f"SELECT TABLE_NAME AS table_name, INDEX_NAME AS index_name, SEQ_IN_INDEX AS position, COLUMN_NAME AS column_name, SUB_PART AS prefix_length, NON_UNIQUE = 0 AS is_unique, INDEX_NAME = 'PRIMARY' AS is_primary, INDEX_TYPE AS kind FROM {info}.STATISTICS WHERE TABLE_SCHEMA = {db} ORDER BY BINARY TABLE_NAME, BINARY INDEX_NAME, SEQ_IN_INDEX",
        "fk_parts": "SELECT k.TABLE_NAME AS table_name, k.CONSTRAINT_NAME AS constraint_name, k.ORDINAL_POSITION AS position, k.COLUMN_NAME AS column_name, k.REFERENCED_TABLE_SCHEMA AS referenced_schema, k.REFERENCED_TABLE_NAME AS referenced_table,"
        f" k.REFERENCED_COLUMN_NAME AS referenced_column, r.UPDATE_RULE AS on_update, r.DELETE_RULE AS on_delete FROM {info}.KEY_COLUMN_USAGE k JOIN {info}.REFERENTIAL_CONSTRAINTS r ON r.CONSTRAINT_SCHEMA = k.CONSTRAINT_SCHEMA AND r.TABLE_NAME = k.TABLE_NAME"
        f" AND r.CONSTRAINT_NAME = k.CONSTRAINT_NAME WHERE k.TABLE_SCHEMA = {db} AND k.REFERENCED_TABLE_NAME IS NOT NULL ORDER BY BINARY k.TABLE_NAME, BINARY k.CONSTRAINT_NAME, k.ORDINAL_POSITION",
        "unsupported": f"SELECT 'trigger' AS kind, CONCAT(EVENT_OBJECT_TABLE, '.', TRIGGER_NAME) AS object, 'triggers are not migrated' AS reason FROM {info}.TRIGGERS WHERE TRIGGER_SCHEMA = {db}"
        f" UNION ALL SELECT LOWER(ROUTINE_TYPE), ROUTINE_NAME, 'routines are not migrated' FROM {info}.ROUTINES WHERE ROUTINE_SCHEMA = {db}"
        f" UNION ALL SELECT 'event', EVENT_NAME, 'events are not migrated' FROM {info}.EVENTS WHERE EVENT_SCHEMA = {db}"
        f" UNION ALL SELECT DISTINCT 'partition', TABLE_NAME, 'partitioning is not kept' FROM {info}.PARTITIONS WHERE TABLE_SCHEMA = {db} AND PARTITION_NAME IS NOT NULL",
    }
    if version >= (8, 0, 16):
        out["checks"] = (
            f"SELECT t.TABLE_NAME AS table_name, c.CONSTRAINT_NAME AS constraint_name, c.CHECK_CLAUSE AS expression, t.ENFORCED = 'YES' AS enforced FROM {info}.CHECK_CONSTRAINTS c JOIN {info}.TABLE_CONSTRAINTS t"
            f" ON t.CONSTRAINT_SCHEMA = c.CONSTRAINT_SCHEMA AND t.CONSTRAINT_NAME = c.CONSTRAINT_NAME WHERE c.CONSTRAINT_SCHEMA = {db} AND t.CONSTRAINT_TYPE = 'CHECK' ORDER BY BINARY t.TABLE_NAME, BINARY c.CONSTRAINT_NAME"
        )
    return out


def bounds_sql(database: str, table: str, key: str) -> str:
    """Exact least and greatest key as text, so unsigned 64-bit values survive."""
    q = spark_quote(key)
    return f"SELECT CAST(MIN({q}) AS CHAR) AS low, CAST(MAX({q}) AS CHAR) AS high FROM {spark_quote(database)}.{spark_quote(table)}"
