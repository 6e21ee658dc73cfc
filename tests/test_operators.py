import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keelson.operators import constraints, fulltext, load, multiset
from keelson.operators.closure import closure
from keelson.operators.ranges import ranged_scan
from keelson.operators.verify import verify
from keelson.plans.catalogue import documents_plan, orders_slice, sample_catalog
from keelson.plans.model import ColumnPlan, IndexPart, Kind, SourceCatalog, SourceColumn, SourceIndex, SourceTable, TablePlan, Verified
from keelson.plans.run import FileTarget, Run, summary
from keelson.plans.planner import build
from keelson.plans.target import Namespace, TargetCatalog
from keelson.sources import artifacts, catalog, jdbc
from keelson.sources.config import parse

SF = "/root/testdata/sf0.001"


def plan(name, target, kind, **more):
    return ColumnPlan(name, name, more.pop("source", "x"), target, kind, **more)


PEOPLE = TablePlan("t_people", "people", "app", "people", [plan("id", "integer", Kind.SIGNED, nullable=False), plan("day", "date", Kind.DATE), plan("name", "varchar(4)", Kind.TEXT)], ["id"])
ROWS = [(1, "2024-01-01", "a"), (2, "0000-00-00", "b"), (3, None, "toolong"), (None, "2024-01-01", "d"), (1, "2024-01-02", None)]
KIND = "id int, day string, name string"


def test_multisets_against_counters(spark):
    a = [("x", 1), ("x", 1), (None, 2), (None, 2), ("y", None)]
    b = [("x", 1), (None, 2), (None, 2), (None, 2), ("z", 0)]
    s, t = (spark.createDataFrame(r, "k string, v int") for r in (a, b))
    want = {k: n for k in {*a, *b} if (n := Counter(a)[k] - Counter(b)[k])}
    assert {(r.k, r.v): r.surplus for r in multiset.multiset_diff(s, t).collect()} == want
    assert multiset.multiset_equal(s, t) == (False, 5, 5) and multiset.multiset_equal(s, s.repartition(3)) == (True, 5, 5)
    assert multiset.multiset_equal(s.limit(0), t.limit(0)) == (True, 0, 0)


def test_content_comparison(spark):
    c = [plan("v", "numeric(5,2)", Kind.DECIMAL)]
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    assert multiset.compare_content(one("1.50", "-0"), one("1.5", "0.00"), c).status == Verified.COMPLETE
    assert multiset.compare_content(one("1"), one("1", "1"), c).status == Verified.DIFFERENT
    assert multiset.compare_content(one("1"), one("1", "2"), c, one("2")).status == Verified.COMPLETE
    assert multiset.compare_content(one("1"), one("1"), [plan("v", "real", Kind.FLOAT)]).status == Verified.UNSUPPORTED


def test_comparison_is_one_shuffle(spark):
    s = spark.range(10).withColumn("k", F.col("id") % 3)
    text = multiset.multiset_diff(s, s)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_keys(spark):
    r = spark.createDataFrame([(1, 1), (1, 1), (2, None), (2, None), (None, 3)], "a int, b int")
    got = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert got(constraints.unique_violations(r, ["a", "b"])) == [(1, 1, 2)]
    assert got(constraints.unique_violations(r, ["a", "b"], primary=True)) == [(1, 1, 2), (2, None, 2), (None, 3, 1)]
    parent = spark.createDataFrame([(1, 1)], "x int, y int")
    assert constraints.fk_orphans(r, ["a", "b"], parent, ["x", "y"]).count() == 0
    assert constraints.fk_orphans(r, ["a"], parent, ["x"]).count() == 2
    assert constraints.check_violations(r, "b > 1").count() == 2
    assert constraints.sequence_floor(r, "a", 1) == 3 and constraints.sequence_floor(r.limit(0), "a", 7) == 7
    assert constraints.sequence_exhausted(2**15, "smallint") and not constraints.sequence_exhausted(5, "integer")


def test_first_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 3), (None, "y", 4)], "k int, v string, _row_ordinal long")
    kept, late = load.first_wins(rows, ["k"])
    assert sorted(r.v for r in kept.collect()) == ["a", "x", "y"] and [r.v for r in late.collect()] == ["b"]


def test_split_and_accounts(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, KIND)
    made = load.converted(rows, PEOPLE)
    assert sorted(r.reason for r in load.rejects(made, PEOPLE).collect()) == ["day: field_overflow", "id: not_null", "name: length"]
    assert load.good(made, PEOPLE).count() == 2
    with pytest.raises(load.StoppedOnReject):
        load.load_table(rows, PEOPLE, f"{tmp_path}/a")
    with pytest.raises(load.RejectLimit):
        load.load_table(rows, PEOPLE, f"{tmp_path}/b", on_row_error="reject", max_rejected=2)
    done = load.load_table(rows, PEOPLE, f"{tmp_path}/c", reject_dir=str(tmp_path), on_row_error="reject", max_rejected=3)
    r = done.report
    assert (r.rows_read, r.committed_rows, r.rejected_rows, r.status) == (5, 2, 3, "partial") and r.accounted_rows == 5
    assert r.committed_bytes == len("1\t2024-01-01\ta\n1\t2024-01-02\t\\N\n")
    lines = [x.asDict(True) for x in spark.read.json(f"{tmp_path}/t_people.reject.jsonl").collect()]
    assert {x["kind"] for x in lines} == {"conversion"} and len(lines) == 3
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name and p.name.startswith("c")]


def test_row_size_and_generated_columns(spark):
    t = TablePlan("t", "t", "a", "t", [plan("s", "text", Kind.TEXT), plan("g", "integer", Kind.SIGNED, copy=False, generated_expression="length(s) + 1")])
    rows = spark.createDataFrame([("abc",), ("x" * 100,)], "s string")
    made = load.converted(rows, t, max_row_bytes=50)
    assert [r.g for r in load.good(made, t).collect()] == [4]
    assert load.rejects(made, t).first().reason == "row_size"


def test_conversion_is_one_projection_without_python(spark):
    rows, p = orders_slice(spark, SF)
    text = load.good(load.converted(rows, p), p)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text


def test_range_scans_and_fallback(spark):
    columns = [SourceColumn("id", 1, "bigint", "bigint", nullable=False)]
    source = SourceTable("t", columns, indexes=[SourceIndex("PRIMARY", [IndexPart("id")], primary=True)])
    t = TablePlan("t", "t", "a", "t", [plan("id", "bigint", Kind.SIGNED, source="bigint", nullable=False)], ["id"])
    for values in ([-(2**63), -9, -3, 4, 11, 2**63 - 1], list(range(10))):
        rows = spark.createDataFrame([(v,) for v in values], "id long")
        span = 2**62 if values[0] < -(2**62) else 3
        parts, said = ranged_scan(rows, t, source, span)
        assert sorted(r.id for p in parts for r in p.collect()) == sorted(values) and not said and len(parts) > 1
    assert ranged_scan(rows.limit(0), t, source, 3)[1][0].code == "RANGE_FALLBACK"
    assert ranged_scan(rows, t, SourceTable("t", columns), 100)[1][0].code == "RANGE_FALLBACK"


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b", "n"), ("b", "a", "n"), ("b", "c", "x"), ("d", "e", "n"), (None, "q", "n")], "parent string, child string, kind string")
    roots = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    assert sorted(r.node for r in closure(roots, e).collect()) == ["a", "b", "c"]
    assert sorted(r.node for r in closure(roots, e, ["n"]).collect()) == ["a", "b"]


def test_fulltext(spark):
    rows = spark.createDataFrame([(1, "The Quick", None), (2, None, "quickly; done"), (3, "x", "QUICK-fox")], "i int, a string, b string")
    assert sorted(r.i for r in fulltext.matching(rows, ["a", "b"], "Quick").collect()) == [1, 3]


CONFIG = """version = 1
source = { url_env = "S", consistency = "frozen" }
target = { url_env = "T", schema = "app" }
migration = { on_row_error = "reject", max_rejected_rows = 10, table_workers = 2 }
verification = { mode = "content" }
report = { directory = "%s/runs" }
"""


def test_a_whole_run(spark, tmp_path):
    c = parse(CONFIG % tmp_path)
    source = SourceCatalog("shop", [
        SourceTable("people", [SourceColumn("id", 1, "int", "int", nullable=False), SourceColumn("day", 2, "date", "date"), SourceColumn("name", 3, "varchar", "varchar(4)", character_length=4)]),
        SourceTable("other", [SourceColumn("v", 1, "bigint", "bigint unsigned")])])
    staged = {"people": spark.createDataFrame(ROWS, KIND), "other": spark.range(5).select(F.col("id").alias("v"))}
    target = FileTarget(spark, f"{tmp_path}/target")
    p = build(c, source, TargetCatalog(namespaces=[Namespace("app", True)]))
    events = []
    report = Run(spark, c, p, lambda t: staged[t.source_name], target, events.append).go()
    assert report.exit_code() == 3 and report.verification.status == "complete", report
    assert target.read("app", "other").count() == 5 and events[-1]["committed_rows"] == 7 and "committed 7" in summary(report)
    saved_plan, saved = artifacts.saved_run(report.artifact_dir)
    assert saved_plan == p and saved.tables == report.tables
    # a changed target is found again from the saved run
    staged["other"].union(spark.createDataFrame([(99,)], "v long")).select(F.col("v").cast("decimal(20,0)").alias("v")).write.mode("overwrite").parquet(target.path("app", "other"))
    again = verify(saved_plan, saved, lambda t: staged[t.source_name], target.read)
    assert again.status == "different" and any("other" in d for d in again.differences)
    # the destination exists now
    second = Run(spark, c, p, lambda t: staged[t.source_name], target).go()
    assert second.exit_code() == 1 and second.failed_steps


def test_locks_hooks_and_redaction(spark, tmp_path):
    with artifacts.schema_locks(str(tmp_path), ["b", "a"]), pytest.raises(RuntimeError), artifacts.schema_locks(str(tmp_path), ["a"]):
        pass
    with artifacts.schema_locks(str(tmp_path), ["a"]):
        pass
    hook = tmp_path / "h.sql"
    hook.write_text("CREATE OR REPLACE TEMP VIEW hooked AS SELECT 1 AS one;\n")
    import hashlib

    from keelson.plans.model import HookPlan

    h = HookPlan(True, str(hook), hashlib.sha256(hook.read_bytes()).hexdigest())
    artifacts.run_hooks(spark, [h], True)
    assert spark.table("hooked").first().one == 1
    hook.write_text("SELECT 2;")
    with pytest.raises(ValueError):
        artifacts.run_hooks(spark, [h], True)
    assert artifacts.safe("mysql://u:p@h/d password=abc\n\x1b") == "[redacted-uri] password=[redacted]\\n\\x1b"
    assert artifacts.endpoint_digest("a://u:p@h:1/d?x=1#f") == artifacts.endpoint_digest("a://u:q@h:1/d")


def test_catalogues_and_statements(spark):
    s = sample_catalog()
    f = catalog.facts(spark, s)
    back = catalog.from_facts("shop", f["columns"], f["index_parts"], f["fk_parts"], f["checks"])
    assert [t.name for t in back.tables] == ["lineitem", "orders"] and back.tables[0].foreign_keys == s.tables[1].foreign_keys and back.tables[1].indexes == s.tables[0].indexes
    from keelson.plans.model import to_json

    assert catalog.load_source(to_json(s)) == s
    one = catalog.fingerprint(s, TargetCatalog(), ["orders"])
    s.tables[0].estimated_rows = 9
    assert catalog.fingerprint(s, TargetCatalog(), ["orders"]) == one
    c = [SourceColumn("e", 1, "enum", "enum('a')"), SourceColumn("g", 2, "point", "point"), SourceColumn("t`x", 3, "text", "text", charset="latin1"), SourceColumn("n", 4, "int", "int")]
    assert jdbc.select_sql("d", "t", c, "`n` >= 1") == "SELECT CAST(`e` AS UNSIGNED) AS `e`, CONCAT('SRID=', ST_SRID(`g`), ';', ST_AsText(`g`)) AS `g`, CAST(`t``x` AS BINARY) AS `t``x`, `n` FROM `d`.`t` WHERE `n` >= 1"
    assert jdbc.check_server("8.4.1", "MySQL Community Server - GPL") == (8, 4)
    for bad in (("8.3.0", "MySQL Community Server"), ("10.6.2-MariaDB", "mariadb.org binary distribution"), ("8.0.30", "Percona Server (GPL)")):
        with pytest.raises(jdbc.ServerRefused):
            jdbc.check_server(*bad)


def test_catalogue_statements():
    old, new = jdbc.catalog_queries("sh'op", (5, 7, 44)), jdbc.catalog_queries("sh'op", (8, 0, 16))
    assert set(new) - set(old) == {"checks"} and all("'sh''op'" in q for q in new.values())
    import duckdb

    for q in new.values():  # the statements parse; the dialect's BINARY ordering and quotes aside
        text = q.replace("BINARY ", "").replace("`", '"')
        assert duckdb.sql(f"SELECT json_serialize_sql($x${text}$x$)").fetchall()[0][0].count('"error":false') == 1
    assert jdbc.bounds_sql("d", "t", "k`") == "SELECT CAST(MIN(`k```) AS CHAR) AS low, CAST(MAX(`k```) AS CHAR) AS high FROM `d`.`t`"


def test_stream(spark, tmp_path):
    from keelson.streaming.load import load_stream

    spark.createDataFrame(ROWS, KIND).write.parquet(f"{tmp_path}/in")
    q = load_stream(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), PEOPLE, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and spark.read.json(f"{tmp_path}/bad/t_people").count() == 3


def test_cli(tmp_path, capsys):
    from keelson.cli import main

    (tmp_path / "c.toml").write_text(CONFIG % tmp_path)
    assert main(["check", str(tmp_path / "c.toml")]) == 0
    from keelson.plans.model import to_json

    (tmp_path / "cat.json").write_text(to_json(sample_catalog()))
    assert main(["inspect", str(tmp_path / "c.toml"), "--catalog", str(tmp_path / "cat.json")]) == 0
    assert json.loads(capsys.readouterr().out.split("\n", 1)[1])["selected"] == ["orders", "lineitem"]
    (tmp_path / "bad.toml").write_text("version = 2")
    assert main(["check", str(tmp_path / "bad.toml")]) == 2
    (tmp_path / "x.load").write_text("LOAD DATABASE FROM mysql://h/d INTO pgsql://h/e;")
    args = ["import-load", str(tmp_path / "x.load"), str(tmp_path / "out.toml"), "--consistency", "frozen", "--target-schema", "app", "--accept-defaults"]
    assert main(args) == 0 and main(args) == 2 and main(["check", str(tmp_path / "out.toml")]) == 0


def test_counts_of_transformations(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    made = load.converted(d.withColumn("text", F.concat("text", F.lit(" "))), documents_plan())
    assert load.transformation_counts(made) == {"text": d.count()}


def test_entry_without_the_optional_package(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    everything = set(e.queries())
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "keelson.llm" else real(n, *a))
    core = e.queries()
    assert set(core) <= everything and "flagship" in core and not any(k.startswith("op") for k in core) and set(e.oracle_sql()) <= set(core)


# Whole runs over targets that are there already


def shop(**more):
    id_ = SourceColumn("id", 1, "int", "int", nullable=False, extra="auto_increment")
    name = SourceColumn("name", 2, "varchar", "varchar(4)", character_length=4)
    return SourceCatalog("shop", [SourceTable("people", [id_, name], indexes=[SourceIndex("PRIMARY", [IndexPart("id")], primary=True)], **more)])


def configured(tmp_path, **more):
    """CONFIG with other settings of the migration and the target."""
    c = parse(CONFIG % tmp_path)
    for k, v in more.items():
        setattr(c.target if k == "on_existing" else c.verification if k == "verification" else c.migration, k, v)
    return c


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, name string")


def go(spark, tmp_path, rows, c, source=None, **known):
    target = FileTarget(spark, f"{tmp_path}/target")
    p = build(c, source or shop(), target.catalog(["app"]))
    return Run(spark, c, p, lambda t: rows, target, **known).go(), p, target


def test_append_is_verified_on_top_of_what_was_there(spark, tmp_path):
    first, _, target = go(spark, tmp_path, people(spark, (1, "a"), (2, "b")), configured(tmp_path))
    assert first.exit_code() == 0, first
    c = configured(tmp_path, mode="data_only", on_existing="append")
    second, p, _ = go(spark, tmp_path, people(spark, (3, "c"), (4, "a")), c)
    assert second.exit_code() == 0 and second.baselines[p.tables[0].id].rows == 2, second
    assert sorted(r.id for r in target.read("app", "people").collect()) == [1, 2, 3, 4]
    # the saved run knows the baseline
    saved_plan, saved = artifacts.saved_run(second.artifact_dir)
    assert verify(saved_plan, saved, lambda t: people(spark, (3, "c"), (4, "a")), target.read, held=target.held).status == "complete"
    assert verify(saved_plan, saved, lambda t: people(spark, (3, "c"), (4, "x")), target.read, held=target.held).status == "different"
    # a later append makes the earlier one's target another
    assert go(spark, tmp_path, people(spark, (5, "e")), c)[0].exit_code() == 0
    assert verify(saved_plan, saved, lambda t: people(spark, (3, "c"), (4, "a")), target.read, held=target.held).status == "different"


def test_the_earliest_row_of_a_key_wins(spark, tmp_path):
    assert go(spark, tmp_path, people(spark, (1, "a"), (2, "b")), configured(tmp_path))[0].exit_code() == 0
    c = configured(tmp_path, mode="data_only", on_existing="append")
    rows = people(spark, (2, "late"), (3, "c"), (3, "d"), (4, "tooolong"), (5, "e\t\\")).coalesce(1)
    report, p, target = go(spark, tmp_path, rows, c)
    t = report.tables[0]
    assert report.exit_code() == 3 and (t.rows_read, t.committed_rows, t.rejected_rows) == (5, 2, 3), report
    assert {(r.id, r.name) for r in target.read("app", "people").collect()} == {(1, "a"), (2, "b"), (3, "c"), (5, "e\t\\")}
    assert t.committed_bytes == len("3\tc\n5\te\\t\\\\\n")
    records = [json.loads(r.value) for r in spark.read.text(f"{report.artifact_dir}/{p.tables[0].id}.reject.jsonl").collect()]
    assert sorted(r["kind"] for r in records) == ["conversion", "copy", "copy"]
    lines = "".join(r.value + "\n" for r in spark.read.text(f"{report.artifact_dir}/{p.tables[0].id}.reject.copy").collect()).encode()
    cut = sorted(lines[r["offset"] : r["offset"] + r["length"]] for r in records if r["kind"] == "copy")
    assert cut == [b"2\tlate\n", b"3\td\n"] and {r["encoding"] for r in records if r["kind"] == "copy"} == {"postgresql_copy_text"}
    # without rejects the run stops, and nothing is there that wasn't
    report, _, target = go(spark, tmp_path, rows, configured(tmp_path, mode="data_only", on_existing="append", on_row_error="stop", max_rejected_rows=0))
    assert report.exit_code() == 1 and target.read("app", "people").count() == 4


def test_refused_rows_get_their_places_in_ranges(spark, tmp_path, monkeypatch):
    """No task has all of them, and their lines are one file still, in the order of the rows."""
    monkeypatch.setattr(load, "RANGE_ROWS", 10, raising=False)
    assert go(spark, tmp_path, people(spark, (1, "a")), configured(tmp_path))[0].exit_code() == 0
    given = [(i % 3 + 1, f"é{i}") for i in range(90)] + [(4, "tooolong")]
    report, p, target = go(spark, tmp_path, people(spark, *given).coalesce(1), configured(tmp_path, mode="data_only", on_existing="append", max_rejected_rows=99))
    assert report.exit_code() == 3 and (report.tables[0].committed_rows, report.tables[0].rejected_rows) == (2, 89), report
    files = {kind: sorted(Path(report.artifact_dir, f"{p.tables[0].id}.reject.{kind}").glob("part-*")) for kind in ("jsonl", "copy")}
    parts = [[r for r in map(json.loads, f.read_text().splitlines()) if r["kind"] == "copy"] for f in files["jsonl"]]
    assert max(map(len, parts)) <= 30 and len(files["copy"]) == 1
    lines, records = files["copy"][0].read_bytes(), [r for part in parts for r in part]
    late = {i: "%d\t%s\n" % row for i, row in enumerate(given) if i not in (1, 2, 90)}  # key 1 was there, and rows 1 and 2 stay
    assert {r["locator"]["ordinal"]: lines[r["offset"] : r["offset"] + r["length"]].decode() for r in records} == late and len(records) == 88
    assert lines.decode() == "".join(late.values())


def test_duplicates_of_a_new_key_fail_the_run(spark, tmp_path):
    report, _, _ = go(spark, tmp_path, people(spark, (1, "a"), (1, "b")), configured(tmp_path))
    assert report.exit_code() == 1 and "unique key on id" in report.failed_steps[0]


def test_rows_that_are_too_large_are_rejected_and_verified(spark, tmp_path):
    report, _, _ = go(spark, tmp_path, people(spark, (1, "a"), (2, "b" * 400)), configured(tmp_path, max_row_bytes=300))
    assert report.exit_code() == 3 and report.verification.status == "complete", report


def test_the_reject_cap_holds_over_all_tables(spark, tmp_path):
    bad = spark.createDataFrame([(1, "toolong"), (2, "toolong"), (3, "ok")], "id int, name string")
    source = shop()
    source.tables.append(SourceTable("others", source.tables[0].columns, indexes=source.tables[0].indexes))
    report, _, target = go(spark, tmp_path, bad, configured(tmp_path, max_rejected_rows=3), source)
    assert report.exit_code() == 1 and "4 rejected rows exceed 3" in report.failed_steps[0] and target.catalog(["app"]).tables == []
    assert go(spark, tmp_path, bad, configured(tmp_path, max_rejected_rows=4), source)[0].exit_code() == 3


def test_a_table_is_replaced_only_when_the_new_one_is_good(spark, tmp_path):
    assert go(spark, tmp_path, people(spark, (1, "a")), configured(tmp_path))[0].exit_code() == 0
    c = configured(tmp_path, on_existing="recreate", on_row_error="stop", max_rejected_rows=0)
    report, _, target = go(spark, tmp_path, people(spark, (1, "toolong")), c)
    assert report.exit_code() == 1 and [tuple(r) for r in target.read("app", "people").collect()] == [(1, "a")]
    report, _, target = go(spark, tmp_path, people(spark, (7, "n")), c)
    assert report.exit_code() == 0 and [tuple(r) for r in target.read("app", "people").collect()] == [(7, "n")]
    assert target.names("app") == ["people"]


def test_sequences_go_on_after_what_was_reached(spark, tmp_path):
    report, p, target = go(spark, tmp_path, people(spark, (1, "a"), (9, "b")), configured(tmp_path), shop(next_auto_increment=5))
    assert report.exit_code() == 0 and target.states("app", "people") == {"id": 10} == report.sequences[p.tables[0].id], report
    c = configured(tmp_path, mode="data_only", on_existing="append")
    report, p, target = go(spark, tmp_path, people(spark, (3, "c")), c, shop(next_auto_increment=20))
    assert report.exit_code() == 0 and target.states("app", "people") == {"id": 20}
    target.set_states("app", "people", {"id": 3})
    again = verify(p, report, lambda t: people(spark, (3, "c")), target.read, held=target.held, states={p.tables[0].id: target.states("app", "people")})
    assert again.status == "different" and "below 20" in again.differences[0]
    report, _, _ = go(spark, tmp_path / "other", people(spark, (2**31 - 1, "z")), configured(tmp_path / "other"))
    assert report.exit_code() == 1 and "no value" in report.failed_steps[0]


def test_another_structure_is_found(spark, tmp_path):
    report, p, target = go(spark, tmp_path, people(spark, (1, "a")), configured(tmp_path))
    seen = target.table("app", "people", 1)[0].observed
    seen.columns[1].comment, seen.columns[1].default, seen.indexes = "said", "'x'::text", []
    out = verify(p, report, lambda t: people(spark, (1, "a")), target.read, states=report.sequences, observed=lambda t: seen)
    assert out.status == "different" and len(out.differences) == 3, out


def test_a_snapshot_is_read_once(spark, tmp_path):
    from pyspark.sql import types as T

    drawn = F.udf(lambda i: int.from_bytes(__import__("os").urandom(3), "big"), T.IntegerType()).asNondeterministic()
    rows = spark.range(20).select(drawn("id").alias("id"), F.lit("a").alias("name"))
    c = configured(tmp_path, table_workers=1)
    c.source.consistency = "single_snapshot"
    report, _, _ = go(spark, tmp_path, rows, c)
    assert report.exit_code() == 0, report  # load, counts and content saw the same rows
    assert [n for n, _, _ in report.phases] == ["copy", "index_constraints", "verify"] and not (tmp_path / "target" / f".snapshot-{report.run_id}").exists()


def test_saved_runs_of_other_endpoints_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("S", "mysql://u:p@h/d")
    report, _, _ = go(spark, tmp_path, people(spark, (1, "a")), configured(tmp_path))
    digest = artifacts.endpoint_digest("mysql://u:other@h/d")
    assert report.source_endpoint_sha256 == digest
    artifacts.saved_run(report.artifact_dir, digest)
    with pytest.raises(artifacts.SavedRunError):
        artifacts.saved_run(report.artifact_dir, artifacts.endpoint_digest("mysql://u:p@h2/d"))


def test_admission_comes_before_any_write(spark, tmp_path):
    c, target = configured(tmp_path), FileTarget(spark, f"{tmp_path}/target")
    p = build(c, shop(), target.catalog(["app"]))
    c.migration.memory_bytes = 1
    report = Run(spark, c, p, lambda t: people(spark, (1, "a")), target).go()
    assert report.exit_code() == 1 and "AdmissionError" in report.failed_steps[0] and target.names("app") == []


def test_fulltext_expressions_are_recognised():
    names = ["a", 'B "q"']
    made = fulltext.expression_sql(names)
    shown = "to_tsvector('simple'::regconfig, ((COALESCE(a, ''::text) || ' '::text) || COALESCE(\"B \"\"q\"\"\", ''::text)))"
    assert fulltext.is_expression(made, names) and fulltext.is_expression(shown, names)
    for bad in (made.replace("simple", "english"), shown.replace("a,", "b,"), shown + " ", shown[:-1], shown.replace("' '", "''"), shown.replace("|| COALESCE", "COALESCE"), shown.replace("::regconfig", ""), "f(" + shown + ")", ""):
        assert not fulltext.is_expression(bad, names) or bad.strip() == shown, bad
    assert not fulltext.is_expression(made, ["a"]) and not fulltext.is_expression(made, [])


# A server, by what stands in for Spark's reader


def test_options_of_both_sides(tmp_path):
    c = parse((CONFIG % tmp_path).replace('consistency = "frozen"', 'consistency = "frozen", ca_file = "/c/ca.p12", session = { sql_mode = "ANSI" }'))
    o = jdbc.read_options("mysql://us%40er:p%2Fw@db.example:3307/shop", c)
    assert o["url"].startswith("jdbc:mysql://db.example:3307/shop?sslMode=VERIFY_IDENTITY&trustCertificateKeyStoreUrl=file%3A%2Fc%2Fca.p12&trustCertificateKeyStoreType=PKCS12&connectTimeout=10000&maxAllowedPacket=")
    assert (o["user"], o["password"], o["sessionInitStatement"]) == ("us@er", "p/w", "SET SESSION sql_mode = 'ANSI', SESSION time_zone = '+00:00'")
    assert [jdbc.packet_bytes(n) for n in (0, 1 << 20, 1 << 31)] == [65_536, (1 << 20) + 65_536, 1 << 30]
    c.source.ca_file = "/c/ca.pem"
    with pytest.raises(jdbc.ServerRefused):
        jdbc.read_options("mysql://h/d", c)
    c.target.ca_file, c.target.passfile = "/c/root.pem", str(tmp_path / "pass")
    (tmp_path / "pass").write_text("# x\nother:5432:d:u:no\n*:5432:d:u:se\\:cret\n")
    (tmp_path / "pass").chmod(0o600)
    t = TablePlan("t", "t", 'a"b', "t", [plan("s", "text[]", Kind.SET, set_labels=["a,b"])])
    w = jdbc.write_options("pgsql://u@h/d", c, t)
    assert w["password"] == "se:cret" and w["dbtable"] == '"a""b"."t"' and "sslmode=verify-full" in w["url"] and "sslrootcert=%2Fc%2Froot.pem" in w["url"] and "TimeZone%3DUTC" in w["url"]
    (tmp_path / "pass").chmod(0o644)
    with pytest.raises(jdbc.ServerRefused):
        jdbc.write_options("pgsql://u@h/d", c, t)
    with pytest.raises(jdbc.ServerRefused):
        jdbc.write_options("pgsql://u@h,h2/d", c, t)


def test_labels_with_commas_stay_whole(spark):
    t = TablePlan("t", "t", "a", "t", [plan("s", "text[]", Kind.SET, set_labels=["a,b", 'c"']), plan("n", "bigint", Kind.SIGNED)])
    rows = spark.createDataFrame([(["a,b", 'c"'], 1)], "s array<string>, n long")
    assert tuple(rows.select(*(v.alias(n) for n, v in jdbc.write_columns(t))).first()) == ('{"a,b","c\\""}', 1)


def test_a_write_is_tried_again_where_the_server_says_so():
    waits, errors = [], [RuntimeError("ERROR: deadlock (SQLSTATE 40P01)"), RuntimeError("state 40001")]

    def write():
        if errors:
            raise errors.pop(0)

    assert jdbc.retried(write, waits.append) == 3 and waits == [0.02, 0.04]
    for left in ([RuntimeError("23505")], [RuntimeError("40001")] * 3):
        errors[:] = left
        with pytest.raises(RuntimeError):
            jdbc.retried(write, waits.append)


def test_ranged_scans_are_one_scan(spark):
    source = SourceTable("t", [SourceColumn("id", 1, "bigint", "bigint unsigned", nullable=False), SourceColumn("x", 2, "int", "int")], indexes=[SourceIndex("PRIMARY", [IndexPart("id")], primary=True)])
    t = TablePlan("t", "t", "a", "t", [plan("id", "numeric(20,0)", Kind.UNSIGNED, source="bigint unsigned", nullable=False), plan("x", "integer", Kind.SIGNED, source="int")], ["id"])
    asked, bounds = [], ("1", str(2**64 - 1))
    query = lambda text: spark.createDataFrame([bounds], "low string, high string")
    read = lambda text, predicates: asked.append((text, predicates))
    _, said = jdbc.scan(query, read, "d", t, source, 2, 2**62)
    assert not said and len(asked) == 1 and asked[0][0] == "SELECT `id`, `x` FROM `d`.`t`"
    assert asked[0][1][0] == f"`id` >= 1 AND `id` <= {2**62}" and asked[0][1][-1].endswith(f"`id` <= {2**64 - 1}") and len(asked[0][1]) == 4
    for bounds, key in ((("1", "5"), "id"), ((None, None), "id"), (("1", "9"), None)):
        t.primary_key = [key] if key else []
        assert jdbc.scan(query, read, "d", t, source, 2, 100)[1][0].code == "RANGE_FALLBACK" and asked[-1][1] == []
    assert jdbc.scan(query, read, "d", t, source, 1, None)[1] == []


def test_a_server_is_inspected(spark):
    s = sample_catalog()
    known = catalog.facts(spark, s)
    literal = SourceColumn("c", 1, "varchar", "varchar(9)", default="a?")
    columns = known["columns"].withColumns({"default": F.when(F.col("column_name") == "l_linenumber", F.lit("0")), "extra": F.lit("")})

    def query(text):
        if "VERSION()" in text:
            return spark.createDataFrame([("8.4.2", "MySQL Community Server - GPL", "shop")], "version string, comment string, db string")
        for name in ("COLUMNS", "STATISTICS", "KEY_COLUMN_USAGE", "CHECK_CONSTRAINTS", "TRIGGERS", "TABLES"):
            if f"information_schema.{name}" in text:
                kinds = {"COLUMNS": columns, "STATISTICS": known["index_parts"], "KEY_COLUMN_USAGE": known["fk_parts"], "CHECK_CONSTRAINTS": known["checks"], "TABLES": known["tables"]}
                return kinds[name] if name in kinds else spark.createDataFrame([("trigger", "t.g", "x")], "kind string, object string, reason string")
        raise AssertionError(text)

    made = jdbc.inspect(query)
    assert made.database == "shop" and made.server_version == "8.4.2" and [t.name for t in made.tables] == ["lineitem", "orders"] and made.unsupported_objects[0].object == "t.g"
    assert "LIMIT 1" in jdbc.default_probe("d", "t", literal) and jdbc.default_probe("d", "t", SourceColumn("c", 1, "int", "int", default="1")) is None
    holder = SourceCatalog("d", [SourceTable("t", [literal, SourceColumn("b", 2, "varbinary", "varbinary(3)", default="x")])])
    jdbc.recover_defaults(lambda text: spark.createDataFrame([(None if "NULL AS text" in text else "a🙂", "00FF")], "text string, bytes string"), holder)
    assert (holder.tables[0].columns[0].default, holder.tables[0].columns[0].default_bytes_hex, holder.tables[0].columns[1].default) == ("a🙂", "00FF", "0x00FF")


def test_facts_that_contradict_each_other(spark):
    f = catalog.facts(spark, sample_catalog())
    parts = ("columns", "index_parts", "fk_parts", "checks")
    assert len(catalog.from_facts("shop", *(f[p] for p in parts)).tables) == 2
    for name, change in (("columns", F.col("ordinal") != 1), ("index_parts", F.col("position") != 1), ("columns", F.col("table_name") != "orders"), ("columns", F.col("column_name") != "l_linenumber")):
        with pytest.raises(catalog.FactError):
            catalog.from_facts("shop", *(f[p].where(change) if p == name else f[p] for p in parts))


def facts_of_a_target():
    """Facts of one table as the server's statements give them."""
    at = {"table_schema": "app", "table_name": "people"}
    return {
        "version": [{"version": "17.2"}], "namespaces": [{"name": "app", "can_use": True, "can_create": True}], "extensions": [{"name": "plpgsql"}],
        "relations": [{"table_schema": "app", "name": "people", "sort": "relation"}, {"table_schema": "app", "name": "mood", "sort": "type"}],
        "tables": [at | {"oid": 7, "ordinary": True, "standalone": True, "can_insert": True, "can_select": True, "can_truncate": True, "can_alter": True, "row_security": False, "comment": None}],
        "columns": [at | {"position": 1, "name": "id", "type": "integer", "nullable": False, "identity": "d", "generated": False, "expression": None, "comment": None}, at | {"position": 3, "name": "name", "type": "character varying(4)", "nullable": True, "identity": "", "generated": False, "expression": None, "comment": None}],
        "index_parts": [at | {"name": "people_pkey", "position": 1, "column_name": "id", "expression": None, "descending": False, "is_unique": True, "is_primary": True, "method": "btree", "plain": True}],
        "constraint_parts": [at | {"name": "people_pkey", "kind": "p", "position": 1, "column_name": "id", "expression": None, "referenced_schema": None, "referenced_table": None, "referenced_column": None, "on_update": " ", "on_delete": " ", "validated": True, "deferrable": False}],
        "sequences": [at | {"column_name": "id", "last_value": 41, "is_called": True, "first_value": 1, "increment": 1, "minimum": 1, "maximum": 2**31 - 1, "cache": 1, "cycle": False, "can_lock": True}],
        "triggers": [at | {"name": "g", "enabled": "O", "internal": False, "on_truncate": True}], "event_triggers": [{"name": "ev", "enabled": "O"}],
        "enum_labels": [{"table_schema": "app", "name": "mood", "position": i, "label": x, "usable": True} for i, x in enumerate("ab", 1)],
        "dependencies": [{"dependent_class": c, "dependent": i, "reference_class": "pg_class", "reference": 7, "kind": k, "label": label} for c, i, k, label in (("pg_class", 8, "a", "index people_pkey"), ("pg_constraint", 9, "a", "constraint people_pkey on table people"), ("pg_rewrite", 10, "n", "rule _RETURN on view v"))],
    }


def test_a_target_server_is_inspected():
    from keelson.sources import server

    import duckdb

    for name, text in server.target_queries(["app", "o'x"]).items():  # the statements parse; types by name aside
        plain = text.replace("::regclass", "::text").replace("::bigint", "").replace("::int[]", "::INTEGER[]")
        shown = duckdb.sql(f"SELECT json_serialize_sql($x${plain}$x$)").fetchall()[0][0]
        assert '"error":false' in shown, (name, shown[:200])
        assert "o''x" in text or name in ("version", "event_triggers", "extensions")
    made = server.decode(facts_of_a_target(), ["app", "new"])
    t = made.table("app", "people")
    assert [c.name for c in t.observed.columns] == ["id", "name"] and t.observed.columns[0].identity == "by_default" and t.observed.indexes[0].columns == ["id"]
    assert t.observed.sequences[0].last_value == 41 and made.enums[0].labels == ["a", "b"] and not made.namespace("new").exists and made.graph.valid()
    assert server.decode_sequences(facts_of_a_target()["sequences"]) == {("app", "people"): {"id": 42}}
    # the plan for it is the one that the facts allow
    c = parse(CONFIG % "x")
    c.migration.mode, c.target.on_existing = "data_only", "append"
    assert build(c, shop(), made).tables[0].structure.indexes[0].name == "people_pkey"
    c.migration.mode, c.target.on_existing = "full", "recreate"
    with pytest.raises(ValueError) as e:
        build(c, shop(), made)
    codes = {d.code for d in e.value.diagnostics}
    assert {"TARGET_EVENT_TRIGGER", "TARGET_DEPENDENCY_OUTSIDE_SELECTION"} <= codes
    for name, change in (("version", {"version": "15.1"}), ("index_parts", {"position": 2}), ("columns", {"table_name": "other"}), ("enum_labels", {"position": 5})):
        facts = facts_of_a_target()
        facts[name][0] |= change
        with pytest.raises(ValueError):
            server.decode(facts, ["app"])


def test_a_run_into_a_server(spark, tmp_path):
    """Into the database that comes with Spark, whose statements for tables, keys and rows are the same."""
    from keelson.plans.run import Run as ARun
    from keelson.sources import server

    options = {"url": f"jdbc:derby:memory:{tmp_path.name};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "batchsize": "100"}
    execute, query = server.executor(spark, options), jdbc.reader(spark, options)
    execute(['CREATE SCHEMA "app"'])
    with pytest.raises(Exception, match="42X"):
        execute(['CREATE TABLE "app"."half" (a INT)', "NO STATEMENT"])
    id_, name = SourceColumn("id", 1, "int", "int", nullable=False), SourceColumn("name", 2, "varchar", "varchar(4)", character_length=4)
    source = SourceCatalog("shop", [SourceTable("people", [id_, name], indexes=[SourceIndex("PRIMARY", [IndexPart("id")], primary=True)])])
    target = server.ServerTarget(spark, options, f"{tmp_path}/staging", query, execute)
    target.catalog = lambda schemas: TargetCatalog(namespaces=[Namespace("app", True)])  # its catalogue has other names
    assert target.read("app", "half") is None and target.read("app", "people") is None
    c = configured(tmp_path)
    p = build(c, source, TargetCatalog(namespaces=[Namespace("app", True)]))
    rows = people(spark, (1, "a"), (2, "toolong"), (3, "c"))
    report = ARun(spark, c, p, lambda t: rows, target).go()
    assert report.exit_code() == 3 and report.tables[0].committed_rows == 2 and report.tables[0].rejected_rows == 1, report
    assert sorted((r.id, r.name) for r in target.read("app", "people").collect()) == [(1, "a"), (3, "c")]
    scanned = jdbc.table_reader(spark, options)('SELECT "id" AS ID FROM "app"."people"', ["ID >= 1 AND ID <= 2", "ID >= 3 AND ID <= 4", "ID > 4"])
    assert scanned.rdd.getNumPartitions() == 3 and sorted(r.ID for r in scanned.collect()) == [1, 3]
    before = target.baseline("app", "people")
    assert before.rows == 2 and target.held(before).count() == 2
    with pytest.raises(Exception, match="23505"):  # the key is there
        execute(["INSERT INTO \"app\".\"people\" VALUES (4, 'x'), (1, 'y')"])
    assert target.read("app", "people").count() == 2
    assert ARun(spark, c, p, lambda t: rows, target).go().exit_code() == 1  # the table is there
