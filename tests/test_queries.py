import pytest

from keelson.plans import catalogue, run_queries  # noqa: F401  the latter adds to the former
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    check(spark, SF, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first().equal


@pytest.mark.parametrize("name,column", [("reject_split", "l_quantity"), ("fk_orphans", "l_orderkey"), ("range_scan_union", "o_totalprice")])
def test_scans_read_only_what_is_needed(spark, name, column):
    text = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = [x.split("ReadSchema: ")[1].split("\n")[0] for x in text.split("FileScan")[1:] if "ReadSchema" in x]
    assert any(column in s for s in schemas) and not any("l_comment" in s or "l_tax" in s for s in schemas)


def test_range_scans_cover_the_whole_table(spark, tmp_path):
    """Beyond the first three ranges, and where the least key is not the start of a range."""
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    orders.where("o_orderkey > 7000").write.parquet(f"{tmp_path}/orders.parquet")
    for folder, first in (("/root/testdata/sf0.1", 0), (str(tmp_path), 7001)):
        found = catalogue.QUERIES["range_scan_union"](spark, folder).collect()
        rows = orders.where(f"o_orderkey >= {first}")
        want = rows.selectExpr("CAST(floor(o_orderkey / 5000) AS int) AS range_id", "o_totalprice").groupBy("range_id").agg({"*": "count"}).collect()
        assert sorted((r.range_id, r.n_rows) for r in found) == sorted(map(tuple, want)) and sum(r.n_rows for r in found) == rows.count()
    orders.limit(0).write.parquet(f"{tmp_path}/none/orders.parquet")
    assert catalogue.QUERIES["range_scan_union"](spark, f"{tmp_path}/none").count() == 0
