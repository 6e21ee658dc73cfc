import pytest

from keelson.operators import load, multiset
from keelson.plans import workloads


@pytest.mark.parametrize("make", [workloads.narrow_integers, workloads.skewed_keys, workloads.wide_text])
def test_workloads_convert_without_loss(spark, make):
    rows, plan = make(spark, 500)
    made = load.good(load.converted(rows, plan), plan)
    same = rows.select(*made.columns)
    assert made.count() == 500
    text = lambda df: df.selectExpr(*(f"cast(cast({n} AS {k}) AS string) AS {n}" for n, k in made.dtypes))
    assert multiset.multiset_equal(text(same), text(made))[0]


def test_bad_rows_are_rejected(spark):
    rows, plan = workloads.bad_rows(spark, 1000, 20)
    made = load.converted(rows, plan)
    assert load.good(made, plan).count() == 950 and load.rejects(made, plan).select("reason").distinct().collect()[0].reason == "payload: charset"
