from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import reconcile as R


def amounts(**k):
    return R.Rule("r", (R.Component("v", "v", "v", "DECIMAL_ABSOLUTE", tolerance="2.50", tolerance_approved=True),), **k)


@pytest.mark.parametrize("kind", ["decimal(18,2)", "string"])
def test_lone_partners_are_counted_without_pairs(spark, kind):
    side = lambda rows: spark.createDataFrame(rows, "record_id string, v string").select("record_id", F.col("v").cast(kind).alias("v"))
    left = side([("a", "10.00"), ("b", "20.00"), ("c", "30.00"), ("d", "30.01"), ("e", "-1.00"), ("f", None), ("g", "50.00"), ("g", "70.00"), ("h", "90.00")])
    right = side([("A", "12.50"), ("B", "22.51"), ("C", "31.00"), ("E", "-3.50"), ("G", "50.00"), ("H", "70.00"), ("I", "91.00"), ("J", "89.00"), ("K", None)])
    l, r = R.lone_in_band(left, right, amounts())
    links = lambda l, r: sorted((x.left_id, x.right_id, x.status) for x in R.links_of(R.resolved(R.pairs_of(l, r, amounts()), amounts())).collect())
    assert links(l, r) == links(left, right) == [("a", "A", "WITHIN_TOLERANCE"), ("e", "E", "WITHIN_TOLERANCE")]
    assert {x.record_id for x in l.collect()} == {"a", "c", "d", "e"} and {x.record_id for x in r.collect()} == {"A", "E", "G", "H", "I", "J"}
    with pytest.raises(ValueError):
        R.lone_in_band(left, right, amounts(cardinality="MANY_TO_MANY"))


def test_a_status_costs_no_texts_of_comparisons(spark):
    rule = R.Rule("r", (R.Component("d", "d", "d", "DATE_WINDOW", tolerance=1, tolerance_approved=True), R.Component("v", "v", "v", "DECIMAL_ABSOLUTE", tolerance="2", tolerance_approved=True)), cardinality="MANY_TO_MANY")
    side = lambda i, rows: spark.createDataFrame([(f"{i}{k}", *r) for k, r in enumerate(rows)], "record_id string, d string, v decimal(18,2)")
    left = side("l", [("2024-01-01", Decimal("5")), ("2024-01-09", Decimal("5"))])
    right = side("r", [("2024-01-01", Decimal("5")), ("2024-01-02", Decimal("7")), ("2023-12-31", Decimal("9")), ("soon", Decimal("5"))])
    pairs = R.pairs_of(left, right, rule)
    rows = pairs.collect()
    assert {(r.left_id, r.right_id): r.status for r in rows} == {("l0", "r0"): "EXACT_MATCH", ("l0", "r1"): "WITHIN_TOLERANCE", ("l0", "r2"): "CONFLICTING_MATCH"}
    assert all(min(R.SEVERITY.index(c.status) for c in r.comparisons) == R.SEVERITY.index(r.status) for r in rows)
    assert "DATE_EQUAL" not in pairs.select("left_id", "right_id", "status")._jdf.queryExecution().optimizedPlan().toString()
