"""Typed values, wide decimals, bands, group keys and field names of reconciliation."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import fields as X
from tessera.operators import profiles as P
from tessera.operators import reconcile as R


def typed(spark, rows):
    """record_id and a column v of variants."""
    return spark.createDataFrame(rows, "record_id string, t string").select("record_id", F.parse_json("t").alias("v"))


def statuses(spark, comparator, left, right, **k):
    rule = R.Rule("r", (R.Component("v", "v", "v", comparator, **k),), max_pairs=10_000)
    rows = R.pairs_of(typed(spark, [(f"L{i}", x) for i, x in enumerate(left)]), typed(spark, [(f"R{i}", x) for i, x in enumerate(right)]), rule, "all").collect()
    return {(r.left_id, r.right_id): (r.status, r.comparisons[0].reason) for r in rows}


def test_no_value_is_coerced(spark):
    got = statuses(spark, "IDENTIFIER_EXACT", ['"5"', "5", "null", "true"], ['"5"', "5", '["5"]'])
    assert got["L0", "R0"] == ("EXACT_MATCH", "TEXT_EQUAL")
    assert all(got[k] == ("HUMAN_REVIEW_REQUIRED", "NON_STRING_VALUE") for k in (("L0", "R1"), ("L1", "R0"), ("L1", "R1"), ("L3", "R2")))
    assert got["L2", "R0"] == ("HUMAN_REVIEW_REQUIRED", "REQUIRED_FIELD_MISSING")
    got = statuses(spark, "BOOLEAN_EXACT", ["true", '"true"', "1"], ["true", "false"])
    assert [got[f"L{i}", "R0"][1] for i in range(3)] == ["BOOLEAN_EQUAL", "NON_BOOLEAN_VALUE", "NON_BOOLEAN_VALUE"] and got["L0", "R1"][0] == "CONFLICTING_MATCH"
    got = statuses(spark, "SET_CONTAINS", ['["a",1,{"x":1,"y":[2]},null]', '"a"'], ['["a","a"]', '["1"]', '[{"y":[2],"x":1},null]', "[]"])
    assert [got["L0", f"R{i}"][0] for i in range(4)] == ["EXACT_MATCH", "CONFLICTING_MATCH", "EXACT_MATCH", "EXACT_MATCH"] and got["L1", "R0"][1] == "NON_ARRAY_SET_VALUE"
    got = statuses(spark, "DECIMAL_ABSOLUTE", ['"12.0"', "12"], ['"12"', "12.0"])
    assert [x[0] for x in (got["L0", "R0"], got["L0", "R1"], got["L1", "R1"])] == ["EXACT_MATCH", "HUMAN_REVIEW_REQUIRED", "HUMAN_REVIEW_REQUIRED"]
    assert statuses(spark, "DATE_WINDOW", ['"2024-01-01"'], ["20240101"])["L0", "R0"][1] == "DATE_NOT_CANONICAL"


def test_columns_of_another_type_are_not_coerced(spark):
    left, right = spark.createDataFrame([("L", 5)], "record_id string, v long"), spark.createDataFrame([("R", "5")], "record_id string, v string")
    row = R.pairs_of(left, right, R.Rule("r", (R.Component("v", "v", "v", "IDENTIFIER_EXACT"),))).first()
    assert (row.status, row.comparisons[0].reason) == ("HUMAN_REVIEW_REQUIRED", "NON_STRING_VALUE")


def test_keyed_pairs_meet_across_types(spark):
    rule = R.Rule("r", (R.Component("v", "v", "v", "IDENTIFIER_EXACT"),))
    got = {(r.left_id, r.right_id): r.status for r in R.pairs_of(typed(spark, [("L", "5")]), typed(spark, [("A", '"5"'), ("B", "5"), ("C", '"6"')]), rule).collect()}
    assert got == {("L", "A"): "HUMAN_REVIEW_REQUIRED", ("L", "B"): "HUMAN_REVIEW_REQUIRED"}


def test_wide_decimals_are_decided(spark):
    kind = "record_id string, v string, total string"
    wide = "9" * 30
    left = spark.createDataFrame([("L", wide + ".5", None)], kind)
    right = spark.createDataFrame([("A", wide + ".50", wide), ("B", wide + ".25", wide + ".6"), ("C", "-" + wide, wide), ("D", "1e5", wide)], kind)
    run = lambda **k: {r.right_id: (r.status, r.comparisons[0].difference) for r in R.pairs_of(left, right, R.Rule("r", (R.Component("v", "v", "v", k.pop("kind", "DECIMAL_ABSOLUTE"), tolerance=k.pop("tolerance", None), tolerance_approved=True),), **k), "all").collect()}
    assert run() == {"A": ("EXACT_MATCH", "0"), "B": ("CONFLICTING_MATCH", "0.25"), "C": ("CONFLICTING_MATCH", "1" + "9" * 29 + "8.5"), "D": ("HUMAN_REVIEW_REQUIRED", None)}
    assert run(tolerance="0.25")["B"][0] == run(kind="DECIMAL_RELATIVE", tolerance="0." + "0" * 29 + "1")["B"][0] == "WITHIN_TOLERANCE"
    assert run(partial="RIGHT_LESS_THAN_LEFT", partial_approved=True)["B"][0] == "PARTIAL_MATCH" and run(partial="RIGHT_LESS_THAN_LEFT", partial_approved=True)["C"][0] == "CONFLICTING_MATCH"
    assert [run(partial="AGGREGATED_RIGHT_NOT_ABOVE_LEFT", partial_approved=True, aggregate="total")[x][0] for x in "BA"] == ["CONFLICTING_MATCH", "EXACT_MATCH"]


def test_over_allocation_of_wide_values(spark):
    rule = R.Rule("r", (R.Component("po", "po", "po", "IDENTIFIER_EXACT"), R.Component("v", "v", "v", "DECIMAL_ABSOLUTE")), cardinality="ONE_TO_MANY", partial="RIGHT_LESS_THAN_LEFT", partial_approved=True)
    wide = "1" + "0" * 40
    left = spark.createDataFrame([("L", "1", wide), ("M", "2", wide)], "record_id string, po string, v string")
    right = spark.createDataFrame([("A", "1", "5" + "0" * 39), ("B", "1", "5" + "0" * 39 + ".01"), ("C", "2", "5" + "0" * 39)], "record_id string, po string, v string")
    got = {r.right_id: (r.status, r.total) for r in R.allocations(R.links_of(R.resolved(R.pairs_of(left, right, rule), rule))).collect()}
    assert got == {"A": ("HUMAN_REVIEW_REQUIRED", wide + ".01"), "B": ("HUMAN_REVIEW_REQUIRED", wide + ".01"), "C": ("PARTIAL_MATCH", "5" + "0" * 39)}


@pytest.mark.parametrize(("tolerance", "block"), [(None, 10_000), ("0.07", 5), ("3", 10_000), ("250", 7), ("1" + "0" * 25, 10_000)])
def test_decimal_band_is_all_pairs(spark, tolerance, block):
    r = random.Random(6)
    values = [r.choice(["", "-"]) + r.choice([str(r.randint(0, 30)), f"{r.randint(0, 5)}.{r.randint(0, 99):02d}", "9" * 25 + f"{r.randint(0, 9)}", "0.00"]) for _ in range(160)] + ["1.00"] * 30 + ["x", None]
    left, right = values[:90] + values[-10:], values[70:]
    frame = lambda m, own: spark.createDataFrame([(f"{m}{i}", v) for i, v in enumerate(own)], f"{m}_record_id string, {m}_v string")
    c = R.Component("v", "v", "v", "DECIMAL_ABSOLUTE", tolerance=tolerance)
    got = sorted((x.l_record_id, x.r_record_id) for x in R.band_joined(frame("l", left), frame("r", right), c, block).collect())
    d = lambda v: None if v in ("x", None) else Decimal(v)
    assert got == sorted((f"l{i}", f"r{j}") for i, a in enumerate(left) for j, b in enumerate(right) if d(a) is not None and d(b) is not None and abs(d(a) - d(b)) <= Decimal(tolerance or 0))


@pytest.mark.parametrize(("tolerance", "block"), [(None, 10_000), (0, 3), (1, 3), (40, 10_000)])
def test_date_band_is_all_pairs(spark, tolerance, block):
    r = random.Random(7)
    days = [(dt.date(1969, 12, 20) + dt.timedelta(r.randint(0, 60))).isoformat() for _ in range(120)] + ["1970-01-01"] * 20 + ["1.1.1970", None]
    left, right = days[:80], days[60:]
    frame = lambda m, own: spark.createDataFrame([(f"{m}{i}", v) for i, v in enumerate(own)], f"{m}_record_id string, {m}_v string")
    got = sorted((x.l_record_id, x.r_record_id) for x in R.band_joined(frame("l", left), frame("r", right), R.Component("v", "v", "v", "DATE_WINDOW", tolerance=tolerance), block).collect())
    d = lambda v: None if v in ("1.1.1970", None) else dt.date.fromisoformat(v)
    assert got == sorted((f"l{i}", f"r{j}") for i, a in enumerate(left) for j, b in enumerate(right) if d(a) and d(b) and abs((d(a) - d(b)).days) <= (tolerance or 0))


def test_band_plan_has_no_cross_product(spark):
    rows = spark.createDataFrame([("a", "2024-01-01")], "record_id string, d string")
    df = R.pairs_of(rows, rows, R.Rule("r", (R.Component("d", "d", "d", "DATE_WINDOW", tolerance=3),)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan and df.count() == 1


def test_aggregates_of_typed_and_broken_rows(spark):
    rows = spark.createDataFrame([("1", "a", "99999999999999999999"), ("2", "a", "99999999999999999999"), ("3", None, "1"), ("4", "a", "1e9"), ("5", "b", None)], "record_id string, g string, v string")
    good, bad = R.aggregated(rows, ["g"], "v")
    assert {r.g: (r.sum_value, r.n_records) for r in good.collect()} == {"a": ("199999999999999999998", 3), "b": (None, 1)}
    assert {r.record_id: r.reason for r in bad.collect()} == {"3": "GROUP_FIELD_MISSING", "4": "DECIMAL_VALUE_MISSING_OR_INVALID", "5": "DECIMAL_VALUE_MISSING_OR_INVALID"}
    values = spark.createDataFrame([("1", "1", '"2"'), ("2", '"1"', '"3"'), ("3", "1", "4"), ("4", "null", '"5"')], "record_id string, g string, v string").select("record_id", F.parse_json("g").alias("g"), F.parse_json("v").alias("v"))
    good, bad = R.aggregated(values, ["g"], "v")
    assert {r.g: (r.sum_value, r.n_records) for r in good.collect()} == {"1": ("2", 2), '"1"': ("3", 1)}
    assert {r.record_id: r.reason for r in bad.collect()} == {"3": "DECIMAL_VALUE_MISSING_OR_INVALID", "4": "GROUP_FIELD_MISSING"}


def test_canonical_json_of_broken_texts(spark):
    rows = spark.createDataFrame([('{"b":1,"a":[1,{"d":2,"c":3}]}',), ("{",), ('{"a":NaN}',), ('{"a":1,"a":2}',), ("1 2",), (None,), ("[" * 100_000,), ('"é"',)], "t string")
    assert [r.c for r in rows.select(X.canonical_json(F.col("t")).alias("c")).collect()] == ['{"a":[1,{"c":3,"d":2}],"b":1}', None, None, None, None, None, None, '"é"']


def test_profile_takes_typed_records(spark):
    p = P.load_profiles("""
profile T TWO_WAY DOCUMENT
role A DOCUMENT TA - A ref flag
role B DOCUMENT TB - B ref=head.ref flag
rule ab A B ONE_TO_ONE disallow ref flag^?
""")["T"]
    rows = [("a1", "A", "TA", '{"ref":"1","flag":true}'), ("a2", "A", "TA", '{"ref":"2"}'), ("b1", "B", "TB", '{"head":{"ref":"1"},"flag":true}'), ("b2", "B", "TB", '{"head":{"ref":2},"flag":"yes"}')]
    records = spark.createDataFrame(rows, "record_id string, role string, document_type string, t string").select("record_id", "role", "document_type", F.try_variant_get(F.parse_json("t"), "$", "map<string,variant>").alias("fields"), F.lit(None).cast("string").alias("source_reference"))
    run = P.run_profile(records, p)
    assert {(r.left_id, r.right_id): r.status for r in run["pairs"].collect()} == {("a1", "b1"): "EXACT_MATCH", ("a2", "b2"): "HUMAN_REVIEW_REQUIRED"}
    assert {(r.side, r.record_id) for r in run["unmatched"].collect()} == {("left", "a2"), ("right", "b2")} and run["links"].count() == 1
    P.released(run)


def test_cardinalities_of_several_rules(spark):
    rows = [(rule, l, r, "EXACT_MATCH") for rule in ("one", "many", "any") for l, r in (("a", "x"), ("a", "y"), ("b", "y"), ("c", "z"))]
    pairs = spark.createDataFrame(rows, "rule string, left_id string, right_id string, status string")
    rules = [R.Rule("one", ()), R.Rule("many", (), cardinality="ONE_TO_MANY"), R.Rule("any", (), cardinality="MANY_TO_MANY")]
    got = {(r.rule, r.left_id, r.right_id) for r in R.resolved(pairs, *rules).where("selected").collect()}
    assert got == {("one", "c", "z"), ("many", "a", "x"), ("many", "c", "z")}


def test_types_of_field_names(spark):
    cases = [("account_period", "IDENTIFIER_EXACT", "REFERENCE_MISMATCH"), ("taxonomy", "EXACT_TEXT", "SYSTEM_DOCUMENT_MISMATCH"), ("subtotal", "EXACT_TEXT", "SYSTEM_DOCUMENT_MISMATCH"), ("Currency", "EXACT_TEXT", "CURRENCY_MISMATCH"), ("customer_po", "IDENTIFIER_EXACT", "REFERENCE_MISMATCH"),
             ("seller_bank_account", "IDENTIFIER_EXACT", "REFERENCE_MISMATCH"), ("PAYEE_ACCOUNT", "IDENTIFIER_EXACT", "BANK_ACCOUNT_MISMATCH"), ("due_date", "EXACT_TEXT", "DATE_MISMATCH"), ("vendor", "EXACT_TEXT", "PARTY_MISMATCH"), ("note", "DATE_WINDOW", "DATE_MISMATCH")]
    rows = spark.createDataFrame(cases, "n string, c string, kind string")
    assert all(r.kind == r.got for r in rows.select("kind", R.discrepancy_type_of(F.col("n"), F.lit("other"), F.col("c")).alias("got")).collect())
