from pyspark.sql import functions as F

from tessera.operators import profiles as P
from tessera.operators import reconcile as R
from tessera.plans.profile_queries import PROFILES, overrides

RULE = R.Rule("r", (R.Component("k", "k", "k", "IDENTIFIER_EXACT"), R.Component("v", "v", "v", "DECIMAL_ABSOLUTE")), cardinality="MANY_TO_MANY", partial="RIGHT_LESS_THAN_LEFT", partial_approved=True)
WIDE = "9" * 40
CASES = [("1.50", "1.5", "EXACT_MATCH", "0.00"), ("+1", "1", "EXACT_MATCH", "0"), ("-0", "0", "EXACT_MATCH", "0"), ("2", "1.250", "PARTIAL_MATCH", "0.750"), ("1", "2", "CONFLICTING_MATCH", "1"), ("01", "1", "HUMAN_REVIEW_REQUIRED", None), (None, "1", "HUMAN_REVIEW_REQUIRED", None),
         ("0.1234567890123456789", "0.123456789012345678", "PARTIAL_MATCH", "0.0000000000000000009"), (WIDE, WIDE + ".0", "EXACT_MATCH", "0"), (WIDE, "1", "PARTIAL_MATCH", "9" * 39 + "8")]


def test_a_keyed_join_moves_texts_and_no_numbers(spark):
    rows = [(f"l{i}", str(i), l, f"r{i}", r) for i, (l, r, _, _) in enumerate(CASES)]
    both = spark.createDataFrame(rows, "l string, k string, lv string, r string, rv string")
    made = R.pairs_of(both.select(F.col("l").alias("record_id"), "k", F.col("lv").alias("v")), both.select(F.col("r").alias("record_id"), "k", F.col("rv").alias("v")), RULE)
    below = made._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert "__digits_v" in below and "__number_v" not in below
    got = {r.left_id: (r.status, r.comparisons[1]["difference"]) for r in made.collect()}
    assert got == {f"l{i}": (status, difference) for i, (_, _, status, difference) in enumerate(CASES)}


def test_only_links_with_parts_are_joined_with_over_allocations(spark):
    p = PROFILES["PR_PO"]
    texts = [("p1", "PR", "10", "N1"), ("o1", "PO", "6", "N1"), ("o2", "PO", "5", "N1"), ("p2", "PR", "8", "N2"), ("o3", "PO", "8", "N2")]
    rows = [(i, role, "", f"{role}.json", {"requisition_number": n, "item_code": "i", "requested_quantity" if role == "PR" else "ordered_quantity": q, "currency": "USD"}) for i, role, q, n in texts]
    records = spark.createDataFrame(rows, "record_id string, role string, document_type string, source_reference string, fields map<string,string>")
    found = P.run_profile(records, p, overrides(p))["link_rows"]
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.left_id, r.right_id): (r.status, r.reason_code) for r in found.collect()} == {("p1", "o1"): ("HUMAN_REVIEW_REQUIRED", "PARTIAL_OVER_ALLOCATION"), ("p1", "o2"): ("HUMAN_REVIEW_REQUIRED", "PARTIAL_OVER_ALLOCATION"), ("p2", "o3"): ("EXACT_MATCH", None)}
