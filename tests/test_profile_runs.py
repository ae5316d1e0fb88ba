from pyspark.sql import functions as F

from tessera.operators import profiles as P
from tessera.operators import reconcile as R
from tessera.plans.profile_queries import PROFILES, overrides


def test_a_run_holds_nothing_in_memory_and_sends_over_allocations_to_review(spark):
    p = PROFILES["PR_PO"]
    texts = [("p1", "PR", "10"), ("o1", "PO", "6"), ("o2", "PO", "5"), ("p2", "PR", "8"), ("o3", "PO", "3")]
    rows = [(i, role, "", f"{role}.json", {"requisition_number": "N1" if i in ("p1", "o1", "o2") else "N2", "item_code": "i", "requested_quantity" if role == "PR" else "ordered_quantity": q, "currency": "USD"}) for i, role, q in texts]
    records = spark.createDataFrame(rows, "record_id string, role string, document_type string, source_reference string, fields map<string,string>")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    run = P.run_profile(records, p, overrides(p))
    rows = run["link_rows"].collect()
    assert {(r.left_id, r.right_id): (r.status, r.reason_code) for r in rows} == {("p1", "o1"): ("HUMAN_REVIEW_REQUIRED", "PARTIAL_OVER_ALLOCATION"), ("p1", "o2"): ("HUMAN_REVIEW_REQUIRED", "PARTIAL_OVER_ALLOCATION"), ("p2", "o3"): ("PARTIAL_MATCH", None)}
    assert {(r.left_source, r.right_source) for r in rows} == {("PR.json", "PO.json")} and rows[0].match_keys == ["currency", "item_code", "quantity", "requisition_number"]
    assert {(r.left_id, r.right_id): (r.status, r.link_id) for r in run["links"].collect()} == {(r.left_id, r.right_id): (r.status, r.link_id) for r in rows}
    assert {(r.holder, r.total) for r in run["over_allocations"].collect()} == {("p1", "11")}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_views_are_counted_in_one_pass(spark):
    one = lambda s: F.array(F.struct(F.lit("c").alias("component"), F.lit(s).alias("status"), F.lit("r").alias("reason"), F.lit("d").alias("difference")))
    rows = spark.range(5).select(F.col("id").cast("string").alias("reconciliation_id"), F.lit("r").alias("rule"), F.lit("l").alias("left_id"), F.lit("r").alias("right_id"), (F.col("id") > 1).alias("review_required"), F.when(F.col("id") > 2, one("CONFLICTING_MATCH")).otherwise(one("EXACT_MATCH")).alias("rule_results"))
    assert {r.view: r.n for r in R.view_counts(rows).collect()} == {v: R.output_view(rows, v).count() for v in ("full", "package", "discrepancies")}


def test_views_of_results_are_counted_without_comparisons(spark):
    p = PROFILES["INVENTORY_COUNT_BOOK_STOCK"]
    rule = P.materialized(p)[0]
    fields = lambda q, d: {"count_date": d, "as_of_date": d, "location_code": "L", "item_code": "i", "counted_quantity": q, "book_quantity": q, "unit": "EA"}
    rows = [("c1", "INVENTORY_COUNT", fields("5", "2024-01-01")), ("b1", "BOOK_STOCK", fields("5", "2024-01-01")), ("b2", "BOOK_STOCK", fields("6", "2024-01-02")), ("b3", "BOOK_STOCK", fields("5", "2024-13-02"))]
    records = spark.createDataFrame([(i, role, "", "s", f) for i, role, f in rows], "record_id string, role string, document_type string, source_reference string, fields map<string,string>")
    made = P.run_profile(records, p)["pairs"]
    results = R.result_rows(made.withColumn("reason", F.lit("")), None, rule, {"grain": p.grain})
    counted = R.view_counts(results)
    assert {r.view: r.n for r in counted.collect()} == {v: R.output_view(results, v).count() for v in ("full", "package", "discrepancies")} == {"full": 3, "package": 1, "discrepancies": 2}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toJSON()
    assert "DECIMAL_DIFFERENCE" in plan(results) and "DECIMAL_DIFFERENCE" not in plan(counted)


def test_links_are_counted_where_the_join_dealt_them_and_only_shared_holders_are_written(spark, monkeypatch):
    p = PROFILES["CUSTOM_N_WAY"]
    fields = lambda k, a, c="USD": {"reference_id": k, "amount": a, "currency": c}
    rows = [("a1", "ROLE_A", fields("N1", "5")), ("a2", "ROLE_A", fields("N2", "5")), ("a3", "ROLE_A", fields("N2", "5")), ("a4", "ROLE_A", fields(None, "5")),
            ("b1", "ROLE_B", fields("N1", "5")), ("b2", "ROLE_B", fields("N2", "5")), ("b3", "ROLE_B", fields("N1", "5", "EUR")), ("b4", "ROLE_B", fields(None, "5"))]
    records = spark.createDataFrame([(i, role, "", "s", f) for i, role, f in rows], "record_id string, role string, document_type string, source_reference string, fields map<string,string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        written = []
        monkeypatch.setattr(P, "kept", lambda df, label: written.append(label) or df)
        monkeypatch.setattr(R, "kept", lambda df, label: written.append(label) or df)
        links = P.run_profile(records, p)["link_rows"]
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert [(r.left_id, r.right_id, r.status) for r in links.collect()] == [("a1", "b1", "EXACT_MATCH")]
        assert (plan.count("Exchange hashpartitioning"), plan.count("+- Window") + plan.count("   Window"), written) == (2, 2, [])
        by_id = R.resolved(R.pairs_of(*[P.canonical_records(records, p, r) for r in p.roles.values()], P.materialized(p)[0], told=False), P.materialized(p)[0])
        assert by_id.where("selected").count() == 1 and by_id.where("NOT selected").count() == 2
        several = PROFILES["PR_PO"]
        P.run_profile(records, several, overrides(several))["link_rows"]
        assert written == ["links", "holders"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_part_of_a_bounded_holder_is_never_over_allocated():
    rule = lambda partial, cardinality: R.Rule("x", (), cardinality, partial=partial)
    assert [c for c in R.BOUNDED if R.shares(rule("RIGHT_LESS_THAN_LEFT", c))] == ["ONE_TO_MANY", "MANY_TO_MANY"]
    assert [c for c in R.BOUNDED if R.shares(rule("LEFT_LESS_THAN_RIGHT", c))] == ["MANY_TO_ONE", "MANY_TO_MANY"]
    assert not any(R.shares(rule(partial, c)) for c in R.BOUNDED for partial in (None, "AGGREGATED_RIGHT_NOT_ABOVE_LEFT"))


def test_records_that_several_rules_join_by_the_same_keys_are_dealt_once(spark):
    p = PROFILES["PO_GRN_INVOICE"]
    fields = lambda role, q: {s[-1]: {"quantity": q, "item_code": "i", "po_number": "N1", "currency": "USD"}.get(n) for n, s in p.roles[role].fields.items()}
    rows = [(f"{role}-{q}", role, "", "s", fields(role, q)) for role, q in (("PO", "10"), ("GRN", "10"), ("INVOICE", "10"), ("INVOICE", "11"), ("GRN", None))]
    rows.append(("INVOICE-EUR", "INVOICE", "", "s", fields("INVOICE", "12") | {p.roles["INVOICE"].fields["currency"][-1]: "EUR"}))
    records = spark.createDataFrame(rows, "record_id string, role string, document_type string, source_reference string, fields map<string,string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        links = P.run_profile(records, p)["link_rows"]
        plan = links._jdf.queryExecution().executedPlan().toString()
        again = plan.count("ReusedExchange")  # each names the exchange that it reads
        assert (plan.count("Exchange hashpartitioning") - again, again) == (3, 3)
        assert {(r.rule, r.left_id, r.right_id, r.status) for r in links.collect()} == {("po-to-grn", "PO-10", "GRN-10", "EXACT_MATCH"), ("po-to-invoice", "PO-10", "INVOICE-10", "EXACT_MATCH"), ("grn-to-invoice", "GRN-10", "INVOICE-10", "EXACT_MATCH")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
