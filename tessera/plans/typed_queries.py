"""Queries of typed values, decimals of any width, bands, group keys of JSON and field names, with their SQL; odd values stand among the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..operators import checks as K
from ..operators import content as C
from ..operators import profiles as P
from ..operators import reconcile as R
from ..operators import slides as S
from ..operators import type_rules as T
from ..sinks.scratch import scratch
from ..sources import byte_ranges as B
from ..operators import workflow as W
from .queries import _INV, _PO, invoices, orders, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


TYPED = P.load_profiles("""
profile TYPED TWO_WAY DOCUMENT
role A DOCUMENT TYPE_A - ROLE_A reference_id amount urgent tags
role B DOCUMENT TYPE_B - ROLE_B reference_id amount=sums.total urgent tags
rule a-to-b A B ONE_TO_ONE disallow reference_id amount#? urgent^ tags@
""")["TYPED"]
#: Two documents for each order: numbers for texts, texts for booleans, members in another order, a nested field and decimals of 30 digits.
_SIDES = (
    """concat('{"document_id":"A-', o_orderkey, '","document_type":"TYPE_A","fields":{"reference_id":"', o_orderkey, '","amount":"1000000000000000000000000', o_orderkey, '.10","urgent":true,"tags":["a",1,{"y":1,"x":2}]}}')""",
    """concat('{"document_id":"B-', o_orderkey, '","document_type":"TYPE_B","fields":{"reference_id":', CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS STRING) ELSE concat('"', o_orderkey, '"') END,
 ',"sums":{"total":', CASE o_orderkey % 5 WHEN 0 THEN '12' WHEN 1 THEN 'null' ELSE concat('"1000000000000000000000000', o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN '.1' WHEN 3 THEN '.11' ELSE '.10' END, '"') END,
 '},"urgent":', CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '"true"' END, ',"tags":', CASE o_orderkey % 2 WHEN 0 THEN '[{"x":2,"y":1},"a","a"]' ELSE '["1"]' END, '}}')""")


def typed_records(spark, sf):
    out = None
    for role, text in zip("AB", _SIDES, strict=True):
        rows = table(spark, sf, "orders").select(F.concat(F.lit(f"{role}-"), "o_orderkey", F.lit(".json")).alias("source"), X.strict_json(F.expr(text)).alias("value"))
        docs = W.documents_of(rows).where("issue IS NULL")
        own = W.typed_records_of(docs, role)
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'NON_STRING_VALUE' ELSE 'TEXT_EQUAL' END AS r1, CASE o_orderkey % 5 WHEN 0 THEN 'DECIMAL_NOT_CANONICAL' WHEN 1 THEN 'OPTIONAL_FIELD_MISSING' WHEN 3 THEN 'DECIMAL_DIFFERENCE' ELSE 'DECIMAL_EQUAL' END AS r2,
 CASE o_orderkey % 3 WHEN 0 THEN 'BOOLEAN_EQUAL' WHEN 1 THEN 'BOOLEAN_DIFFERENCE' ELSE 'NON_BOOLEAN_VALUE' END AS r3, CASE o_orderkey % 2 WHEN 0 THEN 'SET_CONTAINED' ELSE 'SET_DIFFERENCE' END AS r4 FROM orders)
 SELECT 'A-' || k AS left_id, 'B-' || k AS right_id, r1 || ',' || r2 || ',' || r3 || ',' || r4 AS reasons, CASE WHEN r2 = 'DECIMAL_DIFFERENCE' OR r3 = 'BOOLEAN_DIFFERENCE' OR r4 = 'SET_DIFFERENCE' THEN 'CONFLICTING_MATCH' WHEN r1 = 'NON_STRING_VALUE' OR r2 = 'DECIMAL_NOT_CANONICAL' OR r3 = 'NON_BOOLEAN_VALUE' THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'EXACT_MATCH' END AS status,
 CASE r2 WHEN 'DECIMAL_EQUAL' THEN CASE WHEN k % 5 = 2 THEN '0' ELSE '0' END WHEN 'DECIMAL_DIFFERENCE' THEN '0.01' END AS difference FROM c""")
def typed_values(spark, sf):
    found = P.run_profile(typed_records(spark, sf), TYPED)["pairs"]
    return found.select("left_id", "right_id", F.array_join("comparisons.reason", ",").alias("reasons"), "status", F.col("comparisons")[1]["difference"].alias("difference"))


# -- decimals of any width ---------------------------------------------------------------------------------------------

_WIDE = "l_orderkey % 5 > 0 AND l_linenumber % 3 > 0"


@query(f"""SELECT l_suppkey AS grp, count(*) AS n_records, CASE WHEN count(*) FILTER ({_WIDE}) > 0 THEN CAST(7 * count(*) FILTER ({_WIDE}) AS VARCHAR) || lpad(CAST(sum(CASE WHEN {_WIDE} THEN l_orderkey WHEN l_orderkey % 5 > 0 THEN 2 ELSE 0 END) AS VARCHAR), 50, '0') || '.' || lpad(CAST(count(*) FILTER ({_WIDE}) AS VARCHAR), 9, '0')
 WHEN count(*) FILTER (l_orderkey % 5 > 0) > 0 THEN CAST(2 * count(*) FILTER (l_orderkey % 5 > 0) AS VARCHAR) END AS sum_value,
 CASE WHEN count(*) FILTER (l_orderkey % 5 > 0 AND l_linenumber % 3 = 0) > 0 THEN '+2' WHEN count(*) FILTER ({_WIDE}) > 0 THEN '7' || lpad(CAST(min(l_orderkey) FILTER ({_WIDE}) AS VARCHAR), 50, '0') || '.000000001' END AS min_value FROM lineitem GROUP BY 1""")
def wide_sums(spark, sf):
    v = F.when(F.col("l_orderkey") % 5 == 0, F.when(F.col("l_linenumber") == 1, "007").when(F.col("l_linenumber") == 2, "1e5")).when(F.col("l_linenumber") % 3 == 0, "+2").otherwise(F.concat(F.lit("7"), F.lpad(F.col("l_orderkey").cast("string"), 50, "0"), F.lit(".000000001")))
    good, _ = R.aggregated(table(spark, sf, "lineitem").select(F.lit("").alias("record_id"), F.col("l_suppkey").alias("grp"), v.alias("v")), ["grp"], "v")
    return good.select("grp", "n_records", "sum_value", "min_value")


@query("""SELECT o_orderkey, ['EXACT_MATCH', 'WITHIN_TOLERANCE', 'CONFLICTING_MATCH', 'HUMAN_REVIEW_REQUIRED'][o_orderkey % 4 + 1] AS relative, ['EXACT_MATCH', 'CONFLICTING_MATCH', 'CONFLICTING_MATCH', 'HUMAN_REVIEW_REQUIRED'][o_orderkey % 4 + 1] AS absolute,
 ['0', '3210000000000000000000.000000000', '100000000000000000000000000.000000000', NULL][o_orderkey % 4 + 1] AS difference FROM orders""")
def wide_tolerances(spark, sf):
    k, rule = F.col("o_orderkey"), R.Rule("x", ())
    tail = F.lpad(k.cast("string"), 10, "0")
    left = F.concat(F.lit("12345678901234567"), tail, F.lit(".123456789"))
    right = F.concat(F.when(k % 4 == 0, "12345678901234567").when(k % 4 == 1, "12345999901234567").when(k % 4 == 2, "22345678901234567").otherwise("0"), tail, F.when(k % 4 == 0, ".1234567890").otherwise(".123456789"))
    c = lambda kind, t: R.Component("v", "l", "r", kind, tolerance=t, tolerance_approved=True)
    made = table(spark, sf, "orders").select("o_orderkey", left.alias("l"), right.alias("r")).select("o_orderkey", R.compared(c("DECIMAL_RELATIVE", "0.005"), rule, F.col("l"), F.col("r")).alias("a"), R.compared(c("DECIMAL_ABSOLUTE", "12345678901234567890.5"), rule, F.col("l"), F.when(k % 4 == 1, F.concat(F.lit("9"), F.col("r"))).otherwise(F.col("r"))).alias("b"))
    return made.select("o_orderkey", F.col("a.status").alias("relative"), F.col("b.status").alias("absolute"), F.col("a.difference").alias("difference"))


# -- bands -------------------------------------------------------------------------------------------------------------

_NEAR = f"WITH p AS ({_PO}), i AS ({_INV})"
DATES_ALONE = R.Rule("po-days", (R.Component("issue_date", "issue_date", "issue_date", "DATE_WINDOW", tolerance=1, tolerance_approved=True), R.Component("amount", "amount", "amount", "DECIMAL_ABSOLUTE", tolerance="20000", tolerance_approved=True)), cardinality="MANY_TO_MANY")
AMOUNTS_ALONE = R.Rule("po-amounts", (R.Component("amount", "amount", "amount", "DECIMAL_ABSOLUTE", tolerance="2.50", tolerance_approved=True),), cardinality="ONE_TO_ONE")


@query(f"{_NEAR} SELECT p.record_id AS left_id, i.record_id AS right_id, CASE WHEN abs(p.amount - i.amount) > 20000 THEN 'CONFLICTING_MATCH' WHEN p.d = i.d AND p.amount = i.amount THEN 'EXACT_MATCH' ELSE 'WITHIN_TOLERANCE' END AS status FROM p JOIN i ON p.d BETWEEN i.d - INTERVAL 1 DAY AND i.d + INTERVAL 1 DAY")
def date_band(spark, sf):
    return R.pairs_of(orders(spark, sf), invoices(spark, sf), DATES_ALONE, told=False).select("left_id", "right_id", "status")


@query(f"{_NEAR}, m AS (SELECT p.record_id AS left_id, i.record_id AS right_id, CASE WHEN p.amount = i.amount THEN 'EXACT_MATCH' ELSE 'WITHIN_TOLERANCE' END AS status FROM p JOIN i ON p.amount BETWEEN i.amount - 2.50 AND i.amount + 2.50) SELECT left_id, right_id, status FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS a, count(*) OVER (PARTITION BY right_id) AS b FROM m) WHERE a = 1 AND b = 1")
def amount_band(spark, sf):
    left, right = R.lone_in_band(orders(spark, sf), invoices(spark, sf), AMOUNTS_ALONE)
    return R.links_of(R.resolved(R.pairs_of(left, right, AMOUNTS_ALONE, told=False), AMOUNTS_ALONE)).select("left_id", "right_id", "status")


# -- group keys --------------------------------------------------------------------------------------------------------

_KEY = """CASE event_id % 6 WHEN 0 THEN CAST(user_id % 5 AS STRING) WHEN 1 THEN concat('"', user_id % 5, '"') WHEN 2 THEN concat('{"b":1,"a":[', user_id % 5, ',null]}') WHEN 3 THEN concat('{ "a" : [', user_id % 5, ', null], "b": 1 }') WHEN 4 THEN '{"a":NaN}' END"""


@query("""WITH e AS (SELECT CASE event_id % 6 WHEN 0 THEN CAST(user_id % 5 AS VARCHAR) WHEN 1 THEN '"' || user_id % 5 || '"' WHEN 2 THEN '{"a":[' || user_id % 5 || ',null],"b":1}' WHEN 3 THEN '{"a":[' || user_id % 5 || ',null],"b":1}' END AS g, CAST(value AS DECIMAL(18,2)) AS v FROM events)
 SELECT g, count(*) AS n_records, CASE WHEN sum(v) = 0 THEN '0' ELSE CAST(CAST(sum(v) AS DECIMAL(18,2)) AS VARCHAR) END AS sum_value FROM e WHERE g IS NOT NULL GROUP BY g""")
def json_groups(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("record_id"), F.expr(_KEY).alias("g"), F.col("value").cast("decimal(18,2)").cast("string").alias("v"))
    return R.aggregated(rows, ["g"], "v", json_keys=("g",))[0].select("g", "n_records", "sum_value")


@query("SELECT event_id AS record_id, CASE WHEN event_id % 6 = 4 THEN 'GROUP_VALUE_NOT_CANONICAL_JSON' WHEN event_id % 6 = 5 THEN 'GROUP_FIELD_MISSING' ELSE 'DECIMAL_VALUE_MISSING_OR_INVALID' END AS reason FROM events WHERE event_id % 6 > 3 OR event_id % 10 = 0")
def json_group_rejects(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("record_id"), F.expr(_KEY).alias("g"), F.when(F.col("event_id") % 10 == 0, "-.5").otherwise("-0.5").alias("v"))
    return R.aggregated(rows, ["g"], "v", json_keys=("g",))[1]


@query("SELECT CAST(event_id % 3 AS INTEGER) AS kind, CAST(user_id % 4 AS INTEGER) AS k, count(*) AS n_records FROM events GROUP BY 1, 2")
def typed_groups(spark, sf):
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN CAST(user_id % 4 AS STRING) WHEN 1 THEN concat('"', user_id % 4, '"') ELSE concat(CASE WHEN event_id % 2 = 0 THEN '{"b":1,"a":' ELSE '{"a":' END, user_id % 4, CASE WHEN event_id % 2 = 0 THEN '}' ELSE ',"b":1}' END) END""")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("record_id"), F.parse_json(text).alias("g"), F.lit("1").alias("v"))
    good = R.aggregated(rows, ["g"], "v")[0]
    return good.select(F.when(F.startswith("g", F.lit("{")), 2).when(F.startswith("g", F.lit('"')), 1).otherwise(0).alias("kind"), F.regexp_extract("g", "[0-9]", 0).cast("int").alias("k"), "n_records")


# -- field names -------------------------------------------------------------------------------------------------------

#: Field names of a part: a word, at times with another one and in another case.
_FIRST = ("bank_account", "quantity", "price", "tax", "currency", "amount", "issue", "vendor", "account", "unit", "sub", "tax_amount", "customer", "po", "date", "total_amount", "vat_rate", "seller_bank_account", "note")
_LAST = ("", "_date", "_price", "total", "_po", "_number", "_id", "_name", "_code", "_period")


def _name(key: str, step: int) -> str:
    words = "CASE " + " ".join(f"WHEN ({key} * {step}) % {len(_FIRST)} = {i} THEN '{w}'" for i, w in enumerate(_FIRST)) + " END"
    ends = "CASE " + " ".join(f"WHEN ({key} // {step} ) % {len(_LAST)} = {i} THEN '{w}'" for i, w in enumerate(_LAST)) + " END"
    return f"CASE WHEN {key} % 3 = 0 THEN upper(concat({words}, {ends})) ELSE concat({words}, {ends}) END"


def _in(names) -> str:
    own = ", ".join(f"'{x}'" for x in names)
    return f"(lower(l) IN ({own}) OR lower(r) IN ({own}))"


@query(f"SELECT p_partkey, CASE WHEN {_in(('account_number', 'bank_account', 'bank_account_number', 'beneficiary_account', 'beneficiary_account_number', 'beneficiary_bank_account', 'payee_account', 'payee_bank_account'))} THEN 'BANK_ACCOUNT_MISMATCH' WHEN {_in(('quantity', 'ordered_quantity', 'received_quantity', 'invoiced_quantity'))} THEN 'QUANTITY_MISMATCH'"
       f" WHEN {_in(('unit_price', 'price', 'unit_cost'))} THEN 'PRICE_MISMATCH' WHEN {_in(('tax', 'tax_amount', 'tax_rate', 'vat_amount', 'vat_rate'))} THEN 'TAX_MISMATCH' WHEN {_in(('currency', 'currency_code'))} THEN 'CURRENCY_MISMATCH' WHEN {_in(('amount', 'gross_amount', 'net_amount', 'total_amount', 'payment_amount'))} THEN 'AMOUNT_MISMATCH'"
       f" WHEN c = 'DATE_WINDOW' OR lower(l) LIKE '%\\_date' ESCAPE '\\' OR lower(r) LIKE '%\\_date' ESCAPE '\\' OR {_in(('date',))} THEN 'DATE_MISMATCH' WHEN {_in(('party', 'party_id', 'vendor', 'vendor_id', 'customer', 'customer_id'))} THEN 'PARTY_MISMATCH' WHEN c = 'IDENTIFIER_EXACT' THEN 'REFERENCE_MISMATCH' ELSE 'SYSTEM_DOCUMENT_MISMATCH' END AS kind"
       f" FROM (SELECT p_partkey, {_name('p_partkey', 1)} AS l, {_name('p_partkey', 7)} AS r, ['IDENTIFIER_EXACT', 'EXACT_TEXT', 'DATE_WINDOW'][p_size % 3 + 1] AS c FROM part)")
def discrepancy_types(spark, sf):
    sql = lambda step: F.expr(_name("p_partkey", step).replace("//", "div"))
    rows = table(spark, sf, "part").select("p_partkey", sql(1).alias("l"), sql(7).alias("r"), F.element_at(F.array(*map(F.lit, ("IDENTIFIER_EXACT", "EXACT_TEXT", "DATE_WINDOW"))), F.col("p_size") % 3 + 1).alias("c"))
    return rows.select("p_partkey", R.discrepancy_type_of(F.col("l"), F.col("r"), F.col("c")).alias("kind"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(n, 'amount|total|balance|price') THEN 'CURRENCY_AMOUNT' WHEN regexp_matches(n, 'quantity|qty') THEN 'QUANTITY' WHEN regexp_matches(n, '_date$|^date$') THEN 'DATE' WHEN contains(n, 'account') THEN CASE WHEN t THEN 'BANK_ACCOUNT' ELSE 'TEXT' END WHEN regexp_matches(n, 'number|_id|code|reference') AND t THEN 'IDENTIFIER' ELSE 'TEXT' END AS type FROM (SELECT p_partkey, {_name('p_partkey', 1)} AS n, p_size % 2 = 0 AS t FROM part)")
def type_inference(spark, sf):
    name = F.expr(_name("p_partkey", 1).replace("//", "div"))
    return table(spark, sf, "part").select("p_partkey", X.inferred_type(name, F.when(F.col("p_size") % 2 == 0, "STRING").otherwise("BIGINT")).alias("type"))


@query(f"SELECT p_partkey, regexp_matches(lower({_name('p_partkey', 7)}), '(id|number|account|reference|code|sha256|checksum)$') AS as_text FROM part")
def identifier_columns(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.identifier_column(F.expr(_name("p_partkey", 7).replace("//", "div"))).alias("as_text"))


# -- rules of document types -------------------------------------------------------------------------------------------

RULES = T.load_rules()
_INVOICE = """concat('{"invoice_number":', CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS STRING) ELSE concat('"', o_orderkey, '"') END, ',"invoice_date":"', CASE WHEN o_orderkey % 5 = 0 THEN '03/04/2024' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END, '","seller_name":"s"', CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ',"buyer_name":"b"' END,
 ',"currency":"USD","subtotal":"', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '","tax_amount":"1.50","discount_amount":"0.50","total_amount":"', CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS STRING), '"}')"""
_ORDER = """concat('{"po_number":"', o_orderkey, '","po_date":"', CAST(CAST(o_orderdate AS DATE) AS STRING), '","buyer_name":"b","vendor_name":"v","currency":"USD","total_po_amount":"', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '"}')"""
_STATEMENT = """concat('{"statement_reference":"', c_custkey, '","account_number":"0', c_custkey, '","account_holder_name":"h","statement_currency":"USD","statement_start_date":"2024-01-', CASE WHEN c_custkey % 4 = 0 THEN '31' ELSE '01' END, '","statement_end_date":"2024-01-30"', CASE WHEN c_custkey % 6 = 1 THEN ',"statement_generated_date":"2024-1-31"' ELSE '' END,
 ',"opening_balance":"', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING), '","total_credits":"10.25","total_debits":"0.25","closing_balance":"', CAST(CAST(c_acctbal AS DECIMAL(18,2)) + CASE WHEN c_custkey % 9 = 0 THEN 9.99 ELSE 10 END AS STRING), '"}')"""


def _typed_fields(text):
    return F.try_variant_get(X.strict_json(text), "$", "map<string,variant>").alias("fields")


def _purchase_lines(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    money = lambda c, k: F.col(c).cast(k).cast("string")
    text = F.to_json(F.struct(money("l_quantity", "decimal(10,2)").alias("ordered_quantity"), money("p_retailprice", "decimal(12,2)").alias("unit_price"), money("l_extendedprice", "decimal(18,2)").alias("line_value")))
    return rows.select(F.concat(F.lit("PO-"), "l_orderkey").alias("document_id"), F.lit("PURCHASE_ORDER").alias("document_type"), "l_linenumber", _typed_fields(text))


@query("""SELECT 'I-' || o_orderkey AS document_id, t.* FROM orders, LATERAL (VALUES ('invoice.required-status', 'CRITICAL', 'FAIL', CASE WHEN o_orderkey % 11 = 0 THEN 'MISSING:buyer_name' END), ('invoice.identifier-text', 'HIGH', 'FAIL', CASE WHEN o_orderkey % 7 = 0 THEN 'NOT_TEXT:invoice_number' END),
 ('invoice.date-ambiguity', 'HIGH', 'REVIEW', CASE WHEN o_orderkey % 5 = 0 THEN 'AMBIGUOUS_DATE:invoice_date' END), ('invoice.grand-total', 'CRITICAL', 'FAIL', CASE WHEN o_orderkey % 3 = 0 THEN 'DIFFERENCE:-1.00' END)) t(rule_id, severity, outcome, reason) WHERE reason IS NOT NULL
 UNION ALL SELECT 'PO-' || o_orderkey, 'po.grand-total', 'CRITICAL', 'FAIL', 'DIFFERENCE:' || CAST(t - s AS VARCHAR) FROM (SELECT o_orderkey, CAST(any_value(o_totalprice) AS DECIMAL(18,2)) AS t, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1) WHERE t <> s
 UNION ALL SELECT 'S-' || c_custkey, t.* FROM customer, LATERAL (VALUES ('bank-statement.period-order', 'CRITICAL', CASE WHEN c_custkey % 6 = 1 THEN 'REVIEW' ELSE 'FAIL' END, CASE WHEN c_custkey % 6 = 1 THEN 'DATE_NOT_CANONICAL:statement_generated_date' WHEN c_custkey % 4 = 0 THEN 'DATES_OUT_OF_ORDER' END),
 ('bank-statement.balance', 'CRITICAL', 'FAIL', CASE WHEN c_custkey % 9 = 0 THEN 'DIFFERENCE:-0.01' END)) t(rule_id, severity, outcome, reason) WHERE reason IS NOT NULL""")
def type_rule_failures(spark, sf):
    make = lambda name, key, mark, kind, text: table(spark, sf, name).select(F.concat(F.lit(mark), key).alias("document_id"), F.lit(kind).alias("document_type"), _typed_fields(F.expr(text)))
    docs = make("orders", "o_orderkey", "I-", "INVOICE", _INVOICE).unionByName(make("orders", "o_orderkey", "PO-", "PURCHASE_ORDER", _ORDER)).unionByName(make("customer", "c_custkey", "S-", "BANK_STATEMENT", _STATEMENT))
    ready = T.with_line_sums(docs, _purchase_lines(spark, sf), [r for r in RULES if r.document_type == "PURCHASE_ORDER"])
    return T.failing(T.rule_outcomes(ready, RULES)).select("document_id", "rule_id", "severity", "outcome", "reason")


@query("SELECT 'PO-' || l_orderkey AS document_id, 'DIFFERENCE:' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(24,4)) AS VARCHAR) AS reason FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_extendedprice AS DECIMAL(18,2)) <> CAST(l_quantity AS DECIMAL(10,2)) * CAST(p_retailprice AS DECIMAL(12,2))")
def line_rule_failures(spark, sf):
    return T.failing(T.rule_outcomes(_purchase_lines(spark, sf), RULES, "line")).select("document_id", "reason")


# -- binary files ------------------------------------------------------------------------------------------------------

_NEEDLES = ("the", "password", "ü", "://")


@query(" UNION ALL ".join(f"SELECT '{n}' AS needle, CAST(sum((length(text) - length(replace(text, '{n}', ''))) // {len(n)}) AS BIGINT) AS n FROM documents" for n in _NEEDLES))
def range_scan(spark, sf):
    path = scratch(spark, "texts")
    table(spark, sf, "documents").where("text IS NOT NULL").select("text").write.text(path)
    found = B.needle_counts(spark, path, _NEEDLES, range_bytes=100_000)
    return found.select(F.explode("found").alias("needle", "n")).groupBy("needle").agg(F.sum("n").alias("n"))


# -- order over whole tables and hot groups ----------------------------------------------------------------------------


@query("SELECT doc_id, CAST(sum(strlen(text)) OVER (ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes, strlen(text) > 20000 OR sum(strlen(text)) OVER (ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING) > 1000000 AS over FROM documents")
def package_bytes(spark, sf):
    members = table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("position"), F.octet_length("text").cast("long").alias("size"))
    return C.package_bytes(members, 1_000_000, 20_000).select(F.col("position").alias("doc_id"), "bytes", "over")


_CHAINS = "SELECT o_orderkey AS k, o_orderkey // 7 AS b, (SELECT max(o_orderkey) FROM orders) AS m FROM orders"


@query(f"SELECT k AS document_id, CASE WHEN c THEN NULL ELSE least(b * 7 + 6, m) END AS current, CASE WHEN c THEN NULL ELSE least(b * 7 + 6, m) - k END AS steps, CASE WHEN c THEN 'CYCLE' WHEN least(b * 7 + 6, m) = k THEN 'CURRENT' ELSE 'SUPERSEDED' END AS state FROM (SELECT *, b % 5 = 0 AND b * 7 + 6 <= m AS c FROM ({_CHAINS})) WHERE NOT (k = m AND k % 7 = 0)")
def version_chains(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    onward = keys.where("k % 7 < 6").select(F.col("k").alias("earlier"), (F.col("k") + 1).alias("later")).join(keys.select(F.col("k").alias("later")), "later", "left_semi").select("earlier", "later")
    return K.version_chains(onward.unionByName(keys.where("k % 35 = 6").select(F.col("k").alias("earlier"), (F.col("k") - 6).alias("later"))))


# -- slides ------------------------------------------------------------------------------------------------------------

_TOP, _BOTTOM, _GAP, _ROW = 300_000, 6_558_000, 120_000, 350_000
_BLOCKS = """SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'HEADING' WHEN turn % 5 = 3 THEN 'TABLE' WHEN turn % 5 = 4 THEN 'CAPTION' ELSE 'PARAGRAPH' END AS kind, CASE WHEN turn % 5 = 3 THEN NULL ELSE concat(repeat(text, CAST(1 + turn % 4 * 12 AS INT)), CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END) END AS text, CAST(CASE WHEN turn % 5 = 3 THEN length(text) % 70 END AS INT) AS n_rows FROM conversations"""


def _measured(kind: str, a, b, c, d) -> str:
    return f"CASE {kind} WHEN 'HEADING' THEN {a} WHEN 'PARAGRAPH' THEN {b} WHEN 'CAPTION' THEN {c} ELSE {d} END"


@query(f"""WITH RECURSIVE m AS (SELECT *, {_measured('kind', 58, 105, 120, 1)} AS per, {_measured('kind', 430_000, 285_000, 240_000, _ROW)} AS lh, {_measured('kind', 100_000, 90_000, 80_000, _ROW)} AS pad FROM ({_BLOCKS})),
 b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, kind, lh, pad, kind = 'TABLE' AS tab, coalesce(n_rows, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, CAST(ceil(length(x) / per) AS BIGINT)))) AS BIGINT)) AS n, coalesce(text LIKE '%' || chr(10), false) AS tail FROM m WHERE kind = 'TABLE' OR text <> ''),
 f AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS piece, CAST(n AS BIGINT) AS rest, CAST(1 AS BIGINT) AS slide, CAST({_TOP} AS BIGINT) AS y, false AS filled, CAST(NULL AS BIGINT) AS e_turn, CAST(0 AS BIGINT) AS e_piece, CAST(0 AS BIGINT) AS e_slide, CAST(0 AS BIGINT) AS e_y, CAST(0 AS BIGINT) AS e_units, CAST(0 AS BIGINT) AS e_height FROM b WHERE i = 1
 UNION ALL SELECT conv_id, i + CAST(done AS INT), CASE WHEN done THEN 0 ELSE piece + 1 END, CASE WHEN done THEN coalesce(next_n, 0) ELSE rest - take END, s2 + CASE WHEN done THEN 0 ELSE 1 END, CASE WHEN done THEN y2 + h + {_GAP} ELSE {_TOP} END, done, turn, piece, s2, y2, take, h FROM (
 SELECT *, rest - take <= 0 OR (NOT tab AND rest - take = 1 AND tail) AS done, pad + CASE WHEN tab THEN take ELSE greatest(take, 1) END * lh AS h FROM (
 SELECT *, least(rest, greatest(CASE WHEN tab THEN ({_BOTTOM} - y2) // {_ROW} - 1 ELSE ({_BOTTOM} - y2 - pad) // lh END, 0)) AS take FROM (
 SELECT *, s1 + CAST(moved AND filled1 AS INT) AS s2, CASE WHEN moved THEN {_TOP} ELSE y1 END AS y2 FROM (
 SELECT *, CASE WHEN tab AND rest = 0 THEN {_BOTTOM} - y1 < {_ROW} WHEN tab THEN ({_BOTTOM} - y1) // {_ROW} - 1 < 1 ELSE ({_BOTTOM} - y1 - pad) // lh < 1 END AS moved FROM (
 SELECT f.conv_id, f.i, f.piece, f.rest, b.turn, b.tab, b.tail, b.lh, b.pad, nb.n AS next_n, f.slide + CAST(b.kind = 'HEADING' AND f.piece = 0 AND f.filled AS INT) AS s1, CASE WHEN b.kind = 'HEADING' AND f.piece = 0 AND f.filled THEN {_TOP} ELSE f.y END AS y1, f.filled AND NOT (b.kind = 'HEADING' AND f.piece = 0) AS filled1
 FROM f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i LEFT JOIN b nb ON nb.conv_id = f.conv_id AND nb.i = f.i + 1))))))
 SELECT conv_id AS document_id, e_turn AS reading_order, e_piece AS piece, e_slide AS slide, e_units AS units, e_y AS y, e_height AS height FROM f WHERE e_turn IS NOT NULL""")
def slide_pieces(spark, sf):
    blocks = spark.sql(_BLOCKS.replace("FROM conversations", "FROM {turns}"), turns=table(spark, sf, "conversations")).select(F.col("conv_id").alias("document_id"), F.col("turn").alias("reading_order"), F.col("kind").alias("block_type"), "text", "n_rows", F.lit(None).cast("int").alias("height"))
    return S.slide_pieces(blocks).select("document_id", "reading_order", "piece", "slide", "units", "y", "height")
