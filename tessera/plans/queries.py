"""Queries over the supplied tables, with their SQL.

Orders are purchase orders and the sums of their lines are invoices; documents are files and their lines blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fields as X
from ..operators import content as C
from ..operators import inventory as I
from ..operators import reconcile as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MONEY = "decimal(18,2)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.concat(F.lit("PO-"), "o_orderkey").alias("record_id"), F.col("o_orderkey").cast("string").alias("po_number"), F.col("o_totalprice").cast(MONEY).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issue_date"))


def invoices(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amount"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("issue_date"))
    return lines.select(F.concat(F.lit("INV-"), "l_orderkey").alias("record_id"), F.col("l_orderkey").cast("string").alias("po_number"), "amount", "issue_date")


def lines(spark, sf) -> DataFrame:
    """Invoices of one order, supplier and ship day: several for an order."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("d")).agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amount"))
    return rows.select(F.concat_ws("-", F.lit("INV"), "l_orderkey", "l_suppkey", F.date_format("d", "yyyyMMdd")).alias("record_id"), F.col("l_orderkey").cast("string").alias("po_number"), "amount")


PO = R.Component("po_number", "po_number", "po_number", "IDENTIFIER_EXACT")
TOLERANT = R.Rule("po-invoice", (PO, R.Component("amount", "amount", "amount", "DECIMAL_RELATIVE", tolerance="0.5", tolerance_approved=True)))
ABSOLUTE = R.Rule("po-invoice-absolute", (PO, R.Component("amount", "amount", "amount", "DECIMAL_ABSOLUTE", tolerance="50000", tolerance_approved=True)))
PARTIAL = R.Rule("po-lines", (PO, R.Component("amount", "amount", "amount", "DECIMAL_ABSOLUTE")), cardinality="ONE_TO_MANY", partial="RIGHT_LESS_THAN_LEFT", partial_approved=True)
DATES = R.Rule("po-dates", (PO, R.Component("issue_date", "issue_date", "issue_date", "DATE_WINDOW", tolerance=400, tolerance_approved=True)))

_PO = "SELECT 'PO-' || o_orderkey AS record_id, CAST(o_orderkey AS VARCHAR) AS po, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS d FROM orders"
_INV = "SELECT 'INV-' || l_orderkey AS record_id, CAST(l_orderkey AS VARCHAR) AS po, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, CAST(min(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY l_orderkey"
_LINES = "SELECT concat_ws('-', 'INV', l_orderkey, l_suppkey, strftime(CAST(l_shipdate AS DATE), '%Y%m%d')) AS record_id, CAST(l_orderkey AS VARCHAR) AS po, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount FROM lineitem GROUP BY l_orderkey, l_suppkey, CAST(l_shipdate AS DATE)"
_REL = f"WITH p AS ({_PO}), i AS ({_INV}), m AS (SELECT p.record_id AS left_id, i.record_id AS right_id, CASE WHEN p.amount = i.amount THEN 'EXACT_MATCH' WHEN abs(i.amount - p.amount) <= 0.5 * greatest(p.amount, i.amount) THEN 'WITHIN_TOLERANCE' ELSE 'CONFLICTING_MATCH' END AS status FROM p JOIN i USING (po))"
_ONE_MANY = f"WITH p AS ({_PO}), i AS ({_LINES}), m AS (SELECT p.record_id AS left_id, i.record_id AS right_id, p.amount AS la, i.amount AS ra, CASE WHEN p.amount = i.amount THEN 'EXACT_MATCH' WHEN i.amount < p.amount THEN 'PARTIAL_MATCH' ELSE 'CONFLICTING_MATCH' END AS status FROM p JOIN i USING (po))"


def pairs(spark, sf, rule, right=invoices) -> DataFrame:
    return R.pairs_of(orders(spark, sf), right(spark, sf), rule)


@query(f"{_REL} SELECT left_id, right_id, status FROM m WHERE status <> 'CONFLICTING_MATCH'")
def reconcile_links_keyed(spark, sf):
    return R.links_of(R.resolved(pairs(spark, sf, TOLERANT), TOLERANT)).select("left_id", "right_id", "status")


@query(f"{_REL} SELECT left_id, right_id, status FROM m")
def tolerance_relative(spark, sf):
    return pairs(spark, sf, TOLERANT).select("left_id", "right_id", "status")


@query(f"WITH p AS ({_PO}), i AS ({_INV}) SELECT p.record_id AS left_id, i.record_id AS right_id, CASE WHEN p.amount = i.amount THEN 'EXACT_MATCH' WHEN abs(i.amount - p.amount) <= 50000 THEN 'WITHIN_TOLERANCE' ELSE 'CONFLICTING_MATCH' END AS status FROM p JOIN i USING (po)")
def tolerance_absolute(spark, sf):
    return pairs(spark, sf, ABSOLUTE).select("left_id", "right_id", "status")


@query(f"WITH p AS ({_PO}), i AS ({_INV}) SELECT p.record_id AS left_id, i.record_id AS right_id, CASE WHEN p.d = i.d THEN 'EXACT_MATCH' WHEN abs(date_diff('day', p.d, i.d)) <= 400 THEN 'WITHIN_TOLERANCE' ELSE 'CONFLICTING_MATCH' END AS status FROM p JOIN i USING (po)")
def date_window(spark, sf):
    return pairs(spark, sf, DATES).select("left_id", "right_id", "status")


@query(f"{_REL} SELECT record_id FROM p WHERE record_id NOT IN (SELECT left_id FROM m WHERE status <> 'CONFLICTING_MATCH')")
def unmatched_left(spark, sf):
    return R.unmatched(orders(spark, sf), R.resolved(pairs(spark, sf, TOLERANT), TOLERANT), "left").select("record_id")


@query(f"{_REL} SELECT record_id FROM i WHERE record_id NOT IN (SELECT right_id FROM m WHERE status <> 'CONFLICTING_MATCH')")
def unmatched_right(spark, sf):
    return R.unmatched(invoices(spark, sf), R.resolved(pairs(spark, sf, TOLERANT), TOLERANT), "right").select("record_id")


@query(f"{_ONE_MANY}, q AS (SELECT *, count(*) OVER (PARTITION BY left_id) AS n FROM m WHERE status <> 'CONFLICTING_MATCH') SELECT left_id, string_agg(right_id, ',' ORDER BY right_id) AS candidates FROM q WHERE n > 1 GROUP BY left_id")
def ambiguous_candidates(spark, sf):
    rule = R.Rule("po-lines-1", PARTIAL.components, partial=PARTIAL.partial, partial_approved=True)
    return R.ambiguities(R.resolved(pairs(spark, sf, rule, lines), rule)).select("left_id", F.array_join("candidates", ",").alias("candidates"))


@query(f"{_ONE_MANY} SELECT left_id, right_id, status FROM m WHERE status <> 'CONFLICTING_MATCH'")
def one_to_many(spark, sf):
    return R.links_of(R.resolved(pairs(spark, sf, PARTIAL, lines), PARTIAL)).select("left_id", "right_id", "status")


@query(f"{_ONE_MANY} SELECT right_id AS left_id, left_id AS right_id, status FROM m WHERE status <> 'CONFLICTING_MATCH'")
def many_to_one(spark, sf):
    rule = R.Rule("lines-po", PARTIAL.components, cardinality="MANY_TO_ONE", partial="LEFT_LESS_THAN_RIGHT", partial_approved=True)
    return R.links_of(R.resolved(R.pairs_of(lines(spark, sf), orders(spark, sf), rule), rule)).select("left_id", "right_id", "status")


@query(f"{_ONE_MANY}, a AS (SELECT *, sum(ra) OVER (PARTITION BY left_id) AS total FROM m WHERE status = 'PARTIAL_MATCH') SELECT left_id, right_id, CAST(ra AS VARCHAR) AS allocated, CAST(la AS VARCHAR) AS capacity, CASE WHEN total > la THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PARTIAL_MATCH' END AS status FROM a")
def allocations(spark, sf):
    found = R.allocations(R.links_of(R.resolved(pairs(spark, sf, PARTIAL, lines), PARTIAL)))
    return found.select("left_id", "right_id", F.col("allocated").cast(MONEY).cast("string").alias("allocated"), F.col("capacity").cast(MONEY).cast("string").alias("capacity"), "status")


@query(f"{_ONE_MANY} SELECT left_id, CAST(CAST(sum(ra) AS DECIMAL(18,2)) AS VARCHAR) AS total FROM m WHERE status = 'PARTIAL_MATCH' GROUP BY left_id, la HAVING sum(ra) > la")
def over_allocation(spark, sf):
    found = R.allocations(R.links_of(R.resolved(pairs(spark, sf, PARTIAL, lines), PARTIAL)))
    return found.where("reason IS NOT NULL").select("left_id", F.col("total").cast(MONEY).cast("string").alias("total")).distinct()


@query(f"{_ONE_MANY}, t AS (SELECT *, sum(ra) OVER (PARTITION BY left_id) AS total FROM m) SELECT left_id, right_id, CASE WHEN la = ra THEN 'EXACT_MATCH' WHEN total <= la THEN 'PARTIAL_MATCH' ELSE 'CONFLICTING_MATCH' END AS status FROM t")
def partial_aggregated(spark, sf):
    rule = R.Rule("po-lines-total", PARTIAL.components, cardinality="ONE_TO_MANY", partial="AGGREGATED_RIGHT_NOT_ABOVE_LEFT", partial_approved=True, aggregate="group_total")
    return R.pairs_of(orders(spark, sf), R.with_group_total(lines(spark, sf), ["po_number"], "amount", "group_total"), rule).select("left_id", "right_id", "status")


@query(f"{_REL} SELECT left_id, right_id, 'AMOUNT_MISMATCH' AS type, 'MEDIUM' AS severity FROM m WHERE status = 'CONFLICTING_MATCH'")
def discrepancy_taxonomy(spark, sf):
    return R.discrepancies(pairs(spark, sf, TOLERANT), TOLERANT).select("left_id", "right_id", "type", "severity")


@query(f"{_REL} SELECT CASE WHEN bool_or(status = 'CONFLICTING_MATCH') THEN 'CONDITIONAL' WHEN bool_or(status = 'WITHIN_TOLERANCE') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS run_status FROM m")
def run_status(spark, sf):
    found = pairs(spark, sf, TOLERANT)
    return R.run_status(found.select(F.when(F.col("status") == "CONFLICTING_MATCH", "HUMAN_REVIEW_REQUIRED").otherwise(F.col("status")).alias("status")), 0)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS grp, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS VARCHAR) AS sum_value, count(*) AS n_records, CAST(CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS VARCHAR) AS min_value, CAST(CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS VARCHAR) AS max_value FROM lineitem GROUP BY l_orderkey")
def aggregations(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.lit("").alias("record_id"), F.col("l_orderkey").cast("string").alias("grp"), F.col("l_extendedprice").cast(MONEY).alias("v"))
    good, _ = R.aggregated(rows, ["grp"], "v")
    return good.select("grp", *[F.col(c).cast(MONEY).cast("string").alias(c) if c != "n_records" else F.col(c) for c in ("sum_value", "n_records", "min_value", "max_value")])


@query("SELECT event_id AS record_id, CASE WHEN event_id % 10 = 0 THEN 'GROUP_FIELD_MISSING' ELSE 'DECIMAL_VALUE_MISSING_OR_INVALID' END AS reason FROM events WHERE event_id % 10 = 0 OR event_id % 7 = 0")
def aggregation_rejects(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("record_id"), F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("grp"), F.when(F.col("event_id") % 7 == 0, "007").otherwise("7.50").alias("v"))
    return R.aggregated(rows, ["grp"], "v")[1]


@query("SELECT * FROM (VALUES ('BANK_TRANSACTION', 'MISSING_REQUIRED_ROLE'), ('GOODS_RECEIPT', 'MISSING_REQUIRED_ROLE')) t(role, type)")
def required_role_missing(spark, sf):
    records = orders(spark, sf).select(F.lit("PURCHASE_ORDER").alias("role")).unionByName(invoices(spark, sf).select(F.lit("INVOICE").alias("role")))
    return R.missing_roles(spark.createDataFrame([("PURCHASE_ORDER",), ("INVOICE",), ("GOODS_RECEIPT",), ("BANK_TRANSACTION",)], "role string"), records)


@query("SELECT 'INVOICE' AS role, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'PURCHASE_ORDER', count(*) FROM orders")
def role_counts(spark, sf):
    return orders(spark, sf).select(F.lit("PURCHASE_ORDER").alias("role")).unionByName(invoices(spark, sf).select(F.lit("INVOICE").alias("role"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'CONTRACT' WHEN 'de' THEN 'AMBIGUOUS' WHEN 'fr' THEN 'INVOICE' ELSE 'UNCLASSIFIED' END AS role FROM documents")
def role_classification(spark, sf):
    aliases = spark.createDataFrame([("en", "CONTRACT"), ("de", "CONTRACT"), ("de", "INVOICE"), ("fr", "INVOICE")], "document_type string, role string")
    return R.classified(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("document_type")), aliases).select("doc_id", "role")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return I.duplicate_groups(I.with_hash(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text"), "doc_id")


@query("SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY sha256(text)) AS document, doc_id AS duplicate FROM documents) WHERE duplicate > document")
def duplicate_edges(spark, sf):
    return I.duplicate_edges(I.with_hash(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text"), "doc_id").select("document", "duplicate")


@query("SELECT doc_id, 'doc-' || substr(sha256(text), 1, 24) || '-' || lpad(CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS VARCHAR), 4, '0') AS occurrence_id FROM documents")
def occurrence_ids(spark, sf):
    return I.occurrences(I.with_hash(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text"), "doc_id").select("doc_id", "occurrence_id")


@query("SELECT 'XML_TEXT' AS kind, count(*) AS n FROM pages WHERE html IS NOT NULL")
def signatures(spark, sf):
    return table(spark, sf, "pages").where("html IS NOT NULL").select(I.signature(F.col("html").cast("binary"), F.lit(".xml")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_BLOCKS = "b AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)"


def _chunk_sql(width: int, overlap: int) -> str:
    step = width - overlap
    return f"WITH {_BLOCKS}, s AS (SELECT doc_id, l, unnest(generate_series(0, CASE WHEN len(l) > {width} THEN CAST(ceil((len(l) - {width}) / {step}.0) AS BIGINT) ELSE 0 END)) AS k FROM b WHERE len(l) > 0) SELECT doc_id AS document_id, CAST(k + 1 AS INTEGER) AS sequence, CAST(k * {step} AS INTEGER) AS start, CAST(len(l[k * {step} + 1:k * {step} + {width}]) AS INTEGER) AS n_blocks, sha256(array_to_string(l[k * {step} + 1:k * {step} + {width}], chr(10) || chr(10))) AS text_sha256 FROM s"


def _chunks(spark, sf, width, overlap):
    docs = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return C.chunked(docs, width, overlap).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query(_chunk_sql(4, 0))
def chunk_blocks(spark, sf):
    return _chunks(spark, sf, 4, 0)


@query(_chunk_sql(5, 2))
def chunk_overlap(spark, sf):
    return _chunks(spark, sf, 5, 2)


@query(f"WITH {_BLOCKS} SELECT doc_id AS document_id, CAST(len(l) AS BIGINT) AS n_blocks, 0 AS first_block, CAST(len(l) - 1 AS INTEGER) AS last_block FROM b WHERE len(l) > 0")
def block_coverage(spark, sf):
    return C.coverage(C.split_lines(table(spark, sf, "documents"))).select("document_id", "n_blocks", "first_block", "last_block")


_HEADS = "SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN turn % 3 + 1 END AS l FROM conversations"
_LAST = ", ".join(f"last_value(CASE WHEN l = {k} THEN turn END IGNORE NULLS) OVER w AS a{k}, last_value(CASE WHEN l = {k} THEN text END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3))


@query(f"SELECT conv_id AS document_id, turn AS reading_order, coalesce(array_to_string([t1, CASE WHEN a2 > coalesce(a1, -1) THEN t2 ELSE 'UNKNOWN' END, t3][1:d].list_transform(lambda x: coalesce(x, 'UNKNOWN')), ' > '), '') AS path FROM (SELECT conv_id, turn, {_LAST}, coalesce(last_value(l IGNORE NULLS) OVER w, 0) AS d FROM ({_HEADS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))")
def heading_path(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("reading_order"), F.when(F.col("role") == "user", "HEADING").otherwise("PARAGRAPH").alias("block_type"), ((F.col("turn") % 3) + 1).cast("int").alias("level"), "text")
    return C.heading_paths(turns).select("document_id", "reading_order", F.array_join("path", " > ").alias("path"))


@query("SELECT conv_id AS document_id, turn AS position FROM (SELECT *, lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE turn // 2 <= before")
def reading_order_violations(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), F.floor(F.col("turn") / 2).alias("reading_order"))
    return C.order_violations(turns).select("document_id", "position")


@query("SELECT conv_id AS document_id, turn AS block_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def dangling_parents(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("block_id"), (F.col("turn") + 1).alias("parent_block_id"))
    return C.dangling(turns).select("document_id", "block_id")


@query("SELECT n, CAST(sum(c) AS BIGINT) AS c FROM (SELECT 'c_name' AS n, count(c_name) AS c FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer) GROUP BY n")
def field_long_view(spark, sf):
    long = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment").unpivot("c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], "n", "value")
    return long.where("value IS NOT NULL").groupBy("n").agg(F.count(F.lit(1)).alias("c"))


@query("SELECT doc_id, regexp_matches(text, '^[=+@-]') AS formula FROM documents")
def formula_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.formula_like(F.col("text")).alias("formula"))


@query("SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial FROM orders")
def excel_serial(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.excel_serial(F.to_date("o_orderdate")).cast("long").alias("serial"))


@query("SELECT o_orderkey, length(ltrim(replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * o_orderkey * 1000000 AS VARCHAR), '.', ''), '0')) <= 15 AS precise FROM orders")
def precise_number(spark, sf):
    v = (F.col("o_totalprice").cast(MONEY) * F.col("o_orderkey").cast("decimal(10,0)") * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,2)").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", X.precise_number(v).alias("precise"))


@query("SELECT doc_id, lower(trim(regexp_replace(source || '  ' || lang, '\\s+', ' ', 'g'))) AS value FROM documents")
def normalize_ascii(spark, sf):
    v = F.concat("source", F.lit("  "), "lang")
    return table(spark, sf, "documents").select("doc_id", X.normalized(v, ("COLLAPSE_WHITESPACE", "CASEFOLD_ASCII")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(10,2)) * CAST(p_retailprice AS DECIMAL(12,2))) <= 0.01 AS agrees FROM lineitem JOIN part ON l_partkey = p_partkey")
def line_total_check(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.abs(F.col("l_extendedprice").cast(MONEY) - F.col("l_quantity").cast("decimal(10,2)") * F.col("p_retailprice").cast("decimal(12,2)")) <= F.lit("0.01").cast("decimal(3,2)")).alias("agrees"))


@query("SELECT event_id, CAST(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS VARCHAR) AS balance FROM events")
def running_balance(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.sum(F.col("value").cast(MONEY)).over(w).cast(MONEY).cast("string").alias("balance"))


@query("SELECT doc_id, 'ev-' || substr(sha256('[\"' || doc_id || '\",\"' || source || '\"]'), 1, 24) AS id FROM documents")
def stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.stable_id("ev", F.col("doc_id"), F.col("source")).alias("id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT o_orderkey, len(list_filter(list_distinct(['1-URGENT', o_orderstatus]), lambda x: x NOT IN ('1-URGENT', 'O', 'F'))) = 0 AS contained FROM orders")
def set_contains(spark, sf):
    rule = R.Rule("sets", (R.Component("tags", "l", "r", "SET_CONTAINS"),))
    rows = table(spark, sf, "orders").withColumns({"l": F.array(*map(F.lit, ("1-URGENT", "O", "F"))), "r": F.array(F.lit("1-URGENT"), F.col("o_orderstatus"))})
    return rows.select("o_orderkey", (R.compared(rule.components[0], rule, F.col("l"), F.col("r"))["status"] == "EXACT_MATCH").alias("contained"))


@query("SELECT 'PO-' || o_orderkey AS left_id, 'S-' || s_suppkey AS right_id, count(*) AS n_bridges FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def bridge_links(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order"), F.concat(F.lit("PO-"), "o_orderkey").alias("record_id"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("party"), F.concat(F.lit("S-"), "s_suppkey").alias("record_id"))
    return R.bridged(left, right, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("party")), "order", "party")
