"""Queries of ingest, validation, inventory, content and checks over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..operators import checks as K
from ..operators import content as C
from ..operators import inventory as I
from ..operators import profiles as P
from ..operators import projections as J
from ..operators import reconcile as R
from ..operators import registers as G
from ..operators import validation as V
from ..operators import workflow as W
from ..sinks import office as O
from ..sinks.scratch import kept
from . import profile_queries as PQ
from .queries import MONEY, PARTIAL, _LINES, _ONE_MANY, lines, orders, pairs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- ingest ------------------------------------------------------------------------------------------------------------

#: A document for each order: plain fields, a wrapper, a list and a formula.
_DOC = """concat('{"document_id":"PO-', o_orderkey, '","document_type":"PURCHASE_ORDER"', CASE WHEN o_orderkey % 10 = 0 THEN ',"extra":1' ELSE '' END, ',"fields":{"po_number":"', o_orderkey, '","total_amount":"', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING),
 '","urgent":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"tags":["a","=b"],"priority":{"raw_value":"', CASE WHEN o_orderkey % 3 = 0 THEN '=cmd' ELSE 'x' END, '","normalized_value":', CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"n"' END, ',"provenance":{"source_page":"4"}}}}')"""
_GOOD = "o_orderkey % 10 <> 0"
_WRAP = """concat(CASE o_orderkey % 4 WHEN 0 THEN concat('{"documents":[', d, ',', d, ']}') WHEN 1 THEN concat('[', d, ']') WHEN 2 THEN d ELSE concat(d, '}') END)"""


def payloads(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_DOC).alias("d")).select(F.concat(F.lit("f"), "o_orderkey", F.lit(".json")).alias("source"), F.expr(_WRAP).alias("text"))
    return rows.select("source", "text", X.strict_json(F.col("text")).alias("value"))


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'COLLECTION' WHEN 1 THEN 'ARRAY' WHEN 2 THEN 'DOCUMENT' END AS shape, count(*) AS n FROM orders GROUP BY 1")
def payload_shapes(spark, sf):
    return payloads(spark, sf).groupBy(F.when(F.col("value").isNotNull(), W.payload_shape(F.col("value"))).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'f' || o_orderkey || '.json' AS source, CAST(i AS INTEGER) AS ordinal, 'PO-' || o_orderkey AS document_id, CASE WHEN o_orderkey % 10 = 0 THEN 'UNSUPPORTED_KEYS' END AS issue FROM orders, (VALUES (0), (1)) t(i) WHERE o_orderkey % 4 < 3 AND (i = 0 OR o_orderkey % 4 = 0)")
def parsed_documents(spark, sf):
    return W.documents_of(payloads(spark, sf)).select("source", "ordinal", "document_id", "issue")


def _documents(spark, sf):
    """Every document; the second of a collection, which declares the same id, gets one of its own."""
    docs = W.documents_of(payloads(spark, sf)).where("issue IS NULL")
    return docs.withColumn("document_id", F.when(F.col("ordinal") > 0, F.concat_ws("#", "document_id", "ordinal")).otherwise(F.col("document_id")))


def _fields(spark, sf):
    return W.field_rows(_documents(spark, sf))


_FIELDS = f"""SELECT 'PO-' || o_orderkey || CASE WHEN i > 0 THEN '#1' ELSE '' END AS document_id, t.* FROM orders, (VALUES (0), (1)) o(i), LATERAL (VALUES
 ('po_number', CAST(o_orderkey AS VARCHAR), 'IDENTIFIER', false, 'structured-json:po_number'), ('total_amount', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'CURRENCY_AMOUNT', false, 'structured-json:total_amount'),
 ('urgent', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, 'BOOLEAN', false, 'structured-json:urgent'), ('tags', '["a","=b"]', 'LIST', true, 'structured-json:tags'),
 ('priority', CASE WHEN o_orderkey % 5 <> 0 THEN 'n' WHEN o_orderkey % 3 = 0 THEN '=cmd' ELSE 'x' END, 'TEXT', o_orderkey % 3 = 0, 'structured-json:priority')) t(field_name, effective_value, data_type, formula_injection_flag, source_region) WHERE o_orderkey % 4 < 3 AND (i = 0 OR o_orderkey % 4 = 0) AND {_GOOD}"""


@query(_FIELDS)
def document_fields(spark, sf):
    return _fields(spark, sf).select("document_id", "field_name", "effective_value", "data_type", "formula_injection_flag", "source_region")


@query(f"SELECT field_name, data_type, CASE WHEN bool_or(formula_injection_flag) THEN 'Formula-like text detected and kept non-executable' ELSE 'Follow source package classification' END AS sensitivity FROM ({_FIELDS}) GROUP BY 1, 2")
def field_dictionary(spark, sf):
    return W.field_dictionary(_fields(spark, sf), "P").drop("source_profile")


@query(f"SELECT 'PO' AS role, document_id AS record_id, field_name, effective_value, CASE field_name WHEN 'priority' THEN '4' ELSE 'NOT_APPLICABLE' END AS source_page, 'ev-' || substr(sha256(document_id), 1, 24) AS evidence_id FROM ({_FIELDS})")
def role_field_sheet(spark, sf):
    docs = _documents(spark, sf).select("document_id", F.lit("PO").alias("role"), F.col("document_id").alias("source_document_id"))
    return W.role_field_sheet(_fields(spark, sf), docs).select("role", "record_id", "field_name", "effective_value", "source_page", "evidence_id")


@query(f"SELECT document_id AS record_id, string_agg(field_name || '=' || effective_value, '|' ORDER BY field_name) AS fields FROM ({_FIELDS}) GROUP BY 1")
def mapped_records(spark, sf):
    docs = _documents(spark, sf).select("document_id", F.lit("PO").alias("role"), "document_type", "source")
    made = W.record_map(_fields(spark, sf), docs)
    return made.select("record_id", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("fields"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS flat, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS nested, o_orderstatus AS literal FROM orders")
def mapped_paths(spark, sf):
    inner = F.concat(F.lit('{"c":{"d":"'), "o_orderstatus", F.lit('"}}'))
    m = F.create_map(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("b"), F.when(F.col("o_orderkey") % 2 == 0, inner).otherwise("{}"), F.lit("x.y"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").withColumn("m", m).select("o_orderkey", P.mapped_value(F.col("m"), "a").alias("flat"), P.mapped_value(F.col("m"), "b.c.d").alias("nested"), P.mapped_value(F.col("m"), "x.y").alias("literal"))


@query("SELECT r_name AS source, n_name AS document_id, 'NATION' AS document_type, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'IDENTIFIER' END AS data_type, CASE WHEN n_nationkey % 3 > 0 THEN 'p' || n_nationkey END AS page, CASE WHEN n_nationkey % 3 > 0 THEN 'a,b' END AS notes, CASE WHEN r_regionkey = 4 THEN 'MALFORMED_FIELD' WHEN n_nationkey % 7 = 0 THEN 'MALFORMED_ITEM' END AS issue FROM region JOIN nation ON n_regionkey = r_regionkey")
def package_documents(spark, sf):
    # of two records of a field the last stands; region 4 has one without a name, some items lack a classification
    field = lambda value: F.struct(F.col("n_name").alias("document_id"), F.when((F.col("n_regionkey") < 4) | (F.length(value) > 1), "name").alias("field_name"), F.lit("IDENTIFIER").alias("data_type"), F.struct(value.alias("raw_value")).alias("values"), F.struct(F.concat(F.lit("p"), "n_nationkey").alias("source_page")).alias("provenance"), F.array(F.lit("a"), F.lit("b")).alias("notes"))
    item = F.struct(F.col("n_name").alias("document_id"), F.when(F.col("n_nationkey") % 7 != 0, F.struct(F.lit("NATION").alias("document_type"))).alias("classification"))
    fields = F.when(F.col("n_nationkey") % 3 > 0, F.array(field(F.lit("x")), field(F.col("n_name")))).otherwise(F.array().cast("array<struct<document_id:string,field_name:string,data_type:string,values:struct<raw_value:string>,provenance:struct<source_page:string>,notes:array<string>>>"))
    joined = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    packs = joined.groupBy(F.col("r_name").alias("source")).agg(F.to_json(F.struct(F.collect_list(item).alias("document_inventory"), F.flatten(F.collect_list(fields)).alias("extracted_fields"))).alias("text"))
    docs = W.package_documents(packs.select("source", F.parse_json("text").alias("value")))
    get = lambda path, kind="string": F.try_variant_get(F.try_element_at("fields", F.lit("name")), f"$.{path}", kind)
    return docs.select("source", "document_id", F.coalesce("document_type", F.lit("NATION")).alias("document_type"), get("raw_value").alias("name"), get("data_type").alias("data_type"), get("provenance.source_page").alias("page"), F.array_join(get("notes", "array<string>"), ",").alias("notes"), "issue")


@query("SELECT 'f' || o_orderkey AS source, CAST(i AS INTEGER) AS ordinal, CAST(o_orderkey + i AS BIGINT) AS k FROM orders, (VALUES (0), (1)) t(i) WHERE i = 0 OR o_orderkey % 3 < 2")
def extracted_records(spark, sf):
    text = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('{"records":[{"k":', o_orderkey, '},{"k":', o_orderkey + 1, '}]}') WHEN 1 THEN concat('[{"k":', o_orderkey, '},{"k":', o_orderkey + 1, '}]') ELSE concat('{"k":', o_orderkey, '}') END""")
    rows = table(spark, sf, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("source"), F.parse_json(text).alias("value"))
    return W.extracted_records(rows, "records").select("source", "ordinal", F.try_variant_get("record", "$.k", "long").alias("k"))


@query("SELECT 'f' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.json' END AS source_reference, CASE WHEN o_orderkey % 7 = 0 THEN 'SKIPPED' WHEN o_orderkey % 4 = 3 OR o_orderkey % 10 = 0 THEN 'FAILED' ELSE 'PROCESSED' END AS status, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 3 OR o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS document_count, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported input type' WHEN o_orderkey % 4 = 3 THEN 'not a strict JSON object or array' WHEN o_orderkey % 10 = 0 THEN 'UNSUPPORTED_KEYS' END AS issue FROM orders")
def source_index(spark, sf):
    key = F.regexp_extract("source", r"[0-9]+", 0).cast("long")
    made = payloads(spark, sf).withColumn("source", F.when(key % 7 == 0, F.replace("source", F.lit(".json"), F.lit(".txt"))).otherwise(F.col("source")))
    status = F.when(key % 7 == 0, "SKIPPED").when(F.col("value").isNull(), "FAILED").otherwise("PROCESSED")
    files = made.select("source", F.col("text").cast("binary").alias("content"), status.alias("status"))
    return W.source_index(files, W.documents_of(made.where(key % 7 != 0))).select("source_reference", "status", "document_count", "issue")


def _versions(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id"), F.concat("lang", F.lit("-"), F.col("doc_id") % 50).alias("document_id"), F.concat("source", F.lit("/"), "doc_id").alias("source"), F.sha2("text", 256).alias("content_sha256"))


_VERSIONS = "SELECT doc_id, lang || '-' || (doc_id % 50) AS id, source || '/' || doc_id AS source, sha256(text) AS h FROM documents"


@query(f"SELECT doc_id, id AS source_document_id, CASE WHEN n = 1 THEN id ELSE id || '.dup-' || substr(sha256('{{\"content_sha256\":\"' || h || '\",\"ordinal\":' || i || ',\"source_reference\":\"' || source || '\"}}'), 1, 10) END AS document_id FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY source, h) - 1 AS i FROM ({_VERSIONS}))")
def unique_document_ids(spark, sf):
    return W.unique_ids(_versions(spark, sf)).select("doc_id", "source_document_id", "document_id")


@query(f"SELECT 'DUPLICATE_CONTENT' AS issue_code, h AS key, count(*) AS n FROM ({_VERSIONS}) GROUP BY h HAVING count(*) > 1 UNION ALL SELECT 'DUPLICATE_RECORD_ID', id, count(*) FROM ({_VERSIONS}) GROUP BY id HAVING count(*) > 1")
def duplicate_issues(spark, sf):
    return W.duplicate_issues(W.unique_ids(_versions(spark, sf)))


# -- validation --------------------------------------------------------------------------------------------------------

SCHEMA = {
    "type": "object", "required": ["k", "status"], "additionalProperties": False, "$defs": {"money": {"type": "number", "maximum": 200000}},
    "properties": {"k": {"type": "integer", "minimum": 10}, "status": {"enum": ["O", "F"]}, "total": {"$ref": "#/$defs/money"}, "day": {"type": "string", "format": "date"}, "name": {"type": "string", "pattern": "[02468]$"}},
    "if": {"properties": {"status": {"const": "F"}}}, "then": {"required": ["day"]},
}
_RECORD = """concat('{"k":', o_orderkey, ',"status":"', o_orderstatus, '","total":', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(',"day":"', CASE WHEN o_orderkey % 9 = 0 THEN '2024-02-30' ELSE '2024-02-03' END, '"') END, ',"name":"n', o_orderkey, '"', CASE WHEN o_orderkey % 11 = 0 THEN ',"other":1' WHEN o_orderkey % 13 = 0 THEN ',"k":1' ELSE '' END, '}')"""
_ERRORS = """SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 THEN ['parse'] ELSE list_filter([CASE WHEN o_orderkey < 10 THEN 'minimum' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'enum' END, CASE WHEN o_totalprice > 200000 THEN 'maximum' END,
 CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 9 = 0 THEN 'format' END, CASE WHEN o_orderkey % 2 = 1 THEN 'pattern' END, CASE WHEN o_orderkey % 11 = 0 THEN 'additionalProperties' END, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'required' END], lambda x: x IS NOT NULL) END) AS keyword FROM orders"""


def _checked(spark, sf):
    return V.schema_errors(table(spark, sf, "orders").select("o_orderkey", F.expr(_RECORD).alias("text")), SCHEMA)


@query(_ERRORS)
def schema_errors(spark, sf):
    return V.error_rows(_checked(spark, sf), "o_orderkey").select("o_orderkey", "keyword")


@query(f"SELECT (SELECT count(*) FROM orders) AS n_records, (SELECT count(*) FROM orders) - count(DISTINCT o_orderkey) AS n_valid, count(DISTINCT o_orderkey) AS n_invalid, count(*) AS n_errors, 0 AS n_package_errors, 'INVALID' AS status FROM ({_ERRORS})")
def validation_summary(spark, sf):
    return V.validation_summary(_checked(spark, sf))


@query("SELECT doc_id || '.txt' AS path, CASE WHEN doc_id % 5 = 0 THEN 'BAD_DIGEST' WHEN doc_id % 7 = 0 THEN 'MISSING' ELSE 'MISMATCH' END AS error FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0")
def package_files(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    manifest = docs.select("path", F.when(F.col("doc_id") % 5 == 0, "x").when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return V.package_file_errors(manifest, docs.where(F.col("doc_id") % 7 != 0))


@query("""WITH p AS (SELECT CASE doc_id % 5 WHEN 0 THEN '../' || doc_id WHEN 1 THEN 'A/' || (doc_id // 10) WHEN 2 THEN 'a/' || (doc_id // 10) WHEN 3 THEN 'd' || doc_id ELSE 'd' || (doc_id - 1) || '/f' END AS path FROM documents)
SELECT path, 'UNSAFE' AS error FROM p WHERE path LIKE '../%' UNION ALL SELECT path, 'CASE_COLLISION' FROM p WHERE lower(path) IN (SELECT lower(path) FROM p GROUP BY 1 HAVING count(DISTINCT path) > 1) UNION ALL SELECT path, 'PREFIX_COLLISION' FROM p WHERE path || '/f' IN (SELECT path FROM p)""")
def path_collisions(spark, sf):
    d = F.col("doc_id")
    path = F.when(d % 5 == 0, F.concat(F.lit("../"), d)).when(d % 5 == 1, F.concat(F.lit("A/"), F.floor(d / 10))).when(d % 5 == 2, F.concat(F.lit("a/"), F.floor(d / 10))).when(d % 5 == 3, F.concat(F.lit("d"), d)).otherwise(F.concat(F.lit("d"), d - 1, F.lit("/f")))
    return V.path_collisions(table(spark, sf, "documents").select(path.alias("path")))


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN '-' || o_orderkey ELSE 'R' || (o_orderkey // 2) END AS id, o_orderkey AS k FROM orders)
SELECT id AS record_id, 'INVALID_ID' AS error FROM r WHERE k % 6 = 0 UNION ALL SELECT id, 'UNKNOWN_ROLE' FROM r WHERE k % 5 = 0 UNION ALL SELECT id, 'EVIDENCE_REPEATS' FROM r WHERE k % 7 = 0 UNION ALL SELECT id, 'INVALID_EVIDENCE_ID' FROM r WHERE k % 11 = 0 UNION ALL SELECT id, 'ID_REPEATS' FROM r GROUP BY id HAVING count(*) > 1""")
def record_errors(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(k % 6 == 0, F.concat(F.lit("-"), k)).otherwise(F.concat(F.lit("R"), F.floor(k / 2))).alias("record_id"), F.when(k % 5 == 0, "X").otherwise("PO").alias("role"),
                                             F.array(F.lit("e1"), F.when(k % 7 == 0, "e1").otherwise("e2"), F.when(k % 11 == 0, "!").otherwise("e3")).alias("evidence_ids"))
    return V.record_errors(rows, ["PO"])


_BLOCK = """SELECT conv_id AS document_id, turn AS position, 'b' || (turn - CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END) AS block_id, CASE turn % 3 WHEN 0 THEN 'HEADING' WHEN 1 THEN 'TABLE' ELSE 'CAPTION' END AS block_type, turn - CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS reading_order, CASE WHEN turn % 2 = 1 THEN 'b' || (turn + 2) WHEN turn = 2 THEN 'b2' END AS parent_block_id, CASE WHEN turn % 6 = 2 THEN 'b0' END AS target_block_id FROM conversations"""


def _blocks(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("long"))
    t = F.col("turn")
    box = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), t.cast("double").alias("width"), F.lit(1.0).alias("height"), F.lit(4.0).alias("page_width"), F.lit(9.0).alias("page_height"))
    return rows.select(F.col("conv_id").alias("document_id"), t.alias("position"), F.concat(F.lit("b"), t - F.when(t % 5 == 4, 1).otherwise(0)).alias("block_id"), F.when(t % 3 == 0, "HEADING").when(t % 3 == 1, "TABLE").otherwise("CAPTION").alias("block_type"),
                       (t - F.when(t % 4 == 3, 1).otherwise(0)).alias("reading_order"), F.when(t % 2 == 1, F.concat(F.lit("b"), t + 2)).when(t == 2, "b2").alias("parent_block_id"), F.when(t % 6 == 2, "b0").alias("target_block_id"),
                       F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(F.array(F.lit("1"), F.lit("2")), F.when(t % 2 == 0, F.array(F.lit("3"))).otherwise(F.array(F.lit("3"), F.lit(None)))).alias("rows"), box.alias("box"),
                       "text", ((t % 3) + 1).cast("int").alias("level"), (F.floor(t / 2) + 1).alias("page"), F.lit("all").alias("region"), F.lit(None).cast("string").alias("asset_reference"), F.lit(None).cast("string").alias("alt_text"))


@query(f"""WITH b AS ({_BLOCK}), w AS (SELECT *, count(*) OVER (PARTITION BY document_id, block_id) AS n_id, count(*) OVER (PARTITION BY document_id, reading_order) AS n_order, lag(reading_order) OVER (PARTITION BY document_id ORDER BY position) AS before FROM b)
SELECT document_id, block_id, unnest(list_filter([CASE WHEN n_id > 1 THEN 'ID_REPEATS' END, CASE WHEN n_order > 1 THEN 'ORDER_REPEATS' END, CASE WHEN reading_order <= before THEN 'ORDER_NOT_INCREASING' END, CASE WHEN block_type = 'TABLE' AND position % 2 = 0 THEN 'ROW_WIDTH' END, CASE WHEN 1 + position > 4 THEN 'BOX_TOO_WIDE' END, CASE WHEN block_type = 'CAPTION' AND target_block_id IS NULL THEN 'DANGLING_TARGET' END], lambda x: x IS NOT NULL)) AS error FROM w
UNION ALL SELECT document_id, block_id, 'DANGLING_PARENT' FROM b WHERE parent_block_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b c WHERE c.document_id = b.document_id AND c.block_id = b.parent_block_id)
UNION ALL SELECT document_id, block_id, 'DANGLING_TARGET' FROM b WHERE block_type = 'CAPTION' AND target_block_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b c WHERE c.document_id = b.document_id AND c.block_id = b.target_block_id)
UNION ALL SELECT DISTINCT document_id, 'b2', 'PARENT_CYCLE' FROM b WHERE position = 2""")
def block_errors(spark, sf):
    return V.block_errors(_blocks(spark, sf))


# -- inventory ---------------------------------------------------------------------------------------------------------

_HEAD = "CASE doc_id % 8 WHEN 0 THEN '%PDF-1.7 /JS /Encrypt ' WHEN 1 THEN 'GIF89a' WHEN 2 THEN '{\"a\":1}' WHEN 3 THEN '<?xml?>' WHEN 4 THEN '  {\\rtf1' WHEN 5 THEN 'MZ' WHEN 6 THEN 'PDF' ELSE '%PDF-1.7 /URI ' END"
_EXT = "CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.json' WHEN 3 THEN '.xml' WHEN 4 THEN '.rtf' WHEN 5 THEN '.txt' WHEN 6 THEN '.csv' ELSE '.PDF' END"
_KIND = "['PDF', 'GIF', 'JSON_TEXT', 'XML_TEXT', 'RTF', 'EXECUTABLE', 'DELIMITED_TEXT', 'PDF'][doc_id % 8 + 1]"
_MIME = "['MATCH', 'MISMATCH', 'MATCH', 'MATCH', 'MATCH', 'MISMATCH', 'MATCH', 'MATCH'][doc_id % 8 + 1]"


def _files(spark, sf):
    d = F.col("doc_id") % 8
    head = F.get(F.array(*[F.lit(x) for x in ("%PDF-1.7 /JS /Encrypt ", "GIF89a", '{"a":1}', "<?xml?>", "  {\\rtf1", "MZ", "PDF", "%PDF-1.7 /URI ")]), d)
    ext = F.get(F.array(*[F.lit(x) for x in (".pdf", ".png", ".json", ".xml", ".rtf", ".txt", ".csv", ".PDF")]), d)
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), ext).alias("source"), F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("content"))


@query(f"SELECT doc_id, {_KIND} AS kind, {_MIME} AS status FROM documents")
def file_classes(spark, sf):
    ext = I.extension_of(F.col("source"))
    return _files(spark, sf).select("doc_id", I.signature(F.col("content"), ext).alias("kind"), I.mime_status(ext, I.detected_mime(I.signature(F.col("content"), ext))).alias("status"))


@query("SELECT doc_id, doc_id % 8 = 0 AS encrypted, CASE WHEN doc_id % 8 = 0 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS javascript, CASE WHEN doc_id % 8 = 7 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS external_links FROM documents WHERE doc_id % 8 IN (0, 7)")
def pdf_states(spark, sf):
    return _files(spark, sf).where(F.col("doc_id") % 8 % 7 == 0).select("doc_id", I.pdf_states(F.col("content")).alias("s")).select("doc_id", "s.encrypted", "s.javascript", "s.external_links")


@query(f"""WITH f AS (SELECT doc_id, 'in/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || {_EXT} AS source, sha256(['%PDF-1.7 /JS /Encrypt ', 'GIF89a', '{{"a":1}}', '<?xml?>', '  {{\\rtf1', 'MZ', 'PDF', '%PDF-1.7 /URI '][doc_id % 8 + 1] || coalesce(text, '')) AS h FROM documents)
SELECT 'doc-' || substr(h, 1, 24) || '-' || lpad(CAST(row_number() OVER (PARTITION BY h ORDER BY source) AS VARCHAR), 4, '0') AS document_id, source, {_KIND} AS signature, ['ACTIVE_CONTENT_JAVASCRIPT', 'EXTENSION_MIME_MISMATCH', '', '', '', 'EXECUTABLE_SIGNATURE,EXTENSION_MIME_MISMATCH', '', 'ACTIVE_CONTENT_EXTERNAL_LINKS'][doc_id % 8 + 1] AS flags,
 ['AUTHORIZATION_REQUIRED', 'ELIGIBLE_WITH_LIMITATIONS', 'ELIGIBLE', 'ELIGIBLE', 'ELIGIBLE', 'BLOCKED', 'ELIGIBLE', 'ELIGIBLE_WITH_LIMITATIONS'][doc_id % 8 + 1] AS eligibility, count(*) OVER (PARTITION BY h) AS n_copies FROM f""")
def inventory(spark, sf):
    return I.assembled(_files(spark, sf).select("source", "content")).select("document_id", "source", "signature", F.array_join("flags", ",").alias("flags"), "eligibility", "n_copies")


# -- content -----------------------------------------------------------------------------------------------------------


@query("SELECT conv_id AS document_id, 1 AS first_page, max(turn) // 2 + 1 AS last_page, max(turn) // 2 + 1 AS n_pages, true AS contiguous FROM conversations GROUP BY 1")
def page_coverage(spark, sf):
    return C.page_coverage(_blocks(spark, sf))


@query("SELECT conv_id AS document_id, turn // 2 + 1 AS page, count(*) AS n FROM conversations WHERE turn % 5 <> 0 GROUP BY 1, 2 HAVING count(*) > 1")
def pages_with_many_images(spark, sf):
    return C.pages_with_many_images(_blocks(spark, sf).withColumn("block_type", F.when(F.col("position") % 5 != 0, "IMAGE").otherwise("PARAGRAPH")))


@query("SELECT conv_id AS document_id, coalesce(arg_min(CASE WHEN role = 'user' THEN text END, turn) FILTER (role = 'user' AND turn % 2 = 1), 'UNKNOWN') AS title FROM conversations GROUP BY 1")
def document_titles(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("reading_order"), F.when(F.col("role") == "user", "HEADING").otherwise("PARAGRAPH").alias("block_type"), F.when(F.col("turn") % 2 == 1, 1).otherwise(2).alias("level"), "text")
    return C.document_titles(rows)


_ESC = "regexp_replace(text, '([\\\\`*_{}\\[\\]()#+.!<>|])', '\\\\\\1', 'g')"


@query(f"SELECT conv_id AS document_id, turn AS position, sha256(CASE turn % 3 WHEN 0 THEN repeat('#', CAST(turn % 3 + 1 AS INTEGER)) || ' ' || {_ESC} WHEN 1 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || CASE WHEN turn % 2 = 0 THEN '| 3 |' ELSE '| 3 | ⟦CANONICAL_NULL⟧ |' END ELSE '*Caption for `b0`: ' || {_ESC} || '*' END) AS sha256 FROM conversations")
def markdown_blocks(spark, sf):
    b = _blocks(spark, sf)
    c = F.col
    return b.select("document_id", "position", F.sha2(C.markdown_block(c("block_type"), c("text"), c("level"), c("columns"), c("rows"), c("asset_reference"), c("alt_text"), F.lit("b0")), 256).alias("sha256"))


@query(f"SELECT conv_id AS document_id, sha256(string_agg({_ESC}, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS sha256 FROM conversations GROUP BY 1")
def markdown_documents(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("reading_order"), "text")
    return C.documents_in_markdown(rows, C.markdown_block(F.lit("PARAGRAPH"), F.col("text"), F.lit(1))).select("document_id", F.sha2("markdown", 256).alias("sha256"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t, list('b' || turn ORDER BY turn) AS i FROM conversations GROUP BY 1), s AS (SELECT *, unnest(generate_series(0, CASE WHEN len(t) > 3 THEN CAST(ceil((len(t) - 3) / 2.0) AS BIGINT) ELSE 0 END)) AS k FROM c),
p AS (SELECT conv_id, k + 1 AS sequence, i[k * 2 + 1:k * 2 + 3] AS ids, array_to_string(t[k * 2 + 1:k * 2 + 3], chr(10) || chr(10)) AS text FROM s)
SELECT conv_id AS document_id, CAST(sequence AS INTEGER) AS sequence, array_to_string(ids, ',') AS block_ids, CAST(length(text) AS INTEGER) AS character_count, 'chunk-' || substr(sha256('{"block_ids":["' || array_to_string(ids, '","') || '"],"config_checksum":"c0","document_id":' || conv_id || ',"sequence":' || sequence || ',"target_id":"t","text_checksum":"' || sha256(text) || '"}'), 1, 24) AS chunk_id FROM p""")
def rag_chunks(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("reading_order"), F.concat(F.lit("b"), "turn").alias("block_id"), "text", F.array().cast("array<string>").alias("path"), F.lit(1).alias("page"), F.lit("all").alias("region"))
    return C.rag_chunks(rows, 3, 1, "t", "c0").select("document_id", "sequence", F.array_join("block_ids", ",").alias("block_ids"), "character_count", "chunk_id")


@query("SELECT conv_id AS document_id, turn AS position, CASE WHEN turn % 3 = 1 THEN 'a | b' || chr(10) || '1 | 2' || chr(10) || CASE WHEN turn % 2 = 0 THEN '3' ELSE '3 | ' END ELSE text END AS text FROM conversations")
def plain_block_text(spark, sf):
    c = F.col
    return _blocks(spark, sf).select("document_id", "position", C.plain_text(c("block_type"), c("text"), c("columns"), c("rows"), c("alt_text")).alias("text"))


@query("SELECT conv_id AS document_id, turn AS position, CASE WHEN turn % 3 = 1 THEN CASE WHEN turn % 2 = 0 THEN '[[\"1\",\"2\"],[\"3\"]]' ELSE '[[\"1\",\"2\"],[\"3\",null]]' END ELSE text END AS text, 2 AS n_rows FROM conversations")
def content_sheet(spark, sf):
    b = _blocks(spark, sf).withColumn("reading_order", F.col("position"))
    return C.content_sheet(b).select("document_id", F.col("reading_order").alias("position"), "text", "n_rows")


@query("SELECT conv_id AS document_id, turn AS position, CAST(sum(strlen(text)) OVER w AS BIGINT) AS bytes, sum(strlen(text)) OVER w > 2000 OR strlen(text) > 900 AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def running_bytes(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), F.octet_length("text").cast("long").alias("size"))
    return C.running_bytes(rows, 2000, 900).select("document_id", "position", "bytes", "over")


@query("SELECT doc_id, CAST(least(greatest(15.0 * list_sum(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: greatest(1, ceil(length(x) / 80.0)))), 30), 405) AS DOUBLE) AS height FROM documents")
def row_heights(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.row_height(F.col("text"), 80).alias("height"))


@query("SELECT p_partkey, CAST(least(200.0 / w, 100.0 / h) * w AS DOUBLE) AS width, CAST((100.0 - least(200.0 / w, 100.0 / h) * h) / 2 AS DOUBLE) AS top, CAST(least(greatest(w / 40.0 * 10, 0), 10) AS DOUBLE) AS x FROM (SELECT p_partkey, p_partkey % 50 + 1.0 AS w, p_partkey % 30 + 1.0 AS h FROM part)")
def fitted_boxes(spark, sf):
    k = F.col("p_partkey")
    w, h = (k % 50 + 1).cast("double"), (k % 30 + 1).cast("double")
    box = F.struct(w.alias("x"), h.alias("y"), w.alias("width"), h.alias("height"), F.lit(40.0).alias("page_width"), F.lit(40.0).alias("page_height"))
    return table(spark, sf, "part").select("p_partkey", C.fit_box(w, h, 200.0, 100.0).alias("f"), C.on_slide(box, 10.0, 10.0).alias("s")).select("p_partkey", "f.width", "f.top", "s.x")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, role, CAST(length(text) AS DOUBLE) AS h FROM conversations), f AS (SELECT conv_id, turn, h AS used, 1 AS slide FROM c WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, CASE WHEN c.turn % 4 = 0 OR f.used + c.h > 1000 THEN c.h ELSE f.used + c.h END, f.slide + CASE WHEN c.turn % 4 = 0 OR f.used + c.h > 1000 THEN 1 ELSE 0 END FROM f JOIN c ON c.conv_id = f.conv_id AND c.turn = f.turn + 1) SELECT conv_id AS document_id, turn AS reading_order, slide FROM f""")
def slides(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("reading_order"), F.when(F.col("turn") % 4 == 0, "HEADING").otherwise("PARAGRAPH").alias("block_type"), F.length("text").alias("h"))
    return C.paginated(rows, "h", 1000.0)


# -- scalar families ---------------------------------------------------------------------------------------------------


@query("WITH RECURSIVE l AS (SELECT p_partkey AS k, p_partkey AS n, '' AS s FROM part UNION ALL SELECT k, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || s FROM l WHERE n > 0) SELECT k AS p_partkey, nullif(s, '') AS letters FROM l WHERE n = 0")
def column_letters(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.column_letters(F.col("p_partkey")).alias("letters"))


@query("SELECT doc_id, sha256(coalesce(replace(regexp_replace(text, '([\\\\`*_{}\\[\\]()#+.!<>|])', '\\\\\\1', 'g'), chr(10), ' ↵ '), '⟦CANONICAL_NULL⟧')) AS rag, sha256(coalesce(replace(regexp_replace(text, '([\\\\`*_{}\\[\\]<>#])', '\\\\\\1', 'g'), chr(10), '<br>'), '')) AS conversion FROM documents")
def table_cells(spark, sf):
    text = F.regexp_replace("text", "\r", "")
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.table_cell(text), 256).alias("rag"), F.sha2(X.table_cell(text, "conversion"), 256).alias("conversion"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'd-' || doc_id || '-' || substr(sha256('d:' || doc_id), 1, 8) WHEN 1 THEN 'd' || doc_id ELSE 'document-' || substr(sha256('a/' || doc_id), 1, 20) END AS directory FROM documents")
def directory_ids(spark, sf):
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, F.concat(F.lit("d:"), d)).when(d % 3 == 1, F.concat(F.lit("d"), d)).otherwise(F.concat(F.lit("a/"), d))
    return table(spark, sf, "documents").select("doc_id", X.directory_id(name).alias("directory"))


@query("SELECT event_id, '{\"a\":' || event_id || ',\"b\":[1,2],\"é\":null}' AS json FROM events")
def canonical_json(spark, sf):
    return table(spark, sf, "events").select("event_id", X.canonical_json(F.concat(F.lit('{ "b": [1, 2], "é": null, "a": '), "event_id", F.lit("}"))).alias("json"))


@query("SELECT event_id, nfc_normalize(CASE event_id % 2 WHEN 0 THEN 'e' || chr(769) || 'a' ELSE 'é' END) AS nfc, CASE event_id % 4 WHEN 0 THEN '2024-12-31' WHEN 1 THEN '03/04/2024' WHEN 2 THEN '2024-02-03' ELSE 'soon' END AS day, CASE event_id % 3 WHEN 0 THEN 'USD' ELSE 'dollars' END AS currency FROM events")
def normalizer_vocabulary(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 2 == 0, F.lit("éa")).otherwise("é")
    day = F.when(k % 4 == 0, "31.12.2024").when(k % 4 == 1, "03/04/2024").when(k % 4 == 2, "2024/02/03").otherwise("soon")
    return table(spark, sf, "events").select("event_id", X.normalized(text, ("UNICODE_NFC",)).alias("nfc"), X.normalized(day, ("ISO_DATE_WHEN_UNAMBIGUOUS",)).alias("day"), X.normalized(F.when(k % 3 == 0, " usd ").otherwise("dollars"), ("ISO_CURRENCY_CODE_WHEN_EXPLICIT",)).alias("currency"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'z' END AS unknown, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN 'HIGH' ELSE 'UNKNOWN' END AS confidence, event_type IN ('account_id') AS as_text FROM events")
def cell_projections(spark, sf):
    k = F.col("event_id")
    keys = F.when(k % 5 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("z"), F.lit("a")))
    return table(spark, sf, "events").select("event_id", F.array_join(X.closed_set_violations(keys, ["a", "b"]), ",").alias("unknown"), X.confidence_shown(F.when(k % 3 == 0, k), F.when(k % 3 == 1, "HIGH")).alias("confidence"), X.identifier_column(F.col("event_type")).alias("as_text"))


# -- reconciliation, more ----------------------------------------------------------------------------------------------

_ALLOCATED = f"{_ONE_MANY}, a AS (SELECT *, sum(CASE WHEN status = 'PARTIAL_MATCH' THEN ra END) OVER (PARTITION BY left_id) AS total FROM m WHERE status <> 'CONFLICTING_MATCH')"


@query(f"{_ALLOCATED} SELECT left_id, right_id, CASE WHEN status = 'PARTIAL_MATCH' AND total > la THEN 'HUMAN_REVIEW_REQUIRED' ELSE status END AS status, CASE WHEN status = 'PARTIAL_MATCH' AND total > la THEN 'PARTIAL_OVER_ALLOCATION' END AS reason_code FROM a")
def demoted_links(spark, sf):
    found = kept(R.links_of(R.resolved(pairs(spark, sf, PARTIAL, lines), PARTIAL)).select("rule", "left_id", "right_id", "status", "partials"), "links")
    return R.demoted(found, R.over_allocations(found)).select("left_id", "right_id", "status", "reason_code")


@query(f"{_ALLOCATED} SELECT DISTINCT 'disc-' || substr(sha256('[\"PARTIAL_OVER_ALLOCATION\",\"po-lines\",\"amount\",\"' || left_id || '\"]'), 1, 24) AS discrepancy_id, left_id AS holder, 'PARTIAL_OVER_ALLOCATION' AS type FROM a WHERE status = 'PARTIAL_MATCH' AND total > la")
def over_allocation_discrepancies(spark, sf):
    found = kept(R.links_of(R.resolved(pairs(spark, sf, PARTIAL, lines), PARTIAL)).select("rule", "left_id", "right_id", "partials"), "links")
    return R.over_allocation_discrepancies(R.over_allocations(found)).select("discrepancy_id", "holder", "type")


@query(f"{_ONE_MANY} SELECT left_id AS left_record_id, right_id AS right_record_id, status AS pair_status, c.* FROM m, LATERAL (VALUES ('po_number', 'EXACT_MATCH', CAST(NULL AS VARCHAR)), ('amount', m.status, CAST(abs(m.ra - m.la) AS VARCHAR))) c(component_id, component_status, difference)")
def match_sheet(spark, sf):
    return W.match_sheet(pairs(spark, sf, PARTIAL, lines)).select("left_record_id", "right_record_id", "pair_status", "component_id", "component_status", "difference")


@query(f"{_ONE_MANY} SELECT 'AMOUNT_MISMATCH' AS issue_code, left_id AS document_id FROM m WHERE status = 'CONFLICTING_MATCH' UNION ALL SELECT 'UNCLASSIFIED_DOCUMENT', r_name FROM region")
def human_review_sheet(spark, sf):
    issues = table(spark, sf, "region").select(F.col("r_name").alias("document_id"), F.lit("UNCLASSIFIED_DOCUMENT").alias("issue_code"))
    return W.human_review_sheet(issues, R.discrepancies(pairs(spark, sf, PARTIAL, lines), PARTIAL)).select("issue_code", "document_id")


@query("SELECT 'agg-' || substr(sha256('[\"{\\\"l_orderkey\\\":' || l_orderkey || '}\"]'), 1, 24) AS aggregation_result_id, CAST(l_linenumber AS BIGINT) AS record_id FROM lineitem")
def aggregation_members(spark, sf):
    return R.aggregation_members(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("record_id")), ["l_orderkey"]).select("aggregation_result_id", "record_id")


@query("SELECT l_suppkey AS grp, count(*) AS n_records, CAST(sum(CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_quantity AS DECIMAL(18,6)) + 0.000001 END) AS VARCHAR) AS sum_value FROM lineitem GROUP BY 1")
def exact_aggregations(spark, sf):
    v = F.when(F.col("l_orderkey") % 3 == 0, "n/a").otherwise(F.concat(F.col("l_quantity").cast("decimal(10,0)").cast("string"), F.lit(".000001")))
    good, _ = R.aggregated(table(spark, sf, "lineitem").select(F.lit("").alias("record_id"), F.col("l_suppkey").alias("grp"), v.alias("v")), ["grp"], "v")
    return good.select("grp", "n_records", F.col("sum_value").cast("decimal(38,6)").cast("string").alias("sum_value"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'EXACT_MATCH' WHEN 1 THEN 'WITHIN_TOLERANCE' ELSE 'CONFLICTING_MATCH' END AS status, CASE o_orderkey % 3 WHEN 0 THEN '0.00000' WHEN 1 THEN '0.00001' ELSE '0.00002' END AS difference FROM orders")
def exact_decimals(spark, sf):
    c = R.Component("v", "l", "r", "DECIMAL_ABSOLUTE", tolerance="0.000015", tolerance_approved=True)
    right = F.when(F.col("o_orderkey") % 3 == 0, "1.00000").when(F.col("o_orderkey") % 3 == 1, "1.00001").otherwise("1.00002")
    rule = R.Rule("x", (c,))
    return table(spark, sf, "orders").select("o_orderkey", R.compared(c, rule, F.lit("1.00000"), right).alias("x")).select("o_orderkey", "x.status", "x.difference")


@query("SELECT o_orderkey, ['EXACT_MATCH', 'CONFLICTING_MATCH', 'HUMAN_REVIEW_REQUIRED'][o_orderkey % 3 + 1] AS flag, ['EXACT_MATCH', 'CONFLICTING_MATCH'][o_orderkey % 2 + 1] AS text, ['EXACT_MATCH', 'EXACT_MATCH'][o_orderkey % 2 + 1] AS folded, CASE WHEN o_orderkey % 5 = 0 THEN 'NOT_APPLICABLE' ELSE 'EXACT_MATCH' END AS optional FROM orders")
def comparator_cases(spark, sf):
    k, rule = F.col("o_orderkey"), R.Rule("x", ())
    one = lambda c, l, r: R.compared(c, rule, l, r)["status"]
    return table(spark, sf, "orders").select("o_orderkey", one(R.Component("f", "l", "r", "BOOLEAN_EXACT"), F.lit(True), F.when(k % 3 == 0, True).when(k % 3 == 1, False)).alias("flag"),
                                             one(R.Component("t", "l", "r", "EXACT_TEXT"), F.lit("A"), F.when(k % 2 == 0, "A").otherwise("a")).alias("text"), one(R.Component("n", "l", "r", "NORMALIZED_TEXT", ("TRIM_OUTER_WHITESPACE", "CASEFOLD")), F.lit(" A "), F.when(k % 2 == 0, "A").otherwise("a")).alias("folded"),
                                             one(R.Component("o", "l", "r", "EXACT_TEXT", required=False), F.lit("A"), F.when(k % 5 != 0, "A")).alias("optional"))


# -- extensions --------------------------------------------------------------------------------------------------------


@query("WITH i AS (SELECT l_orderkey % 500 AS number, l_suppkey % 20 AS vendor, 'USD' AS currency, CAST(l_quantity AS DECIMAL(18,2)) AS amount FROM lineitem) SELECT number, 'DUPLICATE_CANDIDATE' AS kind, count(*) AS n FROM i GROUP BY number, vendor, currency, amount HAVING count(*) > 1 UNION ALL SELECT number, 'NUMBER_COLLISION', count(DISTINCT vendor) FROM i GROUP BY number HAVING count(DISTINCT vendor) > 1")
def business_duplicates(spark, sf):
    return K.business_duplicates(table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("number"), (F.col("l_suppkey") % 20).alias("vendor"), F.lit("USD").alias("currency"), F.col("l_quantity").cast(MONEY).alias("amount")))


@query("SELECT o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS parts, abs(sum(CAST(l_extendedprice AS DECIMAL(18,2))) - CAST(any_value(o_totalprice) AS DECIMAL(18,2))) <= 50000 AS agrees FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def line_sum_check(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast(MONEY).alias("p"))
    totals = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("t"))
    return K.sum_check(parts, totals, "o_orderkey", "p", "t", "50000").select("o_orderkey", F.col("parts").cast("decimal(38,2)").cast("string").alias("parts"), "agrees")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) - CAST(l_extendedprice AS DECIMAL(18,2)) * 0.05) <= 0.01 AS tax_agrees FROM lineitem")
def tax_checks(spark, sf):
    price = F.col("l_extendedprice").cast(MONEY)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.tax_check(price, F.col("l_tax").cast("decimal(4,2)"), price * F.lit("0.05").cast("decimal(3,2)")).alias("tax_agrees"))


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(100 - coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS BIGINT) AS balance, q FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)) x, LATERAL (SELECT least(q, balance) AS granted, balance - least(q, balance) AS remaining) y".replace("SELECT * FROM", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, balance, granted, remaining FROM"))
def remaining_balances(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_orderkey").alias("source_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.col("l_quantity").cast("long").alias("quantity"), F.lit(100).cast("long").alias("available"))
    return K.remaining_balances(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "balance", "granted", "remaining")


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'MISSING_IN_SYSTEM' WHEN 1 THEN 'MISSING_DOCUMENT' WHEN 2 THEN 'CURRENCY' WHEN 3 THEN 'TIMING' WHEN 4 THEN 'ROUNDING' WHEN 5 THEN 'DUPLICATE' WHEN 6 THEN 'PARTIAL' ELSE 'NONE' END AS kind FROM orders")
def difference_kinds(spark, sf):
    k, m = F.col("o_orderkey") % 8, F.lit("100.00").cast(MONEY)
    system = F.when(k == 0, None).when(k == 4, F.lit("100.03").cast(MONEY)).when(k == 5, F.lit("200.00").cast(MONEY)).when(k == 6, F.lit("40.00").cast(MONEY)).otherwise(m)
    return table(spark, sf, "orders").select("o_orderkey", K.difference_kind(F.when(k != 1, m), system, F.lit("d1"), F.when(k == 3, "d2").otherwise("d1"), F.lit("EUR"), F.when(k == 2, "USD").otherwise("EUR")).alias("kind"))


@query("SELECT 'L' || a.o_orderkey AS left_id, 'R' || b.o_orderkey AS right_id, min(CASE WHEN a.o_orderkey = b.o_orderkey THEN 'PRIMARY' ELSE 'SECONDARY' END) AS strength FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey OR (a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate) GROUP BY 1, 2")
def candidate_pairs(spark, sf):
    rows = table(spark, sf, "orders").withColumn("who", F.concat_ws("/", "o_custkey", F.col("o_orderdate").cast("string")))
    side = lambda mark: rows.select(F.concat(F.lit(mark), "o_orderkey").alias("record_id"), F.col("o_orderkey").alias("number"), "who")
    left, right = side("L"), side("R")
    cast = lambda df: df.withColumn("number", F.col("number").cast("string"))
    return K.candidate_pairs(cast(left), cast(right), [("number", "PRIMARY"), ("who", "SECONDARY")])


@query("SELECT before AS earlier, doc_id AS later, CASE WHEN h = bh THEN 'EXACT_DUPLICATE' WHEN before % 2 = 0 AND doc_id % 2 = 1 THEN 'DRAFT_FINAL' ELSE 'SUPERSEDED_BY' END AS relationship FROM (SELECT doc_id, sha256(text) AS h, lag(doc_id) OVER w AS before, lag(sha256(text)) OVER w AS bh FROM documents WINDOW w AS (PARTITION BY doc_id % 97 ORDER BY doc_id)) WHERE before IS NOT NULL")
def version_edges(spark, sf):
    d = F.col("doc_id")
    return K.version_edges(table(spark, sf, "documents").select(d.alias("document_id"), (d % 97).alias("number"), d.alias("version"), F.when(d % 2 == 0, "DRAFT").otherwise("FINAL").alias("status"), F.sha2("text", 256).alias("sha256")))


@query("SELECT conv_id || '-' || turn AS line_id, text || coalesce(' ' || nullif((SELECT string_agg(c.text, ' ' ORDER BY c.turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn = a.turn + 1), ''), '') AS text FROM conversations a WHERE turn % 4 = 0")
def item_lines(spark, sf):
    t = F.col("turn")
    rows = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("line_id"), F.when(t % 4 == 0, "ITEM").when(t % 4 == 1, "CONTINUATION").otherwise("SUBTOTAL").alias("row_type"), F.when(t % 4 == 1, F.concat_ws("-", "conv_id", t - 1)).alias("continues"), t.alias("position"), "text")
    return K.item_lines(rows).select("line_id", "text")


@query("""SELECT 'l-' || l_orderkey || '-' || l_linenumber AS line_item_id, l_linenumber || ' | x' AS source_pages, '{"a":' || l_linenumber || ',"b":"' || l_returnflag || '"}' AS raw_cells,
 CASE l_linenumber % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN l_linestatus ELSE 'UNKNOWN' END AS row_confidence, CAST(NULL AS VARCHAR) AS notes FROM lineitem""")
def line_item_sheet(spark, sf):
    confidence = F.expr("""CASE l_linenumber % 3 WHEN 0 THEN '{"band":"HIGH"}' WHEN 1 THEN concat('"', l_linestatus, '"') ELSE '{}' END""")
    text = F.format_string('{"line_item_id":"l-%d-%d","source_pages":[%d,"x"],"raw_cells":{"b":"%s","a":%d},"row_confidence":%s}', F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linenumber"), confidence)
    return J.projected(table(spark, sf, "lineitem").select(F.parse_json(text).alias("record")), "line_items", ["line_item_id", "source_pages", "raw_cells", "row_confidence", "notes"])


_RENDERED = "SELECT CAST(conv_id AS VARCHAR) AS document_id, count(*) AS n_blocks, true AS sound FROM conversations GROUP BY conv_id"


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("long").alias("reading_order"), F.concat(F.lit("t"), "turn").alias("block_id"),
                                                    F.when(F.col("role") == "user", "HEADING").otherwise("PARAGRAPH").alias("block_type"), F.lit(2).alias("level"), "text")


@query(_RENDERED)
def docx_documents(spark, sf):
    return O.rendered(_turns(spark, sf), "DOCX").select("document_id", "n_blocks", (F.size("findings") == 0).alias("sound"))


@query(_RENDERED)
def pptx_documents(spark, sf):
    return O.rendered(_turns(spark, sf), "PPTX").select("document_id", "n_blocks", (F.size("findings") == 0).alias("sound"))


def _redactions(spark, sf):
    text = F.expr("""concat('{"redaction_event_id":"', CASE WHEN o_orderkey % 50 = 0 THEN 'same' ELSE concat('r', o_orderkey) END, '","evidence_id":"e","source_document_id":"d","derivative_document_id":null,',
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('"status":"', o_orderstatus, '",') END, '"method":', CASE WHEN o_orderkey % 7 = 0 THEN '5' ELSE '"m"' END,
        ',"regions":[],"performed_at":null,"performed_by":null,"approval_status":null,"approval_reference":null,"verification_status":null,"notes":["n"]}')""")
    return table(spark, sf, "orders").select(F.parse_json(text).alias("record"))


@query("SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'same' ELSE 'r' || o_orderkey END AS redaction_event_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN 'm' END AS method, 'n' AS notes FROM orders")
def redaction_register(spark, sf):
    return G.register_rows(_redactions(spark, sf), "redaction_events").select("redaction_event_id", "status", "method", F.array_join("notes", "|").alias("notes"))


@query("""WITH r AS (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN 'same' ELSE 'r' || o_orderkey END AS id FROM orders)
 SELECT id, 'MISSING status' AS error FROM r WHERE o_orderkey % 3 = 0 UNION ALL SELECT id, 'WRONG_TYPE method' FROM r WHERE o_orderkey % 7 = 0 UNION ALL SELECT id, 'REPEATED_ID' FROM r GROUP BY id HAVING count(*) > 1""")
def register_errors(spark, sf):
    return G.register_errors(_redactions(spark, sf), "redaction_events")


@query("""SELECT 'd' || l_orderkey AS document_id, l_linenumber AS page, k.kind, k.text, CASE WHEN k.kind = 'WORD' THEN CAST(l_quantity AS DOUBLE) END AS x, CASE WHEN k.kind = 'WORD' THEN 'LOW' ELSE 'UNKNOWN' END AS confidence
 FROM lineitem, LATERAL (VALUES ('WORD', l_returnflag), ('CELL', l_linestatus)) k(kind, text)""")
def adapter_rows(spark, sf):
    text = F.format_string('{"input_document_id":"d%d","pages":[{"page_number":%d,"words":[{"text":"%s","bounding_box":{"x":%s},"confidence":{"band":"LOW"}}],"tables":[{"table_id":"t","cells":[{"row":1,"column":1,"text":"%s"}]}]}]}',
                           F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity").cast("double").cast("string"), F.col("l_linestatus"))
    return G.adapter_rows(table(spark, sf, "lineitem").select(F.parse_json(text).alias("output"))).select("document_id", "page", "kind", "text", "x", "confidence")
