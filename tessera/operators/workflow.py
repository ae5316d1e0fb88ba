"""From JSON sources to records: shapes of payloads, field wrappers, unique document ids, issues and the field dictionary.

A payload is parsed strictly (strict_json) and may be an extraction package, a collection ``{documents: [...]}``, an
array or a single document. A source that can't be read gives a row in the index, never a failed job. All is relational:
documents and fields are exploded rows, groups are pre-aggregated, and nothing is collected by source or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import formula_in_json, formula_like, inferred_type, kind_of, text_of
from .ordered import numbered

#: The members of a field's wrapper and of a document.
WRAPPER = ("raw_value", "normalized_value", "display_value", "data_type", "provenance", "human_review_required", "notes")
DOCUMENT_KEYS = ("document_id", "record_id", "document_type", "role", "source_reference", "fields", "evidence_ids", "data_classification", "limitations")
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"
TYPE = r"^[A-Z][A-Z0-9_]*$"


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once for each row: a generator between projections keeps them from being repeated in each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def payload_shape(v: Column) -> Column:
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return F.when(kind_of(v) == "ARRAY", "ARRAY").when(kind_of(v) != "OBJECT", "INVALID").when(has("document_inventory") & has("extracted_fields"), "PACKAGE").when(has("documents"), "COLLECTION").otherwise("DOCUMENT")


def extracted_records(payloads: DataFrame, key: str, value: str = "value") -> DataFrame:
    """source, ordinal, record: the array under ``key`` of an object, a payload that is an array, or the payload alone."""
    v = F.col(value)
    many = F.when(kind_of(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array(v)))
    return payloads.where(v.isNotNull()).select("source", F.posexplode(many).alias("ordinal", "record"))


def documents_of(payloads: DataFrame) -> DataFrame:
    """source, ordinal, document_id, document_type, role_hint, fields (map of variants), issue of payloads (source, value), of any shape but a package."""
    v = F.col("_value")
    payloads = held(held(payloads, {"_value": F.col("value")}), {"_shape": payload_shape(v)})
    shape = F.col("_shape")
    several = F.when(shape == "COLLECTION", F.try_variant_get(v, "$.documents", "array<variant>")).when(shape == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    rows = payloads.where(v.isNotNull() & (shape != "PACKAGE")).select("source", F.posexplode(several).alias("ordinal", "d"))
    get = lambda k, kind="string": F.try_variant_get("d", f"$.{k}", kind)
    made = rows.select("source", "ordinal", F.coalesce(get("document_id"), get("record_id")).alias("document_id"), get("document_type").alias("document_type"), get("role").alias("role_hint"), get("source_reference").alias("declared_source"),
                       get("fields", "map<string,variant>").alias("fields"), F.map_keys(F.try_variant_get("d", "$", "map<string,variant>")).alias("_keys"))
    issue = (F.when(F.col("_keys").isNull(), "NOT_AN_OBJECT").when(F.size(F.array_except("_keys", F.array(*map(F.lit, DOCUMENT_KEYS)))) > 0, "UNSUPPORTED_KEYS")
             .when(~F.coalesce(F.rlike("document_id", F.lit(IDENTIFIER)), F.lit(False)), "INVALID_DOCUMENT_ID").when(~F.coalesce(F.rlike("document_type", F.lit(TYPE)), F.lit(False)), "INVALID_DOCUMENT_TYPE")
             .when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, "FIELDS_MISSING"))
    return made.withColumn("issue", issue).drop("_keys")


def package_documents(payloads: DataFrame) -> DataFrame:
    """Documents of extraction packages: inventory items with the extracted fields of their id (none: an empty map) as wrappers, with provenance, review flag and notes.

    Of a field that is extracted twice the last in the package's order stands. A source with a malformed field record has the issue MALFORMED_FIELD on all its
    documents, an item without a classification MALFORMED_ITEM."""
    v = F.col("value")
    get = lambda x, path, kind="variant": F.try_variant_get(x, f"$.{path}", kind)
    some = payloads.where(payload_shape(v) == "PACKAGE")
    texts = lambda path, other: F.coalesce(get("d", path, "array<string>"), other)
    none = F.array().cast("array<string>")
    items = some.select("source", F.posexplode(get(v, "document_inventory", "array<variant>")).alias("ordinal", "d")).select(
        "source", "ordinal", get("d", "document_id", "string").alias("document_id"), get("d", "classification.document_type", "string").alias("document_type"), (kind_of(get("d", "classification")) == "OBJECT").alias("_whole"),
        texts("evidence_ids", none).alias("evidence_ids"), texts("data_classification", F.array(F.lit("UNKNOWN"))).alias("data_classification"))
    text = lambda path: F.when(kind_of(get("f", path)) == "STRING", get("f", path, "string"))
    wrapper = F.to_json(F.struct(*[get("f", f"values.{k}").alias(k) for k in WRAPPER[:3]], F.coalesce(get("f", "data_type", "string"), F.lit("TEXT")).alias("data_type"),
                                 F.struct(*[get("f", f"provenance.{k}").alias(k) for k in ("source_page", "source_region", "bounding_box", "source_snippet")]).alias("provenance"),
                                 F.coalesce(get("f", "human_review.required", "boolean"), F.lit(False)).alias("human_review_required"), F.coalesce(get("f", "notes", "array<string>"), none).alias("notes")))
    fields = some.select("source", F.posexplode(get(v, "extracted_fields", "array<variant>")).alias("position", "f")).select("source", "position", text("document_id").alias("document_id"), text("field_name").alias("name"), wrapper.alias("wrapper"))
    broken = fields.where("document_id IS NULL OR name IS NULL").select("source").distinct().withColumn("_broken", F.lit(True))
    one = fields.where("document_id IS NOT NULL AND name IS NOT NULL").groupBy("source", "document_id", "name").agg(F.max_by("wrapper", "position").alias("w"))
    grouped = one.groupBy("source", "document_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.parse_json("w").alias("wrapper")))).alias("fields"))
    issue = F.when(F.col("_broken"), "MALFORMED_FIELD").when(~F.coalesce("_whole", F.lit(False)), "MALFORMED_ITEM")
    return items.join(grouped, ["source", "document_id"], "left").join(broken, "source", "left").select(
        "source", "ordinal", "document_id", "document_type", F.lit(None).cast("string").alias("role_hint"), F.lit(None).cast("string").alias("declared_source"), F.coalesce("fields", F.create_map().cast("map<string,variant>")).alias("fields"), issue.alias("issue"), "evidence_ids", "data_classification")


def field_rows(documents: DataFrame) -> DataFrame:
    """A row for each field: raw, normalized, display and effective text (normalized, else raw), type, page, region, snippet, review and formula flags."""
    rows = documents.select("source", "document_id", "document_type", F.explode("fields").alias("field_name", "v"))
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    wrapped = F.coalesce((kind_of(F.col("v")) == "OBJECT") & F.arrays_overlap(keys, F.array(*map(F.lit, WRAPPER))), F.lit(False))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    own = held(rows, {"wrapped": wrapped})
    raw = F.when(F.col("wrapped"), get("raw_value")).otherwise(F.col("v"))
    normalized = F.when(F.col("wrapped"), F.when(F.array_contains(keys, F.lit("normalized_value")), get("normalized_value")).otherwise(get("raw_value"))).otherwise(F.col("v"))
    made = held(held(own, {"_raw": raw, "_norm": normalized}), {
        "_display": F.when(F.col("wrapped") & F.array_contains(keys, F.lit("display_value")), get("display_value")).otherwise(F.col("_norm")),
        "unsupported": F.when(F.col("wrapped"), F.array_except(keys, F.array(*map(F.lit, WRAPPER)))).otherwise(F.array().cast("array<string>"))})
    formula = F.lit(False)
    for c in ("_raw", "_norm", "_display"):
        t = text_of(F.col(c))
        formula = formula | F.coalesce(F.when(kind_of(F.col(c)) == "STRING", formula_like(t)).when(kind_of(F.col(c)).isin("ARRAY", "OBJECT"), formula_in_json(t)), F.lit(False))
    raw_text, norm_text = text_of(F.col("_raw")), text_of(F.col("_norm"))
    return made.select("source", "document_id", "document_type", "field_name", raw_text.alias("raw_value"), norm_text.alias("normalized_value"), text_of(F.col("_display")).alias("display_value"), F.coalesce(norm_text, raw_text).alias("effective_value"), F.when(norm_text.isNotNull(), F.col("_norm")).otherwise(F.col("_raw")).alias("typed_value"),
                       F.coalesce(F.when(F.col("wrapped"), F.try_variant_get("v", "$.data_type", "string")), inferred_type(F.col("field_name"), kind_of(F.col("_norm")))).alias("data_type"),
                       F.coalesce(F.try_variant_get("v", "$.provenance.source_page", "string"), F.lit("NOT_APPLICABLE")).alias("source_page"),
                       F.coalesce(F.try_variant_get("v", "$.provenance.source_region", "string"), F.concat(F.lit("structured-json:"), "field_name")).alias("source_region"),
                       F.coalesce(F.try_variant_get("v", "$.provenance.source_snippet", "string"), raw_text).alias("source_snippet"),
                       F.coalesce(F.when(F.col("wrapped"), F.try_variant_get("v", "$.human_review_required", "boolean")), F.lit(False)).alias("human_review_required"), formula.alias("formula_injection_flag"), "unsupported")


def content_hashes(fields: DataFrame) -> DataFrame:
    """document_id, content_sha256 over type and raw values in the order of field names; a document's fields are bounded by the document."""
    return fields.groupBy("source", "document_id").agg(F.sha2(F.to_json(F.struct(F.first("document_type").alias("document_type"), F.array_sort(F.collect_list(F.struct("field_name", "raw_value"))).alias("fields"))), 256).alias("content_sha256"))


def unique_ids(documents: DataFrame, pieces: int | None = None) -> DataFrame:
    """document_id, with source_document_id the declared one: ids that several documents declare get a suffix from source, content hash and ordinal.

    Documents are numbered by pieces of their order, so an id that many declare is no single task."""
    made = numbered(documents, ["document_id"], ["source", "content_sha256"], "_i", "_n", pieces)
    basis = F.to_json(F.struct(F.col("content_sha256"), (F.col("_i") - 1).cast("int").alias("ordinal"), F.col("source").alias("source_reference")))
    own = F.when(F.col("_n") > 1, F.concat(F.substring("document_id", 1, 140), F.lit(".dup-"), F.substring(F.sha2(basis, 256), 1, 10))).otherwise(F.col("document_id"))
    return made.select(*documents.columns, own.alias("_id")).withColumnRenamed("document_id", "source_document_id").withColumnRenamed("_id", "document_id")


def duplicate_issues(documents: DataFrame) -> DataFrame:
    """issue_code, key, n: contents and declared ids that several documents share; documents: source_document_id, content_sha256."""
    def shared(c: str, code: str) -> DataFrame:
        return documents.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(code).alias("issue_code"), "key", "n")

    return shared("content_sha256", "DUPLICATE_CONTENT").unionByName(shared("source_document_id", "DUPLICATE_RECORD_ID"))


def field_dictionary(fields: DataFrame, profile: str) -> DataFrame:
    """Of each field name: its types, sorted, and whether a value looks like a formula. Types are few, so the sets are bounded."""
    return fields.groupBy("field_name").agg(F.array_join(F.array_sort(F.collect_set("data_type")), " | ").alias("data_type"), F.max("formula_injection_flag").alias("formula")).select(
        "field_name", "data_type", F.lit(profile).alias("source_profile"), F.when(F.col("formula"), "Formula-like text detected and kept non-executable").otherwise("Follow source package classification").alias("sensitivity"))


def source_index(files: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each source: status, hash, size, number of documents, issue. files: source, content (binary), status (of the scan); documents: source, issue."""
    counts = documents.groupBy("source").agg(F.count_if(F.col("issue").isNull()).alias("document_count"), F.min("issue").alias("_issue"))
    made = files.join(counts, "source", "left")
    status = F.when(F.col("status") != "PROCESSED", F.col("status")).when(F.col("_issue").isNotNull(), "FAILED").otherwise("PROCESSED")
    done = status == "PROCESSED"
    return made.select(F.col("source").alias("source_reference"), F.when(done, F.sha2("content", 256)).alias("sha256"), F.length("content").cast("long").alias("size_bytes"), status.alias("status"), F.when(done, F.coalesce("document_count", F.lit(0))).otherwise(0).cast("long").alias("document_count"),
                       F.when(F.col("status") == "SKIPPED", "unsupported input type").when(F.col("status") == "FAILED", "not a strict JSON object or array").otherwise(F.col("_issue")).alias("issue"))


def record_map(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, role, document_type, fields (map of effective texts), source_reference of documents (document_id, role, source)."""
    maps = fields.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "effective_value"))).alias("fields"))
    return documents.where("role IS NOT NULL").join(maps, "document_id").select(F.col("document_id").alias("record_id"), "role", "document_type", "fields", F.col("source").alias("source_reference"))


def typed_record_map(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """The same with the fields' values as they are typed in JSON (a map of variants)."""
    maps = fields.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "typed_value"))).alias("fields"))
    return documents.where("role IS NOT NULL").join(maps, "document_id").select(F.col("document_id").alias("record_id"), "role", "document_type", "fields", F.col("source").alias("source_reference"))


def unwrapped(v: Column) -> Column:
    """A field's value as it is typed in JSON (as typed_value of field_rows): of a wrapper its normalized value, else its raw one; other values as they are."""
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    wrapped = F.coalesce((kind_of(v) == "OBJECT") & F.arrays_overlap(keys, F.array(*map(F.lit, WRAPPER))), F.lit(False))
    return F.when(wrapped, F.coalesce(F.when(text_of(get("normalized_value")).isNotNull(), get("normalized_value")), get("raw_value"))).otherwise(v)


def typed_records_of(documents: DataFrame, role: str) -> DataFrame:
    """typed_record_map of documents that all have one role and ids of their own, straight from their maps: no rows of fields, no shuffle and no second parse.

    Maps stand behind generators, since each use of a field would make them again."""
    own = held(documents.select("source", "document_id", "document_type", "fields"), {"_fields": F.col("fields")})
    made = held(own.select("source", "document_id", "document_type", "_fields"), {"_typed": F.transform_values("_fields", lambda _, v: unwrapped(v))})
    return made.select(F.col("document_id").alias("record_id"), F.lit(role).alias("role"), "document_type", F.col("_typed").alias("fields"), F.col("source").alias("source_reference"))


def routed(request: dict) -> str:
    """The one task that a request asks for: conversion, rag or reconciliation."""
    asked = [k for k in ("conversion", "rag", "reconciliation") if request.get(k) is not None]
    if len(asked) != 1:
        raise ValueError(f"exactly one task is asked for, got {asked}")
    return asked[0]


def role_field_sheet(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """The long review sheet of all roles: one row for each field with the 14 columns of a role's sheet, and the role."""
    own = documents.select("document_id", "role", "source_document_id").where("role IS NOT NULL")
    return fields.join(own, "document_id").select("role", F.col("document_id").alias("record_id"), "source_document_id", "document_type", F.col("source").alias("source_reference"), "field_name", "raw_value", "normalized_value", "effective_value", "data_type",
                                                  "source_page", "source_region", "source_snippet", "formula_injection_flag", F.concat(F.lit("ev-"), F.substring(F.sha2("document_id", 256), 1, 24)).alias("evidence_id"))


def match_sheet(pairs: DataFrame) -> DataFrame:
    """A row for each compared component of each pair."""
    return pairs.select("rule", "left_id", "right_id", F.col("status").alias("pair_status"), F.explode("comparisons").alias("c")).select(
        F.col("rule").alias("rule_id"), F.col("left_id").alias("left_record_id"), F.col("right_id").alias("right_record_id"), "pair_status", F.col("c.component").alias("component_id"), F.col("c.left_value").alias("left_raw_value"), F.col("c.right_value").alias("right_raw_value"),
        "c.difference", F.col("c.status").alias("component_status"), F.col("c.reason").alias("reason_code"))


def human_review_sheet(issues: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Issues and discrepancies as one sheet."""
    a = issues.select("issue_code", F.col("document_id").cast("string").alias("document_id"), F.lit("HUMAN_REVIEW_REQUIRED").alias("status"))
    b = discrepancies.select(F.col("type").alias("issue_code"), F.col("left_id").cast("string").alias("document_id"), F.lit("HUMAN_REVIEW_REQUIRED").alias("status"))
    return a.unionByName(b)
