"""Typed tables of what reviewers and adapters hand over: clause, obligation, custody, redaction and review registers, and the
words, lines, regions and table cells of pages that a text recogniser read.

Inputs are variants. A member of another type gives null and is told by ``register_errors``; null and non-object records are errors,
never a failed job. Rows are exploded, nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workflow import held, kind_of, text_of

# fixed values: members of each register in their order, the identifier first. A type stands behind a colon, text is the default
REGISTERS = {
    "contract_clauses": "clause_id document_id contract_id clause_number clause_title clause_type clause_text_raw clause_text_normalized page_start:int page_end:int source_reference party_affected:list cross_references:list amended_by:list supersedes:list extraction_confidence:variant human_review_status legal_review_required:boolean",
    "contract_obligations": "obligation_id contract_id clause_id obligated_party beneficiary_party action_required object_or_deliverable trigger condition start_date due_date recurrence evidence_required:list consequence_of_nonperformance status source_reference extraction_confidence:variant human_review_status",
    "chain_of_custody": "custody_event_id evidence_id event_type from_person_or_location to_person_or_location event_datetime timezone purpose action_performed tool_used tool_version checksum_before:variant checksum_after:variant working_copy_created:boolean authorization_reference performed_by witness_or_reviewer notes:list",
    "redaction_events": "redaction_event_id evidence_id source_document_id derivative_document_id status method regions:variants performed_at performed_by approval_status approval_reference verification_status notes:list",
    "human_review_queue": "review_item_id document_id evidence_id field_id issue_type raw_value:variant candidate_values:variants source_reference reason_for_review risk_level reviewer reviewed_value:variant review_decision review_note reviewed_at second_review_required:boolean status approval_status",
}
TYPES = {"list": "array<string>", "variants": "array<variant>"}


def members_of(register: str) -> dict[str, str]:
    return {m: TYPES.get(t, t or "string") for m, _, t in (x.partition(":") for x in REGISTERS[register].split())}


def _as(v: Column, member: str, kind: str) -> Column:
    held = F.try_variant_get(v, f"$.{member}", "variant")
    if kind == "variant":
        return held
    fits = {"string": "^STRING$", "int": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL)$", "boolean": "^BOOLEAN$"}.get(kind, "^ARRAY$")
    return F.when(F.rlike(kind_of(held), F.lit(fits)), F.try_variant_get(v, f"$.{member}", kind))


def register_rows(records: DataFrame, register: str, record: str = "record") -> DataFrame:
    """The register's members of each record, typed."""
    v = F.col("_v")
    return held(records.select(F.col(f"`{record}`").alias("_record")), {"_v": F.col("_record")}).select(*[_as(v, m, t).alias(m) for m, t in members_of(register).items()])


def register_errors(records: DataFrame, register: str, record: str = "record") -> DataFrame:
    """id, error of records: no object, members that are missing, unknown or of another type, and identifiers that are empty or repeated (null ids give no repeat)."""
    v, members = F.col("_v"), members_of(register)
    records = held(records.select(F.col(f"`{record}`").alias("_record")), {"_v": F.col("_record")})
    first = next(iter(members))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    own = lambda m: F.try_variant_get(v, f"$.{m}", "variant")
    told = lambda error, m: F.concat(F.lit(error + " "), F.lit(m))
    wrong = [F.when(F.array_contains(keys, m) & (kind_of(own(m)) != "VOID") & _as(v, m, t).isNull(), told("WRONG_TYPE", m)) for m, t in members.items() if t != "variant"]
    missing = F.transform(F.array_except(F.array(*map(F.lit, members)), keys), lambda m: F.concat(F.lit("MISSING "), m))
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, members)))), lambda m: F.concat(F.lit("UNKNOWN "), m))
    empty = F.array(F.when(F.trim(_as(v, first, "string")) == "", F.lit("EMPTY_ID")))
    found = F.when(F.coalesce(kind_of(v), F.lit("")) != "OBJECT", F.array(F.lit("NO_OBJECT"))).otherwise(F.filter(F.concat(missing, unknown, F.array(*wrong), empty), lambda e: e.isNotNull()))
    ids = records.select(_as(v, first, "string").alias("id"))
    repeated = ids.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("REPEATED_ID").alias("error"))
    return records.select(_as(v, first, "string").alias("id"), F.explode(found).alias("error")).unionByName(repeated)


#: What is read of a page. A recogniser's output is cast to it in one go: a call for each member costs far more, as tasks of an executor hinder each other in it.
_REGION = "struct<text:string, bounding_box:struct<x:double, y:double, width:double, height:double, coordinate_system:string>, confidence:struct<score:variant, band:string>"
OUTPUT = f"struct<input_document_id:string, pages:array<struct<page_number:int, words:array<{_REGION}>>, lines:array<{_REGION}>>, regions:array<{_REGION}>>, tables:array<struct<table_id:string, cells:array<{_REGION}, row:int, column:int>>>>>>>"


def adapter_rows(outputs: DataFrame, output: str = "output") -> DataFrame:
    """document_id, page, kind (WORD, LINE, REGION, CELL), position, table_id, row, column, text, x, y, width, height, coordinate_system, confidence of
    what adapters read on pages: members of a page's lists in their order, from 0; a box that is null has no coordinates, a member of another type is null."""
    read = outputs.select(F.inline(F.array(F.try_variant_get(F.col(f"`{output}`"), "$", OUTPUT))))
    pages = read.select(F.col("input_document_id").alias("document_id"), F.explode("pages").alias("p"))
    none = F.lit(None)

    def rows(items: Column, kind: str, cell: bool = False, table_id: Column = none) -> Column:
        own = lambda x, name: (x[name] if cell else none.cast("int")).alias(name)
        return F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("position"), table_id.cast("string").alias("table_id"), own(x, "row"), own(x, "column"), x["text"].alias("text"), x["bounding_box"].alias("box"), x["confidence"].alias("confidence")))

    cells = F.flatten(F.transform(F.col("p.tables"), lambda t: F.coalesce(rows(t["cells"], "CELL", True, t["table_id"]), F.array())))
    lists = [F.coalesce(x, F.array()) for x in (rows(F.col("p.words"), "WORD"), rows(F.col("p.lines"), "LINE"), rows(F.col("p.regions"), "REGION"), cells)]
    flat = pages.select("document_id", F.col("p.page_number").alias("page"), F.explode(F.concat(*lists)).alias("m"))
    confidence = F.coalesce(text_of(F.col("m.confidence.score")), F.col("m.confidence.band"), F.lit("UNKNOWN"))
    return flat.select("document_id", "page", "m.kind", "m.position", "m.table_id", "m.row", "m.column", "m.text", *[F.col(f"m.box.{n}").alias(n) for n in ("x", "y", "width", "height", "coordinate_system")], confidence.alias("confidence"))
