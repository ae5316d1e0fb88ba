"""Records of an extraction package as flat rows of workbook sheets: a sheet's nested members become columns by their paths.

All columns are text, so that identifiers and amounts keep their characters; what a member lacks is null. Formula-like text
is for the sink to hold back (``formula_safe``). A record that is no object gives a row of nulls, an unknown sheet is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import date_or_null, excel_serial
from .workflow import held, kind_of, text_of

# fixed values: sheet, key and the columns whose value isn't the member of their name. column=path, then :list (joined by " | "),
# :json, :digest of a checksum, :shown confidence, :levels of a confidence, :value of a field, or ~pattern for each member of a list
SHEETS = """
01_DOCUMENT_INDEX document_inventory
 evidence_ids:list original_filename=file.original_filename source_reference=file.source_reference extension=file.extension declared_mime_type=file.declared_mime_type
 detected_mime_type=file.detected_mime_type size_bytes=file.size_bytes sha256=file.checksum:digest read_status=integrity.read_status extension_mime_status=integrity.extension_mime_status
 password_protected=integrity.password_protected encrypted=integrity.encrypted javascript_status=integrity.active_content.javascript macro_status=integrity.active_content.macro
 embedded_files_status=integrity.active_content.embedded_files external_links_status=integrity.active_content.external_links observed_pages=integrity.page_count.observed declared_pages=integrity.page_count.declared
 page_completeness_status=integrity.page_completeness_status processing_eligibility=integrity.processing_eligibility document_type=classification.document_type profile_id=classification.profile_id
 profile_version=classification.profile_version classification_status=classification.status classification_confidence=classification.confidence:shown selected_route=processing.selected_route
 processing_status=processing.status data_classification:list security_flags:list assumptions:list limitations:list
02_DOCUMENT_FIELDS extracted_fields
 raw_value=values.raw_value normalized_value=values.normalized_value:value display_value=values.display_value:value source_page=provenance.source_page source_region=provenance.source_region
 bounding_box=provenance.bounding_box source_snippet=provenance.source_snippet extraction_method=extraction.method adapter_name=extraction.adapter_name adapter_version=extraction.adapter_version run_id=extraction.run_id
 normalization_rules=extraction.normalization_rules~{rule_id}@{rule_version}:{result}{:locale} confidence:levels overall_confidence=confidence.overall:shown validation_result=validation.status
 validation_details=validation.results~{rule_id}:{status}:{message} human_review_required=human_review.required human_review_status=human_review.status reviewed_value=human_review.reviewed_value
 review_decision=human_review.decision status_flags:list notes:list
03_LINE_ITEMS line_items
 source_pages:list source_rows:list raw_cells:json field_ids:list row_confidence:shown reconciliation_key:json notes:list
08_CONTRACT_CLAUSES contract_clauses
 party_affected:list cross_references:list amended_by:list supersedes:list extraction_confidence:shown
09_CONTRACT_OBLIGATIONS contract_obligations
 evidence_required:list extraction_confidence:shown
11_DOCUMENT_LINKS document_links
 match_keys:list confidence:shown source_references:list
12_RECONCILIATION reconciliation_results
 participants~{role_id}:{record_ids} rule_results~{rule_id}/{component_id}:{status}:{reason} supporting_evidence_ids:list human_review_required=human_review.required human_review_status=human_review.status
 reviewer=human_review.reviewer decision=human_review.decision reviewed_at=human_review.reviewed_at limitations:list
13_DISCREPANCIES discrepancies
 document_ids:list values:json tolerance:json possible_explanations:list supporting_evidence_ids:list
14_EVIDENCE_REGISTER evidence_register
 source_type=source.source_type source_reference=source.source_reference provided_by=source.provided_by received_by=source.received_by custodian=source.custodian received_at=acquisition.received_at
 captured_at=acquisition.captured_at acquisition_method=acquisition.method authorization_reference=acquisition.authorization_reference original_location_reference=locations.original_location_reference
 working_copy_location_reference=locations.working_copy_location_reference checksum_algorithm=checksum.algorithm checksum_digest=checksum.digest checksum_computed_at=checksum.computed_at
 checksum_object_role=checksum.object_role reliability_classification=reliability.classification reliability_assessment_status=reliability.assessment_status reliability_basis=reliability.basis:list
 reliability_limitations=reliability.limitations:list data_classification:list access_restrictions:list related_objects:list claim_limits:json notes:list
15_CHAIN_OF_CUSTODY chain_of_custody
 checksum_before:digest checksum_after:digest notes:list
17_HUMAN_REVIEW human_review_queue
 candidate_values:list
"""

_COLUMN = re.compile(r"(\w+)(?:=([\w.]+))?(?::(\w+))?(?:~(\S+))?$")


def sheet_specs(text: str = SHEETS) -> dict[str, tuple[str, dict[str, tuple[str, str | None, str | None]]]]:
    """key: (sheet, column: (path, kind, pattern))."""
    out: dict = {}
    for line in text.strip().splitlines():
        if line.startswith(" "):
            for word in line.split():
                column, path, kind, pattern = _COLUMN.match(word).groups()
                out[key][1][column] = (path or column, kind, pattern)
        else:
            sheet, key = line.split()
            out[key] = (sheet, {})
    return out


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def joined_list(v: Column) -> Column:
    """Members of an array joined by " | ", objects as JSON (a variant keeps its keys sorted); another value as it is."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(kind_of(x) == "OBJECT", F.to_json(x)).otherwise(F.coalesce(text_of(x), F.lit("null"))))
    return F.when(kind_of(v) == "ARRAY", F.array_join(items, " | ")).otherwise(text_of(v))


def shown_confidence(v: Column) -> Column:
    return F.when(kind_of(v) == "OBJECT", F.coalesce(text_of(member(v, "score")), text_of(member(v, "band")), F.lit("UNKNOWN"))).otherwise(text_of(v))


def _levels(v: Column) -> Column:
    each = F.transform(F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))), lambda k: F.concat(k, F.lit(":"), F.coalesce(shown_confidence(F.try_variant_get(v, "$", "map<string,variant>")[k]), F.lit(""))))
    return F.when(kind_of(v) == "OBJECT", F.array_join(each, " | ")).otherwise(text_of(v))


def _patterned(v: Column, pattern: str) -> Column:
    def one(x: Column) -> Column:
        parts = []
        for said, mark, name in re.findall(r"([^{}]+)|\{(:?)(\w+)\}", pattern):
            value = joined_list(member(x, name)) if name else None
            parts.append(F.lit(said) if not name else F.coalesce(F.concat(F.lit(mark), value), F.lit("")))
        return F.concat(*parts)

    return F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), " | ")


def _field_value(record: Column, v: Column) -> Column:
    """A validated date as a sheet's serial number, else the value."""
    sound = text_of(member(record, "validation.status")).isin("PASS", "PASS_WITH_WARNING") & ~F.coalesce(text_of(member(record, "field_status")).isin("AMBIGUOUS", "CONFLICTING", "HUMAN_REVIEW_REQUIRED"), F.lit(False))
    serial = F.when(sound & (text_of(member(record, "data_type")) == "DATE"), excel_serial(date_or_null(text_of(v))).cast("string"))
    return F.coalesce(serial, text_of(v))


def projected(records: DataFrame, key: str, columns: list[str], record: str = "record") -> DataFrame:
    """``columns`` of a sheet, in this order, of records (a variant each): those that the sheet maps by their paths, others as members of their names."""
    _, spec = sheet_specs()[key]
    specs = [spec.get(c, (c, None, None)) for c in columns]
    # records and members are computed once, not in each use
    rows = held(records.select(F.col(f"`{record}`").alias("_record")), {"_r": F.col("_record")}).drop("_record")
    rows = held(rows, {f"_m{i}": member(F.col("_r"), path) for i, (path, _, _) in enumerate(specs)})

    def column(v: Column, kind: str | None, pattern: str | None) -> Column:
        if pattern:
            return _patterned(v, pattern)
        made = {"list": lambda: joined_list(v), "json": lambda: F.to_json(v), "digest": lambda: F.when(kind_of(v) == "OBJECT", text_of(member(v, "digest"))).otherwise(text_of(v)),
                "shown": lambda: shown_confidence(v), "levels": lambda: _levels(v), "value": lambda: _field_value(F.col("_r"), v)}
        return made.get(kind, lambda: text_of(v))()

    return rows.select(*[column(F.col(f"_m{i}"), kind, pattern).alias(c) for i, (c, (_, kind, pattern)) in enumerate(zip(columns, specs, strict=True))])
