import json

from pyspark.sql import functions as F

from tessera.operators import registers as G


def variants(spark, values, name="record"):
    return spark.createDataFrame([(v if v is None else json.dumps(v),) for v in values], "t string").select(F.parse_json("t").alias(name))


def test_registers(spark):
    good = {m: None for m in G.members_of("redaction_events")} | {"redaction_event_id": "r1", "regions": [{"x": 1}], "notes": ["n"]}
    more = {k: v for k, v in good.items() if k != "status"} | {"redaction_event_id": "r2", "extra": 1, "notes": "n", "method": 5}
    records = variants(spark, [good, more, good | {"redaction_event_id": " "}, [1], None, good])
    rows = G.register_rows(records, "redaction_events").collect()
    assert len(rows) == 6 and rows[0].redaction_event_id == "r1" and rows[0].notes == ["n"] and rows[1].notes is None and rows[3].redaction_event_id is None
    errors = sorted((r.id or "", r.error) for r in G.register_errors(records, "redaction_events").collect())
    assert errors == sorted([("r2", "MISSING status"), ("r2", "UNKNOWN extra"), ("r2", "WRONG_TYPE notes"), ("r2", "WRONG_TYPE method"), (" ", "EMPTY_ID"), ("", "NO_OBJECT"), ("", "NO_OBJECT"), ("r1", "REPEATED_ID")])
    review = variants(spark, [{"review_item_id": "q", "raw_value": 5, "candidate_values": [1, "a"], "second_review_required": True}])
    row = G.register_rows(review, "human_review_queue").first()
    assert row.second_review_required is True and len(row.candidate_values) == 2 and row.raw_value.toPython() == 5
    for register in G.REGISTERS:
        assert G.register_errors(variants(spark, []), register).count() == 0
    clause = variants(spark, [{"clause_id": "c", "page_start": 3, "page_end": "4"}])
    assert (G.register_rows(clause, "contract_clauses").first().page_start, "WRONG_TYPE page_end" in {r.error for r in G.register_errors(clause, "contract_clauses").collect()}) == (3, True)


def test_adapter_rows(spark):
    box = {"coordinate_system": "PIXEL", "x": 1, "y": 2.5, "width": 3, "height": 4}
    page = {"page_number": 2, "words": [{"text": "a", "bounding_box": box, "confidence": {"score": 0.5}}, {"text": "b", "bounding_box": None, "confidence": {"band": "LOW"}}], "lines": [], "regions": [{"text": "r", "bounding_box": box, "confidence": None}],
            "tables": [{"table_id": "t", "cells": [{"row": 0, "column": 1, "text": "c", "bounding_box": None, "confidence": {"score": 1}}]}]}
    got = G.adapter_rows(variants(spark, [{"input_document_id": "d", "pages": [page, {"page_number": 3}]}, {"input_document_id": "e"}, None], "output")).collect()
    assert [(r.kind, r.position, r.text, r.x, r.confidence) for r in got] == [("WORD", 0, "a", 1.0, "0.5"), ("WORD", 1, "b", None, "LOW"), ("REGION", 0, "r", 1.0, "UNKNOWN"), ("CELL", 0, "c", None, "1")]
    assert {(r.document_id, r.page) for r in got} == {("d", 2)} and (got[3].table_id, got[3].row, got[3].column) == ("t", 0, 1)


def test_a_table_without_cells_takes_no_others_with_it_and_members_are_read_in_one_go(spark):
    page = {"page_number": "3", "words": [5, None, {"text": 7, "bounding_box": 5, "confidence": "HIGH"}], "tables": [{"table_id": "a"}, 5, {"table_id": "b", "cells": [{"row": "1", "text": "z"}, 7]}]}
    made = G.adapter_rows(variants(spark, [{"input_document_id": "d", "pages": [page, None, 5]}], "output"))
    got = [(r.page, r.kind, r.position, r.table_id, r.row, r.text, r.x, r.confidence) for r in made.collect()]
    assert got == [(3, "WORD", 0, None, None, None, None, "UNKNOWN"), (3, "WORD", 1, None, None, None, None, "UNKNOWN"), (3, "WORD", 2, None, None, "7", None, "UNKNOWN"), (3, "CELL", 0, "b", 1, "z", None, "UNKNOWN"), (3, "CELL", 1, "b", None, None, None, "UNKNOWN")]
    assert made.select("text", "x")._jdf.queryExecution().optimizedPlan().toString().count("variant_get(output") == 1
