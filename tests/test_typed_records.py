from pyspark.sql import functions as F

from tessera.functions.fields import strict_json
from tessera.operators import workflow as W


def test_typed_records_come_straight_from_the_maps_of_documents(spark):
    text = '{"document_id":"D","document_type":"T","fields":{"a":1,"b":"x","c":null,"d":{"raw_value":"5","normalized_value":5},"e":{"raw_value":"r","normalized_value":null},"f":{"notes":[]},"g":{"y":[1]},"h":{"raw_value":true}}}'
    docs = W.documents_of(spark.range(1).select(F.lit("s").alias("source"), strict_json(F.lit(text)).alias("value"))).where("issue IS NULL")
    new = W.typed_records_of(docs, "R")
    old = W.typed_record_map(W.field_rows(docs), docs.select("document_id", F.lit("R").alias("role"), "document_type", "source"))
    shown = lambda df: [(r.record_id, r.role, r.document_type, r.source_reference, sorted((x.key, str(x.v)) for x in r.e)) for r in df.select("record_id", "role", "document_type", "source_reference", F.transform(F.map_entries("fields"), lambda x: F.struct(x["key"].alias("key"), F.to_json(x["value"]).alias("v"))).alias("e")).collect()]
    assert shown(new) == shown(old)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
