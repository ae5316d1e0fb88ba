import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import fields as X
from tessera.operators import content as C
from tessera.operators import inventory as I
from tessera.operators import media as M
from tessera.operators import profiles as P
from tessera.operators import reconcile as R
from tessera.operators import validation as V
from tessera.operators import workflow as W
from tessera.sinks import publish as S
from tessera.sources import strict_json as J

APPROVED = {"basis": "b", "owner": "o", "approval_reference": "r", "approval_status": "APPROVED"}


def test_strict_json(spark, tmp_path):
    texts = ['{"a":1}', '{"a":1}}', '{"a":1}]', "[1] 2", "1,2", '{"a":1,"a":2}', "", "null", '"x"', "[NaN]", "{'a':1}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.strict_json(F.col("t")).isNotNull().alias("ok")).collect()
    assert {r.i for r in rows if r.ok} == {0, 7, 8}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text('{"documents":[{"document_id":"D1","document_type":"INVOICE","fields":{"x_id":7}}]}')
    (tmp_path / "in" / "b.json").write_bytes(b'{"a":"\xff"}')
    (tmp_path / "in" / "deep" / "c.txt").write_text("x")
    files = J.json_files(spark, str(tmp_path / "in"))
    index = {r.source_reference.rsplit("/", 1)[1]: (r.status, r.document_count) for r in W.source_index(files, W.documents_of(files)).collect()}
    assert index == {"a.json": ("PROCESSED", 1), "b.json": ("FAILED", 0), "c.txt": ("SKIPPED", 0)}
    assert J.enumerated(spark, str(tmp_path / "in")).count() == 3
    fields = W.field_rows(W.documents_of(files)).first()
    assert (fields.effective_value, fields.data_type) == ("7", "TEXT")  # an identifier must be a text
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n{"a":2}}\n[3]\n')
    assert sorted((r.line, r.status) for r in J.json_lines(spark, str(tmp_path / "l.jsonl")).collect()) == [(1, "PROCESSED"), (3, "FAILED"), (4, "PROCESSED")]


def test_profiles_and_policies(spark):
    p = P.load_profiles()["PO_GRN_INVOICE"]
    assert all(r.partial is None and r.partial_review for r in P.materialized(p))
    rules = P.materialized(p, {"approval": {"status": "APPROVED"}, "tolerances": {"po-to-invoice.amount": {"value": "0.05", **APPROVED}}, "partial_policies": {"po-to-grn": {"mode": "ALLOW_WHEN_DOCUMENTED", **APPROVED}}})
    assert rules[0].partial_approved and rules[1].components[3].tolerance_approved
    pending = P.materialized(p, {"tolerances": {"po-to-invoice.amount": {"value": "0.05", **APPROVED}}})
    assert not pending[1].components[3].tolerance_approved
    for bad in ({"tolerances": {"po-to-grn.po_number": {"value": "1"}}}, {"partial_policies": {"grn-to-invoice": {"mode": "ALLOW_WHEN_DOCUMENTED"}}}, {"other": 1}, {"tolerances": {"x.y": {"value": 1}}}):
        with pytest.raises(ValueError):
            P.materialized(p, bad)
    for text in ("profile A TWO_WAY D\nrole X DOCUMENT T - S f\nrule r X X ONE_TO_ONE review f", "profile A TWO_WAY D\nrole X DOCUMENT T - S f\nrole Y DOCUMENT U X S f\nrule r X Y ONE_TO_ONE review f", "profile A TWO_WAY D\nrole X DOCUMENT T - S f\nrole Y DOCUMENT U - S f\nrule r X Y ONE_TO_ONE review g"):
        with pytest.raises(ValueError):
            P.load_profiles(text)
    rows = [("a", "PO", "PURCHASE_ORDER", {"po_number": "1", "item_code": "i", "ordered_quantity": "5", "currency": "EUR"}, "s"), ("b", "GRN", "GOODS_RECEIPT", {"po_number": "1", "item_code": "i", "delivered_quantity": "4"}, "s")]
    records = spark.createDataFrame(rows, "record_id string, role string, document_type string, fields map<string,string>, source_reference string")
    assert P.run_profile(records, p)["links"].count() == 0
    linked = P.run_profile(records, p, {"approval": {"status": "APPROVED"}, "partial_policies": {"po-to-grn": {"mode": "ALLOW_WHEN_DOCUMENTED", **APPROVED}}}, pairs="all")
    assert [(r.rule, r.status) for r in linked["links"].collect()] == [("po-to-grn", "PARTIAL_MATCH")]
    with pytest.raises(ValueError):
        P.run_profile(records, p, pairs="all", max_pairs=0)


def test_decimals_are_exact(spark):
    c = R.Component("v", "l", "r", "DECIMAL_RELATIVE", tolerance="0.1", tolerance_approved=True)
    rule = R.Rule("x", (c,))
    cases = [("100", "95", "WITHIN_TOLERANCE"), ("100", "80", "CONFLICTING_MATCH"), ("1.000000001", "1", "WITHIN_TOLERANCE"), ("1.0", "1.00", "EXACT_MATCH"), ("1.0000000000000000001", "1", "WITHIN_TOLERANCE"), ("01", "1", "HUMAN_REVIEW_REQUIRED"), (None, "1", "HUMAN_REVIEW_REQUIRED")]
    rows = spark.createDataFrame([(l, r, w) for l, r, w in cases], "l string, r string, w string").select("w", R.compared(c, rule, F.col("l"), F.col("r"))["status"].alias("s")).collect()
    assert [r.s for r in rows] == [r.w for r in rows]


def test_many_copies_are_numbered(spark):
    rows = spark.range(10_050).select(F.format_string("f%06d", "id").alias("source"), F.lit(b"x").alias("content"))
    got = [r.occurrence_id for r in I.occurrences(I.with_hash(rows), "source").orderBy("source").collect()]
    assert len(set(got)) == 10_050 and got[0].endswith("-0001") and got[10_049].endswith("-10050")


def test_schema_interpreter():
    schema = {"type": "object", "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"$ref": "#/$defs/t"}, "uniqueItems": True, "maxItems": 2}, "c": {"oneOf": [{"type": "string"}, {"const": 1}]}, "d": {"not": {"enum": [1, 2]}}},
              "required": ["a"], "additionalProperties": False, "$defs": {"t": {"type": "string", "minLength": 2, "format": "date-time"}}}
    find = lambda x: [(p, k) for p, k, _ in V.Schema(schema).errors(x)]
    assert find({"a": 1, "b": ["2024-01-01T00:00:00Z"], "c": "x", "d": 3}) == []
    assert find({"a": None}) == [] and find([]) == [("$", "type")] and find({}) == [("$", "required")]
    assert find({"a": True}) == [("$.a", "type")] and find({"a": 0, "z": 1}) == [("$.a", "minimum"), ("$", "additionalProperties")]
    assert find({"a": 1, "b": ["x", "x", "y"]}) == [("$.b", "maxItems"), ("$.b", "uniqueItems")] + [x for i in range(3) for x in ((f"$.b[{i}]", "minLength"), (f"$.b[{i}]", "format"))]
    assert find({"a": 1, "c": True}) == [("$.c", "oneOf")] and find({"a": 1, "d": 2}) == [("$.d", "not")]
    with pytest.raises(ValueError):
        list(V.Schema({"$ref": "http://x"}).errors(1))


def png(w, h, colour=2, depth=8, data=None):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = data if data is not None else bytes(h * (w * 3 + 1))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_media(spark):
    jpeg = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00ab\xff\x00c\xff\xd9"
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 9 | 4 << 14) + b"\0"
    svg = b'<svg xmlns="http://www.w3.org/2000/svg" width="10" height="4"><rect width="3"/></svg>'
    rows = [("a.png", "image/png", png(4, 3)), ("b.png", "image/png", png(4, 3, data=b"x")), ("c.png", "image/png", png(4, 3)[:-5]), ("d.jpg", "image/png", png(4, 3)), ("e.jpg", "image/jpeg", jpeg), ("f.jpg", "image/jpeg", jpeg + b"x"), ("g.webp", "image/webp", webp), ("h.webp", "image/webp", webp[:-1]),
            ("i.svg", "image/svg+xml", svg), ("j.svg", "image/svg+xml", svg.replace(b"rect", b"script")), ("k.svg", "image/svg+xml", svg.replace(b'width="3"', b'onclick="x"')), ("l.svg", "image/svg+xml", b"<svg"), ("m.png", "image/png", None)]
    got = {r.reference[0]: (r.finding is None, r.width, r.height) for r in M.media_findings(spark.createDataFrame(rows, "reference string, media_type string, content binary")).collect()}
    assert {k for k, v in got.items() if v[0]} == set("aegi") and got["a"][1:] == (4, 3) and got["e"][1:] == (7, 5) and got["g"][1:] == (10, 5) and got["i"][1:] == (10, 4)
    blocks = spark.createDataFrame([("x", "0" * 64), ("y", "1" * 64), ("y", "2" * 64), (None, None)], "asset_reference string, checksum string")
    assert sorted(map(tuple, M.asset_errors(blocks, spark.createDataFrame([("x", b"x")], "path string, content binary")).collect())) == [("x", "MISMATCH"), ("y", "CHECKSUMS_DIFFER")]


def test_publishing(spark, tmp_path):
    one, none = spark.range(5).withColumn("t", F.lit("=x")), spark.range(0)
    path = str(tmp_path / "out")
    S.publish({"one": one, "none": none}, path, omit_empty=True)
    assert S.published_differences(spark, path) == [] and not (tmp_path / "out" / "none").exists()
    with pytest.raises(FileExistsError):
        S.publish({"one": one}, path)
    with pytest.raises(Exception):
        S.publish({"bad": one.select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path / "bad"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    S.review_sheets({"SHEET": one, "EMPTY": none}, str(tmp_path / "sheets"))
    assert S.published_differences(spark, str(tmp_path / "sheets"), "csv") == []
    books = S.workbooks(one.coalesce(1), "Sheet", 2).orderBy("book").collect()
    assert [b.n_rows for b in books] == [2, 2, 1]
    with zipfile.ZipFile(io.BytesIO(bytes(books[0].content))) as z:
        assert b"=x" in z.read("xl/worksheets/sheet1.xml") and z.testzip() is None
    with pytest.raises(ValueError):
        S.workbook("s", ["a"], [["x" * 40_000]])
    assert {r.what: r.over for r in S.overflow(one, most=3).collect()} == {"rows": True, "id": False, "t": False}
    assert S.letters(27) == "AA" and W.routed({"rag": {}}) == "rag"


def test_rag_files(spark):
    blocks = spark.createDataFrame([("d:1", 0, "b0", "HEADING", 1, "A *b*", 1), ("d:1", 1, "b1", "PARAGRAPH", None, "text", 2)], "document_id string, reading_order int, block_id string, block_type string, level int, text string, page int").withColumn("region", F.lit("r"))
    made = S.rag_files(C.heading_paths(blocks), 1, 0, "t", "c")
    assert made["documents"].first().markdown == "# A \\*b\\*\n\ntext\n"
    assert [(r.sequence, r.heading_path) for r in made["chunks"].orderBy("sequence").collect()] == [(1, ["A *b*"]), (2, ["A *b*"])]
    assert made["metadata"].first().title == "A *b*" and made["collection"].first().directory.startswith("d-1-")


def test_office_relationships(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/_rels/document.xml.rels", '<Relationship TargetMode="External"/>')
    files = spark.createDataFrame([("a.docx", out.getvalue()), ("b.exe", b"MZ"), ("c.json", b"[]"), ("d", None)], "source string, content binary")
    got = {r.source: (r.signature, r.eligibility, list(r.flags)) for r in I.assembled(files.where("content IS NOT NULL")).collect()}
    assert got["a.docx"][2] == ["ACTIVE_CONTENT_EXTERNAL_LINKS", "EXTENSION_MIME_MISMATCH"] and got["b.exe"][1] == "BLOCKED" and got["c.json"] == ("JSON_TEXT", "ELIGIBLE", [])


def test_last_of_each_and_fields(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(map(tuple, R.last_of_each(rows, "k", "n").collect())) == [("a", 2, "y"), ("b", 1, "z")]
    names = spark.createDataFrame([("date", "STRING"), ("vendor_id_ref", "STRING"), ("account", "INT"), ("x", "BOOLEAN"), ("total", "ARRAY")], "n string, k string")
    assert [r[0] for r in names.select(X.inferred_type(F.col("n"), F.col("k"))).collect()] == ["DATE", "IDENTIFIER", "TEXT", "BOOLEAN", "LIST"]
    assert json.loads(spark.range(1).select(X.canonical_json(F.lit('{"b":1,"a":[2]}'))).first()[0]) == {"a": [2], "b": 1}
    paths = spark.createDataFrame([(x,) for x in ("a/b", "../a", "/a", "a//b", "a/./b", "a\\b", "", None, "é/x.txt")], "p string")
    assert [r[0] for r in paths.select(X.safe_relative_path(F.col("p"))).collect()] == [True, False, False, False, False, False, False, False, True]


def test_all_queries_are_told_apart():
    assert len(entry.queries()) >= len(entry.oracle_sql()) > 110
