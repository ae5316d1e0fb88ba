import pytest
from pyspark.sql import functions as F

from tessera.functions import fields as X
from tessera.operators import content as C
from tessera.operators import reconcile as R

PO = R.Component("po", "po", "po", "IDENTIFIER_EXACT")


def frames(spark, left, right):
    kind = "record_id string, po string, amount string"
    return spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)


def one(spark, rule, left, right, **k):
    return R.pairs_of(*frames(spark, left, right), rule, **k).collect()


def amount(**k):
    return R.Component("amount", "amount", "amount", "DECIMAL_ABSOLUTE", **k)


def test_tolerance_needs_approval(spark):
    rows = [("L", "1", "100.00")], [("R", "1", "100.04")]
    ok = one(spark, R.Rule("r", (PO, amount(tolerance="0.05", tolerance_approved=True))), *rows)[0]
    assert ok.status == "WITHIN_TOLERANCE" and ok.comparisons[1].difference == "0.04"
    pending = one(spark, R.Rule("r", (PO, amount(tolerance="0.05"))), *rows)[0]
    assert (pending.status, pending.comparisons[1].reason) == ("HUMAN_REVIEW_REQUIRED", "TOLERANCE_NOT_APPROVED")


def test_partial_and_over_allocation(spark):
    rule = R.Rule("r", (PO, amount()), cardinality="ONE_TO_MANY", partial="RIGHT_LESS_THAN_LEFT", partial_approved=True)
    pairs = R.pairs_of(*frames(spark, [("L", "1", "100")], [("A", "1", "50"), ("B", "1", "60")]), rule)
    found = R.allocations(R.links_of(R.resolved(pairs, rule))).collect()
    assert {x.status for x in found} == {"HUMAN_REVIEW_REQUIRED"} and {x.reason for x in found} == {"PARTIAL_OVER_ALLOCATION"}


def test_leading_zeros_missing_and_ambiguity(spark):
    rule = R.Rule("r", (PO,))
    assert one(spark, rule, [("L", "000123", "1")], [("R", "123", "1")], pairs="all")[0].status == "CONFLICTING_MATCH"
    assert one(spark, rule, [("L", None, "1")], [("R", "1", "1")], pairs="all")[0].status == "HUMAN_REVIEW_REQUIRED"
    pairs = R.pairs_of(*frames(spark, [("L", "1", "1")], [("A", "1", "1"), ("B", "1", "1")]), rule)
    got = R.resolved(pairs, rule)
    assert R.links_of(got).count() == 0 and R.ambiguities(got).first().candidates == ["A", "B"]


def test_keyed_and_all_pairs_link_alike(spark):
    rule = R.Rule("r", (PO, amount(tolerance="5", tolerance_approved=True)))
    left, right = frames(spark, [(f"L{i}", str(i % 7), str(i)) for i in range(12)], [(f"R{i}", str(i), str(i + 1)) for i in range(9)])
    links = [sorted(map(tuple, R.links_of(R.resolved(R.pairs_of(left, right, rule, pairs=p), rule)).select("left_id", "right_id", "status").collect())) for p in ("keyed", "all")]
    assert links[0] == links[1]
    with pytest.raises(ValueError):
        R.pairs_of(left, right, R.Rule("r", (amount(),), max_pairs=3), "all")
    with pytest.raises(ValueError):  # no text key and no band
        R.pairs_of(left, right, R.Rule("r", (R.Component("amount", "amount", "amount", "DECIMAL_RELATIVE", tolerance="0.1"),), max_pairs=3))


def test_fields(spark):
    df = spark.createDataFrame([("  a  B ", "+1.50"), ("ﬁne", "007")], "t string, d string")
    rows = df.select(X.normalized(F.col("t"), ("COLLAPSE_WHITESPACE", "UNICODE_NFKC", "CASEFOLD")).alias("n"), X.decimal_or_null(F.col("d"), 2).cast("string").alias("d"), X.decimal_text(F.col("d")).alias("x")).collect()
    assert [tuple(r) for r in rows] == [("a b", "1.50", "1.50"), ("fine", None, "007")]


def test_chunks_and_headings(spark):
    docs = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, ["x"])], "doc_id int, lines array<string>")
    got = [(r.document_id, r.start, r.text) for r in C.chunked(docs, 3, 1).orderBy("document_id", "sequence").collect()]
    assert got == [(1, 0, "a\n\nb\n\nc"), (1, 2, "c\n\nd\n\ne"), (1, 4, "e\n\nf\n\ng"), (3, 0, "x")]
    blocks = spark.createDataFrame([("d", 0, "HEADING", 1, "A"), ("d", 1, "HEADING", 3, "B"), ("d", 2, "PARAGRAPH", None, "p")], "document_id string, reading_order int, block_type string, level int, text string")
    assert [r.path for r in C.heading_paths(blocks).orderBy("reading_order").collect()] == [["A"], ["A", "UNKNOWN", "B"], ["A", "UNKNOWN", "B"]]


def test_json_scans(spark, tmp_path):
    from tessera.sources import strict_json as S

    (tmp_path / "a.json").write_text('{"a": 1}')
    (tmp_path / "b.json").write_text('{"a": 1, "a": 2}')
    (tmp_path / "c.txt").write_text("x")
    assert sorted(r.status for r in S.json_files(spark, str(tmp_path)).collect()) == ["FAILED", "PROCESSED", "SKIPPED"]
