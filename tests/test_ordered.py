"""Ordinals, running sums and chains against plain ones, with a group that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks as K
from tessera.operators import content as C
from tessera.operators import ordered as O
from tessera.operators import workflow as W


@pytest.mark.parametrize("pieces", [1, 7])
def test_ordinals_of_a_hot_group(spark, pieces):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(5)
    got = O.numbered(df, ["g"], ["k", "i"], "n", "total", pieces=pieces).collect()
    want = {}
    for g in {g for g, *_ in rows}:
        own = sorted((k, i) for h, k, i in rows if h == g)
        want |= {i: (n, len(own)) for n, (_, i) in enumerate(own, 1)}
    assert {x.i: (x.n, x.total) for x in got} == want and len(got) == len(rows)


def test_a_hot_group_is_spread(spark):
    dealt = O.ranged(spark.range(20_000).select(F.lit("hot").alias("g"), "id"), ["g", "id"], 8)
    sizes = [x["count"] for x in dealt.groupBy("_piece").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000


@pytest.mark.parametrize("pieces", [1, 6])
def test_running_sums(spark, pieces):
    r = random.Random(2)
    rows = [(r.choice("xxxyz"), i, r.choice([None, 1, 5, 10**12])) for i in range(500)]
    got = {x.i: x.s for x in O.running(spark.createDataFrame(rows, "g string, i int, v long").repartition(4), ["g", "i"], "v", "s", pieces).collect()}
    total = 0
    for _, i, v in sorted(rows, key=lambda x: x[:2]):
        total += v or 0
        assert got[i] == total
    assert O.running(spark.createDataFrame([], "g string, i int, v long"), ["g", "i"], "v", "s").count() == 0


def test_package_limits(spark):
    rows = spark.createDataFrame([("b", 1, 50), ("a", 2, 60), ("a", 1, 5), ("c", 1, 1)], "document_id string, position int, size long")
    assert [(x.document_id, x.position, x.bytes, x.over) for x in C.package_bytes(rows, 100, 55, pieces=3).orderBy("bytes").collect()] == [("a", 1, 5, False), ("a", 2, 65, True), ("b", 1, 115, True), ("c", 1, 116, True)]


def test_ids_that_many_declare(spark):
    rows = [("hot", f"s{i % 40:02d}", f"h{i % 7}") for i in range(600)] + [("one", "s", "h"), (None, "s", "h"), (None, "t", "h")]
    df = spark.createDataFrame(rows, "document_id string, source string, content_sha256 string")
    got = [W.unique_ids(df.repartition(k), pieces=p).orderBy("source", "content_sha256", "document_id").collect() for k, p in ((1, 1), (6, 9))]
    assert got[0] == got[1] and len({x.document_id for x in got[0] if x.source_document_id == "hot"}) == 600
    assert [x.document_id for x in got[0] if x.source_document_id == "one"] == ["one"]


def test_chains_and_cycles(spark):
    r = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    edges = chain + [(f"t{i}", "c100") for i in range(300)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("self", "self"), (None, "q"), ("two", "c000"), ("two", "c150")]
    r.shuffle(edges)
    got = {x.document_id: (x.current, x.steps, x.state) for x in K.version_chains(spark.createDataFrame(edges, "earlier string, later string")).collect()}
    assert got["c150"] == ("c150", 0, "CURRENT") and got["c000"] == ("c150", 150, "SUPERSEDED") and got["t7"] == ("c150", 51, "SUPERSEDED") and got["two"] == ("c150", 1, "SUPERSEDED")
    assert all(got[k] == (None, None, "CYCLE") for k in ("x", "y", "z", "w", "self")) and len(got) == 151 + 300 + 4 + 1 + 1
    assert K.version_chains(spark.createDataFrame([], "earlier string, later string")).count() == 0


def test_neighbours_of_versions(spark):
    rows = [(f"d{i:03d}", "n", i // 2, "DRAFT" if i % 3 else "FINAL", f"h{i // 4}") for i in range(200)] + [("e", None, 1, "FINAL", "h")]
    df = spark.createDataFrame(rows, "document_id string, number string, version int, status string, sha256 string")
    got = {(x.earlier, x.later): x.relationship for x in K.version_edges(df, pieces=5).collect()}
    want = {}
    for a, b in zip(rows, rows[1:200]):
        want[a[0], b[0]] = "EXACT_DUPLICATE" if a[4] == b[4] else "DRAFT_FINAL" if (a[3], b[3]) == ("DRAFT", "FINAL") else "SUPERSEDED_BY"
    assert got == want


def test_version_chains_stop_where_only_cycles_are_left(spark, monkeypatch):
    written = []
    monkeypatch.setattr(K, "kept", lambda df, label, own=K.kept: written.append(own(df, label)) or written[-1])
    edges = [("a", "b"), ("b", "c"), ("c", "d")] + [(f"x{i:04}", f"x{i ^ 1:04}") for i in range(2000)]
    rows = {x.document_id: (x.current, x.steps, x.state) for x in K.version_chains(spark.createDataFrame(edges, "earlier string, later string")).collect()}
    assert len(rows) == 2004 and rows["a"] == ("d", 3, "SUPERSEDED") and rows["b"] == ("d", 2, "SUPERSEDED") and rows["d"] == ("d", 0, "CURRENT") and rows["x0000"] == (None, None, "CYCLE")
    assert len(written) == 4  # before: a round for each bit of the number of documents
