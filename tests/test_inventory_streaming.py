import io
import struct
import zipfile

from pyspark.sql import functions as F

from tessera.operators import inventory as I
from tessera.operators import reconcile as R
from tessera.streaming import ingest as S


def test_archive_members(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "x")
        z.writestr("../b.txt", "y")
        z.writestr("word/vbaProject.bin", "0" * 100_000)
    files = spark.createDataFrame([("z", out.getvalue()), ("broken", b"PK"), ("none", None)], "source string, content binary")
    found = {(r.source, r.member): r.flags for r in I.archive_members(files).collect()}
    assert found == {("z", "a.txt"): [], ("z", "../b.txt"): ["UNSAFE_PATH"], ("z", "word/vbaProject.bin"): ["HIGH_RATIO", "MACRO"], ("broken", None): ["INVALID_ARCHIVE"], ("none", None): ["INVALID_ARCHIVE"]}


def test_png_size(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D") + b"IHDR" + struct.pack(">II", 640, 70_000) + bytes(5)
    rows = spark.createDataFrame([(1, png), (2, b"GIF89a"), (3, None)], "i int, c binary").select("i", I.png_size(F.col("c")).alias("s")).collect()
    assert {r.i: r.s and tuple(r.s) for r in rows} == {1: (640, 70_000), 2: None, 3: None}


def test_bridged(spark):
    left, right = spark.createDataFrame([("a", "L1"), ("b", "L2")], "l string, record_id string"), spark.createDataFrame([("x", "R1")], "r string, record_id string")
    bridge = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "x"), ("c", "x")], "l string, r string")
    assert [tuple(r) for r in R.bridged(left, right, bridge, "l", "r").collect()] == [("L1", "R1", 2)]


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def arrived(name, text):
        (tmp_path / "in" / name).write_text(text)
        S.run_available(S.json_stream(spark, str(tmp_path / "in")).select("text", "status"), out, at).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    assert arrived("a.jsonl", '{"k":1}\n\n{oops\n') == [('{"k":1}', "PROCESSED"), ("{oops", "FAILED")]
    assert len(arrived("b.jsonl", '{"k":2}\n')) == 3
