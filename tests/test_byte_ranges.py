import hashlib
import os
import random

import pytest

from tessera.sources import byte_ranges as B


def places(data, needle):
    return sum(data[i:i + len(needle)] == needle for i in range(len(data)))


@pytest.mark.parametrize("each", [1, 3, 7, 64, 1 << 20])
def test_needles_over_cuts_are_found_once(spark, tmp_path, each):
    r = random.Random(each)
    files = {f"f{i}": "".join(r.choices(["/JS", "/J", "S", "/URI", "é", "aa", "x"], k=r.randint(0, 40 if each == 1 else 300))).encode() for i in range(3 if each == 1 else 6)}
    files["empty"] = b""
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    needles = ("/JS", "/URI", "aa", "é", "nowhere")
    got = {os.path.basename(x.path): x for x in B.needle_counts(spark, str(tmp_path), needles, range_bytes=each).collect()}
    assert got.keys() == files.keys()
    for name, data in files.items():
        assert got[name].found == {n: places(data, n.encode()) for n in needles} and (got[name].state, got[name].size) == ("STABLE", len(data))


def test_limits_and_findings(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 " + b"x" * 100 + b"/JavaScript" + b"y" * 50 + b"/Encrypt")
    row = B.pdf_findings(spark, f"file://{tmp_path}", range_bytes=16).first()
    assert (row.encrypted, row.javascript, row.embedded_files, row.external_links, row.scan_limited) == (True, "DETECTED", "NOT_DETECTED", "NOT_DETECTED", False)
    row = B.pdf_findings(spark, str(tmp_path), range_bytes=16, most_bytes=125).first()
    assert (row.encrypted, row.javascript, row.scan_limited) == (False, "DETECTED", True)
    # the limit cuts through the name: what isn't searched isn't found
    assert B.pdf_findings(spark, str(tmp_path), range_bytes=16, most_bytes=112).first().javascript == "NOT_DETECTED"


def test_changes_are_told(spark, tmp_path):
    path = tmp_path / "a"
    path.write_bytes(b"0123456789")
    reader = B.RangeReader({"path": str(tmp_path), "range_bytes": "4", "needles": '["9"]'})
    parts = reader.partitions()
    assert [(p.start, p.length) for p in parts] == [(0, 4), (4, 4), (8, 2)] and next(reader.read(parts[2]))[5:7] == ("STABLE", [1])
    path.write_bytes(b"0123456789x")
    assert next(reader.read(parts[2]))[5] == "CHANGED"
    path.unlink()
    assert next(reader.read(parts[0]))[5] in ("CHANGED", "UNREADABLE")


def test_marks_tell_files_apart(spark, tmp_path):
    for name, data in (("a", b"abc" * 100), ("b", b"abc" * 100), ("c", b"abc" * 99 + b"abd")):
        (tmp_path / name).write_bytes(data)
    marks = {os.path.basename(r.path): r.mark for r in B.file_marks(spark, str(tmp_path), range_bytes=128).collect()}
    parts = [hashlib.sha256((b"abc" * 100)[i:i + 128]).hexdigest() for i in (0, 128, 256)]
    assert marks["a"] == marks["b"] == hashlib.sha256("".join(parts).encode()).hexdigest() != marks["c"]


def test_a_changed_byte_names_its_file(spark, tmp_path):
    from tessera.sinks import publish as K

    target = f"file://{tmp_path}/package"
    K.publish({"a": spark.range(100, numPartitions=3).toDF("n"), "b": spark.range(5).toDF("m"), "none": spark.range(0).toDF("m")}, target, kind="json")
    assert K.changed_files(spark, target).count() == 0 and K.verified(spark, target)
    first, second = sorted((tmp_path / "package" / "a").glob("part-*"))[:2]
    raw = bytearray(first.read_bytes())
    raw[3] ^= 1
    for x in (tmp_path / "package" / "a").glob(".*.crc"):
        x.unlink()
    first.write_bytes(raw)
    second.unlink()
    (tmp_path / "package" / "b" / "part-new").write_bytes(b"{}")
    got = {(r.name, r.file, r.change) for r in K.changed_files(spark, target).collect()}
    assert got == {("a", first.name, "CHANGED"), ("a", second.name, "MISSING"), ("b", "part-new", "ADDED")} and not K.verified(spark, target)


def test_empty_folder(spark, tmp_path):
    assert B.needle_counts(spark, str(tmp_path), ("x",)).count() == 0
