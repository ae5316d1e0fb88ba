"""Token files: round trips against the tokenizer, the public format, single documents, damaged frames and odd input."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import token_files as T
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_tokenizer())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_query_against_the_tokenizer(spark, tokenizer):
    got, at = {r.doc_id: r for r in T.op13_token_files(spark, SF).collect()}, 0
    rows = table(spark, SF, "documents").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = ids_of(tokenizer, r.text)
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4


def test_files_are_plain_zstandard(spark, tokenizer, tmp_path):
    docs = table(spark, SF, "documents")
    T.write_tokens(T.encoded(docs, partitions=3), f"file://{tmp_path}/a", frame_ids=1000, file_ids=20_000)
    made = T.manifest(f"{tmp_path}/a")
    assert len(made["files"]) > 3 and all(f["ids"] < 20_000 + 200_000 for f in made["files"])
    raw = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "a" / f["name"]).read_bytes()), read_across_frames=True).read() for f in made["files"])
    want = b"".join(ids_of(tokenizer, r.text) for r in docs.orderBy("doc_id").collect())
    assert raw == want and made["ids"] == len(want) // 4 and made["documents"] == docs.count()
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted([f["name"] for f in made["files"]] + ["manifest.json"])


def test_single_documents_need_their_frames_alone(tmp_path):
    r = np.random.default_rng(1)
    docs = [r.integers(0, 50_000, n).astype("<u4").tobytes() for n in (5, 0, 3000, 10, 999, 1, 2500)]
    path = tmp_path / "x"
    w = T.FrameWriter(open(path, "wb"), pa.int64(), frame_ids=1000)
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    file = pa.OSFile(str(path))
    reader = T.FrameReader(file, "x")
    n = reader.index().column("n").to_numpy()
    at = np.cumsum(n) - n
    assert n.tolist() == [len(d) // 4 for d in docs] and len(reader.table) == 7
    assert list(reader.documents(at, n)) == docs and reader.decompressed == 7
    reader.decompressed = 0
    assert list(reader.documents(at[[3, 5]], n[[3, 5]])) == [docs[3], docs[5]] and reader.decompressed == 2


@pytest.mark.parametrize("where", ["frame", "footer"])
def test_damage_is_told(tmp_path, where):
    path = tmp_path / "x"
    w = T.FrameWriter(open(path, "wb"), pa.int64(), frame_ids=100)
    w.add(1, np.arange(500, dtype="<u4").tobytes())
    w.close()
    raw = bytearray(path.read_bytes())
    raw[w.frames[0][0] + 40 if where == "frame" else -1] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="frame 1" if where == "frame" else "no seek table"):
        reader = T.FrameReader(pa.OSFile(str(path)), "x")
        list(reader.documents(np.array([0]), np.array([500])))
    with pytest.raises(ValueError, match="no whole number"):
        T.FrameWriter(io.BytesIO(), pa.int64()).add(1, b"abc")


def test_odd_rows_and_fetch(spark, tokenizer, tmp_path):
    texts = [(3, None), (None, "no id"), (3, ""), (3, "twice"), (3, "twice"), (-1, "first word " * 30_000), (9, "last")]
    docs = spark.createDataFrame([(i, t, b"x", 1, 2) for i, t in texts], "doc_id long, text string, ids binary, start int, _row int").coalesce(1)
    path = f"file://{tmp_path}/odd"
    T.write_tokens(T.encoded(docs, partitions=2), path, frame_ids=4096)
    got = T.read_tokens(spark, path).orderBy("start").collect()
    want = [(None, "no id"), (-1, "first word " * 30_000), (3, None), (3, ""), (3, "twice"), (3, "twice"), (9, "last")]
    assert [(r.doc_id, r.ids) for r in got] == [(i, ids_of(tokenizer, t)) for i, t in want]
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) // 4 for r in got[:-1]]).tolist()
    T.write_texts(docs, f"{path}-texts", partitions=2, frame_ids=4096)
    assert T.read_tokens(spark, f"{path}-texts").orderBy("start").collect() == got
    some = T.fetch(spark, path, spark.createDataFrame([(3,), (9,), (3,), (77,)], "doc_id long")).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in some] == [(r.doc_id, r.ids) for r in got if r.doc_id in (3, 9)]


def test_empty_table_and_text_ids(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    T.write_tokens(T.encoded(none), f"{tmp_path}/none")
    assert T.manifest(f"{tmp_path}/none")["files"] == [] and T.read_tokens(spark, f"{tmp_path}/none").count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string")
    T.write_tokens(T.encoded(named), f"{tmp_path}/named")
    assert [r.doc_id for r in T.read_tokens(spark, f"{tmp_path}/named", "digest", "string").orderBy("start").collect()] == ["a", "b"]


def test_lost_attempts_leave_nothing(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-000000-0000-lost.ids.zst").write_bytes(b"half a file")
    T.write_tokens(T.encoded(docs), f"{tmp_path}/t")
    assert not (tmp_path / "t" / "part-000000-0000-lost.ids.zst").exists()
    assert T.read_tokens(spark, f"{tmp_path}/t", "digest").agg(F.sum("n_tokens")).first()[0] == 400
