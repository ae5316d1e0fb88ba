"""Token ids as files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a stream of little-endian unsigned 32-bit ids in the public seekable format of zstandard, so that any zstandard
reader gives back the ids alone: what is no data stands in skippable frames.

* data frames of ``frame_ids`` ids (the last frame may be shorter), each with a content checksum of its own;
* one skippable frame (magic 0x184D2A50) with the documents in order: their ids and numbers of token ids, as an Arrow stream;
* the seek table (skippable frame 0x184D2A5E): for each frame its compressed size, its size and the lower half of its XXH64.

``TokenFiles`` is a data source for Spark. A writing task puts its rows into files of ``file_ids`` ids at most (but whole documents), each under a
fresh name; the commit writes ``manifest.json`` with the files in order, the ids before each one and its first and last
document, and deletes what lost attempts left. Only files of the manifest are read, so lost executors and repeated tasks
do no harm. A reading task gets one file: ``index`` reads no ids, ``digest`` and ``ids`` decompress frame by frame.
``fetch`` joins a table of wanted documents with the index and decompresses the frames in which these lie, no others.
A frame that doesn't match its checksum is an error which names the file and the frame.

Edge cases: null text is an empty one (only the end id); a null document id comes first; rows that repeat an id are written
each on their own, in the order of the input, and all are returned; a long document spans frames; an empty table is a manifest without
files; other columns are not carried.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_folder, table
from .packing import default_tokenizer, encoder

FRAME_IDS, FILE_IDS, LEVEL, REMEMBER = 65_536, 1 << 26, 3, 400_000
# Fixed values of the public formats: zstandard's skippable frames and its seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _checksum(raw: Any) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file; ``ids`` of a document are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, out: Any, kind: pa.DataType, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.out, self.kind, self.size = out, kind, 4 * frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting, self.held, self.frames, self.docs, self.lengths = [], 0, [], [], []

    @property
    def ids(self) -> int:
        return sum(self.lengths)

    def add(self, doc_id: Any, ids: bytes) -> None:
        if len(ids) % 4:
            raise ValueError(f"ids of document {doc_id} are no whole number of 32-bit integers")
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            raw = b"".join(self.waiting)
            whole = len(raw) // self.size * self.size
            for i in range(0, whole, self.size):
                self._frame(raw[i:i + self.size])
            self.waiting, self.held = [raw[whole:]], len(raw) - whole

    def _frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), _checksum(raw)))

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.waiting))
        sink = pa.BufferOutputStream()
        index = pa.record_batch([pa.array(self.docs, self.kind), pa.array(self.lengths, pa.int64())], names=["doc_id", "n"])
        with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(index)
        body = sink.getvalue().to_pybytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        seek = np.array(self.frames, _ENTRY).tobytes() + _FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()


class FrameReader:
    """Reads one file by its seek table."""

    def __init__(self, file: Any, name: str):
        self.file, self.name = file, name
        size = file.size()
        frames, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size)) if size >= _FOOTER.size else (0, 0, 0)
        at = size - _FOOTER.size - frames * _ENTRY.itemsize
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG or at < 8:
            raise ValueError(f"{name}: no seek table with checksums at its end")
        self.table = np.frombuffer(file.read_at(frames * _ENTRY.itemsize, at), _ENTRY)
        self.packed_at = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.raw_at = np.concatenate([[0], np.cumsum(self.table["size"], dtype=np.int64)])
        self.index_at, self.index_to = int(self.packed_at[-1]), at - 8
        self.unpack, self.decompressed = zstandard.ZstdDecompressor(), 0

    def index(self) -> pa.Table:
        magic, size = struct.unpack("<II", self.file.read_at(8, self.index_at))
        if magic != SKIPPABLE_INDEX or self.index_at + 8 + size != self.index_to:
            raise ValueError(f"{self.name}: no document index before the seek table")
        return pa.ipc.open_stream(self.file.read_at(size, self.index_at + 8)).read_all()

    def frame(self, k: int) -> bytes:
        try:
            raw = self.unpack.decompress(self.file.read_at(int(self.table["packed"][k]), int(self.packed_at[k])))
        except zstandard.ZstdError as e:
            raise ValueError(f"{self.name}: frame {k} can't be read: {e}") from None
        if len(raw) != self.table["size"][k] or _checksum(raw) != self.table["check"][k]:
            raise ValueError(f"{self.name}: frame {k} doesn't match its checksum")
        self.decompressed += 1
        return raw

    def documents(self, starts: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        """Ids of documents by their ascending places in the file's ids; a frame is decompressed once, and only if a document needs it."""
        have, held = -1, b""
        for a, b in zip((4 * starts).tolist(), (4 * (starts + lengths)).tolist(), strict=True):
            parts = []
            k = int(np.searchsorted(self.raw_at, a, "right")) - 1
            while a < b:
                if k != have:
                    have, held = k, self.frame(k)
                base = int(self.raw_at[k])
                parts.append(held[a - base:b - base])
                a, k = base + len(held), k + 1
            yield parts[0] if len(parts) == 1 else b"".join(parts)


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[dict[str, Any]]


@dataclass
class OneFile(InputPartition):
    name: str
    start: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.tokenizer, self.remember = options.get("tokenizer"), int(options.get("remember", REMEMBER))
        self.frame_ids, self.file_ids, self.level = int(options.get("frame_ids", FRAME_IDS)), int(options.get("file_ids", FILE_IDS)), int(options.get("level", LEVEL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, files, own = TaskContext.get().partitionId(), [], None
        fs, root = place(self.path)
        fs.create_dir(root, recursive=True)

        def done() -> None:
            own.close()
            files.append({"name": name, "documents": len(own.docs), "ids": own.ids, "frames": len(own.frames), "first": _plain(own.docs[0]), "last": _plain(own.docs[-1])})

        written, encode = 0, encoder(self.tokenizer, self.remember) if self.tokenizer else None
        for batch in iterator:
            if encode:
                found = (x.tobytes() for x in encode.batch([t or "" for t in batch.column("text").to_pylist()]))
            else:
                found = (x.as_py() for x in batch.column("ids"))
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                if own is None:
                    name, written = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.ids.zst", 0
                    own = FrameWriter(fs.open_output_stream(f"{root}/{name}", compression=None), batch.column("doc_id").type, self.frame_ids, self.level)
                own.add(doc_id, raw)
                written += len(raw)
                if written >= 4 * self.file_ids:
                    done()
                    own = None
        if own is not None:
            done()
        return Written(part, files)

    def commit(self, messages: list[Written | None]) -> None:
        files, before = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            for f in m.files:
                files.append(f | {"start": before})
                before += f["ids"]
        fs, root = place(self.path)
        fs.create_dir(root, recursive=True)
        names = {f["name"] for f in files}
        for x in fs.get_file_info(pyarrow.fs.FileSelector(root)):
            if x.is_file and x.base_name not in names and (self.overwrite or x.base_name.startswith("part-")):
                fs.delete_file(x.path)
        with fs.open_output_stream(f"{root}/manifest.json.new") as out:
            out.write(json.dumps({"ids": before, "documents": sum(f["documents"] for f in files), "files": files}).encode())
        fs.move(f"{root}/manifest.json.new", f"{root}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = place(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/{f['name']}")


def _plain(x: Any) -> Any:
    return x if x is None or isinstance(x, (int, str)) else str(x)


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: Any):
        self.path, self.content, self.names = options["path"].rstrip("/"), options.get("content", "ids"), schema.fieldNames()

    def partitions(self) -> list[OneFile]:
        return [OneFile(f["name"], f["start"]) for f in manifest(self.path)["files"]] or [OneFile("", 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = place(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as file:
            reader = FrameReader(file, partition.name)
            index = reader.index().combine_chunks()
            docs, lengths = index.column("doc_id"), index.column("n").to_numpy()
            at = np.cumsum(lengths) - lengths
            whole = reader.documents(at, lengths)
            step = 2000 if self.content != "ids" else 200
            for i in range(0, len(lengths), step):
                own = slice(i, i + step)
                n, a = lengths[own], at[own]
                columns = {"doc_id": docs.slice(i, len(n)).combine_chunks(), "start": pa.array(a + partition.start), "n_tokens": pa.array(n)}
                if self.content == "index":
                    columns |= {"file": pa.array([partition.name] * len(n)), "at": pa.array(a)}
                elif self.content == "digest":
                    columns["ids_crc32"] = pa.array([crc32(next(whole)) for _ in range(len(n))], pa.int64())
                else:
                    columns["ids"] = pa.array([next(whole) for _ in range(len(n))], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[x] for x in self.names], names=self.names)


class TokenFiles(DataSource):
    """``token_files``: options path, frame_ids, file_ids, level and, for rows with texts instead of ids, tokenizer and remember (writing); path, content = ids, digest or index, doc_id = its type (reading)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        more = {"ids": "ids binary", "digest": "ids_crc32 long", "index": "file string, at long"}[self.options.get("content", "ids")]
        return f"doc_id {self.options.get('doc_id', 'long')}, start long, n_tokens long, {more}"

    def writer(self, schema: Any, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), overwrite)

    def reader(self, schema: Any) -> TokenReader:
        return TokenReader(dict(self.options), schema)


def manifest(path: str) -> dict[str, Any]:
    fs, root = place(path)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def in_order(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id and text in ascending doc_id order over the partitions and inside each one; ties in the input's order."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")).repartitionByRange(n, "doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")


def encoded(docs: DataFrame, tokenizer: str | None = None, partitions: int | None = None, remember: int = REMEMBER) -> DataFrame:
    """doc_id and ids (with the end id) in this order."""
    path, kind = tokenizer or default_tokenizer(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, remember)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [x.tobytes() for x in encode.batch([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return in_order(docs, partitions).mapInArrow(run, f"doc_id {kind}, ids binary")


def write_tokens(rows: DataFrame, path: str, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> None:
    """Writes doc_id, ids (binary) as they stand, partition after partition."""
    rows.sparkSession.dataSource.register(TokenFiles)
    rows.select("doc_id", "ids").write.format("token_files").mode("append").options(frame_ids=frame_ids, file_ids=file_ids).save(path)


def write_texts(docs: DataFrame, path: str, tokenizer: str | None = None, partitions: int | None = None, remember: int = REMEMBER, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of texts in ascending doc_id order; the writing tasks encode, so ids go straight to their frames."""
    docs.sparkSession.dataSource.register(TokenFiles)
    rows = in_order(docs, partitions).write.format("token_files").mode("append")
    rows.options(frame_ids=frame_ids, file_ids=file_ids, tokenizer=tokenizer or default_tokenizer(), remember=remember).save(path)


def read_tokens(spark: SparkSession, path: str, content: str = "ids", doc_id: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and, by ``content``, ids, ids_crc32 (digest) or file and at (index)."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("content", content).option("doc_id", doc_id).load(path)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents whose doc_id is in ``wanted``; other frames stay compressed."""
    kind = wanted.schema["doc_id"].dataType.simpleString()
    found = read_tokens(spark, path, "index", kind).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(path)
        for batch in batches:
            names = np.array(batch.column("file").to_pylist(), object)
            for name in dict.fromkeys(names):
                own = batch.filter(pa.array(names == name))
                with fs.open_input_file(f"{root}/{name}") as file:
                    ids = list(FrameReader(file, name).documents(own.column("at").to_numpy(), own.column("n_tokens").to_numpy()))
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return found.repartition("file").sortWithinPartitions("file", "at").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    path = f"{shared_folder(spark)}/tessera-token-files-{uuid.uuid4().hex}"
    write_texts(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, "digest")
