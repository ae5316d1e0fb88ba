"""Binary files read in ranges, so that one large file is many tasks, with a check that it stays the same meanwhile.

``byte_ranges`` (a data source): path (a file or folder), range_bytes, and one of
* ``needles`` (a JSON list of texts, searched as UTF-8): for each range how often each needle *starts* in it. A range reads as many bytes beyond its end as
  the longest needle needs, so what straddles a cut is found, and found once.
* ``hash``: the SHA-256 of each range; ``file_marks`` makes a Merkle root of them, which tells files apart like a hash and needs no sequential pass.
``most_bytes`` ends the search of a file there (scan_limited), as a bounded inspection does.

Size and time of change are taken when the job is planned and compared by each task before and after it has read its range; a range of a file
that changed, went or can't be read has a state other than STABLE, and fails no job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 8 << 20
#: Names in a PDF that show active content, by finding.
PDF_NEEDLES = {"encrypted": ("/Encrypt",), "javascript": ("/JavaScript", "/JS"), "embedded_files": ("/EmbeddedFile",), "external_links": ("/URI",)}


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    length: int
    size: int
    changed: int
    limited: bool


def count_starts(data: bytes, needle: bytes, before: int) -> int:
    """How often a needle stands in the data and starts before a place (occurrences may overlap)."""
    n, at = 0, data.find(needle)
    while 0 <= at < before:
        n, at = n + 1, data.find(needle, at + 1)
    return n


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.each = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.most = int(options["most_bytes"]) if "most_bytes" in options else None
        self.needles = [x.encode() for x in json.loads(options.get("needles", "[]"))]
        if self.each < 1 or not all(self.needles):
            raise ValueError("ranges hold a byte at least, needles a letter")

    def partitions(self) -> list[Range]:
        fs, root = _place(self.path)
        known = fs.get_file_info(root)
        files = [known] if known.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            end = f.size if self.most is None else min(f.size, self.most)
            out += [Range(f.path, at, min(self.each, end - at), f.size, f.mtime_ns or 0, end < f.size) for at in range(0, max(end, 1), self.each)]
        return out or [Range("", 0, 0, 0, 0, False)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        fs, _ = _place(self.path)
        over = max(map(len, self.needles), default=1) - 1
        state, found, digest = "STABLE", [0] * len(self.needles), None
        try:
            same = lambda: (x := fs.get_file_info(part.path)).is_file and (x.size, x.mtime_ns or 0) == (part.size, part.changed)
            if not same():
                state = "CHANGED"
            else:
                # a match may end beyond the range, but never beyond the bytes that are searched
                reach = part.start + part.length + over
                stop = min(reach, part.size) if not part.limited or self.most is None else min(reach, self.most)
                with fs.open_input_file(part.path) as file:
                    data = file.read_at(stop - part.start, part.start)
                if len(data) < part.length or not same():
                    state = "CHANGED"
                else:
                    found, digest = [count_starts(data, n, part.length) for n in self.needles], hashlib.sha256(data[:part.length]).hexdigest()
        except OSError:
            state = "UNREADABLE"
        yield part.path, part.start, part.length, part.size, part.limited, state, found, digest


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start long, length long, size long, scan_limited boolean, state string, found array<long>, sha256 string"

    def reader(self, schema: Any) -> RangeReader:
        return RangeReader(dict(self.options))


def byte_ranges(spark: SparkSession, path: str, needles: tuple[str, ...] = (), range_bytes: int = RANGE_BYTES, most_bytes: int | None = None) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    options = {"needles": json.dumps(list(needles)), "range_bytes": str(range_bytes)} | ({} if most_bytes is None else {"most_bytes": str(most_bytes)})
    return spark.read.format("byte_ranges").options(**options).load(path)


def needle_counts(spark: SparkSession, path: str, needles: tuple[str, ...], range_bytes: int = RANGE_BYTES, most_bytes: int | None = None) -> DataFrame:
    """path, size, state, scan_limited and ``found`` (a map of needle to number of places) of each file; found is null where the file changed or can't be read."""
    ranges = byte_ranges(spark, path, needles, range_bytes, most_bytes)
    sums = [F.sum(F.get("found", F.lit(i))).alias(f"_n{i}") for i in range(len(needles))]
    made = ranges.groupBy("path").agg(F.first("size").alias("size"), F.bool_or("scan_limited").alias("scan_limited"), F.max_by("state", F.when(F.col("state") == "STABLE", 0).otherwise(1)).alias("state"), *sums)
    pairs = [x for i, n in enumerate(needles) for x in (F.lit(n), F.col(f"_n{i}"))]
    return made.select("path", "size", "state", "scan_limited", F.when(F.col("state") == "STABLE", F.create_map(*pairs)).alias("found"))


def pdf_findings(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, most_bytes: int | None = 256 << 20) -> DataFrame:
    """path, size, state, encrypted, javascript, embedded_files, external_links, scan_limited of files, searched in ranges up to ``most_bytes`` (None: whole)."""
    needles = tuple(n for own in PDF_NEEDLES.values() for n in own)
    rows = needle_counts(spark, path, needles, range_bytes, most_bytes)
    some = lambda own: F.array_max(F.array(*[F.try_element_at("found", F.lit(n)) for n in own])) > 0
    shown = lambda own: F.when(F.col("found").isNotNull(), F.when(some(own), "DETECTED").otherwise("NOT_DETECTED"))
    return rows.select("path", "size", "state", some(PDF_NEEDLES["encrypted"]).alias("encrypted"), *[shown(PDF_NEEDLES[k]).alias(k) for k in ("javascript", "embedded_files", "external_links")], "scan_limited")


def file_marks(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, size, state, mark: the SHA-256 over the SHA-256 of a file's ranges in order (null where it changed). A file's ranges are few numbers each."""
    ranges = byte_ranges(spark, path, (), range_bytes)
    rows = ranges.groupBy("path").agg(F.first("size").alias("size"), F.max_by("state", F.when(F.col("state") == "STABLE", 0).otherwise(1)).alias("state"), F.array_sort(F.collect_list(F.struct("start", "sha256"))).alias("r"))
    return rows.select("path", "size", "state", F.when(F.col("state") == "STABLE", F.sha2(F.array_join("r.sha256", ""), 256)).alias("mark"))
