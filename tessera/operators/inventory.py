"""File and document inventory: signatures, hashes, occurrences, duplicates, eligibility."""

from __future__ import annotations

import io
import stat
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading bytes (hexadecimal) of file formats, their class and MIME type.
SIGNATURES = (
    ("255044462D", "PDF", "application/pdf"), ("89504E470D0A1A0A", "PNG", "image/png"), ("FFD8FF", "JPEG", "image/jpeg"), ("49492A00", "TIFF", "image/tiff"), ("4D4D002A", "TIFF", "image/tiff"),
    ("504B0304", "ZIP_CONTAINER", "application/zip"), ("504B0506", "ZIP_CONTAINER", "application/zip"), ("504B0708", "ZIP_CONTAINER", "application/zip"), ("D0CF11E0A1B11AE1", "OLE_COMPOUND_FILE", "application/x-ole-storage"),
    ("7B5C727466", "RTF", "application/rtf"), ("474946383761", "GIF", "image/gif"), ("474946383961", "GIF", "image/gif"), ("7F454C46", "EXECUTABLE", "application/x-executable"), ("4D5A", "EXECUTABLE", "application/x-executable"),
)
#: MIME types that file names declare.
EXTENSIONS = {
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff", ".zip": "application/zip",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docm": "application/vnd.ms-word.document.macroEnabled.12",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
    ".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".ppt": "application/vnd.ms-powerpoint", ".rtf": "application/rtf", ".json": "application/json", ".xml": "application/xml", ".csv": "text/csv", ".txt": "text/plain",
}
HEAD = 8192
MIMES = {kind: mime for _, kind, mime in SIGNATURES} | {"JSON_TEXT": "application/json", "XML_TEXT": "application/xml", "DELIMITED_TEXT": "text/csv", "UTF8_TEXT": "text/plain"}


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def signature(content: Column, extension: Column | None = None) -> Column:
    """Class of a file by its first 8 KiB: known leading bytes, then UTF-8 text (JSON, XML and CSV by extension too), else UNKNOWN; null for null."""
    extension = extension if extension is not None else F.lit("")
    head = F.hex(F.substring(content, 1, 16))
    first = F.substring(content, 1, HEAD)
    case = F.when(content.isNull(), None)
    for prefix, kind, _ in SIGNATURES:
        bytes_ = F.hex(F.regexp_replace(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), r"^[\s\x0B]+", "").cast("binary")) if kind == "RTF" else head
        case = case.when(F.startswith(bytes_, F.lit(prefix)), kind)
    # a character that the cut splits is no fault of the text
    text = first.cast("string")
    valid = F.is_valid_utf8(text) | ((F.length(content) > HEAD) & (F.is_valid_utf8(F.substring(content, 1, HEAD - 1).cast("string")) | F.is_valid_utf8(F.substring(content, 1, HEAD - 2).cast("string")) | F.is_valid_utf8(F.substring(content, 1, HEAD - 3).cast("string"))))
    lead = F.regexp_replace(F.substring(text, 1, 200), "^[\ufeff \\t\\r\\n]+", "")
    as_text = (F.when((extension == ".json") & F.rlike(lead, F.lit(r"^[{\[]")), "JSON_TEXT").when((extension == ".xml") & F.startswith(lead, F.lit("<")), "XML_TEXT").when(extension == ".csv", "DELIMITED_TEXT").otherwise("UTF8_TEXT"))
    return case.when(valid & ~F.contains(text, F.lit("\x00")), as_text).otherwise("UNKNOWN")


def _by_name(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def detected_mime(kind: Column) -> Column:
    return _by_name(MIMES, kind)


def declared_mime(extension: Column) -> Column:
    return _by_name(EXTENSIONS, extension)


def mime_status(extension: Column, detected: Column) -> Column:
    """MATCH, MISMATCH or UNKNOWN of what the name declares and the bytes show; old office files are compound files."""
    declared = declared_mime(extension)
    old = extension.isin(".doc", ".xls", ".ppt") & (detected == "application/x-ole-storage")
    return F.when(declared.isNull() | detected.isNull(), "UNKNOWN").when((declared == detected) | old, "MATCH").otherwise("MISMATCH")


def pdf_states(content: Column) -> Column:
    """struct(encrypted, javascript, embedded_files, external_links) by the byte patterns of PDF names, over the whole file."""
    raw = F.decode(content, "ISO-8859-1")
    has = lambda *xs: F.when(F.rlike(raw, F.lit("|".join(xs))), "DETECTED").otherwise("NOT_DETECTED")
    return F.struct(F.contains(raw, F.lit("/Encrypt")).alias("encrypted"), has("/JavaScript", "/JS").alias("javascript"), has("/EmbeddedFile").alias("embedded_files"), has("/URI").alias("external_links"))


def with_hash(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def boundaries(df: DataFrame, order: str, pieces: int = 32, rows: int = 2000) -> list:
    """At most ``pieces`` values of ``order`` that cut the table into pieces of about one size, from a bounded sample."""
    some = df.select(order).where(F.col(order).isNotNull()).orderBy(F.rand(5)).limit(rows).collect()
    values = sorted(r[0] for r in some)
    return sorted({values[i * len(values) // pieces] for i in range(1, pieces)}) if values else []


def occurrences(df: DataFrame, order: str) -> DataFrame:
    """doc-<24 digits of the hash>-<number>, numbered from 0001 in the order of ``order``; rows that tie get numbers of their own.

    Copies are numbered in pieces of the order, whose counts are summed, so that a hash that holds a third of all rows isn't one task's."""
    cuts = boundaries(df, order)
    piece = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("_piece", F.coalesce(piece, F.lit(-1)))
    before = Window.partitionBy("sha256").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("sha256", "_piece").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    n = F.col("_before") + F.row_number().over(Window.partitionBy("sha256", "_piece").orderBy(order))
    return cut.join(offsets, ["sha256", "_piece"]).withColumn("occurrence_id", F.concat(F.lit("doc-"), F.substring("sha256", 1, 24), F.lit("-"), F.format_string("%04d", n))).select(*df.columns, "occurrence_id")


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")


def duplicate_edges(df: DataFrame, key: str) -> DataFrame:
    """Each further document of a group and the group's first one: one edge for a document, not all pairs."""
    heads = duplicate_groups(df, key).select("sha256", "first")
    return df.join(heads, "sha256").where(F.col(key) > F.col("first")).select(F.col("first").alias("document"), F.col(key).alias("duplicate"), "sha256")


def eligibility(encrypted: Column, blocking: Column, flags: Column, match: Column) -> Column:
    """``flags``, ``blocking``: arrays; ``match``: MATCH, MISMATCH or UNKNOWN of extension and signature."""
    return (F.when(encrypted, "AUTHORIZATION_REQUIRED").when(F.arrays_overlap(flags, blocking), "BLOCKED").when((F.size(flags) > 0) | (match != "MATCH"), "ELIGIBLE_WITH_LIMITATIONS").otherwise("ELIGIBLE"))


#: Flags of archives and files that block a source.
BLOCKING = ("UNSAFE_ARCHIVE_MEMBER_PATH", "ARCHIVE_SYMLINK_MEMBER", "ARCHIVE_MEMBER_LIMIT_EXCEEDED", "ARCHIVE_MEMBER_SIZE_LIMIT_EXCEEDED", "ARCHIVE_TOTAL_SIZE_LIMIT_EXCEEDED", "ARCHIVE_COMPRESSION_RATIO_LIMIT_EXCEEDED", "EXECUTABLE_SIGNATURE")
_ARCHIVE_FLAGS = {"UNSAFE_PATH": "UNSAFE_ARCHIVE_MEMBER_PATH", "SYMLINK": "ARCHIVE_SYMLINK_MEMBER", "HIGH_RATIO": "ARCHIVE_COMPRESSION_RATIO_LIMIT_EXCEEDED", "MACRO": "ACTIVE_CONTENT_MACRO", "EMBEDDING": "ACTIVE_CONTENT_EMBEDDED_FILES", "EXTERNAL_LINK": "ACTIVE_CONTENT_EXTERNAL_LINKS", "INVALID_ARCHIVE": "INVALID_ARCHIVE"}


def assembled(files: DataFrame, most_members: int = 10_000, most_bytes: int = 1 << 30) -> DataFrame:
    """The inventory: a row for each file (source, content) with id, hash, class, MIME status, flags, eligibility, review and number of copies."""
    ext = extension_of(F.col("source"))
    base = with_hash(files).withColumns({"extension": ext, "signature": signature(F.col("content"), ext)})
    zips = archive_members(base.where(F.col("signature") == "ZIP_CONTAINER").select("source", "content"))
    archives = zips.groupBy("source").agg(
        F.count("member").alias("n_members"), F.coalesce(F.sum("size"), F.lit(0)).alias("unpacked"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("found"), F.bool_or(F.coalesce(F.array_contains("flags", "ENCRYPTED"), F.lit(False))).alias("locked"))
    joined = base.join(archives, "source", "left")
    pdf = F.when(F.col("signature") == "PDF", pdf_states(F.col("content")))
    rows = joined.withColumns({"pdf": pdf, "mime_status": mime_status(F.col("extension"), detected_mime(F.col("signature")))})
    archive = F.array(*[F.when(F.array_contains("found", k), v) for k, v in _ARCHIVE_FLAGS.items()], F.when(F.col("n_members") > most_members, "ARCHIVE_MEMBER_LIMIT_EXCEEDED"), F.when(F.col("unpacked") > most_bytes, "ARCHIVE_TOTAL_SIZE_LIMIT_EXCEEDED"))
    active = F.array(*[F.when(F.col(f"pdf.{k}") == "DETECTED", f"ACTIVE_CONTENT_{k.upper()}") for k in ("javascript", "embedded_files", "external_links")])
    other = F.array(F.when(F.col("mime_status") == "MISMATCH", "EXTENSION_MIME_MISMATCH"), F.when(F.col("signature") == "EXECUTABLE", "EXECUTABLE_SIGNATURE"))
    flags = F.array_sort(F.array_compact(F.concat(archive, active, other)))
    encrypted = F.coalesce(F.col("pdf.encrypted"), F.lit(False)) | F.coalesce(F.col("locked"), F.lit(False))
    made = rows.withColumn("flags", flags).withColumn("eligibility", eligibility(encrypted, F.array(*map(F.lit, BLOCKING)), F.col("flags"), F.col("mime_status")))
    copies = base.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_copies"))
    return occurrences(made.join(copies, "sha256"), "source").select(F.col("occurrence_id").alias("document_id"), "source", "sha256", F.length("content").alias("size_bytes"), "extension", "signature", "mime_status", "flags", "eligibility",
                                                                    F.when(F.col("eligibility") == "ELIGIBLE", "NOT_REQUIRED").otherwise("REQUIRED").alias("review_status"), "n_copies")


def png_size(content: Column) -> Column:
    """struct(width, height) of a PNG, null for other content."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    png = F.startswith(F.hex(F.substring(content, 1, 8)), F.lit("89504E470D0A1A0A")) & (F.substring(content, 13, 4) == F.lit(b"IHDR")) & (F.length(content) >= 24)
    return F.when(png, F.struct(number(17).alias("width"), number(21).alias("height")))


def member_flags(m: zipfile.ZipInfo, ratio: int) -> list[str]:
    parts, name = m.filename.replace("\\", "/").split("/"), m.filename.lower()
    found = {"UNSAFE_PATH": ".." in parts or parts[0] == "" or ":" in parts[0], "SYMLINK": stat.S_ISLNK(m.external_attr >> 16), "ENCRYPTED": bool(m.flag_bits & 1),
             "HIGH_RATIO": m.file_size > ratio * max(m.compress_size, 1), "MACRO": name.endswith("vbaproject.bin"), "EMBEDDING": "/embeddings/" in f"/{name}"}
    return [k for k, v in found.items() if v]


def _external(z: zipfile.ZipFile, m: zipfile.ZipInfo, most: int = 4 << 20) -> bool:
    """Whether a relationship part of an office file points outside."""
    return m.filename.endswith(".rels") and m.file_size <= most and not m.flag_bits & 1 and b'TargetMode="External"' in z.read(m)


def archive_members(files: DataFrame, ratio: int = 100) -> DataFrame:
    """source, member, size, compressed, flags of each member of ZIP files (source, content).

    The directory is read and nothing is unpacked but relationship parts of at most 4 MiB. A broken archive (or null content) gives one row without a member, flagged INVALID_ARCHIVE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column("source").to_pylist(), batch.column("content")):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        rows = [(source, m.filename, m.file_size, m.compress_size, member_flags(m, ratio) + ["EXTERNAL_LINK"] * _external(z, m)) for m in z.infolist()]
                except (zipfile.BadZipFile, ValueError, NotImplementedError, zlib.error, EOFError, RuntimeError):
                    rows = [(source, None, None, None, ["INVALID_ARCHIVE"])]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows[i:i + 10_000]], schema=schema)

    schema = pa.schema([("source", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("compressed", pa.int64()), ("flags", pa.list_(pa.string()))])
    return files.select("source", "content").mapInArrow(run, "source string, member string, size long, compressed long, flags array<string>")
