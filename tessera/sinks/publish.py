"""Outputs that appear whole or not at all, and never replace one that is there.

A package is a folder of datasets written to a staging folder beside its target; the manifest comes last, and one rename
publishes all. Paths are Hadoop paths, so the target may be in any store with rename; nothing is written locally.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.fields import directory_id
from ..operators import content as C
from ..sources.byte_ranges import file_marks

CELL, ROWS = 32_767, 1_048_575  # limits of a sheet: characters of a cell, rows under the header


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_once(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """A dataset at a path that must not be there; Spark's commit makes it whole."""
    df.write.format(kind).options(**options).mode("errorifexists").save(path)


def result_json(results: DataFrame, path: str, view: str = "full") -> None:
    """Result rows of a view as JSON lines."""
    from ..operators.reconcile import output_view

    write_once(output_view(results, view), path, "json", ignoreNullFields="false")


def publish(datasets: dict[str, DataFrame], path: str, kind: str = "parquet", omit_empty: bool = False) -> None:
    """The datasets and their manifest as one folder; an error leaves nothing behind, a folder that is there is kept."""
    spark = next(iter(datasets.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        rows = []
        for name, df in datasets.items():
            write_once(df, f"{staged}/{name}", kind, **({"header": "true", "escape": '"'} if kind == "csv" else {}))
            back = spark.read.schema(df.schema).options(header="true", escape='"').format(kind).load(f"{staged}/{name}")
            n, mark = back.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
            if not n and omit_empty:
                fs.delete(_fs(spark, f"{staged}/{name}")[1], True)
                continue
            rows.append((name, n, mark, df.schema.json()))
        files = part_files(spark, staged)
        files.write.json(f"{staged}/manifest-files")
        written = spark.read.schema(files.schema).json(f"{staged}/manifest-files")
        roots = written.groupBy("name").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("file", "size", "mark")))), 256).alias("root"))  # a few numbers for each part file
        spark.createDataFrame(rows, "name string, n_rows long, content_mark string, schema string").join(roots, "name", "left").coalesce(1).write.json(f"{staged}/manifest")
        if not fs.rename(_fs(spark, staged)[1], target):
            raise OSError(f"{path} can't be published")
    except BaseException:
        fs.delete(_fs(spark, staged)[1], True)
        raise


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """name (of the dataset), file, size, mark of each part file of a package: SHA-256 over those of its ranges, read by as many tasks as there are ranges."""
    marks = file_marks(spark, path).where("state = 'STABLE'")
    parts = F.split("path", "/")
    return marks.select(F.element_at(parts, -2).alias("name"), F.element_at(parts, -1).alias("file"), "size", "mark").where(F.startswith("file", F.lit("part-")) & ~F.col("name").isin("manifest", "manifest-files"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """name, file, change (CHANGED, MISSING or ADDED) of the part files of a package that are not those of its manifest; a changed byte names its file."""
    kind = "name string, file string, size long, mark string"
    told = spark.read.schema(kind).json(f"{path}/manifest-files").select("name", "file", F.struct("size", "mark").alias("told"))
    now = part_files(spark, path).select("name", "file", F.struct("size", "mark").alias("now"))
    change = F.when(F.col("told").isNull(), "ADDED").when(F.col("now").isNull(), "MISSING").when(F.col("told") != F.col("now"), "CHANGED")
    return told.join(now, ["name", "file"], "full").select("name", "file", change.alias("change")).where("change IS NOT NULL")


def verified(spark: SparkSession, path: str) -> bool:
    """Whether each dataset's root follows from the files that are there, so that neither they nor the list of them was changed apart."""
    roots = part_files(spark, path).groupBy("name").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("file", "size", "mark")))), 256).alias("now"))
    told = spark.read.schema("name string, n_rows long, root string").json(f"{path}/manifest")
    return told.join(roots, "name", "full").where("NOT (root <=> now)").isEmpty()


def published_differences(spark: SparkSession, path: str, kind: str = "parquet") -> list[str]:
    """Names of datasets of a package whose rows are not those of its manifest."""
    out = []
    for m in spark.read.json(f"{path}/manifest").collect():  # a row for each dataset
        df = spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).options(header="true", escape='"').format(kind).load(f"{path}/{m['name']}")
        n, mark = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
        if (n, mark) != (m["n_rows"], m["content_mark"]):
            out.append(m["name"])
    return sorted(out)


def review_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Review sheets as CSV datasets; empty ones are left out."""
    publish({k: v.select(*[F.col(c).cast("string").alias(c) for c in v.columns]) for k, v in sheets.items()}, path, "csv", omit_empty=True)


def rag_files(blocks: DataFrame, width: int, overlap: int, target: str, checksum: str) -> dict[str, DataFrame]:
    """documents (Markdown), metadata, chunks and the collection of canonical blocks: document_id, reading_order, block_id, block_type, level, text, path, page, region."""
    markdown = C.documents_in_markdown(blocks, C.markdown_block(F.col("block_type"), F.col("text"), F.coalesce(F.col("level"), F.lit(1))))
    titles, chunks = C.document_titles(blocks), C.rag_chunks(blocks, width, overlap, target, checksum)
    metadata = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("page").alias("first_page"), F.max("page").alias("last_page")).join(titles, "document_id")
    named = markdown.select("document_id", directory_id(F.col("document_id")).alias("directory"), "markdown", F.sha2("markdown", 256).alias("sha256"))
    return {"documents": named, "metadata": metadata, "chunks": chunks, "collection": named.select("document_id", "directory", "sha256")}


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>'


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def xml_text(c: str) -> str:
    """Escaped text; characters that XML can't hold are replaced."""
    return escape("".join(x if x in "\t\n\r" or " " <= x < "￾" or x > "￿" else "�" for x in c))


def sheet_xml(header: list[str], rows: list[list[str | None]]) -> str:
    """A worksheet of inline strings with a frozen header and a filter. Longer cells are an error, nothing is cut."""
    if len(rows) > ROWS:
        raise ValueError(f"{len(rows)} rows don't fit a sheet")

    def line(i: int, cells: list[str | None]) -> str:
        if any(c is not None and len(c) > CELL for c in cells):
            raise ValueError(f"row {i} has a cell of more than {CELL} characters")
        return f'<row r="{i}">' + "".join(f'<c r="{letters(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{xml_text(c)}</t></is></c>' for k, c in enumerate(cells, 1) if c is not None) + "</row>"

    body = "".join(line(i, r) for i, r in enumerate([list(header), *rows], 1))
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            f'<sheetData>{body}</sheetData><autoFilter ref="A1:{letters(len(header))}{len(rows) + 1}"/></worksheet>')


def workbook(name: str, header: list[str], rows: list[list[str | None]]) -> bytes:
    """An XLSX file of one sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml")), ("xl/workbook.xml", _BOOK.format(name=escape(name[:31], {'"': "&quot;"}))), ("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml")), ("xl/worksheets/sheet1.xml", sheet_xml(header, rows))):
            z.writestr(zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbooks(df: DataFrame, name: str, rows_per_book: int = 100_000) -> DataFrame:
    """book (partition-number), n_rows, content (an XLSX file) of all rows: a book for each ``rows_per_book`` rows of a partition, so no sheet overflows and no row is left out."""
    header = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[list[str | None]] = []
        made = 0

        def out() -> pa.RecordBatch:
            nonlocal made
            row = pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId():05d}-{made:05d}"]), pa.array([len(held)], pa.int64()), pa.array([workbook(name, header, held)], pa.binary())], names=["book", "n_rows", "content"])
            made += 1
            held.clear()
            return row

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(list(row))
                if len(held) == rows_per_book:
                    yield out()
        if held:
            yield out()

    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in header]).mapInArrow(run, "book string, n_rows long, content binary")


def overflow(df: DataFrame, most: int = ROWS, cell: int = CELL) -> DataFrame:
    """name of each column that a sheet can't hold, and whether the rows don't fit: such data go beside the sheet as a dataset, never cut."""
    long = [F.count_if(F.length(F.col(f"`{c}`").cast("string")) > cell).alias(c) for c in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *long)
    return counted.select(F.explode(F.array(F.struct(F.lit("rows").alias("what"), (F.col("_rows") > most).alias("over")), *[F.struct(F.lit(c).alias("what"), (F.col(f"`{c}`") > 0).alias("over")) for c in df.columns])).alias("x")).select("x.what", "x.over")
