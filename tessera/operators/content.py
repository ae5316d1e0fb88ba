"""Ordered blocks: overlapping chunks, heading paths, coverage, semantic checks, Markdown. All work is by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import running

from ..functions.fields import CONVERSION_MARKS, RAG_MARKS, markdown_escaped, table_cell


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One paragraph block for each line with text: document_id, reading_order (from 0), block_type, text."""
    kept = docs.select(F.col(key).alias("document_id"), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return kept.select("document_id", F.posexplode("lines").alias("reading_order", "text")).withColumn("block_type", F.lit("PARAGRAPH"))


def chunk_starts(n: Column, width: int, overlap: int) -> Column:
    """Starts k * (width - overlap) until a chunk reaches the end."""
    step = width - overlap
    if not 0 <= overlap < width <= 1000:
        raise ValueError("0 <= overlap < width <= 1000 is asked for")
    last = F.when(n > width, F.ceil((n - width) / F.lit(step))).otherwise(0)
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: k * step)


def chunked(docs: DataFrame, width: int, overlap: int, items: str = "lines", key: str = "doc_id") -> DataFrame:
    """document_id, sequence (from 1), start, n_blocks, text (blocks joined by an empty line). No shuffle: a document's blocks are an array."""
    some = docs.where(F.size(items) > 0).select(F.col(key).alias("document_id"), F.col(items).alias("b"), F.posexplode(chunk_starts(F.size(items), width, overlap)).alias("sequence", "start"))
    part = F.slice("b", F.col("start") + 1, F.lit(width))
    return some.select("document_id", (F.col("sequence") + 1).alias("sequence"), "start", F.size(part).alias("n_blocks"), F.array_join(part, "\n\n").alias("text"))


def heading_paths(blocks: DataFrame, levels: int = 6) -> DataFrame:
    """Adds ``path``: the running headings at each block, itself included; gaps in level are UNKNOWN. Linear: for each level the last heading, which stands while none above it came later."""
    w = Window.partitionBy("document_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("block_type") == "HEADING"
    last = {f"_h{k}": F.last(F.when(heading & (F.col("level") == k), F.struct(F.col("reading_order").alias("at"), "text")), ignorenulls=True).over(w) for k in range(1, levels + 1)}
    own = blocks.columns
    made = blocks.withColumns(last | {"_depth": F.coalesce(F.last(F.when(heading, F.col("level")), ignorenulls=True).over(w), F.lit(0))})
    parts = []
    for k in range(1, levels + 1):
        above = F.greatest(*[F.col(f"_h{j}.at") for j in range(1, k)], F.lit(None), F.lit(None)) if k > 1 else F.lit(None)
        stands = F.col(f"_h{k}").isNotNull() & (above.isNull() | (F.col(f"_h{k}.at") > above))
        parts.append(F.when(stands, F.col(f"_h{k}.text")).otherwise("UNKNOWN"))
    return made.withColumn("path", F.slice(F.array(*parts), F.lit(1), F.col("_depth"))).select(*own, "path")


def plain_text(kind: Column, text: Column, columns: Column, rows: Column, alt: Column) -> Column:
    """A block as plain text: tables as lines of cells, images by their alternative text."""
    table = F.concat_ws("\n", F.array_join(columns, " | "), F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n"))
    return F.when(kind == "TABLE", F.when(F.size(rows) > 0, table).otherwise(F.array_join(columns, " | "))).when(kind == "IMAGE", F.coalesce(alt, F.lit(""))).otherwise(text)


def page_coverage(blocks: DataFrame) -> DataFrame:
    """Of each document: least and greatest page, number of pages, and whether they run from 1 without a gap; blocks: page."""
    made = blocks.groupBy("document_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count_distinct("page").alias("n_pages"))
    return made.withColumn("contiguous", F.coalesce((F.col("first_page") == 1) & (F.col("last_page") == F.col("n_pages")), F.lit(False)))


def pages_with_many_images(blocks: DataFrame) -> DataFrame:
    """document_id, page, n of pages that hold more than one image."""
    return blocks.where(F.col("block_type") == "IMAGE").groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def document_titles(blocks: DataFrame) -> DataFrame:
    """The first heading of level 1 of each document, else UNKNOWN."""
    first = F.min_by(F.when((F.col("block_type") == "HEADING") & (F.col("level") == 1), F.col("text")), F.when((F.col("block_type") == "HEADING") & (F.col("level") == 1), F.col("reading_order")))
    return blocks.groupBy("document_id").agg(F.coalesce(first, F.lit("UNKNOWN")).alias("title"))


def content_sheet(blocks: DataFrame) -> DataFrame:
    """The sheet of canonical content: a row for each block with its text or table flattened."""
    return blocks.select("document_id", "block_id", "block_type", "reading_order", "parent_block_id", "level", F.when(F.col("block_type") == "TABLE", F.to_json("rows")).otherwise(F.col("text")).alias("text"), F.array_join("columns", " | ").alias("columns"),
                         F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"), "asset_reference", "alt_text", "target_block_id", "page")


def running_bytes(members: DataFrame, most: int, each: int) -> DataFrame:
    """Members (document_id, position, size) with the bytes so far in their document and whether a limit is passed."""
    w = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumn("bytes", F.sum("size").over(w)).withColumn("over", (F.col("bytes") > most) | (F.col("size") > each))


def package_bytes(members: DataFrame, most: int, each: int, pieces: int | None = None) -> DataFrame:
    """The same over a whole package: the bytes so far of all its members in the order of document and position."""
    summed = running(members, ["document_id", "position", "size"], "size", "bytes", pieces)
    return summed.withColumn("over", (F.col("bytes") > most) | (F.col("size") > each))


def row_height(text: Column, width: int, line: float = 15.0, least: float = 30.0, most: float = 405.0) -> Column:
    """Height of a sheet's row: lines of ``width`` characters, within bounds."""
    lines = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1), F.ceil(F.length(x) / F.lit(width))))
    return F.least(F.greatest(lines * F.lit(line), F.lit(least)), F.lit(most))


def fit_box(width: Column, height: Column, box_width: float, box_height: float) -> Column:
    """struct(width, height, left, top) of an image scaled into a box and centred."""
    scale = F.least(F.lit(box_width) / width, F.lit(box_height) / height)
    return F.struct((width * scale).alias("width"), (height * scale).alias("height"), ((F.lit(box_width) - width * scale) / 2).alias("left"), ((F.lit(box_height) - height * scale) / 2).alias("top"))


def on_slide(box: Column, slide_width: float, slide_height: float) -> Column:
    """A box on a page (x, y, width, height, page_width, page_height) as one on a slide, clamped to it."""
    x, y = box["x"] / box["page_width"] * slide_width, box["y"] / box["page_height"] * slide_height
    clamp = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    left, top = clamp(x, F.lit(slide_width)), clamp(y, F.lit(slide_height))
    return F.struct(left.alias("x"), top.alias("y"), clamp(box["width"] / box["page_width"] * slide_width, F.lit(slide_width) - left).alias("width"), clamp(box["height"] / box["page_height"] * slide_height, F.lit(slide_height) - top).alias("height"))


def paginated(blocks: DataFrame, height: str, most: float) -> DataFrame:
    """Adds ``slide``: blocks in order go on a slide while their heights fit and no heading comes. The state is one document's running height, so a document is folded in its row."""
    items = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "block_type", F.col(height).cast("double").alias("h")))).alias("b"))
    zero = F.struct(F.lit(0).alias("slide"), F.lit(0.0).cast("double").alias("used"), F.array().cast("array<struct<reading_order:bigint,slide:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["slide"] == 0) | (x["block_type"] == "HEADING") | (s["used"] + x["h"] > most)
        slide = (s["slide"] + new.cast("int")).cast("int")
        return F.struct(slide.alias("slide"), F.when(new, x["h"]).otherwise(s["used"] + x["h"]).cast("double").alias("used"), F.concat(s["out"], F.array(F.struct(x["reading_order"].cast("long").alias("reading_order"), slide.alias("slide")))).alias("out"))

    return items.select("document_id", F.explode(F.aggregate("b", zero, step, lambda s: s["out"])).alias("x")).select("document_id", "x.reading_order", "x.slide")


def order_violations(blocks: DataFrame) -> DataFrame:
    """Blocks whose reading order is not above the one before, by position."""
    before = F.lag("reading_order").over(Window.partitionBy("document_id").orderBy("position"))
    return blocks.withColumn("before", before).where(F.col("reading_order") <= F.col("before"))


def dangling(blocks: DataFrame, reference: str = "parent_block_id") -> DataFrame:
    known = blocks.select("document_id", F.col("block_id").alias(reference))
    return blocks.where(F.col(reference).isNotNull()).join(known, ["document_id", reference], "left_anti")


def coverage(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id", "block_type").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("reading_order").alias("first_block"), F.max("reading_order").alias("last_block"))


def markdown_block(kind: Column, text: Column, level: Column, columns: Column | None = None, rows: Column | None = None, asset: Column | None = None, alt: Column | None = None, target: Column | None = None, dialect: str = "rag") -> Column:
    """A block in Markdown; tables, images and captions need their columns."""
    safe = markdown_escaped(text, RAG_MARKS if dialect == "rag" else CONVERSION_MARKS)
    made = F.when(kind == "HEADING", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), safe))
    if rows is not None:
        line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: table_cell(c, dialect)), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda c: F.lit("---")), " | "), F.lit(" |"))
        made = made.when(kind == "TABLE", F.array_join(F.concat(F.array(line(columns), rule), F.transform(rows, line)), "\n"))
    if asset is not None:
        made = made.when(kind == "IMAGE", F.concat(F.lit("!["), markdown_escaped(F.coalesce(alt, F.lit("Image"))), F.lit("]("), F.replace(F.replace(F.url_encode(asset), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit(")")))
    caption = F.concat(F.lit("*Caption for `"), markdown_escaped(target), F.lit("`: "), safe, F.lit("*")) if target is not None else F.concat(F.lit("*"), safe, F.lit("*"))
    return made.when(kind == "CAPTION", caption).otherwise(safe)


def documents_in_markdown(blocks: DataFrame, block: Column) -> DataFrame:
    """document_id, markdown: the blocks of each document in reading order, which are bounded by the document."""
    parts = F.array_sort(F.collect_list(F.struct("reading_order", block.alias("text"))))
    return blocks.groupBy("document_id").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"))


def rag_chunks(blocks: DataFrame, width: int, overlap: int, target: str, checksum: str) -> DataFrame:
    """Chunks with their blocks, heading path, locators, character count and a stable id; blocks: document_id, reading_order, block_id, path, text, page, region."""
    docs = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "text", "path", "page", "region"))).alias("b"))
    some = docs.select("document_id", "b", F.posexplode(chunk_starts(F.size("b"), width, overlap)).alias("k", "start"))
    part = F.slice("b", F.col("start") + 1, F.lit(width))
    made = some.select("document_id", (F.col("k") + 1).alias("sequence"), part["block_id"].alias("block_ids"), F.array_join(part["text"], "\n\n").alias("text"), F.get(part, 0)["path"].alias("heading_path"),
                       F.transform(part, lambda x: F.struct(x["block_id"].alias("block_id"), x["page"].alias("source_page"), x["region"].alias("source_region"))).alias("source_locators"))
    identity = F.to_json(F.struct("block_ids", F.lit(checksum).alias("config_checksum"), "document_id", "sequence", F.lit(target).alias("target_id"), F.sha2("text", 256).alias("text_checksum")))
    return made.withColumns({"character_count": F.length("text"), "chunk_id": F.concat(F.lit("chunk-"), F.substring(F.sha2(identity, 256), 1, 24))})
