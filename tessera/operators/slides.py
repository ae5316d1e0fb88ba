"""Slides of documents: blocks flow down a slide, texts and tables go on where they don't fit.

Blocks are dealt by document and sorted; a task folds them as they stream by and carries where it is on the slide from batch to
batch, so a document costs what its blocks cost and is never held. A text's lines don't depend on where it is cut, so a text is
measured once and its pieces are runs of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Style:
    per_line: int
    line: int
    padding: int


@dataclass(frozen=True)
class Layout:
    """Fixed values of the default: a slide's margins, the gap between items, and each kind's measure, in its units of length."""

    top: int = 300_000
    bottom: int = 6_558_000
    gap: int = 120_000
    row: int = 350_000
    heading: Style = Style(58, 430_000, 100_000)
    paragraph: Style = Style(105, 285_000, 90_000)
    caption: Style = Style(120, 240_000, 80_000)

    def __post_init__(self):
        room = self.bottom - self.top
        if room < 2 * self.row or any(s.per_line < 1 or s.line < 1 or room < s.line + s.padding for s in (self.heading, self.paragraph, self.caption)):
            raise ValueError("a slide must hold one line of each kind and one row under a table's head")


def line_starts(text: str, per_line: int) -> list[int]:
    """Where each line begins: after a line feed, and after ``per_line`` characters without one. A last line feed begins an empty line."""
    starts, at = [], 0
    for part in text.split("\n"):
        starts += range(at, at + max(len(part), 1), per_line)
        at += len(part) + 1
    return starts


class Slide:
    """Where a document is: the number of its slide, whether something stands there, and how far down."""

    def __init__(self, layout: Layout):
        self.layout, self.number, self.filled, self.y = layout, 1, False, layout.top

    def turn(self) -> None:
        self.number += self.filled
        self.filled, self.y = False, self.layout.top

    def put(self, height: int) -> tuple[int, int, int]:
        placed = self.number, self.y, height
        self.filled, self.y = True, self.y + height + self.layout.gap
        return placed

    def pieces(self, kind: str, text: str | None, n_rows: int, height: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(start, length, units, slide, y, height) of each piece; start and length in characters or rows, units in lines or rows."""
        own = self.layout
        if kind == "HEADING" and self.filled:
            self.turn()
        if kind == "TABLE":
            at = 0
            while True:
                room = (own.bottom - self.y) // own.row - 1
                if (room < 1) if at < n_rows else (room < 0):
                    self.turn()
                    continue
                take = min(n_rows - at, max(room, 0))
                yield at, take, take, *self.put((take + 1) * own.row)
                at += take
                if at >= n_rows:
                    return
                self.turn()
        if kind == "IMAGE":
            if self.y + height > own.bottom:
                self.turn()
            yield 0, 0, 1, *self.put(height)
            return
        if kind not in ("HEADING", "PARAGRAPH", "CAPTION"):
            raise ValueError(f"blocks of type {kind} have no place on a slide")
        style = getattr(own, kind.lower())
        starts, at = line_starts(text, style.per_line) if text else [], 0
        while at < len(starts) and starts[at] < len(text):
            room = (own.bottom - self.y - style.padding) // style.line
            if room < 1:
                self.turn()
                continue
            end = min(at + room, len(starts))
            stop = starts[end] if end < len(starts) else len(text)
            yield starts[at], stop - starts[at], end - at, *self.put(style.padding + (end - at) * style.line)
            at = end
            if at < len(starts) and starts[at] < len(text):
                self.turn()


def slide_pieces(blocks: DataFrame, layout: Layout | None = None) -> DataFrame:
    """document_id, reading_order, piece, slide, start, length, units, y, height of blocks (document_id, reading_order, block_type, text, n_rows, height).

    A heading begins a slide; a text without characters has no piece, a table without rows one; images have a height that fit_box gave. Null counts as nothing.
    """
    layout = layout or Layout()
    kind, order = blocks.schema["document_id"].dataType.simpleString(), blocks.schema["reading_order"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slide = object(), Slide(layout)
        numbers = ("piece", "slide", "start", "length", "units", "y", "height")
        for batch in batches:
            at, made = [], []
            columns = [batch.column(c).to_pylist() for c in ("document_id", "block_type", "text", "n_rows", "height")]
            for i, (document, block, text, n_rows, height) in enumerate(zip(*columns, strict=True)):
                if document != now:
                    now, slide = document, Slide(layout)
                for piece, (start, length, units, number, y, h) in enumerate(slide.pieces(block, text, n_rows or 0, height or 0)):
                    at.append(i)
                    made.append((piece, number, start, length, units, y, h))
            rows = batch.select(["document_id", "reading_order"]).take(pa.array(at, pa.int64()))
            values = list(zip(*made, strict=True)) if made else [[]] * len(numbers)
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, pa.int64()) for v in values]], names=["document_id", "reading_order", *numbers])

    rows = blocks.select("document_id", "reading_order", "block_type", "text", "n_rows", "height").repartition("document_id").sortWithinPartitions("document_id", "reading_order")
    return rows.mapInArrow(run, f"document_id {kind}, reading_order {order}, piece long, slide long, start long, length long, units long, y long, height long")
