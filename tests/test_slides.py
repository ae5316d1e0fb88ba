import random
import time

import pytest

from tessera.operators import slides as S

KIND = "document_id string, reading_order int, block_type string, text string, n_rows int, height int"


def lines_of(text, per_line):
    """The lines, by walking over the characters."""
    out, column = [""], 0
    for c in text:
        if c == "\n":
            out[-1] += c
            out.append("")
            column = 0
            continue
        if column == per_line:
            out.append("")
            column = 0
        out[-1] += c
        column += 1
    return out


def test_lines():
    r = random.Random(1)
    for _ in range(500):
        text, per = "".join(r.choices("ab\n", [5, 5, 1], k=r.randint(1, 40))), r.randint(1, 9)
        starts, want = S.line_starts(text, per), lines_of(text, per)
        assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] == want


def blocks(seed, n=60):
    r = random.Random(seed)
    out = []
    for d in ("a", "b", None):
        for i in range(n):
            kind = r.choice(["HEADING", "PARAGRAPH", "PARAGRAPH", "CAPTION", "TABLE", "IMAGE"])
            text = "".join(r.choices("word \n", [9, 9, 9, 9, 5, 1], k=r.choice([0, 5, 300, 9000]))) if kind not in ("TABLE", "IMAGE") else None
            out.append((d, i, kind, text, r.choice([0, 1, 16, 90, None]) if kind == "TABLE" else None, r.choice([10, 2_743_200]) if kind == "IMAGE" else None))
    return out


@pytest.mark.parametrize("small_batches", [False, True])
def test_pieces_cover_blocks_and_fit(spark, small_batches):
    rows = blocks(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if small_batches else 10_000)
    try:
        got = S.slide_pieces(spark.createDataFrame(rows, KIND).repartition(5)).orderBy("document_id", "reading_order", "piece").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = S.Layout()
    by = {}
    for x in got:
        by.setdefault((x.document_id, x.reading_order), []).append(x)
    for d, i, kind, text, n_rows, height in rows:
        mine = by.get((d, i), [])
        assert [x.piece for x in mine] == list(range(len(mine)))
        whole = len(text) if text is not None else (n_rows or 0) if kind == "TABLE" else 0
        assert sum(x.length for x in mine) == whole and len(mine) >= (kind in ("TABLE", "IMAGE") or whole > 0)
        at = 0
        for x in mine:
            assert x.start == at and own.top <= x.y and (x.y + x.height <= own.bottom)
            at += x.length
        assert [x.slide for x in mine] == list(range(mine[0].slide, mine[0].slide + len(mine))) if mine else True  # goes on with the next slide
    for d in ("a", "b", None):
        mine = [x for x in got if x.document_id == d]
        for a, b in zip(mine, mine[1:]):
            assert (b.slide, b.y) == (a.slide, a.y + a.height + own.gap) or (b.slide == a.slide + 1 and b.y == own.top)
        starts = {x.slide: x for x in reversed(mine)}
        kinds = {i: k for e, i, k, *_ in rows if e == d}
        assert all(starts[x.slide] == x for x in mine if kinds[x.reading_order] == "HEADING" and x.piece == 0)


def test_a_long_document_takes_linear_time():
    slide = S.Slide(S.Layout())
    began = time.perf_counter()
    for _ in range(100_000):
        list(slide.pieces("PARAGRAPH", "some words", 0, 0))
    assert len(list(slide.pieces("PARAGRAPH", "x" * 3_000_000, 0, 0))) > 1000
    assert time.perf_counter() - began < 10


def test_odd_blocks(spark):
    with pytest.raises(ValueError):
        list(S.Slide(S.Layout()).pieces("FORMULA", "x", 0, 0))
    with pytest.raises(ValueError):
        S.Layout(bottom=400_000)
    assert S.slide_pieces(spark.createDataFrame([], KIND)).count() == 0
    # a last line feed gives an empty line, which takes height but no piece of its own
    own = S.Layout()
    full = "x\n" * ((own.bottom - own.top - own.paragraph.padding) // own.paragraph.line)
    assert [(p[0], p[1]) for p in S.Slide(own).pieces("PARAGRAPH", full, 0, 0)] == [(0, len(full))]
