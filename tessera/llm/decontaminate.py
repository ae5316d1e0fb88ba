"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case (A-Z) words of letters, digits and non-ASCII characters. The patterns are the windows of
``window`` consecutive words of each benchmark item (an item of fewer words is one window), as sequences of word numbers
of three characters each, so that the automaton's size doesn't depend on the words' length. Each document is normalised and scanned once; ends of
occurrences give word spans, and these are mapped to character offsets of the original text.

The automaton is bounded: a benchmark of up to ``block_words`` words is one automaton (about 1.6 kB a word: 80 MB at the
default) and the documents take one pass. A larger one is dealt into blocks of that size by hash, long items in
overlapping stretches, and its windows also set bits in a bitmap of 2^27 bits (16 MB whatever the benchmark). A first
pass tells the documents that hold a window whose bit is set; only these are written and go through one block's
automaton after the other. Only one block is on the driver or in a worker at a time; there is no join.

Edge cases: a null text (document or item) has no words; a null item_id is the empty string; rows of one item_id are one
item; an empty benchmark marks nothing; windows that several items share count for each; repeated documents are judged on
their own. With ``keep_columns=True`` the other columns stay, but own columns named like a result's give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, checkpointed, table, worker_cache, written

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Word bytes as they are, A-Z lower-cased, all others a space; UTF-8 keeps every non-ASCII character's bytes at 0x80 or above.
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS), T.StructField("offsets", _SPANS)])
_ARROW = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("offsets", pa.list_(pa.list_(pa.int64())))])
RESULTS = ("n_words", "n_hit", "items", "spans", "offsets", "contaminated")
BITMAP = 27


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


class Automaton:
    """The windows of (item, words), each word written as three characters of its number.

    The three places have alphabets of their own, so that no occurrence starts inside a word; unknown words are number 0, which is in no window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        words = sorted({w for _, own in items for w in own})
        radix = 2
        while radix ** 3 <= len(words):
            radix += 1
        self.spelt = {w: chr(i // radix ** 2) + chr(radix + i // radix % radix) + chr(2 * radix + i % radix) for i, w in enumerate(words, 1)}
        self.unknown = chr(0) + chr(radix) + chr(2 * radix)
        self.owners: list[set[str]] = []
        self.lengths: list[int] = []
        known: dict[str, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, own in items:
            text = "".join(map(self.spelt.__getitem__, own))
            for i in range(max(1, len(own) - window + 1)):
                part = text[3 * i:3 * (i + window)]
                k = known.get(part)
                if k is None:
                    k = known[part] = len(self.owners)
                    self.owners.append(set())
                    self.lengths.append(len(part) // 3)
                    self.trie.add_word(part, k)
                self.owners[k].add(item)
        if self.owners:
            self.trie.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged word spans [from, to) that windows cover, and the items they belong to."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if not words or not self.owners:
            return spans, items
        spelt, unknown = self.spelt.get, self.unknown
        for last, k in self.trie.iter("".join([spelt(w, unknown) for w in words])):
            items |= self.owners[k]
            end = last // 3 + 1
            begin = end - self.lengths[k]
            while spans and spans[-1][0] >= begin:
                spans.pop()
            if spans and begin <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([begin, end])
        return spans, items


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def original_spans(text: str, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Word spans as character offsets of the original text."""
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], raw.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    codes = np.cumsum((np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80)
    chars = lambda byte: int(codes[byte - 1]) if byte else 0
    return [(chars(int(begins[a])), chars(int(ends[b - 1]))) for a, b in spans]


def _bits(words: list[bytes], sizes: list[int], seen: dict[bytes, int]) -> np.ndarray:
    """Places in the bitmap of the windows of these sizes."""
    if len(seen) > 200_000:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    out = [np.zeros(0, np.uint64)]
    for k in sizes:
        if len(h) >= k:
            total = np.full(len(h) - k + 1, k, np.uint64)
            for j in range(k):
                total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j:j + len(total)]
            out.append((total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITMAP))
    return np.concatenate(out).astype(np.int64)


def _stretches(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """item, text, n of items with words; long ones in stretches of about ``most`` words that share window - 1 words."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(most))
    cut = rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(most + window - 1)).alias("w"))
    return cut.select("item", F.array_join("w", " ").alias("text"), F.size("w").alias("n"))


def _bitmap(pieces: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """The bits of all windows, and the sizes of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for t in batch.column("text"):
                words = words_of(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bits(words, [min(window, len(words))], seen)))], names=["bit"])

    bits = pieces.select("text").mapInArrow(run, "bit long")
    place = F.col("bit") + 1  # Spark's buckets start at 1, and so do the values in them
    rows = bits.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 4096 rows of 4 kB at most
    out = np.zeros(1 << BITMAP, bool)
    for r in rows:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        out[(r["bucket"] - 1) * len(part):r["bucket"] * len(part)] = part
    sizes = [r[0] for r in pieces.select(F.least("n", F.lit(window)).alias("k")).distinct().collect()]  # window rows at most
    return np.packbits(out), sorted(sizes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 50_000, keep_columns: bool = False) -> DataFrame:
    """Documents with n_words, n_hit, items (sorted ids), spans (word positions), offsets (of the spans, in characters of the text) and contaminated."""
    spark = docs.sparkSession
    pieces = _stretches(benchmark, window, max(window, block_words // 4))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    own = [c for c in docs.columns if c not in RESULTS] if keep_columns else ["doc_id"]
    row = T.StructType([docs.schema[c] for c in own])
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "text", F.lit(None).cast(FOUND).alias("_found"))
    schema = T.StructType([T.StructField("_row", row), T.StructField("text", T.StringType()), T.StructField("_found", FOUND)])

    def passed(state: DataFrame, chosen: DataFrame, keep_text: bool) -> DataFrame:
        """With what this block's automaton finds added to _found."""
        sent = spark.sparkContext.broadcast([(r.item, words_of(r.text)) for r in chosen.select("item", "text").collect()])  # block_words words or so

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_cache("decontamination")
            auto = Automaton(sent.value, window)
            for batch in batches:
                rows, texts = [], batch.column("text")
                for text, before in zip(texts, batch.column("_found").to_pylist(), strict=True):
                    text = text.as_py()
                    words = words_of(text)
                    spans, ids = auto.scan(words)
                    if before:
                        spans, ids = merge(before["spans"] + spans), ids | set(before["items"])
                    rows.append({"n_words": len(words), "items": sorted(ids), "spans": spans, "offsets": original_spans(text, spans) if spans else []})
                yield pa.RecordBatch.from_arrays([batch.column("_row"), texts if keep_text else pa.nulls(len(texts), pa.string()), pa.array(rows, _ARROW)], names=["_row", "text", "_found"])

        return state.mapInArrow(run, schema)

    if blocks == 1:
        done = passed(state, pieces, False)
    else:
        pieces = written(pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark")
        packed, sizes = _bitmap(pieces, window)
        sent_bits = spark.sparkContext.broadcast(packed)  # 16 MB

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, seen = sent_bits.value, {}
            for batch in batches:
                rows, texts = [], []
                for text in batch.column("text"):
                    words = words_of(text.as_py())
                    at = _bits(words, sizes, seen)
                    maybe = bool((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).any()) if len(at) else False
                    texts.append(text.as_py() if maybe else None)
                    rows.append({"n_words": len(words), "items": [], "spans": [], "offsets": []})
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(rows, _ARROW)], names=["_row", "text", "_found"])

        looked = state.mapInArrow(marked, schema)
        some = written(looked.where("text IS NOT NULL"), "candidates")
        for block in range(blocks):
            some = passed(some, pieces.where(F.col("block") == block), block < blocks - 1)
            if block < blocks - 1:
                some = checkpointed(some)
        done = looked.where("text IS NULL").unionByName(some)
    n_hit: Column = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return done.select("_row.*", "_found.n_words", n_hit.alias("n_hit"), "_found.items", "_found.spans", "_found.offsets", (F.size("_found.spans") > 0).alias("contaminated"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark window occurs, with their own columns."""
    clear = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return decontaminate(clear, benchmark, keep_columns=True).where(~F.col("contaminated")).select("_row.*")


#: For tests: what a plain search for every window finds.
def brute_force(doc: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, int, str, bool]:
    words, hit, found = words_of(doc), set(), set()
    for item, text in items:
        own, item = words_of(text), "" if item is None else item
        for i in range(max(1, len(own) - window + 1) if own else 0):
            part = own[i:i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT item, list_slice(w, i, i + 9) AS part FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(part) AS k FROM p),
h AS (
  SELECT r, i, k, list_slice(w, i, i + k - 1) AS part FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT h.r, h.i, h.k, p.item FROM h JOIN p USING (part)),
covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS pos FROM m) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN ids USING (r)
"""
