"""Alignment of two tokenizers over a corpus by a dictionary of groups.

The places in a text where tokens of A and of B both end cut them into groups; a group's A tokens are linked with all its
B tokens. A corpus has far fewer distinct groups than groups, so everything that concerns a group is done once for each distinct one:

1. Tasks encode texts and intern their groups, written as ``a1,a2|b1``. A text is cut into chunks before each single space or line feed between
   other characters, where both tokenizers begin anew; a chunk's groups are remembered. A document is kept as numbers of groups with
   frequencies; a part of a task's documents passes on its dictionary with the number of documents of each group, and how
   often an id pair stands in several distinct groups of one document, which would count that document twice.
2. The parts' dictionaries become one; each distinct group's links are expanded once and weighted with its documents, which, less the
   double counts, gives each id pair's number of documents, and each A id's best pairs.
3. The links of a distinct group, with the times that each occurs in it, are joined with these, summed to one row for each group, and go back to the
   dictionaries by the group. A document's sums are those of its groups times their frequencies; documents meet their own
   part's dictionary in one stream sorted by part, of which a task holds one dictionary (``hold`` groups and what one batch adds).

Edge cases: null and empty texts, and texts whose token bytes are not those of the text behind a space (B writes a space for
U+2581), have no tokens: zeros, and an empty text for the hash; repeated rows are documents of their own; very long texts are
taken whole; an empty table gives no rows; columns other than doc_id and text are not carried. Strings of special tokens are plain text.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, worker_cache, written

HOLD, REMEMBER = 500_000, 300_000
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ODD = re.compile(r"\s\s|^\s|\s\Z")
DOC, GROUP, TWICE = 0, 1, 2
Chunk = str | tuple[str]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters are themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in pieces]
        self.space = self.b.piece_to_id("▁")
        # no piece goes on beyond a space or over a line feed, so that chunks can be encoded apart
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and pieces[self.space] == "▁"

    def chunks(self, text: str) -> list[Chunk]:
        """Parts of a text; what follows a space stands without it, and a text's own first line feed in a tuple."""
        if not self.cuts:
            return [(text,)]
        if not _ODD.search(text):
            return text.replace("\n", " \n").split(" ")
        first, *rest = _CUT.split(text)
        return [(first,) if first[:1] == "\n" else first, *[x[1:] if x[0] == " " else x for x in rest]]

    def encoded(self, chunks: list[Chunk]) -> Iterator[list[tuple[list[int], list[int]]] | None]:
        """The groups of each chunk; None if its bytes are not the text's."""
        bare = [c if isinstance(c, str) else c[0] for c in chunks]
        inner = [c[:1] == "\n" for c in chunks]  # false for a tuple
        of_a = self.a.encode_batch_fast([c if i else " " + c for c, i in zip(bare, inner, strict=True)], add_special_tokens=False)
        of_b = self.b.encode(bare, num_threads=1)
        for text, i, x, b in zip(bare, inner, of_a, of_b, strict=True):
            a = x.ids
            if i:
                if b[:1] != [self.space]:
                    yield None
                    continue
                b = b[1:]
            raw = (text if i else " " + text).encode()
            parts_a, parts_b = [self.a_bytes[t] for t in a], [self.b_bytes[t] for t in b]
            yield aligned(a, list(map(len, parts_a)), b, list(map(len, parts_b))) if b"".join(parts_a) == raw == b"".join(parts_b) else None


def aligned(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> list[tuple[list[int], list[int]]]:
    """Groups of two token lists of the same bytes."""
    groups, i, j, from_i, from_j, at_a, at_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a):
        at_a += a_sizes[i]
        i += 1
        while at_b < at_a:
            at_b += b_sizes[j]
            j += 1
        if at_a == at_b:
            groups.append((a[from_i:i], b[from_j:j]))
            from_i, from_j = i, j
    return groups


class Grown:
    """An array of numbers that is appended to."""

    def __init__(self, kind: str = "i8"):
        self.room, self.n = np.zeros(1024, kind), 0

    def extend(self, values: list[int]) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(max(len(self.room), len(values)), self.room.dtype)])
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)


class Interned:
    """What a worker remembers: groups and id pairs by number, and the groups of chunks (two generations of ``remember``)."""

    def __init__(self, a: str, b: str, remember: int):
        self.pair, self.remember = Pair(a, b), remember
        self.clear()

    def clear(self) -> None:
        self.groups: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.n_a, self.n_b, self.first, self.links = Grown(), Grown(), Grown(), Grown()
        self.first.extend([0])
        self.seen: dict[Chunk, tuple[bytes, str] | None] = {}
        self.old: dict[Chunk, tuple[bytes, str] | None] = {}
        self.docs, self.twice = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[Chunk]) -> None:
        n_a, n_b, first, links, at = [], [], [], [], self.links.n
        for chunk, groups in zip(chunks, self.pair.encoded(chunks), strict=True):
            if groups is None:
                self.seen[chunk] = None
                continue
            own, names = [], []
            for a, b in groups:
                name = f"{a[0]}|{b[0]}" if len(a) == len(b) == 1 else f"{','.join(map(str, a))}|{','.join(map(str, b))}"
                if (i := self.groups.get(name)) is None:
                    i = self.groups[name] = len(self.groups)
                    n_a.append(len(a))
                    n_b.append(len(b))
                    links += [self.pairs.setdefault(x, len(self.pairs)) for x in product(dict.fromkeys(a), dict.fromkeys(b))]
                    first.append(at + len(links))
                own.append(i)
                names.append(name)
            self.seen[chunk] = np.array(own, "<u4").tobytes(), ";".join(names)
        for grown, new in ((self.n_a, n_a), (self.n_b, n_b), (self.first, first), (self.links, links)):
            grown.extend(new)

    def begin(self) -> None:
        """A new part: no documents yet."""
        self.docs, self.twice = np.zeros(max(1024, len(self.groups)), np.int64), np.zeros(max(1024, len(self.pairs)), np.int64)

    def batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, str] | None]:
        """Numbers of a text's distinct groups, their frequencies, and its groups in order; None without tokens."""
        if len(self.seen) > self.remember:
            self.old, self.seen = self.seen, {}
        split = [self.pair.chunks(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.seen)
        again = fresh.intersection(self.old)
        self.seen.update(zip(again, map(self.old.__getitem__, again), strict=True))
        todo = list(fresh - again)
        for i in range(0, len(todo), 5000):
            self.learn(todo[i:i + 5000])
        for kind, most in (("docs", len(self.groups)), ("twice", len(self.pairs))):
            if len(had := getattr(self, kind)) < most:
                setattr(self, kind, np.concatenate([had, np.zeros(most, np.int64)]))
        first = self.first.room
        for chunks in split:
            found = list(map(self.seen.__getitem__, chunks))
            if not found or None in found:
                yield None
                continue
            own, freq = np.unique(np.frombuffer(b"".join([x[0] for x in found]), "<u4"), return_counts=True)
            self.docs[own] += 1
            size = first[own + 1] - first[own]
            links = self.links.room[np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            links.sort()
            same = links[1:][links[1:] == links[:-1]]
            if len(same):
                np.add.at(self.twice, same, 1)
            yield own, freq, ";".join([x[1] for x in found])


COLUMNS = {"kind": "int", "part": "long", "doc_id": "", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "held": "binary", "text": "string", "number": "int", "docs": "long", "a": "int", "b": "int"}


def interned(docs: DataFrame, a: str, b: str, hold: int, remember: int, texts: bool) -> DataFrame:
    """Documents, dictionaries and double counts (kind), as a written table."""
    kinds = COLUMNS | {"doc_id": docs.schema["doc_id"].dataType.simpleString()}
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_cache(f"alignment {a} {b} {remember}", lambda: Interned(a, b, remember))
        packer = zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId() << 24
        doc_kind: list[pa.DataType] = []

        def rows(kind: int, **columns: Any) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns |= {"kind": np.full(n, kind, np.int32), "part": np.full(n, part)}
            types = {c: arrow.get(k) or doc_kind[0] for c, k in kinds.items()} if kinds["doc_id"] not in arrow else {c: arrow[k] for c, k in kinds.items()}
            return pa.RecordBatch.from_arrays([x if isinstance(x := columns.get(c), pa.Array) else pa.nulls(n, t) if x is None else pa.array(x, t) for c, t in types.items()], names=list(types))

        def dictionary() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(state.docs[:len(state.groups)])
            names = list(state.groups)
            for i in range(0, len(used), 20_000):
                own = used[i:i + 20_000]
                yield rows(GROUP, number=own.astype(np.int32), text=[names[k] for k in own.tolist()], docs=state.docs[own])
            often = np.flatnonzero(state.twice[:len(state.pairs)])
            pairs = list(state.pairs) if len(often) else []
            for i in range(0, len(often), 20_000):
                own = often[i:i + 20_000]
                yield rows(TWICE, a=[pairs[k][0] for k in own.tolist()], b=[pairs[k][1] for k in own.tolist()], docs=state.twice[own])

        state.begin()
        for batch in batches:
            doc_kind[:] = [batch.column("doc_id").type]
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                made = []
                for found in state.batch(some.column("text").to_pylist()):
                    if found is None:
                        made.append((0, 0, 0, 0, "", None, ""))
                        continue
                    own, freq, groups = found
                    n_a, n_b = state.n_a.room[own], state.n_b.room[own]
                    held = packer.compress(np.diff(own, prepend=own.dtype.type(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
                    made.append((int(n_a @ freq), int(n_b @ freq), int(freq.sum()), int((n_a * n_b) @ freq), sha256(groups.encode()).hexdigest(), held, groups))
                n_a, n_b, n_groups, n_links, sha, held, groups = zip(*made, strict=True)
                more = {"text": groups} if texts else {}
                yield rows(DOC, doc_id=some.column("doc_id"), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=sha, held=held, **more)
                if len(state.groups) > hold:
                    yield from dictionary()
                    state.clear()
                    state.begin()
                    part += 1
        yield from dictionary()

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    path = f"{shared_folder(docs.sparkSession)}/tessera-alignment-{uuid.uuid4().hex}"
    docs.select("doc_id", "text").mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def expanded(groups: DataFrame) -> DataFrame:
    """group, docs, a, b, m: each distinct id pair of each distinct group once, with the times that it occurs in it."""
    sides = groups.select("group", "docs", F.split(F.split("group", "\\|")[0], ",").alias("as"), F.split(F.split("group", "\\|")[1], ",").alias("bs"))
    times = lambda ids, x: F.size(F.filter(ids, lambda y: y == x))
    one = sides.withColumn("a", F.explode(F.array_distinct("as"))).withColumn("times", F.when(F.size("as") == 1, 1).otherwise(times("as", F.col("a"))))
    both = one.withColumn("b", F.explode(F.array_distinct("bs")))
    return both.select("group", "docs", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), (F.col("times").cast("long") * F.when(F.size("bs") == 1, 1).otherwise(times("bs", F.col("b")))).alias("m"))


class Alignment:
    """The tables of a corpus: ``groups`` (group, docs), ``links`` of each distinct group, ``pairs`` (a, b, count, best) and ``documents()``."""

    def __init__(self, docs: DataFrame, a: str | None = None, b: str | None = None, hold: int = HOLD, remember: int = REMEMBER, texts: bool = False):
        import public_tokenizers

        self.texts = texts
        self.rows = interned(docs, a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"), hold, remember, texts)
        self.dictionaries = self.rows.where(f"kind = {GROUP}").select("part", "number", F.col("text").alias("group"), "docs")
        self.groups = self.dictionaries.groupBy("group").agg(F.sum("docs").alias("docs"))
        self.links = written(expanded(self.groups), "alignment-links")
        twice = self.rows.where(f"kind = {TWICE}").select("a", "b", (-F.col("docs")).alias("docs"))
        counts = written(self.links.select("a", "b", "docs").unionByName(twice).groupBy("a", "b").agg(F.sum("docs").alias("count")), "alignment-pairs")
        top = counts.groupBy("a").agg(F.max("count").alias("top"))
        self.pairs = counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and ``groups`` if asked for) of each document."""
        sums = self.links.join(self.pairs, ["a", "b"]).groupBy("group").agg(F.sum(F.col("m") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"))
        back = self.dictionaries.join(sums, "group").select("part", F.lit(GROUP).alias("kind"), "number", "count_sum", "n_best")
        own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "text"][:8 if self.texts else 7]
        docs = self.rows.where(f"kind = {DOC}").select("part", F.lit(DOC + 9).alias("kind"), *own)
        both = back.unionByName(docs, allowMissingColumns=True)
        kind, texts = self.rows.schema["doc_id"].dataType.simpleString(), self.texts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpacker = zstandard.ZstdDecompressor()
            part, parts, sums = None, [], None
            for batch in batches:
                parts_of, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero((parts_of[1:] != parts_of[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    if parts_of[i] != part:
                        part, parts, sums = parts_of[i], [], None
                    some = batch.slice(i, j - i)
                    if kinds[i] == GROUP:
                        parts.append([some.column(c).to_numpy() for c in ("number", "count_sum", "n_best")])
                        continue
                    if sums is None:
                        sums = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
                        parts = []
                    number, count, best = sums
                    totals = []
                    for held in some.column("held").to_pylist():
                        if held is None:
                            totals.append((0, 0))
                            continue
                        own, freq = np.frombuffer(unpacker.decompress(held), "<u4").astype(np.int64).reshape(2, -1)
                        at = np.searchsorted(number, np.cumsum(own))
                        totals.append((int(best[at] @ freq), int(count[at] @ freq)))
                    n_best, count_sum = zip(*totals, strict=True)
                    columns = {c: some.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": some.column("groups_sha256")} | ({"groups": some.column("text")} if texts else {})
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return both.repartition(parts, "part").sortWithinPartitions("part", "kind", "number").mapInArrow(
            run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * texts)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()
