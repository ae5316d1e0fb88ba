"""Packing by shortest-pack-first over the length histogram.

1. Documents are tokenised once; all whole stretches of ``length`` ids become sequences of their own, the rest of the
   document (1 to length-1 ids) is a piece to be packed. One document in ``filler_every`` is a filler: its rest may be
   cut further, and its ids are kept. A table of one narrow row for each document goes to the shared folder.
2. The histograms of rests and fillers (2 x length numbers, whatever the corpus) are packed on the driver: lengths are
   placed longest first, each class at once, into the emptiest open packs that hold it (the shortest pack first), and
   counts of packs are updated class by class. Fillers are then placed whole where they fit, cut to close the gaps
   that remain, and at last run together into sequences of their own.
   The plan is a list of runs: "pieces of length L with ranks a to b go to sequences s, s+1, ... at offset o".
3. A piece's rank among those of its length is its rank inside its partition plus the sum of the partitions before.
   The sums come from a table of counts by (partition, length), so no task ever holds all pieces of one length.
4. Each piece finds its run by (length, rank) in the plan, whose size depends on ``length`` alone.

A sequence is padded to ``length`` unless its fill is a power of two. Ids are cut nowhere else: all pieces of a
document are disjoint and cover it. Edge cases: null text is an empty one, whose only id is the end id; very long texts
become many whole sequences; repeated rows are packed each on their own (``row_id`` tells them apart); an empty table
gives no pieces; other columns are not carried.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, worker_cache, written

LENGTH, END_ID = 2048, 1
_SPACES = re.compile(r"[ \t\n\r\f\v]+")
#: Letters before marks that are neither letters nor digits: always two words of the tokenizer.
_LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']+)").fullmatch
_ODD = re.compile(r"[\x1c-\x1f]")


class Encoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and then splits letters from the rest.

    Chunks between ASCII white space are encoded apart and remembered in two generations of at most ``remember`` chunks:
    when the young one is full it becomes the old one, and what is met again comes back from there. New chunks of letters, alone or
    before marks, are encoded many at a time, and their ids are told apart by the tokens that end a word. Texts that
    lower-casing could change otherwise (not in NFC, or with letters whose lower case depends on the place) are encoded whole.
    """

    def __init__(self, path: str, remember: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.seen, self.old, self.remember = Tokenizer.from_file(path), {}, {}, remember
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, chunks: list[str]) -> None:
        """Remembers chunks; those of letters alone are encoded together."""
        words = []
        for c in chunks:
            if c.isalpha():
                words.append(c)
            else:
                self.seen[c] = self._plain(c)
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for w, to in zip(part, (stops * 4).tolist(), strict=True):
                    self.seen[w] = raw[at:to]
                    at = to
            else:
                for w in part:
                    self.seen[w] = self._plain(w)

    def _known(self, fresh: set[str]) -> None:
        """Puts chunks that aren't remembered among the young."""
        seen, old = self.seen, self.old
        again = fresh.intersection(old)
        seen.update(zip(again, map(old.__getitem__, again), strict=True))
        fresh -= again
        cut = {c: m.groups() for c in fresh if not c.isalpha() and (m := _LETTERS_AND_MARKS(c)) and m[1].isalpha()}
        self._letters(list({w for w, _ in cut.values()}.union(fresh.difference(cut)).difference(seen)))
        for c, (letters, marks) in cut.items():
            if marks not in seen:
                seen[marks] = self._plain(marks)
            seen[c] = seen[letters] + seen[marks]

    def batch(self, texts: list[str], step: int = 500) -> Iterator[np.ndarray]:
        end = struct.pack("<I", END_ID)
        for start in range(0, len(texts), step):
            split: list[tuple[list[str], list[bytes | None], list[int]] | str] = []
            new: set[str] = set()
            if len(self.seen) > self.remember:
                self.old, self.seen = self.seen, {}
            seen = self.seen
            for text in texts[start:start + step]:
                plain = text.isascii()
                if not plain and ("\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text)) or "<|" in text:
                    split.append(text)
                    continue
                chunks = text.lower().split(None) if plain and not _ODD.search(text) else _SPACES.split(text.lower())
                ids = list(map(seen.get, chunks))
                gaps = [i for i, x in enumerate(ids) if x is None]
                new.update([chunks[i] for i in gaps])
                split.append((chunks, ids, gaps))
            self._known(new)
            for own in split:
                if isinstance(own, str):
                    yield np.frombuffer(self._plain(own) + end, "<u4")
                else:
                    chunks, ids, gaps = own
                    for i in gaps:
                        ids[i] = seen[chunks[i]]
                    yield np.frombuffer(b"".join(ids) + end, "<u4")


def encoder(path: str, remember: int) -> Encoder:
    """One for each Python worker: what it remembers serves the worker's next tasks too, until another operator runs there."""
    return worker_cache(f"packing {path} {remember}", lambda: Encoder(path, remember))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plan(rests: dict[int, int], fillers: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, ...]], int]:
    """Runs (filler, L, rank_from, packs, slots, start, size, sequence, offset) and the number of sequences.

    Of the class (filler, L), the piece of rank ``rank_from + j * packs + i`` puts its ids [start, start + size) into
    sequence + i at offset + j * size. A class fills an open pack with as many of its pieces as fit, which leaves it
    less than half its room, so a group of packs is met log2(length) times at most, and each step splits one group at
    most: O(length log length) runs, however many pieces there are.
    """
    runs: list[tuple[int, ...]] = []
    packs: dict[int, list[list[int]]] = defaultdict(list)  # room -> [first sequence, how many]
    sequences = 0

    def open_packs(n: int) -> None:
        nonlocal sequences
        packs[length].append([sequences, n])
        sequences += n

    def place(filler: int, piece: int, at: int, n: int, start: int, size: int, room: int) -> int:
        """Pieces of the class that went into one group of packs with this much room."""
        group = packs[room][-1]
        slots = min(room // size, n)
        take = min(group[1], n // slots)
        runs.append((filler, piece, at, take, slots, start, size, group[0], length - room))
        if left := room - slots * size:
            packs[left].append([group[0], take])
        group[0] += take
        group[1] -= take
        if not group[1]:
            packs[room].pop()
            if not packs[room]:
                del packs[room]
        return take * slots

    for piece in sorted(rests, reverse=True):
        n, at = rests[piece], 0
        while n:
            if max(packs, default=0) < piece:
                open_packs(-(-n // (length // piece)))
            done = place(0, piece, at, n, 0, piece, max(packs))  # the shortest packs first
            n, at = n - done, at + done
    uncut: list[list[int]] = []  # fillers that fit nowhere whole: [L, rank_from, n, start]
    for piece in sorted(fillers, reverse=True):
        n, at = fillers[piece], 0
        while n and max(packs, default=0) >= piece:
            done = place(1, piece, at, n, 0, piece, max(packs))
            n, at = n - done, at + done
        if n:
            uncut.append([piece, at, n, 0])
    while uncut:
        if not packs:
            # no gap is left: as many new packs as the longest class can fill, the rest of it closes their gaps
            uncut.sort(key=lambda x: x[0] - x[3])
            piece, at, n, start = uncut.pop()
            size = piece - start
            open_packs(max(1, n * size // length))
            fits = max(1, n * size // length) * (length // size)
            first, rest = min(n, fits), n - min(n, fits)
            while first:
                done = place(1, piece, at, first, start, size, length)
                first, at = first - done, at + done
            if rest:
                uncut.append([piece, at, rest, start])
            uncut.sort(key=lambda x: x[0] - x[3], reverse=True)
            continue
        piece, at, n, start = uncut.pop()  # cut the shortest filler to close the widest gap
        room = max(packs)
        size = min(room, piece - start)
        done = place(1, piece, at, n, start, size, room)
        if done < n:
            uncut.append([piece, at + done, n - done, start])
        if start + size < piece:
            uncut.append([piece, at, done, start + size])
    return runs, sequences


def tokenized(docs: DataFrame, tokenizer: str | None, length: int, filler_every: int, remember: int) -> DataFrame:
    """Narrow rows: part, row_id, doc_id, doc_tokens, whole (crc of each whole stretch), whole_rank, filler, rest, rest_rank, rest_crc, ids."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, remember), TaskContext.get().partitionId()
        ranks: dict[tuple[int, int], int] = defaultdict(int)
        row = whole_rank = 0
        for batch in batches:
            made = []
            for ids in encode.batch([t or "" for t in batch.column("text").to_pylist()]):
                whole, rest = divmod(len(ids), length)
                tail = ids[whole * length:].tobytes()
                filler = int(crc32(struct.pack("<qq", part, row)) % filler_every == 0 and rest > 0)
                made.append((part, row, len(ids), [crc32(ids[i * length:(i + 1) * length].tobytes()) for i in range(whole)], whole_rank, filler, rest, ranks[filler, rest], crc32(tail), tail if filler else None))
                ranks[filler, rest] += 1
                whole_rank += whole
                row += 1
            columns = list(zip(*made, strict=True)) if made else [[]] * 10
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "part", "row_id", "doc_tokens", "whole", "whole_rank", "filler", "rest", "rest_rank", "rest_crc", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, row_id long, doc_tokens long, whole array<long>, whole_rank long, filler int, rest int, rest_rank long, rest_crc long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, filler_every: int = 8, remember: int = 400_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id (string) of each piece.

    ``remember``: chunks in each of the two generations that a worker keeps, about 170 bytes each; results are the same for any number.
    """
    rows = written(tokenized(docs, tokenizer, length, filler_every, remember), "tokens")
    counts = written(rows.groupBy("part", "filler", "rest").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("filler", "rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = counts.groupBy("filler", "rest").agg(F.sum("n").alias("n")).collect()  # 2 x length rows at most
    runs, packed = plan({r.rest: r.n for r in histogram if not r.filler and r.rest}, {r.rest: r.n for r in histogram if r.filler}, length)

    # whole stretches: sequence ids after the packed ones, by running sums over partitions (one row for each)
    stretches = rows.groupBy("part").agg(F.sum(F.size("whole")).cast("long").alias("m"))
    wholes = stretches.withColumn("wholes_before", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keyed = rows.join(offsets.join(wholes, "part").select("part", "filler", "rest", "before", "wholes_before"), ["part", "filler", "rest"])

    table_ = np.array(runs, np.int64).reshape(-1, 9)
    order = np.lexsort((table_[:, 5], table_[:, 2], table_[:, 1], table_[:, 0]))
    sent = docs.sparkSession.sparkContext.broadcast(table_[order])  # O(length log length) runs
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        class_ = t[:, 0] * (length + 1) + t[:, 1]
        bounds = {int(c): (int(np.searchsorted(class_, c)), int(np.searchsorted(class_, c, "right"))) for c in np.unique(class_)}
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                own = f"{r['part']}-{r['row_id']}"
                first = packed + r["wholes_before"] + r["whole_rank"]
                for i, crc in enumerate(r["whole"]):
                    out.append((r["doc_id"], i * length, length, crc, r["doc_tokens"], first + i, 0, own))
                if not r["rest"]:
                    continue
                rank, base = r["before"] + r["rest_rank"], len(r["whole"]) * length
                lo, hi = bounds[r["filler"] * (length + 1) + r["rest"]]
                # runs of a class with the same ranks are the cuts of one piece; they stand together
                at = lo + int(np.searchsorted(t[lo:hi, 2], rank, "right")) - 1
                while at >= lo and t[at, 2] <= rank:
                    _, _, a, packs, slots, start, size, seq, off = t[at].tolist()
                    if rank < a + packs * slots:
                        slot, i = divmod(rank - a, packs)
                        crc = r["rest_crc"] if size == r["rest"] else crc32(r["ids"][4 * start:4 * (start + size)])
                        out.append((r["doc_id"], base + start, size, crc, r["doc_tokens"], seq + i, off + slot * size, own))
                        if start == 0:
                            break
                    at -= 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [batch.column("doc_id").type, *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id"])

    return keyed.select("doc_id", "part", "row_id", "doc_tokens", "whole", "whole_rank", "wholes_before", "filler", "rest", "rest_rank", "rest_crc", "before", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id string")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
