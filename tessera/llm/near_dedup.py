"""Near-duplicate classes by ProbMinHash.

A text is the set of its shingles of ``width`` words (letters, digits, non-ASCII; A-Z lower-cased; a shorter text is
one shingle), each of weight 1, as in the verification. For each shingle arrivals of a Poisson process with its weight as rate are drawn
from its hash; each arrival goes to a random register, which keeps the earliest one, and a shingle stops as soon as its
next arrival is later than every register. Two texts agree in a register with their probability Jaccard similarity, which is that of the sets where weights are 1.
Registers are cut into bands; texts that share a band are candidates, and a candidate pair is verified by the exact
Jaccard similarity of its shingle sets. Classes are the connected components of verified pairs and exact copies.

At scale: exact copies are one node (the text's 128-bit hash). Each node is first compared with the least of the heads
(first nodes) of its bands' buckets, which joins most members of a large group. Only buckets whose members are in several
components go on. One of more than ``block`` is dealt into groups by hash, and each pair of groups is a tile with a task of
its own, so that all its pairs are compared. In a block or tile, all pairs from different components are verified in memory by
exact counts of common shingles; those that pass join their components there, so that a block of k texts emits k - 1 links at
most and no candidate pair, and none between two components stays unverified. 32 bands of 7 registers, cut from 112 in two
ways, find a pair of similarity 0.8 with probability 0.9988 (measured), one of 0.5 with 0.2. Components are found by
alternating large and small stars, each step from a checkpoint. Hot buckets and hubs only meet in joins that can be split, or
in sums that are pre-aggregated; nothing that grows with the corpus goes to the driver.

Edge cases: null text counts as empty; texts without words are copies only of equal texts; a null id is carried and is
class id only of a class that has no other; repeated rows are in one class; ties: the least id names the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, worker_cache, written
from .decontaminate import words_of

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashes of a text's shingles; those of words are remembered while they fit."""

    def __init__(self, width: int = 5, remember: int = 150_000):
        self.width, self.remember, self.seen = width, remember, {}
        self.odd = _mix(np.arange(1, width + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > self.remember:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        total = np.full(n, len(h) if len(h) < self.width else self.width, np.uint64)
        for j in range(min(self.width, len(h))):
            total = _mix(total + h[j:j + n] * self.odd[j])
        return total


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash signatures (element hash in each register) of weighted sets (hashes, weights), all at once."""
    b = len(sets)
    lens = np.fromiter((len(e) for e, _ in sets), np.int64, b)
    best, owner = np.full(b * registers, np.inf), np.repeat(np.arange(b), lens)
    sig = np.zeros(b * registers, np.uint64)
    if not lens.sum():
        return sig.reshape(b, registers)
    e, rate = np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets])
    x, seed = np.zeros(len(e)), e.copy()
    while len(e):
        seed = _mix(seed + U(0x9E3779B97F4A7C15))
        x = x - np.log(((seed >> U(11)).astype(np.float64) + 1) * 2.0 ** -53) / rate
        at = owner * registers + (_mix(seed ^ U(0xD6E8FEB86659FD93)) % U(registers)).astype(np.int64)
        new = np.flatnonzero(x < best[at])
        new = new[np.argsort(-x[new], kind="stable")]  # the earliest arrival is written last
        best[at[new]], sig[at[new]] = x[new], e[new]
        stay = x < best.reshape(b, registers).max(axis=1)[owner]
        e, rate, x, seed, owner = e[stay], rate[stay], x[stay], seed[stay], owner[stay]
    return sig.reshape(b, registers)


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.unique(shingles)
    return e, np.ones(len(e))


def bands_of(texts: list[str | None], shingler: Shingler, bands: int, rows: int, most: int = 400_000) -> list[tuple[np.ndarray, int]]:
    """Band hashes (half of them in a row, half in strides) and number of different shingles of each text (none for a text without words), in chunks of about ``most`` shingles."""
    out: list[tuple[np.ndarray, int]] = [(np.zeros(0, np.int64), 0)] * len(texts)
    chunk: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        flat = signatures([s for _, s in chunk], bands * rows // 2)
        sig = np.concatenate((flat.reshape(len(chunk), bands // 2, rows), flat.reshape(len(chunk), rows, bands // 2).transpose(0, 2, 1)), axis=1)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(chunk), bands)).copy()
        for j in range(rows):
            h = _mix(h * U(0x9E3779B97F4A7C15) + sig[:, :, j])
        for (i, (e, _)), x in zip(chunk, h.view(np.int64), strict=True):
            out[i] = x, len(e)
        chunk.clear()
        size = 0

    for i, t in enumerate(texts):
        s = shingler(t)
        if len(s):
            chunk.append((i, weighted(s)))
            size += len(s)
            if size >= most or len(chunk) >= 3000:
                flush()
    if chunk:
        flush()
    return out


def node_of(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node, bands, size of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_cache(f"shingles {width}", lambda: Shingler(width))
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            first = {n: i for i, n in reversed(list(enumerate(nodes)))}  # copies in a batch are sketched once
            chosen = sorted(first.values())
            made = dict(zip((nodes[i] for i in chosen), bands_of([batch.column("text")[i].as_py() for i in chosen], shingler, bands, rows), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array([made[n][0] for n in nodes], pa.list_(pa.int64())), pa.array([made[n][1] for n in nodes], pa.int64())], names=["doc_id", "node", "bands", "size"])

    return docs.select("doc_id", node_of().alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node binary, bands array<long>, size long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, s: sorted distinct shingle hashes of the nodes; ``nodes``: node, doc_id of one document that has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_cache(f"shingles {width}", lambda: Shingler(width))
        for batch in batches:
            sets = [np.unique(shingler(t.as_py())).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    own = F.xxhash64(F.col("doc_id"), F.col("node"))
    texts = docs.select("doc_id", node_of().alias("node"), "text").withColumn("k", own)
    some = nodes.select(own.alias("k"), F.col("node").alias("want"))
    return texts.join(some, "k", "left_semi").select("node", "text").mapInArrow(run, "node binary, s array<long>").dropDuplicates(["node"])


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose shingle sets have this Jaccard similarity or more."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    n = F.size(F.array_intersect("sa", "sb"))
    return both.where(n >= F.lit(similarity) * (F.size("sa") + F.size("sb") - n)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for the nodes of ``edges`` (a, b)."""
    state = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(state)
    while before[0]:
        # large star: every neighbour above u gets the least of u and its neighbours
        ends = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below get the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = checkpointed(small)
        now = mark(state)
        if now == before:
            break
        before = now
    tops = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops.select("node", F.col("node").alias("label")))


def block_links(members: DataFrame, similarity: float) -> DataFrame:
    """Verified pairs (a, b) that join the components of each bucket: a forest over them, never all pairs.

    ``members``: bucket, node, label, side, s; members of one side are not compared, but those of side 0. A bucket's members are in memory.
    """

    def block(nodes: list[bytes], labels: list[bytes], sides: list[int], sets: list[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
        if len(set(labels)) < 2:
            return
        label = np.unique(np.array(labels, dtype="V16"), return_inverse=True)[1]
        side, size = np.array(sides), np.array([len(x) for x in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ids, mark = np.split(flat.astype(np.int32), np.cumsum(size)[:-1]), np.zeros(len(known), np.int8)
        for i in range(len(nodes) - 1):
            other = i + 1 + np.flatnonzero((label[i + 1:] != label[i]) & ((side[i + 1:] != side[i]) | (side[i] == 0)))
            other = other[np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i])]
            if not len(other):
                continue
            mark[ids[i]] = 1
            common = np.add.reduceat(mark[np.concatenate([ids[j] for j in other])], np.cumsum(size[other]) - size[other], dtype=np.int64)
            mark[ids[i]] = 0
            for j in other[common >= similarity * (size[i] + size[other] - common)]:
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    yield nodes[i], nodes[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def buckets() -> Iterator[tuple[list, list, list, list]]:
            at, held = None, ([], [], [], [])
            for batch in batches:
                keys, s = batch.column("bucket").to_numpy(), batch.column("s")
                ends, flat = s.offsets.to_numpy(), s.values.to_numpy()
                columns = [*(batch.column(c).to_pylist() for c in ("node", "label", "side")), [flat[x:y].copy() for x, y in zip(ends, ends[1:])]]
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for x, y in zip(cuts, cuts[1:]):
                    if y > x:
                        if keys[x] != at:
                            yield held
                            at, held = keys[x], ([], [], [], [])
                        for own, new in zip(held, columns):
                            own.extend(new[x:y])
            yield held

        worker_cache("blocks")
        for bucket in buckets():
            found = list(block(*bucket))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    rows = members.select("bucket", "node", "label", "side", "s").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "a binary, b binary").distinct()


def classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 32, rows: int = 7, block: int = 3_000_000) -> DataFrame:
    """doc_id, node (hash of the text), class_id (least doc_id), class_node (the least node among those of class_id), class_size.

    ``block``: most shingles of the texts of a bucket that is compared in memory, where each text counts 1000 more (eight
    texts or fewer always are); a larger one is compared in tiles of about that size.
    """
    sketches = written(sketched(docs, width, bands, rows), "sketches")
    nodes = written(sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("size").alias("size")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", "head")
    shared = written(members.join(heads, "bucket"), "buckets")
    sets = written(shingle_sets(docs, nodes.select("node", "doc_id").join(shared.select("node").distinct(), "node", "left_semi"), width), "shingles")
    # one comparison for each node first: with the least of its heads; most members of a large group meet here
    first = shared.where("node <> head").groupBy("node").agg(F.min("head").alias("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = written(verified(first, sets, similarity), "links")
    labels = written(components(links), "labels")

    known = nodes.select("node", F.col("size").cast("long").alias("size"))

    def mixed(members: DataFrame) -> DataFrame:
        """bucket, node, label of the buckets whose members are in several components, with their weight k."""
        named = members.join(labels, "node", "left").join(known, "node").select("bucket", "node", "size", F.coalesce("label", "node").alias("label"))
        several = named.groupBy("bucket").agg(F.when(F.count(F.lit(1)) > 8, F.sum(F.col("size") + 1000)).otherwise(0).alias("k"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket", "k")
        return named.drop("size").join(several, "bucket")

    # a bucket of more than a block is dealt into groups of half a block; each pair of groups, and each with itself, is a tile
    found = written(mixed(shared), "mixed")
    blocks = found.where(F.col("k") <= block).select("bucket", "node", "label", F.lit(0).alias("side"))
    dealt = found.where(F.col("k") > block).withColumn("groups", F.ceil(2 * F.col("k") / block)).withColumn("own", F.pmod(F.xxhash64("node", "bucket"), "groups"))
    tiles = (dealt.select("bucket", "node", "label", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("other"))
             .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "label", F.signum(F.col("own") - F.col("other")).cast("int").alias("side")))
    blocks = blocks.unionByName(tiles)
    more = written(block_links(blocks.join(sets, "node"), similarity), "links")
    if not more.isEmpty():
        labels = written(components(links.unionByName(more)), "labels")
    labelled = nodes.select("node", "doc_id", "n").join(labels, "node", "left").select("node", "doc_id", "n", F.coalesce("label", "node").alias("label"))
    named = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m"), F.sum("n").alias("class_size"))
    by_node = labelled.join(named, "label").select("node", F.col("m.doc_id").alias("class_id"), F.col("m.node").alias("class_node"), "class_size")
    return sketches.select("doc_id", "node").join(by_node, "node").select("doc_id", "node", "class_id", "class_node", "class_size")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).alias("keep"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class (that of the least id), with its own columns."""
    key = lambda d, n: F.md5(F.concat_ws("/", F.hex(n), F.coalesce(F.col(d).cast("string"), F.lit("null"))))
    kept = classes(docs, **options).select(key("class_id", "class_node").alias("_key")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", node_of().alias("_node"))
    rows = own.select("_row", key("doc_id", "_node").alias("_key"))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
