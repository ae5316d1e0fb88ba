"""Spelling variants by two-dimensional range reporting.

Two words are near if one inserted, deleted or replaced code point makes one the other. For each edit position of a
word, the words that begin with what stands before it are an interval in forward order, and the words that end with what
stands behind it an interval in the order of reversed words. A word is the point (forward rank, reverse rank); a wavelet
matrix over the reverse ranks in forward order reports the points in the rectangle of both intervals, level by level for
all rectangles at once. Replacements are looked up among words of the same length, insertions among words one longer, which
gives deletions as well; of the places where the same insertion can be made, the first counts, so each pair is found once.

How the index is dealt out: let m be the length of the shorter word of a pair (or of both). An edit at position m // 2 or
later leaves the first m // 2 code points, an earlier one leaves the last m - m // 2. So each word goes to the group of its first and to
that of its last part, once for its own length and once as the longer word, and all of a pair's positions are covered by
exactly one group. A task sorts whole groups together, ``chunk`` rows at a time, and builds one index for each chunk. What leaves
a task is a word's number of near words and its best one so far, not the pairs.

Groups of more than ``block`` rows, and words of ``longest`` code points or more, take another exact way that is linear in their letters
and has no index: each position's prefix and suffix hashes meet in a join (at most one word for each letter of the alphabet
has the same ones), and pairs are compared in full.

Edge cases: null texts have no words, a null document id is written as an empty text; repeated rows count each on their own;
texts and words may be of any length; an empty table has no words; other columns are not carried. Ties: the smallest word in
code-point order. Forms lead to words at least ``factor`` times as frequent, so they end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SHORTEST, LEAST, TYPO_EVERY, FACTOR = 5, 3, 97, 2
BLOCK, CHUNK, LONGEST = 100_000, 200_000, 48
#: Latin-1: letters to lower case (A-Z alone), all else to a space.
_LETTERS = bytes(i if 97 <= i <= 122 or i >= 0xC0 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, typo_every: int | None = TYPO_EVERY, hold: int = 400_000) -> DataFrame:
    """word, n: runs of Latin letters of at least ``shortest`` code points and ``least`` occurrences.

    With ``typo_every``, a run whose crc32 with the document's id is a multiple of it loses one code point, as if mistyped there.
    A task adds up at most ``hold`` words (beyond one document's) before it passes them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(word) < shortest:
                        continue
                    if typo_every:
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < shortest:
                                continue
                    total[word] += n
                if len(total) > hold:
                    yield made()
        yield made()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class WaveletMatrix:
    """Reports which of the numbers 0..n-1 in ``sequence``, each there once, stand at given places and lie in given ranges."""

    def __init__(self, sequence: np.ndarray):
        self.bits = max(1, (len(sequence) - 1).bit_length())
        self.levels = []
        for bit in reversed(range(self.bits)):
            zero = (sequence >> bit) & 1 == 0
            before = np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)
            self.levels.append((bit, before, int(before[-1])))
            sequence = np.concatenate([sequence[zero], sequence[~zero]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the rectangle, value) of each point with place in [lo, hi) and value in [least, above)."""
        own = np.flatnonzero((lo < hi) & (least < above))
        lo, hi, value = lo[own], hi[own], np.zeros(len(own), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo].astype(np.int64), before[hi].astype(np.int64)
            own, lo, hi, value = np.concatenate([own, own]), np.concatenate([a, zeros + lo - a]), np.concatenate([b, zeros + hi - b]), np.concatenate([value, value | 1 << bit])
            keep = (lo < hi) & (value < above[own]) & (value + (1 << bit) > least[own])
            own, lo, hi, value = own[keep], lo[keep], hi[keep], value[keep]
        return own, value


def _letters(words: list[str], width: int) -> tuple[np.ndarray, int]:
    """Rows of zero-padded letters that sort by code point, and the bytes of a letter."""
    if (joined := "".join(words)).isascii() or max(joined, default="") <= "\xff":
        if "\0" not in joined:
            return np.array([w.encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width), 1
    out = np.zeros((len(words), width), ">u4")
    for row, w in zip(out, words, strict=True):
        row[:len(w)] = np.frombuffer(w.encode("utf-32-be"), ">u4") + 1
    return out.view(np.uint8).reshape(len(words), 4 * width), 4


def near_pairs(words: list[str], late: np.ndarray, m: np.ndarray, slice_: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(from, to) rows of near words, both ways, of one chunk of whole groups; ``late``: edits at m // 2 and behind, else before."""
    n, size = len(words), np.array([len(w) for w in words])
    width = int(size.max()) + 1
    forward, c = _letters(words, width)
    back = size[:, None] - 1 - np.arange(width)
    rows = np.arange(n)[:, None]
    reverse = np.where((back >= 0)[:, :, None], forward.reshape(n, width, c)[rows, np.maximum(back, 0)], 0).reshape(n, width * c).astype(np.uint8)
    key = lambda head, letters: np.ascontiguousarray(np.hstack([head, letters])).view(f"S{3 + width * c}").ravel()
    head = np.stack([late, m, size], 1).astype(np.uint8)
    forward_keys, reverse_keys = key(head, forward), key(head, reverse)
    by_forward, by_reverse = np.argsort(forward_keys, kind="stable"), np.argsort(reverse_keys, kind="stable")
    forward_keys, reverse_keys = forward_keys[by_forward], reverse_keys[by_reverse]
    rank = np.empty(n, np.int64)
    rank[by_reverse] = np.arange(n)
    matrix = WaveletMatrix(rank[by_forward])

    def interval(keys: np.ndarray, own: np.ndarray, target: int, letters: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys with the same head (but for their size) and the first ``keep`` letters of these rows."""
        first = np.where(np.arange(width * c) < keep[:, None] * c, letters[own], 0).astype(np.uint8)
        last = np.where(np.arange(width * c) < keep[:, None] * c, first, 255).astype(np.uint8)
        top = np.stack([late[own], m[own], m[own] + target], 1).astype(np.uint8)
        return np.searchsorted(keys, key(top, first)), np.searchsorted(keys, key(top, last), "right")

    asking = by_forward[size[by_forward] == m[by_forward]]  # in order, so that lookups are near each other
    waiting: list[tuple[np.ndarray, ...]] = []

    def answered() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, at, target, lo, hi, least, above = map(np.concatenate, zip(*waiting, strict=True))
        waiting.clear()
        which, value = matrix.report(lo, hi, least, above)
        a, b, i, longer = own[which], by_reverse[value], at[which], target[which] == 1
        same = ~longer & (a != b)
        yield a[same], b[same]
        letter = lambda row, k: forward.reshape(n, width, c)[row, k]
        first = longer & ((i == 0) | (letter(b, i) != letter(a, np.maximum(i - 1, 0))).any(1))
        yield np.concatenate([a[first], b[first]]), np.concatenate([b[first], a[first]])

    held = 0
    for i in range(width):
        for target in (0, 1):
            half = m[asking] // 2
            own = asking[np.where(late[asking] == 1, (i >= half) & (i < m[asking] + target), i < half)]
            for start in range(0, len(own), slice_):
                some = own[start:start + slice_]
                lo, hi = interval(forward_keys, some, target, forward, np.full(len(some), i))
                keep = hi - lo > 1 - target  # a word itself is no answer
                some, lo, hi = some[keep], lo[keep], hi[keep]
                if not len(some):
                    continue
                least, above = interval(reverse_keys, some, target, reverse, m[some] - i - 1 + target)
                keep = above - least > 1 - target
                waiting.append((some[keep], np.full(keep.sum(), i), np.full(keep.sum(), target), lo[keep], hi[keep], least[keep], above[keep]))
                held += len(waiting[-1][0])
                if held >= slice_:
                    yield from answered()
                    held = 0
    if waiting:
        yield from answered()


def best_of(words: list[str], n: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with near words, how many, and the row of the best: largest n, then smallest word."""
    order = np.empty(len(words), np.int64)  # 0 is the best
    order[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for a, b in pairs:
        count += np.bincount(a, minlength=len(words))
        np.minimum.at(best, a, order[b])
    at = np.argsort(order)
    own = np.flatnonzero(count)
    return own, count[own], at[best[own]]


def memberships(words: DataFrame, shortest: int) -> DataFrame:
    """g (group), late, m, word, n: the groups in which a word asks (m is its length) and those in which it is the longer one."""
    size = F.length("word")
    half = lambda m: F.floor(m / 2).cast("int")
    groups = [F.struct(F.lit(late).alias("late"), m.cast("int").alias("m"), (F.substring("word", F.lit(1), half(m)) if late else F.right("word", (m - half(m)).cast("int"))).alias("part")) for late in (0, 1) for m in (size, size - 1)]
    rows = words.where(size >= 1).select("word", "n", F.explode(F.array(*groups)).alias("x")).where(f"x.m >= {max(1, shortest)}")
    return rows.select(F.xxhash64("x.late", "x.m", "x.part").alias("g"), "x.late", "x.m", "word", "n")


def by_index(rows: DataFrame, chunk: int) -> DataFrame:
    """word, n_near, form_n, form of whole groups, from the index of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(t: pa.Table) -> pa.RecordBatch:
            words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
            own, count, best = best_of(words, n, near_pairs(words, t.column("late").to_numpy(), t.column("m").to_numpy()))
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in own.tolist()], pa.string()), pa.array(count), pa.array(n[best], pa.int64()), pa.array([words[i] for i in best.tolist()], pa.string())], names=["word", "n_near", "form_n", "form"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                t = pa.Table.from_batches(held)
                g = t.column("g").to_numpy()
                if cut := int(np.searchsorted(g, g[-1])):  # the last group may go on
                    yield made(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield made(pa.Table.from_batches(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, "word string, n_near long, form_n long, form string")


_PRIMES, _BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353 % 2_147_483_629)


def by_hashes(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The same for groups of any size and words of any length: positions meet by the hashes of what stands before and behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for late, m, word, own in zip(*(batch.column(c).to_pylist() for c in ("late", "m", "word", "own")), strict=True):
                letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
                size, before, powers = len(letters), [], []
                for p, base in zip(_PRIMES, _BASES, strict=True):
                    power = np.ones(size + 1, np.uint64)
                    done = 1
                    while done <= size:
                        step = np.uint64(pow(base, done, p))
                        more = min(done, size + 1 - done)
                        power[done:done + more] = power[:more] * step % np.uint64(p)
                        done += more
                    powers.append(np.uint64(base))
                    before.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters % np.uint64(p) * power[:size] % np.uint64(p))]) % np.uint64(p))
                half = m // 2
                at = np.arange(half, m + 1) if late else np.arange(half)
                sets = []  # kind 0: replaced at i; 1: something is inserted at i; 2: it is what was inserted
                if size == m:
                    sets += [(0, at[at < m], 1), (1, at, 0)]
                else:
                    sets += [(2, at[(at == 0) | (letters[at] != letters[np.maximum(at, 1) - 1])], 1)]
                for kind, i, skip in sets:
                    hashes = []
                    for p, base, b in zip(_PRIMES, powers, before, strict=True):
                        rest = (b[-1] + np.uint64(p) - b[i + skip]) % np.uint64(p)
                        hashes += [b[i], rest * base % np.uint64(p) if kind == 1 else rest]
                    for a in range(0, len(i), 100_000):
                        part = slice(a, a + 100_000)
                        k = len(i[part])
                        yield pa.RecordBatch.from_arrays([pa.array([own] * k, pa.string()), pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, m, np.int32)), pa.array(i[part].astype(np.int32)), *[pa.array(h[part].astype(np.int64)) for h in hashes]], names=["own", "kind", "m", "i", "h1", "h2", "h3", "h4"])

    made = rows.withColumn("own", F.md5("word")).select("late", "m", "word", "own").mapInArrow(run, "own string, kind int, m int, i int, h1 long, h2 long, h3 long, h4 long").withColumn("replaced", F.col("kind") == 0)
    keys = ["replaced", "m", "i", "h1", "h2", "h3", "h4"]
    pairs = made.alias("a").join(made.select(*keys, F.col("own").alias("other"), F.col("kind").alias("other_kind")).alias("b"), keys).where("own != other and (replaced or kind != other_kind)").select("own", "other", "i", "kind")
    named = words.select(F.md5("word").alias("own"), "word", "n")
    full = pairs.join(named.select("own", "word"), "own").join(named.select(F.col("own").alias("other"), F.col("word").alias("form"), F.col("n").alias("form_n")), "other")
    behind = lambda c, skip: F.substring(c, F.col("i") + 1 + skip, F.length(c))
    equal = (F.substring("word", F.lit(1), F.col("i")) == F.substring("form", F.lit(1), F.col("i"))) & F.when(F.col("kind") == 0, behind("word", 1) == behind("form", 1)).when(F.col("kind") == 1, behind("word", 0) == behind("form", 1)).otherwise(behind("word", 1) == behind("form", 0))
    return full.where(equal).select("word", F.lit(1).cast("long").alias("n_near"), "form_n", "form")


def near_words(words: DataFrame, shortest: int = SHORTEST, block: int = BLOCK, chunk: int = CHUNK, longest: int = LONGEST) -> DataFrame:
    """word, n_near, best (form_n, form) of the words (word, n; each once) that have near ones."""
    rows = memberships(words, shortest)
    large = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block).select("g"), "spelling-large")
    short = rows.where(F.col("m") < longest)
    some = not large.isEmpty()
    found = by_index(short.join(large, "g", "left_anti") if some else short, chunk)
    odd = rows.where(F.col("m") >= longest)
    if some:
        odd = odd.unionByName(short.join(large, "g", "left_semi"))
    found = found.unionByName(by_hashes(odd, words))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of word -> form, by doubling; as many rounds as the logarithm of the longest chain."""
    known = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        known = written(known.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def spelling_forms(words: DataFrame, factor: int = FACTOR, **options: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n; each once)."""
    words = written(words.select("word", "n"), "spelling-words")
    near = near_words(words, **options)
    good = F.col("form_n") >= factor * F.col("n")
    all_ = written(words.join(near, "word", "left").select("word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")), "spelling-forms")
    ends = roots(all_.where("form is not null"))
    return all_.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(count_words(table(spark, sf_dir, "documents")))
