"""Language-model scores from a probabilistic suffix tree.

Tokens are words and one end for each document. The tree has two levels, both with contexts of variable length that
are retained by frequency and by a divergence test against their parent:

* Words. Symbols are the frequent words (``p_word`` of all tokens or more, at most 1 / p_word), the end, and classes of the
  other words by their first three spelt symbols (``p_class``). The next symbol is predicted behind the longest retained suffix
  of the two symbols before it: a context is retained if it holds ``p_context`` of all symbols and its distribution diverges
  from that of its longest shorter suffix by ``divergence`` nats. Katz back-off to the shorter context.
* Spelling. A word that is no symbol of its own has P(word | class) = (c + f * P(spelling | class)) / (n + f), f the words of
  the class that occur once. The spelling is the word's UTF-8 bytes behind a boundary and closed by one; each byte is predicted from
  the longest retained suffix of up to ``depth`` symbols before it, and distributions are interpolated with the parent's
  down to the uniform one.

So P(text) is a (sub-)distribution over token sequences. Counts come from the training documents (held-out ones add none):

1. Words are counted in each partition and summed by word: the vocabulary, a table in the shared folder.
2. Byte counts behind full contexts are taken from the vocabulary's rare words (each once: what is spelt later is rare too)
   and summed to all suffixes; pairs of word symbols, and what follows frequent pairs, are counted over all training texts. What is below p_min or p_next is dropped,
   so the trees have at most (depth + 1) * 4 / p_min and 1 / p_next next symbols, whatever the corpus; they go to the tasks.
3. Each rare word of the vocabulary is spelt once; documents meet them in a shuffle join, summed by document.

No group is gathered in one task: words are pre-counted in each partition, frequent words never enter the join.
Edge cases: null text is an empty one (one token, the end); a null id counts as training data; repeated rows count and
are scored each on their own; with no training tokens all counts are 0 and symbols and bytes are uniform; other columns
are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_cache, written

BITS, EDGE, END, SYMBOLS = 9, 257, 258, 258  # a byte b is the symbol b + 1; 258 symbols can follow
SCALE = math.log10(math.e)


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def spelt(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol to predict: number of its word, code of the ``depth`` symbols before it, the symbol.

    An empty word stands for the end token."""
    body = b"".join(w + b"\0" for w in words)
    lens = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lens)
    last = np.cumsum(lens) - 1
    sym = np.frombuffer(body, np.uint8).astype(np.int64) + 1
    sym[last] = np.where(lens == 1, END, EDGE)
    place = np.arange(len(sym)) - np.repeat(last + 1 - lens, lens)
    code = np.zeros(len(sym), np.int64)
    for j in range(1, depth + 1):
        before = np.zeros(len(sym), np.int64)
        before[j:] = sym[:-j]
        code |= np.where(place >= j, before, np.where(place == j - 1, EDGE, 0)) << (BITS * (j - 1))
    return owner, code, sym


@dataclass
class Tree:
    """contexts: sorted codes; totals: n(c); entries: sorted (context index << BITS | symbol); counts: n(c, s)."""

    depth: int
    contexts: np.ndarray
    totals: np.ndarray
    entries: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        of = self.entries >> BITS
        kept = np.bincount(of, self.counts, len(self.contexts)) if len(self.entries) else np.zeros(len(self.contexts))
        # as many new symbols are expected as different ones were met (Witten and Bell)
        self.smooth = np.maximum(1, np.bincount(of, minlength=len(self.contexts)))
        self.rest = (self.totals - kept + self.smooth) / (self.totals + self.smooth)

    def log10(self, code: np.ndarray, sym: np.ndarray) -> np.ndarray:
        p = np.full(len(code), 1.0 / SYMBOLS)
        if not len(self.contexts):
            return np.log10(p)
        seen = np.full(len(code), -1, np.int64)
        for d in range(self.depth + 1):
            c = code & ((1 << (BITS * d)) - 1)
            at = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
            hit = (self.contexts[at] == c) & (c != seen)
            seen = c
            i, k = at[hit], np.zeros(int(hit.sum()))
            if len(self.entries):
                key = (i << BITS) | sym[hit]
                e = np.minimum(np.searchsorted(self.entries, key), len(self.entries) - 1)
                k = np.where(self.entries[e] == key, self.counts[e], 0)
            p[hit] = k / (self.totals[i] + self.smooth[i]) + self.rest[i] * p[hit]
        return np.log10(p)

    def words(self, words: list[bytes], given: np.ndarray | int = 0) -> np.ndarray:
        """log10 probability of each word behind its first ``given`` symbols; the empty one is the end."""
        if not words:
            return np.zeros(0)
        owner, code, sym = spelt(words, self.depth)
        lens = np.bincount(owner, minlength=len(words))
        place = np.arange(len(sym)) - np.repeat(np.cumsum(lens) - lens, lens)
        said = place >= np.broadcast_to(given, len(words))[owner]
        owner, code, sym = owner[said], code[said], sym[said]
        # equal (context, symbol) pairs are looked up once
        pairs, back = np.unique((code << BITS) | sym, return_inverse=True)
        return np.bincount(owner, self.log10(pairs >> BITS, pairs & ((1 << BITS) - 1))[back], len(words))


def with_held_out(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False)).alias("held_out"))


def vocabulary(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """word (binary; empty: the end), c: its count in training documents; words of held-out documents alone have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("suffix tree")
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            for i in range(0, len(items), 50_000):
                words, n = zip(*items[i:i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])
            seen.clear()

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                words = tokens_of(text.as_py())
                if held:
                    for w in words:
                        if w not in seen:
                            seen[w] = 0
                else:
                    seen.update(words)
                    seen[b""] += 1
                if len(seen) > flush:
                    yield from out()
        yield from out()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def grow(vocab: DataFrame, depth: int = 6, p_min: float = 5e-6, divergence: float = 0.01) -> Tree:
    """The tree of the vocabulary's words, each weighted by its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting = [], [], 0

        def fold() -> None:
            nonlocal waiting
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(sums), len(k))
            keys[:], sums[:], waiting = [k], [n], len(k)

        limit = 2_000_000
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            if words:
                owner, code, sym = spelt(words, depth)
                keys.append((code << BITS) | sym)
                sums.append(c[owner].astype(float))
                waiting += len(sym)
                if waiting > limit:
                    fold()
                    limit = max(limit, 3 * waiting)
        if keys:
            fold()
            for i in range(0, len(keys[0]), 100_000):
                k = keys[0][i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k >> BITS), pa.array((k & ((1 << BITS) - 1)).astype(np.int32)), pa.array(sums[0][i:i + 100_000].astype(np.int64))], names=["code", "sym", "n"])

    full = vocab.where("c > 0").select("word", "c").mapInArrow(count, "code long, sym int, n long").groupBy("code", "sym").agg(F.sum("n").alias("n"))
    suffixes = F.array_distinct(F.transform(F.array(*[F.lit((1 << (BITS * d)) - 1).cast("long") for d in range(depth + 1)]), lambda m: F.col("code").bitwiseAND(m)))
    every = written(full.select(F.explode(suffixes).alias("code"), "sym", "n").groupBy("code", "sym").agg(F.sum("n").alias("n")), "contexts")
    total = every.where("code = 0").agg(F.sum("n")).first()[0] or 0
    heavy = every.groupBy("code").agg(F.sum("n").alias("total")).where(F.col("total") >= max(1.0, p_min * total))
    kept = every.where(F.col("n") >= max(1.0, p_min * total / 4)).join(heavy, "code").select("code", "sym", "n", "total").toArrow()
    code, sym, n, totals = (kept.column(k).to_numpy() for k in ("code", "sym", "n", "total"))
    if not len(code):
        return Tree(depth, *[np.zeros(0, np.int64)] * 4)
    order = np.lexsort((sym, code))
    code, sym, n, totals = code[order], sym[order].astype(np.int64), n[order], totals[order]
    contexts, first, index = np.unique(code, return_index=True, return_inverse=True)
    tree = Tree(depth, contexts, totals[first], (index.astype(np.int64) << BITS) | sym, n)
    # divergence of each context from its longest shorter suffix in the tree
    lens = np.zeros(len(contexts), np.int64)
    for d in range(1, depth + 1):
        lens += contexts >> (BITS * (d - 1)) != 0
    own = n / totals
    above = code & ((np.int64(1) << (BITS * np.maximum(lens[index] - 1, 0))) - 1)
    gain = np.bincount(index, own * (np.log(own) - tree.log10(above, sym) / SCALE), len(contexts))
    stay = (gain >= divergence) | (contexts == 0)
    new = np.cumsum(stay) - 1
    e = stay[index]
    return Tree(depth, contexts[stay], totals[first][stay], (new[index[e]].astype(np.int64) << BITS) | sym[e], n[e])


def prefix_of(word: bytes) -> bytes:
    """The first three symbols of a spelt word."""
    return (word + b"\0")[:3]


@dataclass
class Alphabet:
    """Symbols of the word level: frequent words (the end is one of them), then prefix classes, then the rest."""

    words: list[bytes]
    counts: np.ndarray  # of the words
    classes: list[bytes]
    mass: np.ndarray  # training tokens of each class; the last is the rest's
    single: np.ndarray  # words of each class that occur once

    def __post_init__(self):
        self.first = len(self.words)
        self.rest = self.first + len(self.classes)
        self.size = self.rest + 1

    def ids(self) -> dict[bytes, int]:
        by_class = {c: self.first + i for i, c in enumerate(self.classes)}
        rest = self.rest

        class Ids(dict):
            def __missing__(self, word: bytes) -> int:
                return by_class.get((word + b"\0")[:3], rest)

        return Ids(zip(self.words, range(self.first), strict=True))

    def totals(self) -> np.ndarray:
        return np.concatenate((self.counts, self.mass)).astype(float)


def alphabet_of(vocab: DataFrame, n: int, p_word: float, p_class: float) -> tuple[Alphabet, float]:
    """At most 1 / p_word words and 1 / p_class classes; and the count from which a word is frequent."""
    least = max(1.0, p_word * n)
    common = vocab.where((F.col("c") >= least) | (F.length("word") == 0)).select("word", "c").toArrow()
    counts = dict(zip(common.column("word").to_pylist(), common.column("c").to_pylist(), strict=True))
    counts.setdefault(b"", 0)
    words = sorted(counts)
    rare = vocab.where((F.col("c") < least) & (F.length("word") > 0)).groupBy(F.substring(F.concat("word", F.lit(bytearray(1))), 1, 3).alias("class")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("single"))
    all_ = rare.agg(F.sum("n"), F.sum("single")).first()
    kept = rare.where(F.col("n") >= max(1.0, p_class * n)).orderBy("class").toArrow()
    m, single = kept.column("n").to_numpy(), kept.column("single").to_numpy()
    return Alphabet(words, np.array([counts[w] for w in words], np.int64), kept.column("class").to_pylist(), np.append(m, (all_[0] or 0) - m.sum()), np.append(single, (all_[1] or 0) - single.sum())), least


@dataclass
class WordTree:
    """Next-symbol distributions behind the empty context and behind retained contexts of one and two symbols; Katz back-off
    from each context to its longest shorter suffix."""

    root: np.ndarray
    state: np.ndarray  # of each symbol: its context's number, or 0 (the empty one)
    entries: np.ndarray  # sorted context * size + symbol
    log: np.ndarray
    back: np.ndarray  # log10 of each context's back-off weight
    pairs: np.ndarray  # sorted symbol * size + symbol: contexts of two, whose last symbol is a context of one
    entries2: np.ndarray
    log2: np.ndarray
    back2: np.ndarray

    def one(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of each symbol behind the symbol before it, from the context of one or the empty one."""
        size = len(self.root)
        keys, back = np.unique(self.state[before] * size + symbol, return_inverse=True)
        context, s = keys // size, keys % size
        out = self.back[context] + np.log10(self.root[s])
        if len(self.entries):
            at = np.minimum(np.searchsorted(self.entries, keys), len(self.entries) - 1)
            out = np.where(self.entries[at] == keys, self.log[at], out)
        return out[back]

    def log10(self, first: np.ndarray, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of each symbol behind the two symbols before it, from the longest retained suffix."""
        out, size = self.one(before, symbol), len(self.root)
        if len(self.pairs):
            keys = first * size + before
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = np.flatnonzero(self.pairs[at] == keys)
            context = at[hit]
            wanted = context * size + symbol[hit]
            longer = self.back2[context] + out[hit]
            if len(self.entries2):
                e = np.minimum(np.searchsorted(self.entries2, wanted), len(self.entries2) - 1)
                longer = np.where(self.entries2[e] == wanted, self.log2[e], longer)
            out[hit] = longer
        return out


def counted(docs: DataFrame, sent, keys_of, chunk: int = 1_000_000) -> DataFrame:
    """key, n over the symbols of the training documents: ``keys_of(symbols, sent.value)`` of stretches that overlap by two symbols."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("suffix tree")
        known = sent.value
        alphabet = known[0]
        ids, end = alphabet.ids(), alphabet.words.index(b"")
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        waiting, line = 0, [end, end]

        def fold() -> None:
            k = np.concatenate(keys)
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
            c = np.add.reduceat(np.concatenate(sums)[order], first) if len(k) else np.zeros(0, np.int64)
            keys[:], sums[:] = [k[first]], [c]

        def take() -> None:
            nonlocal waiting
            k, c = np.unique(keys_of(np.array(line, np.int64), known), return_counts=True)
            keys.append(k)
            sums.append(c)
            waiting += len(k)
            del line[:-2]
            if waiting > 4 * chunk:
                fold()
                waiting = len(keys[0]) // 2

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                if not held:
                    line.extend(map(ids.__getitem__, tokens_of(text.as_py())))
                    line.append(end)
                    if len(line) > chunk:
                        take()
        take()
        fold()
        for i in range(0, len(keys[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][i:i + 100_000]), pa.array(sums[0][i:i + 100_000])], names=["key", "n"])

    return docs.select("text", "held_out").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pair_keys(x: np.ndarray, known) -> np.ndarray:
    alphabet, may = known
    return (x[1:-1] * alphabet.size + x[2:])[may[x[1:-1]]]


def _triple_keys(x: np.ndarray, known) -> np.ndarray:
    alphabet, pairs = known
    keys = x[:-2] * alphabet.size + x[1:-1]
    at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
    hit = pairs[at] == keys
    return at[hit] * alphabet.size + x[2:][hit]


def grow_words(docs: DataFrame, alphabet: Alphabet, p_context: float, p_min: float, divergence: float, longest: int = 2) -> WordTree:
    """Counts next symbols behind contexts of one symbol and, for frequent pairs of them, of two; contexts of p_context of all symbols or more, next symbols of p_min."""
    totals, size = alphabet.totals(), alphabet.size
    n = totals.sum()
    root = (totals + 0.5) / (n + 0.5 * size)
    may = totals >= max(1.0, p_context * n)
    spark, none = docs.sparkSession, np.zeros(0, np.int64)

    def gathered(sent, keys_of) -> tuple[np.ndarray, np.ndarray]:
        found = counted(docs, sent, keys_of).where(F.col("n") >= max(2.0, p_min * n)).toArrow()  # 1 / p_min rows at most
        key, k = found.column("key").to_numpy(), found.column("n").to_numpy()
        order = np.argsort(key)
        return key[order], k[order].astype(float)

    key, k = gathered(spark.sparkContext.broadcast((alphabet, may)), _pair_keys)
    context, symbol = key // size, key % size
    p = (k - 0.5) / totals[context]
    gain = np.bincount(context, p * np.log(p / root[symbol]), size)
    stay = may & (gain >= divergence)
    state = np.where(stay, np.cumsum(stay), 0)
    e = stay[context]
    # contexts of two: frequent pairs whose last symbol is a context itself; none ends a document
    deep = (k >= max(2.0, p_context * n)) & stay[symbol] & (symbol != alphabet.words.index(b""))
    pairs, pair_totals = key[deep], k[deep]
    context, symbol, p = state[context[e]], symbol[e], p[e]
    contexts = int(stay.sum()) + 1

    def weights(context: np.ndarray, taken: np.ndarray, shorter: np.ndarray, contexts: int) -> np.ndarray:
        """log10 of what a context's own symbols leave over what the shorter one leaves for the same others."""
        left, free = 1 - np.bincount(context, taken, contexts), 1 - np.bincount(context, shorter, contexts)
        return np.log10(np.maximum(left, 1e-12) / np.maximum(free, 1e-12))

    tree = WordTree(root, state.astype(np.int64), context * size + symbol, np.log10(p), weights(context, p, root[symbol], contexts), none, none, np.zeros(0), np.zeros(0))
    if longest < 2 or not len(pairs):
        return tree
    key, k = gathered(spark.sparkContext.broadcast((alphabet, pairs)), _triple_keys)
    context, symbol = key // size, key % size
    p, shorter = (k - 0.5) / pair_totals[context], 10.0 ** tree.one(pairs[context] % size, symbol)
    stay = np.bincount(context, p * np.log(p / shorter), len(pairs)) >= divergence
    number, e = np.cumsum(stay) - 1, stay[context]
    context, symbol, p, shorter = number[context[e]], symbol[e], p[e], shorter[e]
    tree.pairs, tree.entries2, tree.log2, tree.back2 = pairs[stay], context * size + symbol, np.log10(p), weights(context, p, shorter, int(stay.sum()))
    return tree


def score_documents(docs: DataFrame, depth: int = 6, p_min: float = 5e-6, divergence: float = 0.01, p_word: float = 1e-5, p_class: float = 1e-5, p_context: float = 5e-5, p_next: float = 5e-7) -> DataFrame:
    """doc_id, text, held_out -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    vocab = written(vocabulary(docs), "vocabulary")
    got = vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = got[0] or 0, got[1] or 0
    alphabet, least = alphabet_of(vocab, n, p_word, p_class)
    spelling = spark.sparkContext.broadcast((grow(vocab.where((F.col("c") > 0) & (F.col("c") < least) & (F.length("word") > 0)).select("word", F.lit(1).cast("long").alias("c")), depth, p_min, divergence), alphabet))
    words = spark.sparkContext.broadcast((grow_words(docs, alphabet, p_context, p_next, divergence), alphabet))
    base = lambda c: np.log10((c + 1) / (n + v + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, alphabet = spelling.value
        ids = alphabet.ids()
        for batch in batches:
            own, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            if own:
                group = np.fromiter((ids.__missing__(w) for w in own), np.int64, len(own)) - alphabet.first
                mass, fresh = alphabet.mass[group], alphabet.single[group] + 0.5
                spelt_ = 10.0 ** tree.words(own, np.where(group < len(alphabet.classes), 3, 0))
                lp = np.log10((c + fresh * spelt_) / (mass + fresh))
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp, pa.float64())], names=["word", "c", "lp"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, alphabet = words.value
        ids, end, first = alphabet.ids(), alphabet.words.index(b""), alphabet.first
        plain, seen = base(alphabet.counts), alphabet.counts > 0
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                line, lens, rare, times, starts = [end], [], [], [], [0]
                for text in part.column("text"):
                    own = tokens_of(text.as_py())
                    x = list(map(ids.__getitem__, own))
                    for w, k in Counter([w for w, i in zip(own, x, strict=True) if i >= first]).items():
                        rare.append(w)
                        times.append(k)
                    starts.append(len(rare))
                    line += x
                    line.append(end)
                    lens.append(len(x) + 1)
                x, owner = np.array(line, np.int64), np.repeat(np.arange(len(lens)), lens)
                lp = np.bincount(owner, tree.log10(np.concatenate(([end], x[:-2])), x[:-1], x[1:]), len(lens))
                common = x[1:] < first
                known = np.bincount(owner[common], seen[x[1:][common]], len(lens)).astype(np.int64)
                b = np.bincount(owner[common], plain[x[1:][common]], len(lens))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "k"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(lens))), part.column("doc_id"), part.column("held_out"), pa.array(lens, pa.int64()), pa.array(known), pa.array(b), pa.array(lp), lists],
                                                 names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "lp", "rare"])
                row += len(lens)

    rated = vocab.where((F.col("c") < least) & (F.length("word") > 0)).select("word", "c").mapInArrow(rate, "word binary, c long, lp double")
    looked = written(docs.mapInArrow(look, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, lp double, rare array<struct<word:binary,k:long>>"), "looked")
    pairs = looked.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    met = pairs.join(rated, "word").select(
        "row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("known"), (F.col("k") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base"), (F.col("k") * F.col("lp")).alias("lp"))
    sums = looked.drop("rare").unionByName(met).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(with_held_out(table(spark, sf_dir, "documents")))
