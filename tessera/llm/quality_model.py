"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades run from 0 to K-1. All grades share one weight for each hashed feature of the text; K-1 ordered thresholds cut
the latent score: P(grade >= k) = sigmoid(w.x - t_k). The model is fitted by adaptive proximal gradient steps with an
L1 penalty, so that the features of everyday words stay at zero and a long clean text does not drift.
The thresholds are kept ordered by construction (a first one and positive gaps).

Features of a text: which words and which word beginnings of 4 and 5 letters it holds (hashed to 2^``bits``), and
bins of whole-text figures: share of symbols, upper case and digits, words repeated in a row, distinct words, length.

``fit`` uses at most ``max_labelled`` labelled rows (those with the least hash of their id: a bounded, repeatable
sample, cut at as many rows) and sends their features to the driver; weights are 2^``bits`` floats whatever the corpus. Scoring is one
pass without a shuffle.
Edge cases: labels with null grade or without a document are left out; several labels of one document: the lowest
counts; with fewer than two grades every document is kept (tail probability 1); null text is an empty one; repeated
rows are scored each on their own; other columns stay in ``keep_good`` and are dropped by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, worker_cache

BITS, DENSE = 18, 64
_WORDS = re.compile(r"[^\W\d_]+")


def _bins(text: str, words: list[str]) -> list[int]:
    """Bins of whole-text figures, as the last ``DENSE`` features."""
    n, m = max(1, len(words)), max(1, len(text))
    symbols = sum(map(text.count, "#*$%&|<>!{}[]=~^\\"))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.split("\n")
    step = lambda x, cuts: int(np.searchsorted(cuts, x))
    return [
        step(symbols / n, (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)), 8 + step(upper / m, (0.001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)), 16 + step(digits / m, (0.001, 0.01, 0.05, 0.1, 0.2, 0.4, 0.6)),
        24 + step(same / n, (0.001, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6)), 32 + step(len(set(words)) / n, (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)), 40 + step(n, (5, 20, 50, 100, 400, 2000, 8000)),
        48 + step(1 - len(set(lines)) / len(lines), (0.001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)), 56 + step(m / n, (2, 40)),
    ]


class Hasher:
    """Feature numbers of a text; those of a word are remembered while they fit."""

    def __init__(self, bits: int = BITS, remember: int = 150_000):
        self.mask, self.size, self.seen, self.remember = (1 << bits) - 1, (1 << bits) + DENSE, {}, remember

    def _word(self, w: str) -> tuple[int, ...]:
        found = self.seen.get(w)
        if found is None:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            low = w.lower()
            marks = {b"w" + low.encode("utf-8", "replace")} | {str(k).encode() + low[:k].encode("utf-8", "replace") for k in (4, 5) if len(low) > k}
            found = self.seen[w] = tuple(crc32(x) & self.mask for x in marks)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = text.split()
        ids: set[int] = set()
        for w in set(_WORDS.findall(text)):
            ids.update(self._word(w))
        ids.update(self.mask + 1 + b for b in _bins(text, words))
        return np.fromiter(ids, np.int32, len(ids))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, a column each."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, size: int, epochs: int = 24, rate: float = 0.2, l1: float = 1e-3, least: int = 8, seed: int = 3, batch: int = 64) -> OrdinalModel:
    """Proximal AdaGrad on the cumulative-link likelihood, with a falling rate and the last third of the epochs
    averaged. Features of fewer than ``least`` rows are left at zero; gaps of the thresholds are softplus of free numbers."""
    k = int(grades.max()) + 1
    df = np.bincount(np.concatenate(rows), minlength=size)
    used = np.flatnonzero(df >= min(least, max(1, len(rows) // 50)))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [(p := place[x])[p >= 0] for x in rows]
    n = len(used)
    w, g2 = np.zeros(n), np.full(n, 1e-6)
    free, f2 = np.full(k - 1, 0.5), np.full(k - 1, 1e-3)
    free[0] = -1.0
    mean_w, mean_free, means = np.zeros(n), np.zeros(k - 1), 0
    r = np.random.default_rng(seed)
    share = np.bincount(grades, minlength=k) / len(grades)
    cost = np.minimum(4.0, 1 / (k * np.maximum(share, 1e-6)))
    gaps = lambda f: np.concatenate((f[:1], np.log1p(np.exp(f[1:]))))
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for epoch in range(epochs):
        order, now = r.permutation(len(rows)), rate / (1 + 0.15 * epoch)
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            lens = np.fromiter((len(rows[i]) for i in part), np.int64, len(part))
            ids, owner = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), lens)
            latent = np.bincount(owner, w[ids], len(part))
            y = grades[part]
            bound = np.concatenate(([-40.0], np.cumsum(gaps(free)), [40.0]))
            hi, lo = s(bound[y + 1] - latent), s(bound[y] - latent)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) * (y < k - 1), lo * (1 - lo) * (y > 0)
            scale = cost[y] / len(part)
            grad = np.bincount(ids, ((dhi - dlo) / p * scale)[owner], n)  # of the loss by the weights
            g2 += grad * grad
            step = now / np.sqrt(g2)
            w -= step * grad
            w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(step, 20 * now) * l1)
            dt = np.zeros(k - 1)
            np.add.at(dt, np.minimum(y, k - 2), np.where(y < k - 1, -dhi / p * scale, 0))
            np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, dlo / p * scale, 0))
            d = np.cumsum(dt[::-1])[::-1] * np.concatenate(([1.0], s(free[1:])))
            f2 += d * d
            free = free - now * d / np.sqrt(f2)
            if epoch >= epochs - epochs // 3:
                mean_w, mean_free, means = mean_w + w, mean_free + free, means + 1
    weights = np.zeros(size, np.float32)
    weights[used] = mean_w / means if means else w
    return OrdinalModel(weights, np.cumsum(gaps(mean_free / means if means else free)))


def fit(docs: DataFrame, graded: DataFrame, max_labelled: int = 15_000, bits: int = BITS) -> OrdinalModel | None:
    """``graded``: doc_id, grade. None where the sample has fewer than two grades."""
    labels = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = worker_cache(f"features {bits}", lambda: Hasher(bits))
        for batch in batches:
            rows = [hasher(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(rows, pa.binary())], names=["doc_id", "grade", "ids"])

    # the ids are at most max_labelled: few enough to go to every task; rows that repeat an id don't make it more
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "text", "grade").mapInArrow(run, f"doc_id {kind}, grade int, ids binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "ids").limit(max_labelled).toArrow()
    grades, ids = rows.column("grade").to_numpy(), [np.frombuffer(x.as_py(), np.int32) for x in rows.column("ids")]
    order = sorted(range(len(ids)), key=lambda i: (rows.column("doc_id")[i].as_py(), ids[i].tobytes()))
    grades, ids = grades[order], [ids[i] for i in order]
    if len(set(grades.tolist())) < 2:
        return None
    _, dense = np.unique(grades, return_inverse=True)
    return fit_ordinal(ids, dense.astype(np.int64), (1 << bits) + DENSE)


def score(docs: DataFrame, model: OrdinalModel | None, least: float = 0.5, bits: int = BITS) -> DataFrame:
    """Adds expected_grade, tail_probability (of the best grade) and keep to ``docs``; own columns of these names give way."""
    spark, docs = docs.sparkSession, docs.drop("expected_grade", "tail_probability", "keep")
    names = docs.columns
    sent = spark.sparkContext.broadcast(model)  # 2^bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = worker_cache(f"features {bits}", lambda: Hasher(bits)), sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if m is None:
                tails = np.ones((len(texts), 1))
            else:
                tails = m.tails(np.array([float(m.weights[hasher(t)].sum()) for t in texts]).reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], names=[*names, "expected_grade", "tail_probability", "keep"])

    made = "expected_grade double, tail_probability double, keep boolean"
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(made).fields]))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of the labels table: 2 good, 1 well written but toxic, 0 poor."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def keep_good(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose tail probability is at least ``least``, with their own columns."""
    model = fit(docs if training is None else training, graded(labels))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return score(row, model, least).where("keep").select("_row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, graded(table(spark, sf_dir, "labels")))).select("doc_id", "expected_grade", "tail_probability", "keep")
