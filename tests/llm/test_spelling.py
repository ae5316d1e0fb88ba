"""Spelling variants against all pairs, for the index, for hashed positions and for both together; counts against a plain count."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling as S
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i:]


def plain_counts(rows):
    total = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def plain_forms(counts):
    """By pairs of all words with equal or neighbouring lengths that share a deletion."""
    by = collections.defaultdict(set)
    for w in counts:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by[v].add(w)
    links = collections.defaultdict(set)
    for own in by.values():
        for a in own:
            links[a] |= {b for b in own if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(links[w]), counts[form[w]] if form[w] is not None else None)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_all_pairs(spark):
    docs = table(spark, SF, "documents")
    want = plain_forms(plain_counts([(r.doc_id, r.text) for r in docs.collect()]))
    assert len(want) > 1000 and sum(x[0] is not None for x in want.values()) > 100
    assert found(S.op12_spelling_variants(spark, SF)) == want


def vocabulary():
    r = random.Random(5)
    words = {"".join(r.choices("aabéÿ", k=r.randint(1, 9))) for _ in range(1500)}
    words |= {"a" * n for n in range(1, 60)} | {"中文" + x for x in "中文Ā\0ab"} | {"x" * 50 + y + "z" * 40 for y in ("", "a", "b", "ab", "q")} | {"\U0001f600ab", "\U0001f601ab", "ab"}
    return {w: r.choice([1, 2, 3, 5, 8, 20, 20, 100]) for w in words if w}


@pytest.mark.parametrize(("block", "chunk", "longest"), [(100_000, 200_000, 48), (100_000, 300, 48), (40, 100, 20), (0, 100, 48)])
def test_index_and_hashes_give_all_pairs(spark, block, chunk, longest):
    counts = vocabulary()
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert found(S.spelling_forms(words, shortest=1, block=block, chunk=chunk, longest=longest)) == plain_forms(counts)


def test_each_pair_is_found_once():
    words = sorted("".join(x) for n in (2, 3, 4) for x in itertools.product("ab", repeat=n))
    rows = [(late, m, w) for w in words for late in (0, 1) for m in (len(w), len(w) - 1) if m >= 2]
    seen = collections.Counter()
    for a, b in S.near_pairs([w for *_, w in rows], np.array([x for x, *_ in rows]), np.array([m for _, m, _ in rows])):
        seen.update((rows[x][2], rows[y][2]) for x, y in zip(a.tolist(), b.tolist()))
    # one chunk holds all groups: a pair is found in its own group alone
    assert set(seen) == {(a, b) for a in words for b in words if near(a, b)} and set(seen.values()) == {1}


def test_wavelet_matrix_reports_rectangles():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        sequence = r.permutation(n)
        lo, hi, least, above = (r.integers(0, n + 1, 300) for _ in range(4))
        which, value = S.WaveletMatrix(sequence).report(lo, hi, least, above)
        want = sorted((k, v) for k in range(300) for v in sequence[lo[k]:hi[k]].tolist() if least[k] <= v < above[k])
        assert sorted(zip(which.tolist(), value.tolist())) == want


def test_counts_of_odd_texts(spark):
    rows = [(1, None), (None, "Étés étés ×÷ABC abcde"), (2, ""), (3, "Lettārs letters-Letters_letters"), (3, "x" * 200_000), (3, "x" * 200_000)] + [(i, "wordy Wordier wÖrdY") for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    assert {r.word: r.n for r in S.count_words(docs, hold=2).collect()} == plain_counts(rows)
    assert S.spelling_forms(S.count_words(docs.limit(0))).count() == 0


def test_long_words_cost_what_they_hold(spark):
    long = "ab" * 20_000
    words = spark.createDataFrame([(long, 4), (long + "c", 9), ("c" + long, 9), (long[:-1] + "z", 3), ("short", 1)], "word string, n long")
    got = found(S.spelling_forms(words))
    assert {w: x[3] for w, x in got.items()} == {long: 3, long + "c": 1, "c" + long: 1, long[:-1] + "z": 1, "short": 0} and got[long][:2] == (long + "c", long + "c")


def test_roots_follow_long_chains(spark):
    forms = spark.range(20).select(F.format_string("w%02d", "id").alias("word"), F.format_string("w%02d", F.col("id") + 1).alias("form"))
    assert {r.root for r in S.roots(forms).collect()} == {"w20"}
