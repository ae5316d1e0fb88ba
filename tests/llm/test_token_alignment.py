"""Alignment against whole texts, encoded and linked plainly."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tessera.llm import token_alignment as A
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers

    return A.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plain_groups(pair, text):
    """From sets of end offsets of the whole text's tokens; None without tokens."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(pair.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(pair.b_bytes[i]) for i in b]).tolist()
    cuts = sorted(set(ends_a) & set(ends_b))
    of = lambda ids, ends: [[t for t, e in zip(ids, ends) if lo < e <= hi] for lo, hi in zip([0, *cuts], cuts)] if len(ids) < 3000 else by_place(ids, ends, cuts)
    return list(zip(of(a, ends_a), of(b, ends_b)))


def by_place(ids, ends, cuts):
    out = [[] for _ in cuts]
    for t, k in zip(ids, np.searchsorted(cuts, ends).tolist()):
        out[k].append(t)
    return out


def plain(pair, rows):
    every = [(i, plain_groups(pair, t)) for i, t in rows]
    counts = collections.Counter()
    for _, groups in every:
        counts.update({(x, y) for a, b in groups or () for x in a for y in b})
    top = collections.defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups in every:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd_texts():
    r = random.Random(2)
    pieces = ["word", "Wörter", " ", "  ", "\n", "\n\n", "\t", " \n", "\n ", ".", ",", "'s", "don't", "中文字", "\U0001f600\U0001f468‍\U0001f469", " ", " ", "\x1c", "\x00", "é", "½", "ﬁ", "<|endoftext|>", "<s>", "<0x41>", "123456", "_", "://", "�", "　", "İ", "ß", "\u0085", "\r\n", "-----", "=====", "​", "ั้", "\n'", " '", "''ll"]
    return ["".join(r.choices(pieces, k=r.randint(1, 25))) for _ in range(1500)]


def test_chunks_are_encoded_like_whole_texts(pair):
    assert pair.cuts
    for text in odd_texts() + ["\nx", "\n", " ", " x", "x ", "x\n", "x\ny", "\n\nx y\nz"]:
        chunks = pair.chunks(text)
        made = list(pair.encoded(chunks))
        want = plain_groups(pair, text)
        assert (None if None in made else [g for x in made for g in x]) == want, repr(text)


def test_query_against_plain(spark, pair):
    docs = table(spark, SF, "documents")
    want = plain(pair, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, A.op11_token_alignment(spark, SF).collect())) == sorted(want)


@pytest.mark.parametrize(("hold", "remember"), [(500_000, 300_000), (40, 30)])
def test_odd_rows_and_small_parts(spark, pair, hold, remember):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, "no id"), (7, None), (8, ""), (9, "has ▁ in it"), (10, " ".join(texts[:300])), (11, " " * 5000 + "x" * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, n_a string").repartition(3)
    got = A.Alignment(docs, hold=hold, remember=remember, texts=True).documents().collect()
    assert sorted([tuple(r)[:8] for r in got], key=str) == sorted(plain(pair, rows), key=str)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)


def test_pairs_count_documents_once(spark, pair):
    # one pair in two distinct groups of a document counts that document once
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts()[:400])], "doc_id long, text string")
    own = A.Alignment(docs)
    want = collections.Counter()
    for r in docs.collect():
        want.update({(x, y) for a, b in plain_groups(pair, r.text) or () for x in a for y in b})
    assert {(r.a, r.b): r["count"] for r in own.pairs.collect()} == dict(want)
    assert own.rows.where(f"kind = {A.TWICE}").count() > 0
    links = own.links.groupBy("group", "a", "b").count()
    assert links.where("count > 1").isEmpty()


def test_empty_table_and_text_ids(spark):
    assert A.Alignment(spark.createDataFrame([], "doc_id long, text string")).documents().count() == 0
    named = spark.createDataFrame([("x", "some text"), ("y", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_best == r.n_links for r in A.Alignment(named).documents().collect()} == {"x": True, "y": True}
