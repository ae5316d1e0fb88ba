"""The stages of the pipeline, each against a plain version of its decisions, and the whole run."""

import zlib

import pytest

import corpus_pipeline as pipeline
from tessera.llm import decontaminate as D
from tessera.llm import near_dedup as N
from tessera.llm import packing as P
from tessera.llm import quality_model as Q
from tessera.llm import secret_scan as S
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_are_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_quality_keeps_what_the_model_scores(spark, docs):
    model = Q.fit(docs, Q.graded(table(spark, SF, "labels")))
    hasher, kept = Q.Hasher(), []
    for r in docs.collect():
        tail = 1.0 if model is None else model.tails(model.weights[hasher(r.text)].sum(dtype="float32").reshape(1).astype(float))[0, -1]
        if tail >= 0.5:
            kept.append(tuple(r))
    out = pipeline.quality(spark, docs, SF)
    assert out.columns == docs.columns and rows_of(out) == sorted(kept, key=str)


def test_near_duplicates_keep_one_of_each_component(spark, docs):
    rows = docs.collect()
    shingler = N.Shingler()
    sets = [frozenset(shingler(r.text).tolist()) for r in rows]
    top = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i].text == rows[j].text or a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = top[i], top[j]
                top = [min(x, y) if t in (x, y) else t for t in top]
    least = {}
    for r, t in zip(rows, top):
        least[t] = min(least.get(t, r.doc_id), r.doc_id)
    out = pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(least.values())


def test_decontamination_drops_what_holds_a_window(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[i:i + 10]) for _, t in items if (w := D.words_of(t)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = lambda t: not any(tuple(w[i:i + k]) in windows for w in [D.words_of(t)] for k in sizes for i in range(len(w) - k + 1))
    out = pipeline.decontamination(spark, docs, SF)
    assert out.columns == docs.columns and rows_of(out) == sorted((tuple(r) for r in docs.collect() if clean(r.text)), key=str)


def test_secrets_change_only_what_the_forest_keeps(spark, docs):
    forest, out = S.trained(), {}
    for r in docs.collect():
        text, at, parts = r.text or "", 0, []
        for f in S.find_secrets([r.text], forest)[0][1]:
            parts += [text[at:f["from"]], f"[{f['kind']}]"]
            at = f["to"]
        out.setdefault(r.doc_id, []).append("".join(parts) + text[at:] if parts else r.text)
    got = {}
    for r in pipeline.secrets(spark, docs, SF).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got.keys() == out.keys() and all(sorted(map(str, got[k])) == sorted(map(str, out[k])) for k in out)


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    some = docs.limit(120)
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in some.collect())
    parts = {}
    for r in pipeline.packing(spark, some, SF).collect():
        parts.setdefault(r.row_id, []).append((r.start, r.length))
    total = []
    for own in parts.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        total.append(at)
    assert sorted(total) == want


def test_run_over_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "x", "en", "a", 1), (3, "x", "en", "a", 1), (None, "some words here " * 30, "en", "b", 1)]
    for name, data, kind in (("documents", rows, KINDS), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [("i", "no such words at all")], "item_id string, text string")):
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 3, None} and all(r.ids_crc32 == zlib.crc32((1).to_bytes(4, "little")) for r in out if r.doc_id == 1)


def test_run_over_empty_tables(spark, tmp_path):
    for name, kind in (("documents", KINDS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
