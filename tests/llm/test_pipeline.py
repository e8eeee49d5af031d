"""The pipeline's stages against brute force, and what they must keep and drop."""

import re

import public_tokenizers
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    from mintlens.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF)))
    return seen


def test_columns_and_sizes(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and stages[-1].columns == ["doc_id", "lang", "source", "ids"]
    n = [s.count() for s in stages]
    assert n[0] > n[1] > n[2] > n[3] == n[4] == n[5]


def test_quality_follows_the_labels(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert sum(r.doc_id in kept for r in labels if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in labels)
    assert sum(r.doc_id in kept for r in labels if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in labels)


def test_no_copy_stays_and_every_dropped_one_has_a_like(stages):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    before = {r.doc_id: grams(r.text) for r in stages[1].collect()}
    after = {r.doc_id for r in stages[2].collect()}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    index = {}
    for d, g in before.items():
        for x in g:
            index.setdefault(x, []).append(d)
    for d, g in before.items():
        near = {o for x in g for o in index[x] if o != d}
        near = {o for o in near if alike(g, before[o])}
        if d in after:
            assert not near & after
        else:
            assert near


def test_leaks_go(spark, stages):
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [" " + " ".join(re.findall(r"[^\W_]+", r.text.lower())) + " " for r in stages[3].collect()]
    assert not any(f" {' '.join(i)} " in t for i in items for t in texts)


def test_secrets_are_masked(stages):
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|password=[0-9a-f]{6}", r.text) for r in stages[4].collect())
    before = {r.doc_id: r.text for r in stages[3].collect()}
    assert any(before[r.doc_id] != r.text and r.n_chars == len(r.text) for r in stages[4].collect())


def test_encoding(spark, stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    assert all(r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids for r in stages[5].collect())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages[5].collect())
