"""The corpus pipeline stage by stage against brute force over the driver's smallest tables."""

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, ngram_join, pii, quality_gam
from tidemark.llm.common import materialize

from llm.test_text_operators import all_pairs, check_packing  # noqa: I001

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = materialize(f(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages)


def test_rejected_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality_gam.accepted(stages[0], labels).collect()}
    assert ids(stages[1]) == want and 0 < len(want) < stages[0].count()
    bad = {r.doc_id for r in labels.where("toxic = 1 or quality = 0").collect()}
    assert len(bad & ids(stages[1])) <= 0.2 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    pairs = all_pairs(rows, ngram_join.THRESHOLD)
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {d for d in parent if root(d) == d}
    got = ids(stages[2])
    assert want <= got and len(got - want) <= 0.1 * (len(parent) - len(want))


def test_leaks_go_and_the_rest_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = ids(stages[3])
    for r in stages[2].collect():
        if len(r.text) < 4000:
            assert (r.doc_id in kept) == all(decontaminate.brute_force(r.text, x) is None for x in items)


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        t = before[r.doc_id]
        assert r.text == pii.redact(t, pii.find_pii(t)) and r.n_chars == len(r.text)


def test_run_packs_what_the_stages_leave(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    last = corpus_pipeline.STAGES[-1][1](spark, stages[-1], SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, last.collect()))
    check_packing(spark, stages[-1], 8192, 512)
