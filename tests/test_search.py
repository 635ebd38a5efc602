import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.errors import ERRORS
from tidemark.operators import ann
from tidemark.operators.evaluate import check_gates, latency_summary, recall_at_k, score_drift
from tidemark.operators.lexical import Bm25Index, hybrid_topk, rrf
from tidemark.operators.search import check_query, envelope, exact_topk, parse_vector, query_error, score_all
from tidemark.plans import queries as core

SF = "/root/testdata/sf0.001"


def frame(spark, v, name="row_id", column="embedding"):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], f"{name} long, {column} array<float>")


def as_set(df):
    return {(r.query_id, r.row_id) for r in df.collect()}


def test_axes_find_themselves(spark):
    eye = np.eye(6)
    got = exact_topk(frame(spark, eye), frame(spark, eye, "query_id", "vector"), 1).collect()
    assert {(r.query_id, r.row_id, round(r.score, 9), r["rank"]) for r in got} == {(i, i, 1.0, 1) for i in range(6)}


def test_ties_go_to_the_lesser_row_and_queries_are_normalised(spark):
    v = np.eye(3)[[0, 1, 0, 1, 0, 2]]
    got = exact_topk(frame(spark, v), frame(spark, [[7, 0, 0]], "query_id", "vector"), 4).orderBy("rank").collect()
    assert [r.row_id for r in got] == [0, 2, 4, 1] and got[0].score == pytest.approx(1)


def test_blocks_and_builtin_plan_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((200, 8)).astype(np.float32), rng.standard_normal((30, 8)).astype(np.float32)
    corpus, queries = frame(spark, v).repartition(7), frame(spark, q, "query_id", "vector")
    unit = q.astype(float) / np.linalg.norm(q.astype(float), axis=1, keepdims=True)
    best = np.argsort(-(unit @ v.T.astype(float)), axis=1)[:, :5]
    want = {(i, int(r)) for i, row in enumerate(best) for r in row}
    assert as_set(exact_topk(corpus, queries, 5)) == want
    assert as_set(exact_topk(corpus, queries, 5, block=50)) == want
    scored = score_all(corpus, queries).where("query_id = 0").orderBy(F.desc("score")).limit(5)
    assert {r.row_id for r in scored.collect()} == set(best[0].tolist())


def test_nulls_zero_queries_and_empty_tables(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (None, [1.0, 0.0])], "row_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [1.0, 1.0])], "query_id long, vector array<float>")
    assert as_set(exact_topk(corpus, queries, 3)) == {(2, 0)}
    assert exact_topk(corpus.where("false"), queries, 3).count() == 0
    assert exact_topk(corpus, queries.where("false"), 3).count() == 0


@pytest.mark.parametrize(
    "vector, k, error",
    [([], 0, "InvalidK"), ([], 1, "EmptyQuery"), ([1.0], 1, "DimensionMismatch"), ([float("nan"), 0.0], 1, "InvalidQueryValue"), ([float("inf"), 0.0], 1, "InvalidQueryValue"), ([0.0, 0.0], 1, "ZeroNormQuery")],
)
def test_query_errors_in_order(spark, vector, k, error):
    with pytest.raises(ERRORS[error]):
        check_query(vector, k, 2)
    row = spark.createDataFrame([(vector,)], "v array<double>").select(query_error(F.col("v"), F.lit(k), 2).alias("e")).first()
    assert row.e == error


def test_fine_query(spark):
    check_query([1.0, 2.0], 3, 2)
    got = spark.range(1).select(query_error(parse_vector(F.lit("[1, 2.5]")), F.lit(1), 2).alias("e"), parse_vector(F.lit("[1, x")).alias("bad")).first()
    assert got.e is None and got.bad is None


def test_envelope_counts_and_truncation(spark):
    q = frame(spark, np.eye(2), "query_id", "vector")
    rows = envelope(exact_topk(frame(spark, np.eye(2)), q, 5), q, 2, 5, "exact", 1.0).collect()
    assert [(r.k_returned, r.truncated, r.recall) for r in rows] == [(2, False, 1.0)] * 2


DOCS = ["vacina covid hospital saúde vacina", "futebol gol campeonato", "eleição voto congresso vacina"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_bm25_ranks_and_formula(spark):
    index = Bm25Index.build(docs(spark, DOCS))
    got = index.search(asks(spark, "vacina covid"), 3).orderBy("rank").collect()
    assert [r.row_id for r in got] == [0, 2]
    n, avg = 3, (5 + 3 + 4) / 3
    idf = lambda df: np.log((n - df + 0.5) / (df + 0.5) + 1)
    term = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[0].score == pytest.approx(idf(2) * term(2, 5) + idf(1) * term(1, 5), abs=1e-6)
    twice = index.search(asks(spark, "covid covid"), 1).first().score
    assert twice == pytest.approx(2 * index.search(asks(spark, "covid"), 1).first().score, abs=2e-6)


def test_bm25_edges(spark, tmp_path):
    index = Bm25Index.build(docs(spark, [*DOCS, "", None]))
    assert index.stats.first().n_docs == 5
    assert index.search(asks(spark, "nothing", "", None), 3).count() == 0
    assert index.search(asks(spark, "gol"), 0).count() == 0
    assert Bm25Index.build(docs(spark, DOCS).where("false")).stats.first().n_docs == 0
    index.write(str(tmp_path))
    back = Bm25Index.read(spark, str(tmp_path))
    assert back.search(asks(spark, "vacina"), 5).collect() == index.search(asks(spark, "vacina"), 5).collect()


def test_rrf_prefers_what_is_in_both_lists(spark):
    def ranks(ids):
        return spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(ids)], "query_id long, row_id long, rank int")

    got = rrf(ranks([10, 20, 30]), ranks([20, 40, 50])).orderBy("rank").collect()
    assert [r.row_id for r in got] == [20, 10, 40, 30, 50]
    assert got[0].rrf == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_hybrid_keeps_vector_candidates_without_lexical_ones(spark):
    eye = np.eye(3)
    corpus, q = frame(spark, eye), frame(spark, eye[:1], "query_id", "vector")
    near = exact_topk(corpus, q, 2)
    assert as_set(hybrid_topk(corpus, near, near.where("false"), q, 2)) == {(0, 0), (0, 1)}


def test_recall_and_drift(spark):
    exact = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (1, 3, 0.7, 1)], "query_id long, row_id long, score double, rank int")
    approx = spark.createDataFrame([(0, 2, 0.85, 1), (0, 9, 0.1, 2)], "query_id long, row_id long, score double, rank int")
    assert {r.query_id: r.recall for r in recall_at_k(approx, exact, 2).collect()} == {0: 0.5, 1: 0.0}
    assert score_drift(approx, exact).collect()[0].drift == pytest.approx(0.05)
    assert latency_summary(spark.createDataFrame([(1.0,), (3.0,)], "ms double")).first().asDict() == {"mean": 2.0, "p50": 1.0, "p95": 3.0, "p99": 3.0}


def test_gates(spark):
    shape = "preset string, size_ratio double, recall_at_k double, p95_ms double"
    base = spark.createDataFrame([("exact", 1.0, 1.0, 2.0)], shape)
    good = spark.createDataFrame([("exact", 1.0, 1.0, 2.9), ("compressed", 0.35, 1.0, 2.0), ("tiny", 0.28, 0.99, 1.0), ("hybrid", 0.6, 1.0, 3.0)], shape)
    assert all(r.passed for r in check_gates(base, good).collect())
    bad = check_gates(base, good.where("preset <> 'hybrid'").withColumn("p95_ms", F.col("p95_ms") * 2)).collect()
    assert sorted((r.preset, r.measure) for r in bad if not r.passed) == [("exact", "p95_ms"), ("hybrid", "recall_at_k")]


def unit_rows(n, dim, seed):
    v = np.random.default_rng(seed).standard_normal((n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_graph_recall_one_shard():
    v, q = unit_rows(800, 32, 1), unit_rows(30, 32, 2)
    g = ann.build_graph(v, ef=100)
    hits = 0
    for x in q:
        want = set(np.argsort(-(v @ x))[:10].tolist())
        hits += len(want & {i for _, i in g.search(x.astype(float), 100)[:10]})
    assert hits / 300 >= 0.95
    assert all(len(n) <= (32 if layer == 0 else 16) for layers in g.links for layer, n in enumerate(layers))


def test_graph_recall_floors():
    """The walk alone, with more rows than its beam is wide: recall at 10 and at 1 of 2000 rows of 128 dimensions."""
    v, q = unit_rows(2000, 128, 0xCAFE), unit_rows(50, 128, 0xFACE)
    g = ann.build_graph(v)
    exact = np.argsort(-(q @ v.T), axis=1)
    found = [[i for _, i in g.search(x.astype(float), 200)] for x in q]
    assert np.mean([len(set(f[:10]) & set(e[:10].tolist())) / 10 for f, e in zip(found, exact)]) >= 0.95
    assert np.mean([g.search(x.astype(float), 100)[0][1] == e[0] for x, e in zip(q, exact)]) >= 0.90
    # a walk sees only part of the graph: a narrow one is not exact
    assert all(len(f) == 200 for f in found)


def test_sharded_graph_recall_floor(spark):
    """10,000 rows of 384 dimensions in four graphs, and fewer candidates back from each than its beam holds."""
    v, q = unit_rows(10_000, 384, 1), unit_rows(30, 384, 2)
    rows = spark.createDataFrame(pa.table({"row_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 384).cast(pa.list_(pa.float32()))})).repartition(4)
    index = storage.written(ann.build_index(rows, shards=4), "graph")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<float>")
    got = ann.ann_topk(rows, queries, 10, 400, index).collect()
    exact = {(i, int(r)) for i, e in enumerate(np.argsort(-(q @ v.T), axis=1)[:, :10]) for r in e}
    assert len(got) == 300 and len({(r.query_id, r.row_id) for r in got} & exact) / 300 >= 0.94


def test_shards_and_what_they_give_back():
    assert [ann.shards_of(n) for n in (0, 1, 3999, 4000, 20_000, 400_000, 500_000)] == [1, 1, 1, 2, 8, 8, 10]
    assert ann.kept_by_shard(1, 400, 10) == 400 and ann.kept_by_shard(20_000, 400, 10) == 10 and ann.kept_by_shard(8, 400, 10) < 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_registered_graph_queries_against_exact_search(spark):
    found = core.queries()
    got = {(r.query_id, r.row_id): r.score for r in found["ann_topk"](spark, SF).collect()}
    exact = {(r.query_id, r.row_id): r.score for r in found["exact_topk"](spark, SF).collect()}
    assert len(got) == len(exact) and len(set(got) & set(exact)) >= 0.95 * len(exact) and all(got[x] == exact[x] for x in set(got) & set(exact))
    hybrid = found["corpus_hybrid"](spark, SF).collect()
    near = {(r.query_id, r["rank"]): r.score for r in found["corpus_search"](spark, SF).collect()}
    # the union with lexical candidates can only raise a rank's score
    assert len(hybrid) == len(near) and sum(r.score >= near[r.query_id, r["rank"]] - 1e-5 for r in hybrid) >= 0.95 * len(hybrid)


def test_exact_topk_in_tiles_and_from_integers(spark, monkeypatch):
    from tidemark.functions.vector import dequantize_int8, quantize_int8
    from tidemark.operators import search

    v = unit_rows(150, 8, 7)
    v[40:60] = v[:20]  # ties
    corpus = frame(spark, v).repartition(3)
    q = frame(spark, v[:50], "query_id", "vector")
    stored = corpus.select("row_id", quantize_int8(F.col("embedding")).alias("z"))
    whole = {form: sorted(map(tuple, exact_topk(c, q, 7).collect())) for form, c in (("float", corpus), ("int", stored.select("row_id", "z.*")), ("back", stored.select("row_id", dequantize_int8(F.col("z")).alias("embedding"))))}
    assert whole["int"] == whole["back"]
    scores = np.round(v[:50].astype(float) / np.linalg.norm(v[:50].astype(float), axis=1, keepdims=True) @ v.astype(float).T, search.PLACES)
    want = {(i, int(r)) for i, s in enumerate(scores) for r in np.lexsort((np.arange(150), -s))[:7]}
    assert {(x[0], x[1]) for x in whole["float"]} == want
    query, row, score = search.best_of(np.array([1, 0, 1, 1]), np.array([5, 1, 4, 3]), np.array([0.5, 0.1, 0.5, 0.4]), 2)
    assert query.tolist() == [0, 1, 1] and row.tolist() == [1, 4, 5] and score.tolist() == [0.1, 0.5, 0.5]


def test_bm25_in_passes_and_tiles_equals_plain_sums(spark, monkeypatch):
    from tidemark.operators import lexical

    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"]
    docs = [" ".join(["the"] * int(rng.integers(0, 3)) + rng.choice(vocabulary, rng.integers(0, 25)).tolist()) for _ in range(120)]
    asked = [" ".join(rng.choice(vocabulary, 6).tolist()) for _ in range(15)] + ["", "unknown word", None]
    index = Bm25Index.build(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "row_id long, text string").repartition(4))
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)] + [(None, "the")], "query_id long, text string")
    words = [t.split() for t in docs]
    mean = sum(map(len, words)) / len(words)

    def score(query, words_of):
        total = 0.0
        for t in query.split():
            tf, df = words_of.count(t), sum(t in w for w in words)
            total += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words_of) / mean)) if tf else 0
        return round(total, 6)

    want = set()
    for i, t in enumerate(asked):
        own = sorted((-s, d) for d, w in enumerate(words) if set((t or "").split()) & set(w) for s in [score(t, w)])[:5]
        want |= {(i, d, -s, r) for r, (s, d) in enumerate(own, 1)}
    for block, tile in ((lexical.QUERY_TERMS, lexical.TILE), (20, 40)):
        monkeypatch.setattr(lexical, "TILE", tile)
        got = {(r.query_id, r.row_id, r.score, r["rank"]) for r in index.search(q, 5, block).collect()}
        assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want} and {round(x[2], 5) for x in got} == {round(x[2], 5) for x in want}
    assert index.search(q, 0).count() == 0


def test_graph_is_deterministic_and_edges():
    v = unit_rows(60, 8, 3)
    assert ann.build_graph(v, ef=40).links == ann.build_graph(v, ef=40).links
    assert ann.build_graph(v[:0]).search(np.zeros(8), 5) == []
    assert ann.build_graph(v[:1]).search(v[0].astype(float), 5)[0][1] == 0


def test_neighbours_shadow_and_refill():
    v = np.array([[1.0, 0.0], [0.99, 0.14], [0.0, 1.0]])
    cands = [(0.05, 0), (0.06, 1), (0.9, 2)]
    assert ann.diverse_neighbours(cands, 2, v) == [0, 2]
    assert ann.diverse_neighbours(cands, 3, v) == [0, 2, 1]
    assert ann.simple_neighbours(cands, 2) == [0, 1]


def test_sharded_ann_reranks_exactly(spark):
    v = unit_rows(300, 16, 4)
    corpus, q = frame(spark, v), frame(spark, v[:20], "query_id", "vector")
    index = ann.build_index(corpus, shards=3, ef=60)
    exact = {(r.query_id, r.row_id): r.score for r in exact_topk(corpus, q, 10).collect()}
    got = ann.ann_topk(corpus, q, 10, 60, index, 60).collect()
    assert sum((r.query_id, r.row_id) in exact for r in got) / 200 >= 0.95
    assert all(abs(exact[r.query_id, r.row_id] - r.score) < 1e-9 for r in got if (r.query_id, r.row_id) in exact)
    assert as_set(ann.ann_topk(corpus, q, 3)) == as_set(exact_topk(corpus, q, 3))


def test_walks_in_step_find_what_single_walks_find():
    v, q = unit_rows(3000, 24, 5), unit_rows(200, 24, 6)
    g = ann.build_graph(v, ef=80)
    near, nodes = g.search_many(q, 80)
    one = [[x for _, x in g.search(x.astype(float), 80)] for x in q]
    assert np.mean([len(set(a[:10].tolist()) & set(b[:10])) / 10 for a, b in zip(nodes, one)]) >= 0.99
    assert (np.diff(near, axis=1) >= 0).all() and all(len(set(a.tolist())) == 80 for a in nodes)
    assert np.allclose(near[:, 0], 1 - np.einsum("ij,ij->i", v[nodes[:, 0]], q), atol=1e-5)


def test_a_shard_gives_back_k_rows_a_query(spark):
    """Candidates are scored where they are found: none of the hundreds a walk finds goes through a shuffle."""
    v = unit_rows(900, 16, 8)
    corpus, q = frame(spark, v), frame(spark, v[:30], "query_id", "vector")
    index = storage.written(ann.build_index(corpus, shards=3), "graph")
    plan = ann.ann_topk(corpus, q, 5, 100, index)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    # a row that the corpus no longer has is no hit
    assert {r.row_id for r in ann.ann_topk(corpus.where("row_id > 9"), q, 1, 100, index).collect()}.isdisjoint(range(10))


def test_exact_search_holds_little_and_forgets_its_queries():
    import tracemalloc
    from types import SimpleNamespace

    from tidemark.operators import search

    v = unit_rows(30_000, 16, 9)
    v[20_000:20_500] = v[:500]  # ties
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10_000)), pa.FixedSizeListArray.from_arrays(v[a : a + 10_000].ravel(), 16).cast(pa.list_(pa.float32()))], names=["row_id", "embedding"]) for a in range(0, 30_000, 10_000)]
    q = v[:4000].astype(np.float64)
    ids, matrix = SimpleNamespace(value=np.arange(len(q)), _value=1), SimpleNamespace(value=q, _value=1)
    tracemalloc.start()
    got = list(search._top(ids, matrix, 5)(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and not hasattr(matrix, "_value") and not hasattr(ids, "_value")
    for i in range(0, 4000, 500):
        s = np.round(v.astype(np.float64) @ q[i], search.PLACES)
        want = np.lexsort((np.arange(len(v)), -s))[:5].tolist()
        mine = [(r, x) for b in got for c, r, x in zip(*(c.to_pylist() for c in b.columns)) if c == i]
        assert [r for r, _ in sorted(mine, key=lambda p: (-p[1], p[0]))] == want


def test_postings_are_added_up_in_groups_of_whole_documents():
    from tidemark.operators import lexical

    row = np.repeat(np.arange(50), 7)
    batches = [pa.RecordBatch.from_arrays([pa.array(row[a : a + 10]), pa.array(np.arange(len(row))[a : a + 10]), pa.array(np.ones(len(row))[a : a + 10])], names=["row_id", "code", "w"]) for a in range(0, len(row), 10)]
    groups = list(lexical._groups(batches, 20))
    assert np.concatenate([c for _, c, _ in groups]).tolist() == list(range(len(row)))
    assert max(len(r) for r, _, _ in groups) < 40
    assert all(a[0][-1] < b[0][0] for a, b in zip(groups, groups[1:]))


def test_document_frequencies_are_counted_without_postings(spark):
    from tidemark.operators.lexical import Bm25Index

    terms = Bm25Index.build(spark.createDataFrame([(1, "uno dos dos"), (2, "dos tres"), (3, "")], "row_id long, text string")).terms
    assert {(r.term, r.df) for r in terms.collect()} == {("uno", 1), ("dos", 2), ("tres", 1)}
    assert terms._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
