import hashlib
import json
import sqlite3
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import tidemark
from tidemark import wire
from tidemark.acceptance import measure_presets, metrics_json, read_metrics
from tidemark.cli import process_embedder, run
from tidemark.corpus import Corpus, build, with_row_ids
from tidemark.errors import ERRORS, CorpusError
from tidemark.identity import check_embedder, fingerprint, resolve_model_folder
from tidemark.operators import etl
from tidemark.pipeline import BuildConfig, EmbeddingCache, Pipeline, prepare_sources
from tidemark.sources import loaders
from tidemark.sources.container import Container
from tidemark.streaming.search import search_stream

HASH = "sha256:" + "ab" * 32
ABOUT = dict(embedding_model="demo", embedding_dim=8, chunker_version="char/20", model_hash=HASH)


def chunks(spark, n=40, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"texto {i} comum", f"doc-{i:03}", 0, 10, v[i].tolist(), "src") for i in range(n)]
    return spark.createDataFrame(rows, "canonical_text string, source_uri string, byte_start long, byte_end long, embedding array<float>, source string"), v


@pytest.fixture(scope="module")
def corpora(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    rows, v = chunks(spark)
    made = {p: build(rows.repartition(3), str(root / p), preset=p, ann_ef_construction=50, **ABOUT) for p in ("exact", "compressed", "tiny", "hybrid")}
    return made, v


def queries(spark, v):
    return spark.createDataFrame([(i, x.tolist(), f"texto {i}") for i, x in enumerate(v)], "query_id long, vector array<float>, text string")


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = with_row_ids(df, "k").collect()
    assert sorted(r.row_id for r in got) == list(range(1000)) and all(r.row_id == r.k for r in got)


def test_presets_differ_as_declared(corpora):
    made, _ = corpora
    got = {p: (c.dtype, c.has_ann, c.has_bm25, c.index_type) for p, c in made.items()}
    assert got == {
        "exact": ("float32", False, False, "exact"), "compressed": ("float16", False, False, "exact"),
        "tiny": ("int8", True, False, "hnsw"), "hybrid": ("float32", True, True, "hybrid"),
    }
    assert all(c.validate().count() == 0 for c in made.values())


def test_every_way_to_search_finds_each_row_itself(spark, corpora):
    made, v = corpora
    q = queries(spark, v)
    for c, kind in ((made["exact"], "exact"), (made["compressed"], "exact"), (made["tiny"], "hnsw"), (made["hybrid"], "hnsw")):
        hits = c.search_ann(q, 1).collect()
        assert {(r.query_id, r.source_uri) for r in hits} == {(i, f"doc-{i:03}") for i in range(40)}
        assert {r.index_type for r in hits} == {kind}
    hits = made["hybrid"].search_hybrid(q, k=3, candidates=5)
    assert set(hits.columns) - {"query_id", "rank"} == {
        "chunk_id", "score", "score_type", "source_uri", "offset_start", "offset_end", "embedding_model", "index_type", "reranked", "file_hash", "content_hash", "citation_id",
    }
    assert {(r.query_id, r.source_uri) for r in hits.where("rank = 1").collect()} == {(i, f"doc-{i:03}") for i in range(40)}
    assert made["exact"].search_hybrid(v[0].tolist(), "texto", 9, candidates=4).count() == 4  # candidates bound a search without a graph


def test_single_queries_are_checked(corpora):
    made, v = corpora
    c = made["exact"]
    assert c.search(v[3].tolist(), 2).orderBy("rank").first().source_uri == "doc-003"
    for vector, k, error in ((v[0].tolist(), 0, "InvalidK"), ([], 1, "EmptyQuery"), ([1.0], 1, "DimensionMismatch"), ([0.0] * 8, 1, "ZeroNormQuery"), ([float("nan")] * 8, 1, "InvalidQueryValue")):
        with pytest.raises(ERRORS[error]):
            c.search(vector, k)


def test_citations(corpora):
    c = corpora[0]["compressed"]
    hit = c.search(corpora[1][5].tolist(), 1).first()
    assert c.cite(hit.citation_id)["canonical_text"] == "texto 5 comum"
    assert c.cite(hit.citation_id.replace("sha256:", "", 1) + "/x")["source_uri"] == "doc-005"
    with pytest.raises(CorpusError, match="content_hash"):
        c.cite(c.citation("x").replace(c.content_hash, HASH))
    with pytest.raises(CorpusError, match="not found"):
        c.cite(c.citation("x"))
    with pytest.raises(CorpusError):
        c.cite("http://x/y")


def test_hash_ignores_partitions_and_compression(spark, tmp_path, corpora):
    rows, _ = chunks(spark)
    again = build(rows.repartition(7), str(tmp_path / "a"), text_encoding="zstd", **ABOUT)
    assert again.content_hash == corpora[0]["exact"].content_hash
    assert build(rows.limit(39), str(tmp_path / "b"), **ABOUT).content_hash != again.content_hash


def test_damage_is_found(spark, tmp_path):
    rows, _ = chunks(spark, 6)
    c = build(rows, str(tmp_path / "c"), **ABOUT)
    c.chunks.withColumn("canonical_text", F.when(F.col("row_id") == 2, "changed").otherwise(F.col("canonical_text"))).write.parquet(str(tmp_path / "d"))
    c.chunks = spark.read.parquet(str(tmp_path / "d"))
    assert {(r.row_id, r.rule) for r in c.validate().collect()} == {(2, "ChunkIdMismatch"), (None, "ContentHashMismatch")}


def test_bad_input_is_refused_and_nothing_written(spark, tmp_path):
    rows, _ = chunks(spark, 4)
    path = tmp_path / "none"
    for bad in (rows.withColumn("byte_end", F.lit(-1)), rows.withColumn("embedding", F.slice("embedding", 1, 3)), rows.withColumn("row_id", F.lit(5))):
        with pytest.raises(ERRORS["InvalidInput"]):
            build(bad, str(path), **ABOUT)
    with pytest.raises(ERRORS["ManifestInvalid"]):
        build(rows.where("false"), str(path), **ABOUT)
    assert not path.exists()
    with pytest.raises(ERRORS["FileNotFound"]):
        tidemark.open(spark, str(path))


def test_containers_hold_the_same(spark, tmp_path, corpora):
    made, v = corpora
    for name in ("exact", "compressed", "tiny", "hybrid"):
        path = str(tmp_path / f"{name}.bin")
        made[name].export_container(path)
        c = tidemark.open(spark, path)
        assert c.validate().count() == 0 and c.dtype == made[name].dtype
        assert {(r.query_id, r.source_uri) for r in c.search(queries(spark, v), 1).collect()} == {(i, f"doc-{i:03}") for i in range(40)}
        assert c.inspect()["file_size"] == len(c.container.data)
    c = tidemark.open(spark, str(tmp_path / "hybrid.bin"))
    ask = spark.createDataFrame([(0, "texto 7")], "query_id long, text string")
    assert c.has_bm25 and c.lexical.search(ask, 1).first().row_id == made["hybrid"].lexical.search(ask, 1).first().row_id


def test_a_stored_graph_is_searched(spark, tmp_path):
    from tidemark.operators import ann
    from tidemark.sources.container import encode_container

    rows, v = chunks(spark, 60, 3)
    index = ann.build_index(with_row_ids(rows, "source_uri").select("row_id", "embedding"), shards=1, ef=40)
    parts = ann.graph_parts(index.first(), 40)
    m = tidemark.Manifest(embedding_model="demo", embedding_dim=8, n_chunks=60, model_hash=HASH, chunker_version="x")
    data = encode_container(m, [f"t{i}" for i in range(60)], [(f"doc-{i:03}", 0, 2) for i in range(60)], v, graph=parts)
    (tmp_path / "g.bin").write_bytes(data)
    c = tidemark.open(spark, str(tmp_path / "g.bin"))
    assert c.has_ann and c.ef_construction == 40
    assert {(r.query_id, r.source_uri) for r in c.search_ann(queries(spark, v), 1).collect()} == {(i, f"doc-{i:03}") for i in range(60)}


def answer(vector, **more):
    return {"embedding_model": "demo", "embedding_dim": len(vector), "model_hash": HASH, "vector": vector, "fingerprint": {}} | more


def test_text_search_gate(corpora):
    c, v = corpora[0]["hybrid"], corpora[1]
    fine = answer(v[2].tolist())
    assert c.search_text("texto 2", lambda t: fine, 1).first().source_uri == "doc-002"
    for change, message in (({"embedding_model": "other"}, "model name mismatch"), ({"embedding_dim": 9}, "dim mismatch"), ({"vector": [1.0]}, "dim mismatch"), ({"model_hash": "x"}, "model_hash mismatch")):
        with pytest.raises(CorpusError, match=message):
            c.search_text("t", lambda t: fine | change, 1)  # noqa: B023
    assert c.search_text("t", lambda t: fine | {"model_hash": "x"}, 1, skip_model_hash_check=True).count() == 1
    from dataclasses import replace

    with pytest.raises(CorpusError, match="legacy placeholder"):
        check_embedder(replace(c.manifest, model_hash=wire.PLACEHOLDER_HASH), fine)


def test_commands(spark, corpora, tmp_path, capsys):
    c, v = corpora[0]["hybrid"], corpora[1]
    script = tmp_path / "embed.py"
    script.write_text(f"import json, sys\nprint(json.dumps({answer(v[4].tolist())!r}))\n")
    cite = c.search(v[1].tolist(), 1).first().citation_id
    vector = json.dumps(v[1].tolist())
    for args in (["inspect", c.path], ["inspect", c.path, "--json"], ["validate", c.path], ["stats", c.path], ["cite", c.path, cite], ["search", c.path, vector, "-k", "2"], ["search-ann", c.path, vector], ["search-text", c.path, "hello", "--embedder", str(script), "-k", "1"], ["benchmark", c.path, "-q", "2", "--ann", "20"]):
        assert run(spark, args) == 0, args
    out = capsys.readouterr().out
    assert "texto 1 comum" in out and "doc-004" in out and '"recall"' in out
    assert run(spark, ["search", c.path, "[1]"]) == 1 and run(spark, ["stats", str(tmp_path / "no")]) == 1
    with pytest.raises(CorpusError):
        process_embedder(str(tmp_path / "none.py"), "demo")("x")


def embedder(texts):
    return [[float(b) for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


def test_pipeline_embeds_only_misses(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return embedder(texts)

    docs = spark.createDataFrame([(0, "Olá mundo, esta é uma frase."), (1, "Outra frase com acentuação."), (2, "")], "doc_id long, text string")
    uri = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))

    def emit(name, more=None):
        p = Pipeline(BuildConfig(str(tmp_path / name), **ABOUT), counted, cache)
        p.add_documents(docs if more is None else docs.union(more), uri, 20)
        return p.emit({"made": name})

    first = emit("one")
    n = calls.value
    assert n == first.n_embeddings == 4 and cache.read().count() == 4
    assert emit("two").n_embeddings == 4 and calls.value == n
    emit("three", spark.createDataFrame([(9, "Uma nova")], "doc_id long, text string"))
    assert calls.value == n + 1
    with pytest.raises(RuntimeError, match="no chunks"):
        Pipeline(BuildConfig(str(tmp_path / "x"), **ABOUT), counted).emit()


def test_cache_replaces_and_refuses_other_dims(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    shape = EmbeddingCache.SCHEMA
    cache.put(spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [2.0])], shape))
    cache.put(spark.createDataFrame([("a", 1, [3.0])], shape))
    assert {(r.chunk_id, r.embedding[0]) for r in cache.read().collect()} == {("a", 3.0), ("b", 2.0)}
    asked = spark.createDataFrame([("a",), ("z",)], "chunk_id string")
    hits, misses = etl.cache_split(asked, cache.read(), 1)
    assert [r.chunk_id for r in hits.collect()] == ["a"] and [r.chunk_id for r in misses.collect()] == ["z"]
    with pytest.raises(Exception, match="cached dim"):
        etl.cache_split(asked, cache.read(), 2)[0].collect()


def test_embedder_is_checked(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, canonical_text string").coalesce(1)
    for bad, message in ((lambda t: [[1.0]], "1 vectors for 2"), (lambda t: [[1.0, 2.0]] * len(t), "not dim 1")):
        with pytest.raises(Exception, match=message):
            etl.embed(rows, bad, 1).collect()


def test_sources(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    for folder in ("FakeBr-hf", "FakeTrue.Br-hf"):
        put(f"{folder}/train.csv", 'text,label\n"uma  notícia\ncom ""aspas"" e linha",True\n')
        put(f"{folder}/test.csv", "text,label\noutra, False \n")
    put("Fake.br-Corpus/preprocessed/pre-processed.csv", "index,label,preprocessed_news\n0,fake,texto falso\n1,odd,texto estranho\n")
    put("FakeRecogna/dataset/FakeRecogna.csv", "Titulo,Subtitulo,Noticia,Classe,URL\nT,,corpo,0,u\nT2,S2,corpo2,1.0,u2\n")
    put("FakeTrue.Br/FakeTrueBr_corpus.csv", "title_fake,fake,link_f,true,link_t\ntf,falso,lf,certo,lt\n")
    put("factck-br/FACTCKBR.tsv", "URL\tclaimReviewed\treviewBody\ttitle\tratingValue\nu\tclaim\tbody\tt\t1\nu\tamb\tb\tt\t3\nu\tnone\tb\tt\t\nu\tgood\tb\tt\t5\n")
    last = "portuguese-fake-news-classifier-bilstm-combined"
    spark.createDataFrame([("texto", True), ("texto 2", False)], "text string, label boolean").write.parquet(str(tmp_path / f"{last}/corpus/corpus_test_df.parquet"))
    rows = loaders.load_sources(spark, str(tmp_path))
    got = {(r.source, r.text, r.label, r.title, r.url, r.source_rank) for r in rows.collect()}
    assert got == {
        *((s, t, lab, "", "", i) for i, s in enumerate(("FakeBr-hf", "FakeTrue.Br-hf")) for t, lab in (('uma notícia com "aspas" e linha', "True"), ("outra", "False"))),
        ("Fake.br-Corpus", "texto falso", "False", "", "", 2), ("Fake.br-Corpus", "texto estranho", "odd", "", "", 2),
        ("FakeRecogna", "T corpo", "False", "T", "u", 3), ("FakeRecogna", "T2 S2 corpo2", "True", "T2", "u2", 3),
        ("FakeTrue.Br", "falso", "False", "tf", "lf", 4), ("FakeTrue.Br", "certo", "True", "", "lt", 4),
        ("factck-br", "claim body", "False", "t", "u", 5), ("factck-br", "good b", "True", "t", "u", 5),
        (last, "texto", "True", "", "", 6), (last, "texto 2", "False", "", "", 6),
    }
    kept, report = prepare_sources(rows, "whole/1")
    only = kept.collect()
    assert [r.source for r in only] == ["FakeBr-hf"] and only[0].source_uri.startswith(wire.SOURCE_SCHEME + "FakeBr-hf/")
    assert {(r.source, r.original, r.kept, r.delta) for r in report.where("source is null or source = 'FakeTrue.Br-hf'").collect()} == {(None, 14, 1, -13), ("FakeTrue.Br-hf", 2, 0, -2)}


def test_older_container(spark, tmp_path):
    path = tmp_path / "old.db"
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE articles(id, block_id, pos_in_block, source, label); CREATE TABLE text_blocks(block_id, data); CREATE TABLE blobs(name, data);")
    texts = [t.encode() for t in ("primeiro", "segundo é", "terceiro")]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    block = struct.pack("<4I", 3, *starts) + b"".join(texts)
    pack = zstandard.ZstdCompressor().compress
    con.execute("INSERT INTO text_blocks VALUES (0, ?)", (pack(block),))
    v = np.array([[3, 4], [0, 0], [1, 0]], np.float16)
    con.executemany("INSERT INTO blobs VALUES (?, ?)", [("manifest", json.dumps({"n_articles": 3, "embedding_dim": 2, "embedding_model": "m"})), ("embeddings", pack(v.tobytes()))])
    con.executemany("INSERT INTO articles VALUES (?, 0, ?, 's', 'True')", [(i, i) for i in range(3)])
    con.commit()
    con.close()
    got = loaders.read_legacy(spark, str(path)).orderBy("row_id").collect()
    assert [(r.canonical_text, r.byte_end, r.source_uri) for r in got][1] == ("segundo é", 10, "legacy://articles/1")
    assert loaders.read_legacy(spark, str(path), "old://").first().source_uri.startswith("old://")
    assert np.allclose([r.embedding for r in got], [[0.6, 0.8], [0, 0], [1, 0]], atol=1e-6)
    con = sqlite3.connect(path)
    con.execute("DELETE FROM articles WHERE id = 2")
    con.commit()
    con.close()
    with pytest.raises(Exception, match="2 articles instead of 3"):
        loaders.read_legacy(spark, str(path)).collect()


def test_fingerprint(tmp_path, monkeypatch):
    (tmp_path / "config.json").write_text('{"hidden_size": 7, "_name_or_path": "n"}')
    one = fingerprint(tmp_path)
    assert (one.model_id, one.embedding_dim, one.tokenizer_hash, one.normalize_embeddings) == ("n", 7, None, True)
    (tmp_path / "README.md").write_text("ignored")
    assert fingerprint(tmp_path) == one
    (tmp_path / "tokenizer.json").write_text("{}")
    two = fingerprint(tmp_path, "given")
    assert two.tokenizer_hash == "sha256:" + hashlib.sha256(b"{}").hexdigest() and two.model_hash() != one.model_hash()
    assert resolve_model_folder(str(tmp_path)) == tmp_path.resolve()
    monkeypatch.setenv("HF_HOME", str(tmp_path))
    (tmp_path / "hub/models--org--name/snapshots/1").mkdir(parents=True)
    assert resolve_model_folder("org/name").name == "1"
    with pytest.raises(FileNotFoundError):
        resolve_model_folder("org/other")
    with pytest.raises(FileNotFoundError):
        fingerprint(tmp_path / "none")


def test_keep_first_and_report(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 2, "x")], "text string, o int, source string")
    assert {(r.text, r.o) for r in etl.keep_first(df, "o").collect()} == {("a", 0), ("b", 2)}
    assert etl.long_enough(spark.createDataFrame([("é" * 20,), ("é" * 21,), (None,)], "text string")).count() == 1


def test_stream_gives_what_the_batch_gives(spark, tmp_path, corpora):
    c, v = corpora[0]["exact"], corpora[1]
    q = queries(spark, v).select("query_id", "vector")
    q.where("query_id < 20").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    writer = search_stream(stream, c.vectors, 2, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    writer.start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 40 and {(r.query_id, r.row_id) for r in got.where("rank = 1").collect()} == {(i, i) for i in range(20)}


def test_acceptance_harness(tmp_path, corpora):
    rows = {r.preset: r for r in measure_presets(corpora[0]["exact"], str(tmp_path), 5, 3, repeats=1).collect()}
    assert set(rows) == {"exact", "compressed", "tiny", "hybrid"}
    assert rows["hybrid"].recall_at_k == 1.0 and rows["hybrid"].search_mode == "hybrid" and rows["tiny"].search_mode == "ann"
    assert rows["compressed"].drift_max < 1e-2 and rows["exact"].is_baseline


def test_container_hash_makes_citations_agree(spark, tmp_path):
    rows, _ = chunks(spark, 12)
    c = build(rows, str(tmp_path / "c"), container_hash=True, **ABOUT)
    c.export_container(str(tmp_path / "c.bin"))
    file = Corpus.open(spark, "file://" + str(tmp_path / "c.bin"))
    assert file.content_hash == c.content_hash and c.validate().count() == 0
    cited = c.with_citations().orderBy("row_id").first().citation_id
    assert file.cite(cited)["canonical_text"] == c.cite(cited)["canonical_text"] == "texto 0 comum"
    assert build(rows, str(tmp_path / "d"), **ABOUT).content_hash != c.content_hash


def test_graphs_of_one_shard_are_exported(spark, tmp_path):
    rows, _ = chunks(spark, 30)
    one, two = (build(rows, str(tmp_path / str(n)), preset="tiny", ann_shards=n, ann_ef_construction=50, **ABOUT) for n in (1, 2))
    assert one.graph.count() == 1 and two.graph.count() == 2
    assert Container(one.export_container()).graph() is not None and Container(two.export_container()).graph() is None


def test_cache_survives_a_crash_between_renames(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    row = lambda i, x: spark.createDataFrame([(i, 1, [x])], cache.SCHEMA)
    cache.put(row("a", 1.0))
    cache.put(row("b", 2.0))
    cache.put(row("a", 3.0))
    assert {(r.chunk_id, r.embedding[0]) for r in cache.read().collect()} == {("a", 3.0), ("b", 2.0)}
    (tmp_path / "cache").rename(tmp_path / "cache.old")  # as a crash leaves it
    assert cache.read().count() == 2 and (tmp_path / "cache").is_dir() and not (tmp_path / "cache.old").exists()


def test_intermediates_go_and_clusters_must_name_a_folder(spark):
    from tidemark import storage

    df = storage.written(spark.range(3), "x")
    path = storage._made[-1][1]
    assert df.count() == 3 and storage.exists(spark, path) and storage.release(spark) >= 1 and not storage.exists(spark, path)

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(CorpusError, match="checkpoint"):
        storage.shared_folder(Unset())


def test_commands_of_harness_gates_and_fingerprint(spark, tmp_path, corpora, capsys):
    path = corpora[0]["exact"].path
    out = tmp_path / "measured.json"
    assert run(spark, ["measure", path, str(tmp_path / "variants"), "-q", "4", "-k", "3", "--json", str(out)]) == 0
    doc = json.loads(out.read_text())
    assert list(doc) == sorted(doc) and all(list(v) == sorted(v) for v in doc.values()) and doc["exact"]["is_baseline"] is True
    assert metrics_json(read_metrics(spark, out.read_text())) == out.read_text()
    good = doc | {"compressed": doc["compressed"] | {"size_ratio": 0.3, "recall_at_k": 1.0}, "tiny": doc["tiny"] | {"size_ratio": 0.2, "recall_at_k": 1.0}}
    out.write_text(json.dumps(good))
    assert run(spark, ["gates", str(out), str(out)]) == 0 and "FAIL" not in capsys.readouterr().out
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(good | {"tiny": good["tiny"] | {"recall_at_k": 0.5}}))
    assert run(spark, ["gates", str(out), str(bad)]) == 1 and "FAIL tiny recall_at_k" in capsys.readouterr().out
    (tmp_path / "model").mkdir()
    (tmp_path / "model/config.json").write_text('{"hidden_size": 7}')
    assert run(spark, ["fingerprint", str(tmp_path / "model"), "--model-id", "m"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["embedding_dim"] == 7 and shown["model_id"] == "m" and shown["model_hash"].startswith("sha256:")
    assert run(spark, ["fingerprint", str(tmp_path / "nowhere/else")]) == 1


def test_api_surface():
    assert tidemark.build is build and tidemark.Corpus is Corpus
    assert tidemark.chunk_id("a", "b", 0, 1, "c").startswith("sha256:")
    with pytest.raises(AttributeError):
        tidemark.nothing  # noqa: B018


def test_an_export_is_written_in_pieces_byte_for_byte(spark, tmp_path):
    import mmap

    from tidemark.sources.container import encode_container

    rows, _ = chunks(spark, 40)
    for preset in ("exact", "compressed"):
        for dtype in ("float32", "int8"):
            c = build(rows.repartition(3), str(tmp_path / preset), preset=preset, dtype=dtype, **ABOUT)
            c.export_file(str(tmp_path / "c.bin"))
            got = c.chunks.join(c.vectors, "row_id").orderBy("row_id").collect()
            want = encode_container(c.manifest, [r.canonical_text for r in got], [(r.source_uri, r.byte_start, r.byte_end) for r in got], np.array([r.embedding for r in got], np.float32), c.provenance, c.text_encoding)
            assert (tmp_path / "c.bin").read_bytes() == want == c.export_container()
    with open(tmp_path / "c.bin", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        assert Container(m).inspect() == Container(want).inspect()
