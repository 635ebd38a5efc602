"""Registered queries of the retrieval engine: each applies an operator to its whole tables, with DuckDB SQL beside it.

Corpus stand-ins: vectors are ``embeddings`` (row vec_id), documents are ``documents`` (row doc_id), lexical queries are the
whole texts of ``benchmark``; where both text and vector are needed, doc_id = vec_id.  In vector searches every row is a query.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage, wire
from ..corpus import Corpus, build
from ..functions.hashing import checksum8, chunk_id, citation_id, parse_citation, source_uri
from ..functions.stats import nearest_ranks
from ..functions.text import join_parts, label_of, rating_label, squash, tokens
from ..functions.vector import cosine_distance, dot_int8, finite, float16, norm, perturb, quantize_int8, unit
from ..manifest import Manifest, compact
from ..operators import ann, etl, evaluate
from ..operators.lexical import Bm25Index, doc_terms, hybrid_topk, rrf
from ..operators.search import envelope, exact_topk, materialize_hits, query_error
from ..operators.validate import chunk_violations, embedder_errors, manifest_errors, resolve_citations
from ..sources.container import Container, read_containers
from ..sources.loaders import both_sides

K = 10
CANDIDATES = 20
COPY = 1_000_000
CHUNKER = "char/512"
CONTENT = "sha256:" + "ab" * 32
FILE = "sha256:" + "cd" * 32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def _text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(docs: DataFrame) -> Bm25Index:
    """A written inverted index, as searches meet it."""
    path = storage.fresh_path(docs.sparkSession, "lexical")
    Bm25Index.build(docs).write(path)
    return Bm25Index.read(docs.sparkSession, path)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


# ---- SQL fragments -------------------------------------------------------------------------------------------------

UNIT = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


def _topk_sql(corpus: str, k: int = K, queries: str = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings") -> str:
    """CTEs ending in r (query_id, row_id, s, rank): corpus yields (row_id, e DOUBLE[])."""
    return f"""
q0 AS ({queries}), qn AS (SELECT query_id, {UNIT.format(v="v")} AS v FROM q0), c AS ({corpus}),
s AS (SELECT query_id, row_id, round(list_dot_product(v, e), 10) AS s FROM qn, c),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS INTEGER) AS rank FROM s),
r AS (SELECT * FROM n WHERE rank <= {k})"""


RAW = "SELECT vec_id AS row_id, embedding::DOUBLE[] AS e FROM embeddings"
INT8_CTE = """
m AS (SELECT vec_id, embedding AS v, list_max(list_transform(embedding, lambda x: abs(x))) AS top FROM embeddings),
z AS (SELECT vec_id, v, CASE WHEN top > 0 THEN CAST(top::DOUBLE / 127 AS FLOAT) ELSE CAST(1 AS FLOAT) END AS scale FROM m),
i8 AS (SELECT vec_id, scale, list_transform(v, lambda x: CAST(greatest(-127, least(127, round(CAST(x::DOUBLE * CAST(1 / scale::DOUBLE AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE))) AS TINYINT)) AS q FROM z)"""
INT8 = "SELECT vec_id AS row_id, list_transform(q, lambda x: CAST(x::DOUBLE * scale::DOUBLE AS FLOAT)::DOUBLE) AS e FROM i8"
_ULP = "pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14.0) - 10)"
F16_VALUE = f"CASE WHEN x = 0 THEN x ELSE CAST(round_even(x::DOUBLE / {_ULP}, 0) * {_ULP} AS FLOAT) END"
F16 = f"SELECT vec_id AS row_id, list_transform(embedding, lambda x: ({F16_VALUE})::DOUBLE) AS e FROM embeddings"
SHOWN = "SELECT query_id, row_id, round(s, 6) AS score, rank FROM r"


def _le(number: str, size: int) -> str:
    digits = f"lpad(to_hex({number}), {2 * size}, '0')"
    return "unhex(" + " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(size))) + ")"


def _chunk_id_sql(text: str, uri: str, start: str, end: str, version: str = f"'{CHUNKER}'") -> str:
    lp = lambda x: f"{_le(f'strlen({x})', 4)} || encode({x})"
    return f"('sha256:' || sha256(unhex('{wire.CHUNK_TAG.hex()}') || {lp(text)} || {lp(uri)} || {_le(start, 8)} || {_le(end, 8)} || {lp(version)}))"


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
w0 AS (SELECT doc_id, text, CAST(unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT)) END)) AS INTEGER) AS chunk_index FROM documents),
w1 AS (SELECT doc_id, chunk_index, substr(text, chunk_index * {step} + 1, {size}) AS canonical_text, strlen(substr(text, 1, chunk_index * {step})) AS byte_start FROM w0),
w AS (SELECT *, byte_start + strlen(canonical_text) AS byte_end, 'doc-' || doc_id AS uri FROM w1)"""


TOKENS = "list_filter(list_transform(regexp_split_to_array({text}, '[^\\pL\\pN]+'), lambda t: lower(t)), lambda t: length(t) >= 2)"
_BM25_CTE = f"""
toks AS (SELECT doc_id AS row_id, {TOKENS.format(text="text")} AS t FROM documents),
dl AS (SELECT row_id, len(t) AS dl FROM toks), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _bm25_sql(queries: str, k: int, name: str = "b") -> str:
    return f"""
{name}q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format(text="text")}) AS term FROM ({queries})) GROUP BY ALL),
{name}s AS (SELECT query_id, row_id, round(sum(times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))))), 6) AS score
  FROM {name}q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (row_id), st GROUP BY ALL),
{name}n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM {name}s),
{name} AS (SELECT * FROM {name}n WHERE rank <= {k})"""


BENCH = "SELECT item_id AS query_id, text FROM benchmark"
# documents that have a vector
_PAIRED = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id"
_PAIRED_ROWS = "SELECT vec_id AS row_id, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON doc_id = vec_id"


# ---- exact search --------------------------------------------------------------------------------------------------


@query(f"WITH {_topk_sql(RAW)} {SHOWN}")
def exact_topk_query(spark, sf_dir):
    return _shown(exact_topk(_vectors(spark, sf_dir), _queries(spark, sf_dir), K))


@query(f"WITH {_topk_sql(RAW + f' UNION ALL SELECT vec_id + {COPY}, embedding::DOUBLE[] FROM embeddings')} {SHOWN}")
def exact_topk_ties(spark, sf_dir):
    """Every vector twice: ties go to the lesser row."""
    v = _vectors(spark, sf_dir)
    return _shown(exact_topk(v.unionByName(v.withColumn("row_id", F.col("row_id") + COPY)), _queries(spark, sf_dir), K))


@query(f"""WITH {_topk_sql(_PAIRED_ROWS, queries=_PAIRED)},
h AS (SELECT r.*, {_chunk_id_sql("text", "'doc-' || doc_id", "0", "strlen(text)")} AS chunk_id, 'doc-' || doc_id AS source_uri, strlen(text) AS n FROM r JOIN documents ON row_id = doc_id)
SELECT query_id, rank, chunk_id, round(CAST(s AS FLOAT)::DOUBLE, 6) AS score, 'cosine' AS score_type, source_uri, CAST(0 AS BIGINT) AS offset_start, CAST(n AS BIGINT) AS offset_end, 'demo' AS embedding_model,
       'exact' AS index_type, false AS reranked, '{FILE}' AS file_hash, '{CONTENT}' AS content_hash, '{wire.CITATION_SCHEME}{CONTENT}/' || chunk_id AS citation_id FROM h""")
def hit_contract(spark, sf_dir):
    """All twelve columns of each hit."""
    base = _docs(spark, sf_dir).join(_vectors(spark, sf_dir), "row_id")
    zero, end = F.lit(0).cast("long"), F.octet_length("text").cast("long")
    uri = F.concat(F.lit("doc-"), F.col("row_id").cast("string"))
    chunks = base.select("row_id", chunk_id(F.col("text"), uri, zero, end, F.lit(CHUNKER)).alias("chunk_id"), uri.alias("source_uri"), zero.alias("byte_start"), end.alias("byte_end"))
    hits = exact_topk(base, base.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector")), K)
    return materialize_hits(hits, chunks, "demo", "exact", False, FILE, CONTENT).withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(f"""WITH {_topk_sql(RAW)}, n2 AS (SELECT count(*) AS n FROM embeddings)
SELECT query_id, CAST(0 AS DOUBLE) AS query_time_ms, 'exact' AS index_type, CAST(1 AS FLOAT) AS recall, {K} < any_value(n) AS truncated,
       CAST({K} AS INTEGER) AS k_requested, count(*) AS k_returned FROM r, n2 GROUP BY query_id""")
def search_result_envelope(spark, sf_dir):
    v, q = _vectors(spark, sf_dir), _queries(spark, sf_dir)
    return envelope(exact_topk(v, q, K), q, v.count(), K, "exact", 1.0)


@query(f"""WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT i, list_transform(v, lambda x, j: x + ((7 * (j - 1) + i) % 17 - 8) * 1e-5) AS p FROM e)
SELECT i AS query_id, round(list_dot_product({UNIT.format(v="p")}, v), 8) AS kept FROM p JOIN e USING (i)""")
def query_perturbation(spark, sf_dir):
    """How near a perturbed query stays to its row."""
    from ..functions.vector import dot

    e = _vectors(spark, sf_dir)
    return e.select(F.col("row_id").alias("query_id"), F.round(dot(perturb(F.col("embedding"), F.col("row_id")), F.col("embedding")), 8).alias("kept"))


@query("""SELECT a.vec_id, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 8) AS norm,
round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) AS distance, CAST(NULL AS VARCHAR) AS error
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_arithmetic(spark, sf_dir):
    """Norm, cosine distance to the next row, and the query check, of each row."""
    e = _t(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(norm(F.col("embedding")), 8).alias("norm"), F.round(cosine_distance(F.col("embedding"), F.col("other")), 8).alias("distance"), query_error(F.col("embedding"), F.lit(K), 64).alias("error"))


# ---- quantised vectors ---------------------------------------------------------------------------------------------


@query(f"WITH {INT8_CTE} SELECT vec_id, scale, list_transform(q, lambda x: x::INTEGER) AS q FROM i8")
def int8_quantize(spark, sf_dir):
    z = quantize_int8(F.col("embedding"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", z["scale"].alias("scale"), z["q"].cast("array<int>").alias("q"))


@query(f"SELECT vec_id, list_transform(embedding, lambda x: {F16_VALUE}) AS half FROM embeddings")
def f16_roundtrip(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", float16(F.col("embedding")).alias("half"))


@query(f"""WITH {INT8_CTE} SELECT a.vec_id, round(a.scale::DOUBLE * list_dot_product(b.embedding::DOUBLE[], a.q::DOUBLE[]), 8) AS score
FROM i8 a JOIN embeddings b ON b.vec_id = a.vec_id""")
def int8_scores(spark, sf_dir):
    """Each row against its own stored form, by the integers and one scale."""
    e = F.col("embedding")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(dot_int8(e, quantize_int8(e)), 8).alias("score"))


def _int8(v: DataFrame) -> DataFrame:
    return v.select("row_id", quantize_int8(F.col("embedding")).alias("z")).select("row_id", "z.scale", "z.q")


def _f16(v: DataFrame) -> DataFrame:
    return v.select("row_id", float16(F.col("embedding")).alias("embedding"))


@query(f"WITH {INT8_CTE}, {_topk_sql(INT8)} {SHOWN}")
def int8_topk(spark, sf_dir):
    return _shown(exact_topk(_int8(_vectors(spark, sf_dir)), _queries(spark, sf_dir), K))


@query(f"WITH {_topk_sql(F16)} {SHOWN}")
def f16_topk(spark, sf_dir):
    return _shown(exact_topk(_f16(_vectors(spark, sf_dir)), _queries(spark, sf_dir), K))


def _recall_sql(cte: str, corpus: str) -> str:
    inner = lambda c: f"SELECT query_id, row_id FROM (WITH {_topk_sql(c)} SELECT * FROM r)"
    return f"""WITH {cte + "," if cte else ""} x AS ({inner(RAW)}), a AS ({inner(corpus)})
SELECT x.query_id, round(count(a.row_id) / {K}.0, 6) AS recall FROM x LEFT JOIN a ON x.query_id = a.query_id AND x.row_id = a.row_id GROUP BY x.query_id"""


def _recall(spark, sf_dir, quantised) -> DataFrame:
    v, q = _vectors(spark, sf_dir), _queries(spark, sf_dir)
    return evaluate.recall_at_k(exact_topk(quantised(v), q, K), exact_topk(v, q, K), K).select("query_id", F.round("recall", 6).alias("recall"))


@query(_recall_sql(INT8_CTE, INT8))
def recall_int8(spark, sf_dir):
    return _recall(spark, sf_dir, _int8)


@query(_recall_sql("", F16))
def recall_f16(spark, sf_dir):
    return _recall(spark, sf_dir, _f16)


@query(f"""WITH {INT8_CTE}, x AS (SELECT * FROM (WITH {_topk_sql(RAW, 1)} SELECT query_id, s FROM r)), a AS (SELECT * FROM (WITH {_topk_sql(INT8, 1)} SELECT query_id, s FROM r))
SELECT query_id, round(abs(a.s - x.s), 6) AS drift FROM x JOIN a USING (query_id)""")
def score_drift(spark, sf_dir):
    v, q = _vectors(spark, sf_dir), _queries(spark, sf_dir)
    return evaluate.score_drift(exact_topk(_int8(v), q, 1), exact_topk(v, q, 1)).select("query_id", F.round("drift", 6).alias("drift"))


# ---- approximate search --------------------------------------------------------------------------------------------


@query()
def ann_topk(spark, sf_dir):
    """Graph search is not SQL; ann_recall and tests/test_search.py hold its recall against exact search."""
    v = _vectors(spark, sf_dir)
    index = storage.written(ann.build_index(v), "graph")
    return _shown(ann.ann_topk(v, _queries(spark, sf_dir), K, 100, index))


#: Vectors that ann_recall searches, at least.
GRAPH_ROWS = 20_000


def many_vectors(spark: SparkSession, sf_dir: str, rows: int = GRAPH_ROWS) -> DataFrame:
    """At least so many unit vectors: each row of embeddings, moved in as many ways as that takes."""
    e = _vectors(spark, sf_dir)
    times = max(1, -(-rows // max(1, e.count())))
    moved = F.transform(F.col("embedding"), lambda x, i: x.cast("double") + ((F.col("row_id") * 7 + i * 13 + F.col("c") * 29 + i * F.col("c")) % 31 - 15) / 150.0)
    copies = e.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.select((F.col("row_id") + F.col("c") * COPY).alias("row_id"), unit(moved).cast("array<float>").alias("embedding"))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings")
def ann_recall(spark, sf_dir):
    """Every row as a query of graphs over at least GRAPH_ROWS vectors: whether the mean recall at K is 0.95 at least."""
    v = storage.written(many_vectors(spark, sf_dir), "many")
    index = storage.written(ann.build_index(v), "graph")
    q = _queries(spark, sf_dir)
    found = evaluate.recall_at_k(ann.ann_topk(v, q, K, 100, index), exact_topk(v, q, K), K)
    return found.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.95).alias("reached"))


# ---- text and lexical search ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({TOKENS.format(text='text')}, ' ') AS tokens, CAST(len({TOKENS.format(text='text')}) AS INTEGER) AS n FROM documents")
def tokenize(spark, sf_dir):
    t = tokens(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query(f"WITH {_BM25_CTE} SELECT row_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return doc_terms(_docs(spark, sf_dir)).select("row_id", "term", "tf")


@query(f"WITH {_BM25_CTE} SELECT term, df FROM df")
def doc_freq(spark, sf_dir):
    return Bm25Index.build(_docs(spark, sf_dir)).terms.select("term", "df")


@query(f"WITH {_BM25_CTE} SELECT n_docs, (SELECT count(*) FROM df) AS n_terms, round(avgdl, 6) AS avgdl FROM st")
def doc_stats(spark, sf_dir):
    return Bm25Index.build(_docs(spark, sf_dir)).stats.select("n_docs", "n_terms", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_BM25_CTE}, {_bm25_sql(BENCH, K)} SELECT query_id, row_id, score, rank FROM b")
def bm25_topk(spark, sf_dir):
    return _index(_docs(spark, sf_dir)).search(_text_queries(spark, sf_dir), K).select("query_id", "row_id", "score", "rank")


def _paired(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(corpus rows with text and vector, one query a test item: its text, and the vector of that number)."""
    both = _docs(spark, sf_dir).join(_vectors(spark, sf_dir), "row_id")
    items = _text_queries(spark, sf_dir).join(both.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return both, items


_ITEM_VECTORS = "SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id JOIN documents ON doc_id = vec_id"
_ITEM_TEXTS = "SELECT item_id AS query_id, benchmark.text AS text FROM benchmark JOIN embeddings ON item_id = vec_id JOIN documents ON doc_id = vec_id"
_FUSED = f"""WITH {_BM25_CTE.replace("FROM documents)", "FROM documents JOIN embeddings ON doc_id = vec_id)", 1)}, {_bm25_sql(_ITEM_TEXTS, CANDIDATES)}, {_topk_sql(_PAIRED_ROWS, CANDIDATES, _ITEM_VECTORS)},
u AS (SELECT query_id, row_id, rank FROM r UNION ALL SELECT query_id, row_id, rank FROM b),
f AS (SELECT query_id, row_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS rrf FROM u GROUP BY ALL)"""


def _both_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    both, items = _paired(spark, sf_dir)
    near = exact_topk(both, items, CANDIDATES)
    return both, items, near, _index(both.select("row_id", "text")).search(items.select("query_id", "text"), CANDIDATES)


@query(f"{_FUSED} SELECT query_id, row_id, rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, row_id) AS INTEGER) AS rank FROM f")
def rrf_union(spark, sf_dir):
    _, _, near, lexical = _both_lists(spark, sf_dir)
    return rrf(near, lexical)


@query(f"""{_FUSED}, h AS (SELECT f.query_id, f.row_id, round(list_dot_product(v, e), 10) AS s FROM f JOIN qn USING (query_id) JOIN c USING (row_id)),
hn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS INTEGER) AS rank FROM h)
SELECT query_id, row_id, round(s, 6) AS score, rank FROM hn WHERE rank <= {K}""")
def hybrid_topk_query(spark, sf_dir):
    both, items, near, lexical = _both_lists(spark, sf_dir)
    return _shown(hybrid_topk(both, near, lexical, items, K))


# ---- preparing documents -------------------------------------------------------------------------------------------


@query(f"WITH {_windows_sql(512, 64)} SELECT doc_id, chunk_index, canonical_text, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM w")
def chunk_text(spark, sf_dir):
    uri = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    rows = etl.chunk_rows(_t(spark, sf_dir, "documents").select("doc_id", "text"), uri, 512, 64)
    return rows.select("doc_id", "chunk_index", "canonical_text", "byte_start", "byte_end")


@query(f"WITH {_windows_sql(512, 0)} SELECT doc_id, chunk_index, {_chunk_id_sql('canonical_text', 'uri', 'byte_start', 'byte_end')} AS chunk_id FROM w")
def chunk_identifiers(spark, sf_dir):
    uri = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return etl.chunk_rows(_t(spark, sf_dir, "documents").select("doc_id", "text"), uri, 512).select("doc_id", "chunk_index", "chunk_id")


@query(f"SELECT doc_id, '{wire.SOURCE_SCHEME}' || source || '/' || left(sha256(text), 16) AS source_uri FROM documents")
def source_uris(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", source_uri(F.col("source"), F.col("text")).alias("source_uri"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest, lower(left(sha256(text), 16)) AS checksum FROM documents")
def text_digests(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2(raw, 256)).alias("digest"), F.lower(F.hex(checksum8(raw))).alias("checksum"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def ws_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", squash(F.col("text")).alias("text"))


@query("SELECT doc_id FROM documents WHERE length(text) > 20")
def min_len_filter(spark, sf_dir):
    return etl.long_enough(_t(spark, sf_dir, "documents")).select("doc_id")


KEPT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS n FROM documents WHERE length(text) > 20) WHERE n = 1"


@query(f"SELECT doc_id, source FROM ({KEPT})")
def dedupe_keep_first(spark, sf_dir):
    return etl.keep_first(etl.long_enough(_t(spark, sf_dir, "documents")), "source", "doc_id").select("doc_id", "source")


@query(f"""SELECT source, count(*) AS original, count(kept) AS kept, count(kept) - count(*) AS delta FROM
(SELECT d.source, k.doc_id AS kept FROM documents d LEFT JOIN ({KEPT}) k ON d.doc_id = k.doc_id AND d.source = k.source) GROUP BY ROLLUP (source)""")
def source_report(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return etl.source_report(docs, etl.keep_first(etl.long_enough(docs), "source", "doc_id"))


@query("SELECT d.source, CASE l.quality WHEN 0 THEN 'False' WHEN 1 THEN 'True' END AS label, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def label_report(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", label_of(F.col("quality"), {"0": "False", "1": "True"}).alias("label"))
    return _t(spark, sf_dir, "documents").join(labels, "doc_id").groupBy("source", "label").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN CAST(trunc(value) AS INTEGER) = 3 THEN NULL WHEN trunc(value) <= 2 THEN 'False' ELSE 'True' END AS label FROM events")
def rating_labels(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", rating_label(F.col("value")).alias("label"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, 'False' AS label, source AS title FROM documents
UNION ALL SELECT doc_id, lang, 'True', '' FROM documents""")
def two_sided_rows(spark, sf_dir):
    """A row with a false and a true side becomes two rows."""
    d = _t(spark, sf_dir, "documents")
    wide = d.select(F.col("text").alias("fake"), F.col("source").alias("title_fake"), F.col("doc_id").cast("string").alias("link_f"), F.col("lang").alias("true"), F.col("doc_id").cast("string").alias("link_t"))
    return both_sides(wide).select(F.col("url").cast("long").alias("doc_id"), "text", "label", "title")


@query("SELECT doc_id, concat_ws(' ', source, lang, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS body FROM documents")
def joined_parts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", join_parts(F.col("source"), F.lit("  "), F.col("lang"), F.lit(None).cast("string"), F.col("text")).alias("body"))


@query("SELECT text, CAST(0 AS INTEGER) AS source_rank FROM documents UNION ALL SELECT text, 1 FROM benchmark UNION ALL SELECT text, 2 FROM conversations")
def union_of_sources(spark, sf_dir):
    names = ("documents", "benchmark", "conversations")
    return etl.union_sources({n: _t(spark, sf_dir, n).select("text") for n in names})


_ID = _chunk_id_sql("text", "'doc'", "0", "strlen(text)")


@query(f"""WITH k AS (SELECT doc_id, {_ID} AS id FROM documents), c AS (SELECT DISTINCT id FROM k JOIN labels USING (doc_id))
SELECT CASE WHEN id IN (SELECT id FROM c) THEN 'hit' ELSE 'miss' END AS found, count(*) AS n, count(DISTINCT id) AS ids FROM k GROUP BY 1""")
def cache_hits_misses(spark, sf_dir):
    """Labelled documents are in the cache, all documents ask for their vector."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", chunk_id(F.col("text"), F.lit("doc"), F.lit(0), F.octet_length("text"), F.lit(CHUNKER)).alias("chunk_id"))
    known = docs.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi").select("chunk_id", F.lit(1).alias("dim"), F.array(F.lit(0.5)).alias("embedding")).dropDuplicates(["chunk_id"])
    hits, misses = etl.cache_split(docs, known, 1)
    both = hits.select(F.lit("hit").alias("found"), "chunk_id").unionByName(misses.select(F.lit("miss").alias("found"), "chunk_id"))
    return both.groupBy("found").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))


# ---- citations, validation, statistics -----------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT doc_id, {_ID} AS id FROM documents), f AS (SELECT id, min(doc_id) AS row_id FROM k GROUP BY id)
SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'content_hash' WHEN 2 THEN 'chunk_id' ELSE 'ok' END AS status, CASE WHEN doc_id % 3 = 0 THEN row_id END AS row_id FROM k JOIN f USING (id)""")
def cite_lookup(spark, sf_dir):
    """A citation of every document; of three, one cites another corpus and one a chunk that isn't there."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", chunk_id(F.col("text"), F.lit("doc"), F.lit(0), F.octet_length("text"), F.lit(CHUNKER)).alias("chunk_id"))
    turn = F.col("doc_id") % 3
    cited = docs.withColumn("citation", citation_id(F.when(turn == 1, FILE).otherwise(CONTENT), F.when(turn == 2, "sha256:none").otherwise(F.col("chunk_id"))))
    found = resolve_citations(cited.select("citation", "doc_id"), docs.select(F.col("doc_id").alias("row_id"), "chunk_id"), CONTENT)
    return found.select("doc_id", "status", "row_id")


@query(f"SELECT doc_id, '{CONTENT}' AS content_hash, 'c' || doc_id AS chunk_id FROM documents")
def cite_parse(spark, sf_dir):
    """With and without the scheme and the hash's prefix; what follows a second slash goes."""
    i = F.col("doc_id").cast("string")
    bare = F.when(F.col("doc_id") % 2 == 0, CONTENT).otherwise(CONTENT.removeprefix("sha256:"))
    cited = F.concat(F.lit(wire.CITATION_SCHEME), bare, F.lit("/c"), i, F.lit("/more/"), i)
    return _t(spark, sf_dir, "documents").select("doc_id", parse_citation(cited).alias("p")).select("doc_id", "p.content_hash", "p.chunk_id")


@query("""SELECT vec_id AS row_id, 'DimensionMismatch' AS rule FROM embeddings WHERE vec_id % 5 = 1
UNION ALL SELECT vec_id, 'InvalidEmbeddingValue' FROM embeddings WHERE vec_id % 5 = 2 UNION ALL SELECT vec_id, 'InvalidSpan' FROM embeddings WHERE vec_id % 5 = 3""")
def validation_violations(spark, sf_dir):
    """Vectors spoilt in three of five ways: too long, with a NaN, with a span that ends early."""
    e, turn = F.col("embedding"), F.col("row_id") % 5
    nan = F.array(F.lit(float("nan")).cast("float"))
    spoilt = F.when(turn == 1, F.concat(e, e)).when(turn == 2, F.concat(F.slice(e, 1, F.size(e) - 1), nan)).otherwise(e)
    rows = _vectors(spark, sf_dir).select("row_id", spoilt.alias("embedding"), F.lit(5).alias("byte_start"), F.when(turn == 3, 4).otherwise(9).alias("byte_end"))
    return chunk_violations(rows, 64)


@query("SELECT count(*) AS n, count(*) FILTER (list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS sound FROM embeddings")
def finite_values(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.count(F.when(finite(F.col("embedding")), 1)).alias("sound"))


def _percentile_sql(p: float) -> str:
    at = f"(count(*) - 1) * {p}::DOUBLE"
    return f"list_sort(list(value))[CAST(round_even({at}, 0) AS BIGINT) + 1] AS p{round(100 * p)}_even, list_sort(list(value))[CAST(floor({at} + 0.5) AS BIGINT) + 1] AS p{round(100 * p)}_away"


@query(f"SELECT event_type, {_percentile_sql(0.5)}, {_percentile_sql(0.95)}, {_percentile_sql(0.99)} FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, sf_dir):
    wanted = {f"p{round(100 * p)}_{t}": (p, t) for p in (0.5, 0.95, 0.99) for t in ("even", "away")}
    return nearest_ranks(_t(spark, sf_dir, "events"), "value", wanted, ("event_type",))


@query(f"SELECT round(avg(value), 6) AS mean, {', '.join(_percentile_sql(p).split(', list_sort')[0].replace('_even', '') for p in (0.5, 0.95, 0.99))} FROM events")
def latency_summary(spark, sf_dir):
    return evaluate.latency_summary(_t(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_topk_sql(RAW, CANDIDATES)}, i8r AS (SELECT query_id, row_id FROM r WHERE rank <= {K}), o AS (SELECT query_id, row_id FROM r WHERE rank > {K // 2})
SELECT query_id, (SELECT count(*) FROM i8r a WHERE a.query_id = q0.query_id) AS one, (SELECT count(*) FROM o a WHERE a.query_id = q0.query_id) AS other,
 (SELECT count(*) FROM (SELECT row_id FROM i8r a WHERE a.query_id = q0.query_id INTERSECT SELECT row_id FROM o a WHERE a.query_id = q0.query_id)) AS both_,
 (SELECT count(*) FROM (SELECT row_id FROM i8r a WHERE a.query_id = q0.query_id EXCEPT SELECT row_id FROM o a WHERE a.query_id = q0.query_id)) AS only_one,
 (SELECT count(*) FROM (SELECT row_id FROM i8r a WHERE a.query_id = q0.query_id UNION SELECT row_id FROM o a WHERE a.query_id = q0.query_id)) AS either FROM q0""")
def candidate_sets(spark, sf_dir):
    """Union, intersection and difference of two candidate lists of each query."""
    all_ = storage.written(exact_topk(_vectors(spark, sf_dir), _queries(spark, sf_dir), CANDIDATES), "candidates")
    one, other = (all_.where(c).select("query_id", "row_id") for c in (f"rank <= {K}", f"rank > {K // 2}"))
    sets = {"one": one, "other": other, "both_": one.intersect(other), "only_one": one.join(other, ["query_id", "row_id"], "left_anti"), "either": one.union(other).distinct()}
    long = None
    for name, df in sets.items():
        part = df.select("query_id", F.lit(name).alias("name"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("query_id").agg(*(F.count(F.when(F.col("name") == n, 1)).alias(n) for n in sets))


@query("""SELECT c.c_custkey AS query_id, 'c-' || c.c_custkey AS name FROM customer c""")
def vector_literals(spark, sf_dir):
    """JSON arrays read as vectors; each comes back as it was written."""
    from ..operators.search import parse_vector

    c = _t(spark, sf_dir, "customer").select("c_custkey", parse_vector(F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit(", 0.5]"))).alias("v"))
    return c.select(F.get("v", F.lit(0)).cast("long").alias("query_id"), F.concat(F.lit("c-"), F.get("v", F.lit(0)).cast("long").cast("string")).alias("name"))


# ---- whole corpora -------------------------------------------------------------------------------------------------


def _build(spark: SparkSession, sf_dir: str, preset: str) -> Corpus:
    both = _docs(spark, sf_dir).join(_vectors(spark, sf_dir), "row_id")
    uri = F.concat(F.lit("doc-"), F.lpad(F.col("row_id").cast("string"), 12, "0"))
    chunks = both.select(F.col("text").alias("canonical_text"), uri.alias("source_uri"), F.lit(0).cast("long").alias("byte_start"), F.octet_length("text").cast("long").alias("byte_end"), "embedding")
    return build(chunks, storage.fresh_path(spark, f"corpus-{preset}"), embedding_model="demo", embedding_dim=64, chunker_version=CHUNKER, model_hash="sha256:" + "12" * 32, preset=preset)


_NUMBERED = """d AS (SELECT doc_id, text, embedding, 'doc-' || lpad(doc_id::VARCHAR, 12, '0') AS uri, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents JOIN embeddings ON doc_id = vec_id)"""


@query(f"WITH {_NUMBERED} SELECT row_id, uri AS source_uri, {_chunk_id_sql('text', 'uri', '0', 'strlen(text)')} AS chunk_id, CAST(strlen(text) AS BIGINT) AS byte_end FROM d")
def corpus_chunks(spark, sf_dir):
    """A corpus built, opened and read back: dense row numbers, identifiers and spans."""
    return _build(spark, sf_dir, "compressed").chunks.select("row_id", "source_uri", "chunk_id", "byte_end")


@query(f"""WITH {_NUMBERED}
SELECT row_id, 'ChunkIdMismatch' AS rule FROM d WHERE row_id % 6 IN (1, 2) UNION ALL SELECT row_id, 'InvalidSpan' FROM d WHERE row_id % 6 = 2
UNION ALL SELECT row_id, 'DimensionMismatch' FROM d WHERE row_id % 6 = 3 UNION ALL SELECT row_id, 'InvalidEmbeddingValue' FROM d WHERE row_id % 6 = 4
UNION ALL SELECT NULL, 'CountMismatch' UNION ALL SELECT NULL, 'ContentHashMismatch'""")
def corpus_validation(spark, sf_dir):
    """A corpus spoilt after it was built: texts changed, spans turned round, vectors lengthened or no numbers, the last row gone."""
    c = _build(spark, sf_dir, "exact")
    if not c.validate().isEmpty():
        raise AssertionError("the corpus was unsound before")
    turn, e = F.col("row_id") % 6, F.col("embedding")
    text = F.when(turn == 1, F.concat("canonical_text", F.lit("!"))).otherwise(F.col("canonical_text"))
    start = F.when(turn == 2, F.col("byte_end") + 1).otherwise(F.col("byte_start"))
    nan = F.concat(F.slice(e, 1, F.size(e) - 1), F.array(F.lit(float("nan")).cast("float")))
    wrong = F.when(turn == 3, F.concat(e, e)).when(turn == 4, nan).otherwise(e)
    return replace(
        c, manifest=replace(c.manifest, n_chunks=c.manifest.n_chunks + 1), chunks=c.chunks.withColumns({"canonical_text": text, "byte_start": start}), stored=c.stored.withColumn("embedding", wrong)
    ).validate()


@query(f"WITH {_NUMBERED} SELECT row_id, {_chunk_id_sql('text', 'uri', '0', 'strlen(text)')} AS chunk_id, text AS canonical_text, uri AS source_uri, CAST(strlen(text) AS BIGINT) AS byte_end, embedding FROM d")
def container_round_trip(spark, sf_dir):
    """A corpus exported as a single file and read back section by section: identifiers, texts, spans, vectors."""
    path = storage.fresh_path(spark, "container")
    with tempfile.TemporaryDirectory(prefix="tidemark-container-") as folder:
        _build(spark, sf_dir, "exact").export_file(f"{folder}/corpus.bin")
        storage.upload(spark, f"{folder}/corpus.bin", f"{path}/corpus.bin")
    return read_containers(spark, f"{path}/corpus.bin").select("row_id", "chunk_id", "canonical_text", "source_uri", "byte_end", "embedding")


def _sections(data: memoryview) -> list[dict]:
    c = Container(data)
    try:
        return c.inspect()["sections"]
    finally:
        c.data = None


@query("""SELECT * FROM (VALUES ('chunk_ids', 0, true), ('chunks_canonical', 1, true), ('chunks_original_spans', 1, true), ('embeddings', 3, true), ('provenance', 1, true),
('search_contract', 1, true)) t(name, encoding, aligned)""")
def container_sections(spark, sf_dir):
    """The sections of a corpus exported with compressed text and int8 vectors, in the order in which they lie."""
    both = _build(spark, sf_dir, "tiny")
    plain = replace(both, graph=None, manifest=replace(both.manifest, index_type="exact", rerank_policy="none"))
    with tempfile.TemporaryDirectory(prefix="tidemark-container-") as folder:
        plain.export_file(f"{folder}/corpus.bin")
        with open(f"{folder}/corpus.bin", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m, memoryview(m) as data:
            found = _sections(data)
    rows = [(x["name"], x["encoding"], x["offset"] % wire.ALIGNMENT == 0) for x in found]
    return spark.createDataFrame(rows, "name string, encoding int, aligned boolean")


# ---- rules and gates -----------------------------------------------------------------------------------------------

#: (field, value that breaks a rule, error), one for each document in turn; the first breaks none.
_BROKEN = [
    (None, None, None), ("format_version", 2, "UnsupportedFormatVersion"), ("schema_version", 2, "UnsupportedSchemaVersion"), ("embedding_model", "", "ManifestInvalid"), ("embedding_dim", 0, "ManifestInvalid"),
    ("n_chunks", 0, "ManifestInvalid"), ("chunker_version", "", "ManifestInvalid"), ("model_hash", "md5:1", "InvalidModelHash"), ("model_hash", "sha256:12", "InvalidModelHash"), ("dtype", "int4", "UnsupportedDType"),
    ("metric", "l2", "UnsupportedMetric"), ("score_type", "x", "UnsupportedScoreType"), ("normalize", "no", "UnsupportedNormalize"), ("index_type", "ivf", "UnsupportedIndexType"),
    ("rerank_policy", "x", "UnsupportedRerankPolicy"), ("index_type", "hnsw", "ManifestInvalid"), ("capabilities", {"supports_exact": False}, "ManifestInvalid"),
    ("capabilities", {"supports_reproducible_build": False}, "ManifestInvalid"), ("n_chunks", -1, "Json"), ("n_chunks", "many", "Json"),
]
_SOUND = Manifest(embedding_model="demo", embedding_dim=64, n_chunks=3, model_hash="sha256:" + "12" * 32, chunker_version=CHUNKER)


def _turns(column: str, values: list[str | None]) -> str:
    """SQL that picks one of values by a number's remainder."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


def _by_turn(column: str, values: list[str | None]):
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col(column) % len(values)).cast("int"))


@query(f"SELECT doc_id AS id, {_turns('doc_id', [e for _, _, e in _BROKEN])} AS error FROM documents")
def manifest_rules(spark, sf_dir):
    """A manifest a document, each breaking one rule in turn: the error that is seen."""
    docs = []
    for name, value, _ in _BROKEN:
        doc = _SOUND.to_dict()
        if name:
            doc[name] = doc[name] | value if isinstance(value, dict) else value
        docs.append(compact(doc).decode())
    return manifest_errors(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _by_turn("doc_id", docs).alias("manifest")))


_ANSWERS = [
    ({}, {}, None), ({"embedding_model": "other"}, {}, "model name mismatch"), ({"embedding_dim": 32}, {}, "dim mismatch"), ({"vector": [0.5]}, {}, "dim mismatch"),
    ({"model_hash": "sha256:" + "34" * 32}, {}, "model_hash mismatch"), ({}, {"model_hash": wire.PLACEHOLDER_HASH}, "the corpus has the legacy placeholder as model_hash"),
]


@query(f"SELECT doc_id AS id, {_turns('doc_id', [e for _, _, e in _ANSWERS])} AS error FROM documents")
def model_gate(spark, sf_dir):
    """An embedder's answer a document, some of other models, dims and hashes: what the gate before a text search says."""
    fine = {"embedding_model": "demo", "embedding_dim": 64, "model_hash": _SOUND.model_hash, "vector": [0.125] * 64}
    answers = [json.dumps(fine | own) for own, _, _ in _ANSWERS]
    manifests = [compact(_SOUND.to_dict() | other).decode() for _, other, _ in _ANSWERS]
    return embedder_errors(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _by_turn("doc_id", manifests).alias("manifest"), _by_turn("doc_id", answers).alias("answer")))


_QUERY_ERRORS = [None, "EmptyQuery", "DimensionMismatch", "InvalidQueryValue", "ZeroNormQuery", "InvalidK", "EmptyQuery"]


@query(f"SELECT vec_id, {_turns('vec_id', _QUERY_ERRORS)} AS error FROM embeddings")
def query_validation(spark, sf_dir):
    """Queries that are null, too long, no number, zero, for no results or empty, in turn: the error of each."""
    e, turn = F.col("embedding"), F.col("vec_id") % len(_QUERY_ERRORS)
    zero = F.transform(e, lambda x: x * 0)
    wrong = F.when(turn == 2, F.concat(e, e)).when(turn == 3, F.concat(F.slice(e, 1, F.size(e) - 1), F.array(F.lit(float("inf")).cast("float")))).when(turn == 4, zero).when(turn == 6, F.slice(e, 1, 0)).when(turn == 1, None).otherwise(e)
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", wrong.alias("v"), F.when(turn == 5, 0).otherwise(K).alias("k"))
    return rows.select("vec_id", query_error(F.col("v"), F.col("k"), 64).alias("error"))


_MEASURED = [("exact", 1.0, 1.0, 2.0), ("compressed", 0.41, 0.9999, 2.5), ("tiny", 0.28, 0.96, 2.5)]
_VALUES = ", ".join(f"('{p}', {s}::DOUBLE, {r}::DOUBLE, {t}::DOUBLE)" for p, s, r, t in _MEASURED)


@query(f"""WITH g AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{m}', '{o}', {b}::DOUBLE)" for p, m, o, b in evaluate.GATES)}) t(preset, measure, op, bound)),
m AS (SELECT * FROM (VALUES {_VALUES}) t(preset, size_ratio, recall_at_k, p95_ms)),
v AS (SELECT g.*, CASE measure WHEN 'size_ratio' THEN size_ratio WHEN 'recall_at_k' THEN recall_at_k ELSE p95_ms END AS value,
  CASE op WHEN '<=x' THEN bound * 1.0 ELSE bound END AS limit_ FROM g LEFT JOIN m ON m.preset = g.preset)
SELECT preset, measure, value, limit_ AS bound, coalesce(CASE op WHEN '>=' THEN value >= limit_ ELSE value <= limit_ END, false) AS passed FROM v""")
def release_gates(spark, sf_dir):
    """The release gates on measures of which some fail and one is missing; the baseline's p95 is 1 ms."""
    shape = "preset string, size_ratio double, recall_at_k double, p95_ms double"
    return evaluate.check_gates(spark.createDataFrame([("exact", 1.0, 1.0, 1.0)], shape), spark.createDataFrame(_MEASURED, shape))


@query(f"""WITH {_NUMBERED}, {_topk_sql("SELECT row_id, embedding::DOUBLE[] AS e FROM d", queries="SELECT row_id AS query_id, embedding::DOUBLE[] AS v FROM d")}
SELECT query_id, rank, source_uri, round(CAST(s AS FLOAT)::DOUBLE, 5) AS score FROM (SELECT r.*, uri AS source_uri FROM r JOIN d USING (row_id))""")
def corpus_search(spark, sf_dir):
    """Search of an opened corpus with its own rows as queries."""
    c = _build(spark, sf_dir, "exact")
    hits = c.search(c.vectors.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector")), K)
    return hits.select("query_id", "rank", "source_uri", F.round(F.col("score").cast("double"), 5).alias("score"))


@query()
def corpus_hybrid(spark, sf_dir):
    """Hybrid search of a corpus with graph and inverted index, its rows as queries; graph candidates are not SQL."""
    c = _build(spark, sf_dir, "hybrid")
    rows = c.vectors.join(c.chunks, "row_id").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("canonical_text").alias("text"))
    hits = c.search_hybrid(rows, k=K)
    return hits.select("query_id", "rank", "chunk_id", F.round(F.col("score").cast("double"), 5).alias("score"), "index_type", "reranked")


#: Names that differ from their function's.
RENAMED = {"exact_topk_query": "exact_topk", "hybrid_topk_query": "hybrid_topk", "chunk_identifiers": "chunk_id", "source_uris": "source_uri"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {RENAMED.get(k, k): f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {RENAMED.get(k, k): s for k, s in ORACLES.items()}
