"""Exact vector search over batches of queries.

The corpus streams once past a broadcast matrix of normalised queries; each task keeps a running top-k a
query, so what is shuffled is at most k rows a query and task, and a window makes the final order.  Queries
beyond BROADCAST_VALUES numbers are taken in blocks, one pass each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, EmptyQuery, InvalidK, InvalidQueryValue, ZeroNormQuery
from ..functions.hashing import citation_id
from ..functions.vector import dot, finite, norm, unit
from ..storage import written

#: Most numbers of query vectors that one pass broadcasts.
BROADCAST_VALUES = 4_000_000
#: Scores are compared after rounding to so many places: equal vectors tie whatever the order of summation.
PLACES = 10


def check_query(vector: list[float], k: int, dim: int) -> None:
    """Refuse a query; the order of the checks decides which error is seen."""
    if k <= 0:
        raise InvalidK(k)
    if not len(vector):
        raise EmptyQuery()
    if len(vector) != dim:
        raise DimensionMismatch(dim, len(vector))
    if not all(math.isfinite(x) for x in vector):
        raise InvalidQueryValue()
    if not any(vector):
        raise ZeroNormQuery()


def query_error(vector: Column, k: Column, dim: int) -> Column:
    """The name of the error of each query of a batch, null if it is fine."""
    return (
        F.when(k <= 0, "InvalidK")
        .when(vector.isNull() | (F.size(vector) == 0), "EmptyQuery")
        .when(F.size(vector) != dim, "DimensionMismatch")
        .when(~finite(vector), "InvalidQueryValue")
        .when(norm(vector) == 0, "ZeroNormQuery")
    )


def parse_vector(literal: Column) -> Column:
    """A JSON array of numbers as a vector; null if it can't be read."""
    return F.from_json(literal, "array<float>")


def ranked(scored: DataFrame, k: int | None, score: str = "score", query: str = "query_id", row: str = "row_id") -> DataFrame:
    """scored with ``rank`` from 1 by falling score and, in ties, rising row; the first k of each query."""
    order = Window.partitionBy(query).orderBy(F.desc(score), row)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def score_all(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, row_id, score) of every pair as a plan of built-in expressions; the small side is the queries."""
    q = queries.select("query_id", unit(F.col("vector")).alias("__q"))
    return corpus.crossJoin(F.broadcast(q)).select("query_id", "row_id", F.round(dot(F.col("__q"), F.col("embedding")), PLACES).alias("score"))


#: Scores that are computed at a time, and rows of the corpus.
TILE, ROWS = 1_000_000, 2048


def best_of(query, row, score, k: int):
    """Of candidates (query, row, score), the k best of each query by falling score and, in ties, rising row; in order of query."""
    import numpy as np

    order = np.lexsort((row, -score, query))
    query = query[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return query[keep], row[order][keep], score[order][keep]


def stored_vectors(batch):
    """The batch's vectors as a matrix in double precision, from floats or from (scale, q), as they are multiplied out
    in single precision."""
    import numpy as np

    n = batch.num_rows
    if batch.num_columns == 2:
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    scale = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
    q = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return (q.astype(np.float32) * scale[:, None]).astype(np.float64)


def forget(*broadcasts) -> None:
    """Let a worker drop the values of broadcasts that its task is done with: it serves other blocks' tasks, and would keep all."""
    for b in broadcasts:
        b.__dict__.pop("_value", None)


def _top(ids, matrix, k: int):
    """A running top-k over batches of (row ids, vectors): arrays of query id, row id and score.

    Products in single precision, less what they can be off by, leave out nearly all pairs; scores that count are
    computed in double precision.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q, own = matrix.value, ids.value
        q32 = q.astype(np.float32)
        row, score = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)  # the best so far, in order
        floor = score[:, k - 1]  # a view: -inf while there are fewer than k
        for rows, v in ((b.column(0).to_numpy()[a : a + ROWS], stored_vectors(b.slice(a, ROWS))) for b in batches for a in range(0, b.num_rows, ROWS)):
            v32, long = v.astype(np.float32), np.linalg.norm(v, axis=1)
            slack = (v.shape[1] + 8) * 2.0**-23 * long[np.isfinite(long)].max(initial=0.0) + 10.0 ** (1 - PLACES)
            step = max(1, TILE // len(rows))
            for a in range(0, len(q), step):
                near = q32[a : a + step] @ v32.T
                least = floor[a : a + step] - slack
                if len(rows) > k and np.isneginf(least).any():
                    kth = np.partition(np.where(np.isnan(near), -np.inf, near), len(rows) - k, axis=1)[:, len(rows) - k]
                    least = np.maximum(least, kth - 2 * slack)
                x, y = np.nonzero(near >= least[:, None])
                if not len(x):
                    continue
                x += a
                exact = np.concatenate([np.einsum("ij,ij->i", q[x[i : i + 65_536]], v[y[i : i + 65_536]]) for i in range(0, len(x), 65_536)])
                exact = np.round(exact, PLACES)
                good = exact >= floor[x]
                x, y, exact = x[good], y[good], exact[good]
                old = np.unique(x)
                before, place = np.nonzero(score[old] > -np.inf)
                query, r, e = best_of(np.append(old[before], x), np.append(row[old[before], place], rows[y]), np.append(score[old[before], place], exact), k)
                first = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
                place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
                row[query, place], score[query, place] = r, e
        query, place = np.nonzero(score > -np.inf)
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(row[query, place]), pa.array(score[query, place])], names=["query_id", "row_id", "score"])
        forget(ids, matrix)

    return run


def query_blocks(queries: DataFrame, block: int = BROADCAST_VALUES):
    """(ids, matrix of unit vectors), broadcast, of the queries, of at most about ``block`` numbers each, with the number
    of queries, their dimension, and how many blocks there are about.

    Queries of norm zero, and null ones, are left out; all are of one dimension.
    """
    import numpy as np

    sc = queries.sparkSession.sparkContext
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("vector")).alias("v")).where("v is not null and query_id is not null")
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    passes = max(1, -(-size.n * (size.dim or 0) // block))
    for i in range(passes if size.n else 0):
        got = q.where(F.pmod(F.hash("query_id"), F.lit(passes)) == i).toArrow()
        if n := got.num_rows:
            flat = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            dim = len(flat) // n
            yield sc.broadcast(got.column("query_id").to_numpy()), sc.broadcast(np.ascontiguousarray(flat).reshape(n, dim)), n, dim, passes


#: A corpus between these many bytes, the latter for each core, is spread over all cores before it meets many queries: its
#: few files would make few tasks.  Beyond, its files make enough.
SPREAD_BYTES, SPREAD_CORE_BYTES, MANY_QUERIES = 2 << 20, 16 << 20, 256


def _spread(base: DataFrame, queries: int) -> DataFrame:
    cores = base.sparkSession.sparkContext.defaultParallelism
    size = int(str(base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return base.repartition(cores, "row_id") if queries >= MANY_QUERIES and SPREAD_BYTES <= size <= cores * SPREAD_CORE_BYTES else base


def exact_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, block: int = BROADCAST_VALUES) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of greatest dot product with each normalised query.

    corpus: (row_id, embedding), or as int8 vectors are stored (row_id, scale, q), queries: (query_id, vector), of one
    dimension.  Stored vectors are taken to be unit and are never divided by their norm.  Ties go to the lesser row_id.
    Queries of norm zero have no rows.
    """
    if k <= 0:
        raise InvalidK(k)
    form = ["embedding"] if "embedding" in corpus.columns else ["scale", "q"]
    base = corpus.select(F.col("row_id").cast("long").alias("row_id"), *form).where(" and ".join(f"{c} is not null" for c in ("row_id", *form)))
    out = None
    for ids, matrix, n, dim, passes in query_blocks(queries, block):
        if out is None and passes > 1:  # else each pass would make the corpus anew
            base = written(base, "searched")
        same = _spread(base.where(F.size(form[-1]) == dim), n)
        part = same.mapInArrow(_top(ids, matrix, k), "query_id long, row_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.select(F.lit(0).cast("long").alias("query_id"), "row_id", F.lit(0.0).alias("score")).where("false")
    return ranked(out, k)


def rerank(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, row_id) by exact score; what proposed them leaves no trace."""
    q = queries.select("query_id", unit(F.col("vector")).alias("__q"))
    rows = candidates.select("query_id", "row_id").distinct().join(corpus.select("row_id", "embedding"), "row_id").join(q, "query_id")
    return ranked(rows.select("query_id", "row_id", F.round(dot(F.col("__q"), F.col("embedding")), PLACES).alias("score")), k)


def envelope(hits: DataFrame, queries: DataFrame, rows: int, k: int, index_type: str, recall: float | None, elapsed_ms: float = 0.0) -> DataFrame:
    """One row a query about its result; recall is null where it isn't known.  truncated says whether k is below the corpus' size."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("__n"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id",
        F.lit(float(elapsed_ms)).alias("query_time_ms"),
        F.lit(index_type).alias("index_type"),
        F.lit(recall).cast("float").alias("recall"),
        F.lit(k < rows).alias("truncated"),
        F.lit(k).alias("k_requested"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("k_returned"),
    )


def materialize_hits(hits: DataFrame, chunks: DataFrame, model: str, index_type: str, reranked: bool, file_hash: str | Column, content_hash: str | Column) -> DataFrame:
    """The twelve columns of a hit, with query_id and rank: where it came from and how to cite it."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return hits.join(chunks.select("row_id", "chunk_id", "source_uri", "byte_start", "byte_end"), "row_id").select(
        "query_id", "rank", "chunk_id", F.col("score").cast("float").alias("score"), F.lit("cosine").alias("score_type"), "source_uri",
        F.col("byte_start").alias("offset_start"), F.col("byte_end").alias("offset_end"), F.lit(model).alias("embedding_model"), F.lit(index_type).alias("index_type"),
        F.lit(reranked).alias("reranked"), lit(file_hash).alias("file_hash"), lit(content_hash).alias("content_hash"), citation_id(lit(content_hash), F.col("chunk_id")).alias("citation_id"),
    )
