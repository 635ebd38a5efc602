"""Exact search over a stream of queries: stateless, each micro-batch is one batch search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.search import exact_topk


def search_stream(queries: DataFrame, corpus: DataFrame, k: int, sink: str) -> DataStreamWriter:
    """A writer, to be started, that appends (query_id, row_id, score, rank, batch_id) of each micro-batch of
    (query_id, vector) to ``sink``, a folder of Parquet with a subfolder a batch.

    Each batch reads the corpus anew and counts its queries first; a corpus that fits the executors' memory is better
    given cached (corpus.persist()), as then only the queries are new to a batch.
    A batch that is retried overwrites what it had written, so each query's result is there once.
    """
    from pyspark.sql import functions as F

    def one(batch: DataFrame, number: int) -> None:
        found = exact_topk(corpus, batch, k).withColumn("batch_id", F.lit(number))
        found.write.mode("overwrite").parquet(f"{sink}/part={number}")

    return queries.writeStream.foreachBatch(one)
