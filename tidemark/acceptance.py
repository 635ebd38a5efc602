"""The acceptance harness: every preset built from one corpus, measured against exact search, and gated."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .corpus import Corpus, build
from .functions.vector import perturb
from .operators.evaluate import recall_at_k, score_drift

MEASURES = (
    "preset string, is_baseline boolean, size_mb double, size_ratio double, build_s double, recall_at_k double, drift_max double, drift_mean double, "
    "p50_ms double, p95_ms double, p99_ms double, dtype string, has_ann boolean, has_bm25 boolean, search_mode string, file_hash string, content_hash string"
)


def metrics_json(measured: DataFrame) -> str:
    """Rows of MEASURES as one JSON document by preset, keys sorted, floats to six places: equal results give equal text."""
    rows = {r.preset: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "preset"} for r in measured.collect()}
    return json.dumps(rows, indent=2, sort_keys=True) + "\n"


def read_metrics(spark: SparkSession, text: str) -> DataFrame:
    """Rows of MEASURES from such a document."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    rows = [tuple({"preset": preset, **values}.get(n) for n in names) for preset, values in json.loads(text).items()]
    return spark.createDataFrame(rows, MEASURES)


def sample_queries(corpus: Corpus, n: int, seed: int = 0) -> DataFrame:
    """n queries near rows of the corpus, in the order of a hash of seed and row: (query_id, vector, text)."""
    from pyspark.sql import Window

    chosen = corpus.vectors.withColumn("h", F.xxhash64(F.lit(seed), "row_id")).orderBy("h", "row_id").limit(n)
    rows = chosen.join(corpus.chunks.select("row_id", "canonical_text"), "row_id")
    # the sample is small: numbering it in one task is meant
    numbered = rows.withColumn("query_id", F.row_number().over(Window.orderBy("h", "row_id")) - 1)
    return numbered.select(F.col("query_id").cast("long").alias("query_id"), perturb(F.col("embedding"), F.col("query_id")).alias("vector"), F.left("canonical_text", F.lit(200)).alias("text"))


def _search(corpus: Corpus, queries: DataFrame, k: int, mode: str) -> DataFrame:
    if mode == "hybrid":
        return corpus.search_hybrid(queries, k=k)
    return corpus.search_ann(queries, k) if mode == "ann" else corpus.search(queries, k)


def _measure(corpus: Corpus, queries: DataFrame, k: int, mode: str, repeats: int) -> tuple[DataFrame, list[float]]:
    """(hits with row_id, milliseconds a query of each repeated batch)."""
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        hits = storage.written(_search(corpus, queries, k, mode), "hits")
        times.append(1000 * (time.perf_counter() - began) / max(1, queries.count()))
    return hits.join(corpus.chunks.select("row_id", "chunk_id"), "chunk_id"), sorted(times)


def measure_presets(baseline: Corpus, folder: str, n_queries: int = 50, k: int = 10, seed: int = 0, variants: Iterable[str] = ("compressed", "tiny", "hybrid"), repeats: int = 3) -> DataFrame:
    """A row of MEASURES for the baseline and each preset, rebuilt from the baseline's chunks under ``folder``.

    Latencies are of whole batches, by query: single jobs would measure the scheduler.
    """
    spark, m = baseline.spark, baseline.manifest
    queries = storage.written(sample_queries(baseline, n_queries, seed), "queries")
    chunks = baseline.chunks.join(baseline.vectors, "row_id").drop("chunk_id")
    exact, times = _measure(baseline, queries, k, "exact", repeats)
    at = lambda t, p: t[min(len(t) - 1, round((len(t) - 1) * p))]
    size = baseline.size()

    def row(name: str, c: Corpus, own: int, seconds: float, recall: float, most: float, mean: float, t: list[float], mode: str):
        return name, name == "exact", own / 1e6, own / size, seconds, recall, most, mean, at(t, 0.5), at(t, 0.95), at(t, 0.99), c.dtype, c.has_ann, c.has_bm25, mode, c.file_hash, c.content_hash

    out = [row("exact", baseline, size, 0.0, 1.0, 0.0, 0.0, times, "exact")]
    for name in variants:
        began = time.perf_counter()
        c = build(
            chunks, f"{folder}/{name}", embedding_model=m.embedding_model, embedding_dim=m.embedding_dim, chunker_version=m.chunker_version,
            model_hash=m.model_hash, preset=name, provenance=baseline.provenance,
        )
        seconds = time.perf_counter() - began
        mode = "hybrid" if name == "hybrid" else "ann" if c.has_ann else "exact"
        hits, times = _measure(c, queries, k, mode, repeats)
        recall = recall_at_k(hits, exact, k).agg(F.avg("recall")).first()[0]
        drift = score_drift(hits, exact).agg(F.max("drift").alias("most"), F.avg("drift").alias("mean")).first()
        out.append(row(name, c, c.size(), seconds, float(recall or 0), float(drift.most or 0), float(drift["mean"] or 0), times, mode))
    return spark.createDataFrame(out, MEASURES)
