"""Recall, drift, latency and size of variants, and the gates on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_ranks


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) of every query of exact: shared rows over k, even where the corpus has fewer."""
    common = exact.select("query_id", "row_id").join(approx.select("query_id", "row_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "row_id"], "left")
    return common.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.lit(float(k))).alias("recall"))


def score_drift(variant: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, drift): how far the best scores of the two lie apart."""
    v = variant.where("rank = 1").select("query_id", F.col("score").alias("a"))
    return exact.where("rank = 1").select("query_id", F.col("score").alias("b")).join(v, "query_id").select("query_id", F.abs(F.col("a") - F.col("b")).alias("drift"))


def latency_summary(samples: DataFrame, value: str = "ms", ties: str = "even") -> DataFrame:
    """One row: mean and the nearest-rank 50th, 95th and 99th percentiles."""
    ranks = nearest_ranks(samples, value, {f"p{round(100 * p)}": (p, ties) for p in (0.5, 0.95, 0.99)})
    return samples.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(ranks))


#: (preset, measure, comparison, bound); the last bound is a multiple of the baseline's.
GATES = [
    ("compressed", "size_ratio", "<=", 0.40),
    ("tiny", "size_ratio", "<=", 0.30),
    ("tiny", "recall_at_k", ">=", 0.95),
    ("compressed", "recall_at_k", ">=", 0.9999),
    ("hybrid", "recall_at_k", ">=", 0.99),
    ("exact", "p95_ms", "<=x", 1.5),
]


def check_gates(baseline: DataFrame, post: DataFrame) -> DataFrame:
    """(preset, measure, value, bound, passed) of every gate; a preset that is missing fails."""
    spark = post.sparkSession
    gates = spark.createDataFrame(GATES, "preset string, measure string, op string, bound double")
    measures = ("size_ratio", "recall_at_k", "p95_ms")

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(name)) for m in measures))
        return df.select("preset", F.explode(pairs).alias("x")).select("preset", "x.measure", f"x.{name}")

    joined = gates.join(long(post, "value"), ["preset", "measure"], "left").join(long(baseline, "base"), ["preset", "measure"], "left")
    bound = F.when(F.col("op") == "<=x", F.col("bound") * F.col("base")).otherwise(F.col("bound"))
    fine = F.when(F.col("op") == ">=", F.col("value") >= bound).otherwise(F.col("value") <= bound)
    return joined.select("preset", "measure", "value", bound.alias("bound"), F.coalesce(fine, F.lit(False)).alias("passed"))
