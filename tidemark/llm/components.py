"""Connected components of an undirected graph, as DataFrame joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, materialize

#: Up to so many edges, one task finds the components by union-find; above, label passing over shuffles does.
LOCAL_EDGES = 4_000_000


def labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, which maps each node to one of its component, once the edges (a, b) have joined some."""
    label = label.copy()
    while True:  # hook larger roots below smaller ones, then compress
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def _union_find(batches):
    import pyarrow as pa

    lean_memory()
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got))
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = labels(np.arange(len(ids)), flat[: len(a)], flat[len(a) :])
    for i in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[label[i : i + 100_000]])], names=["id", "component"])


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every vertex of edges (a, b); component is the least id reached.

    Self loops and repeated edges are allowed; an empty graph gives an empty result.
    Above local_edges edges it alternates large-star and small-star steps (Kiveris et al. 2014),
    each written to the shared folder, until nothing changes.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = materialize(e.distinct(), "edges")
    if e.count() <= local_edges:
        return e.coalesce(1).mapInArrow(_union_find, "id long, component long")
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
        new = materialize(small.select("x.a", "x.b").where("a <> b").distinct(), "edges")
        if new.exceptAll(e.where("a <> b")).isEmpty() and e.where("a <> b").exceptAll(new).isEmpty():
            break
        e = new
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).select(F.col("id").cast("long").alias("id")).distinct()
    return vertices.join(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
