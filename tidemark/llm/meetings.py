"""Candidates of hashed buckets, and the groups they form, compared in tasks of bounded size.

Rows that share a bucket's key are candidates.  A short sketch of each row, carried beside its id, parts most of
those that share a key by chance: what is left are edges that span each bucket's similar rows, never all its pairs.
The edges' connected components are then compared exactly, each row's payload moving once.  Buckets and components
too large for a task are cut into blocks, every two of which meet in some task; small ones share tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, materialize, sized
from .components import connected_components, labels

#: Rows of buckets in a task, about; a larger bucket is cut into blocks of half as many.
BUCKET = 8192
#: Keys of shared buckets that are broadcast, at most; beyond, the join shuffles.
BROADCAST_KEYS = 400_000

#: Tasks of small components hold this part of the most that a task may compare, about.
SHARE = 8

LINKS = "id long, digest binary, other long, links long"


def _cells(block: Column, blocks: Column) -> Column:
    """The cells (i, j), i <= j, of a row's block; (0, 0) where there are no blocks."""
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    many = F.transform(F.sequence(F.lit(1), blocks), lambda k: cell(F.least(k, block + 1), F.greatest(k, block + 1)))
    return F.when(blocks == 1, F.array(cell(F.lit(0), F.lit(0)))).otherwise(many)


def _spread(rows: DataFrame, group: str, limit: float, parts: int) -> DataFrame:
    """rows, of (group, id, weight of the group, ...), with the task (part, i, j) and the block of each."""
    blocks = F.when(F.col("weight") <= limit, 1).otherwise(F.ceil(2 * F.col("weight") / limit)).cast("int")
    part = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(parts))).otherwise(F.col(group))
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.withColumn("cell", F.explode(_cells(F.col("block"), F.col("blocks")))).withColumn("part", part).withColumns({"i": F.col("cell.i"), "j": F.col("cell.j")}).drop("weight", "blocks", "cell")


def _span(similar: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Edges that join the rows of each bucket which similar sketches connect."""

    def run(key, rows):
        import pyarrow as pa

        lean_memory()
        crossed = key[1].as_py() != key[2].as_py()
        h, ids, block = (rows.column(c).to_numpy() for c in ("h", "id", "block"))
        order = np.lexsort((ids, h))
        h, ids, block = h[order], ids[order], block[order]
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        end = np.repeat(np.append(edge[1:], len(h)), np.diff(np.append(edge, len(h))))
        label, left, step = np.arange(len(h)), np.arange(len(h)), 1
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(left):
            left = left[left + step < end[left]]
            p, q = left, left + step
            fresh = label[p] != label[q]
            if crossed:
                fresh &= block[p] != block[q]
            p, q = p[fresh], q[fresh]
            near = similar(sketch[p], sketch[q])
            p, q = p[near], q[near]
            if len(p):
                out_a.append(ids[p])
                out_b.append(ids[q])
                label = labels(label, p, q)
            step += 1
        return pa.table([np.concatenate(out_a), np.concatenate(out_b)], names=["a", "b"])

    return run


def candidate_groups(keyed: DataFrame, sketches: DataFrame, similar, bucket: int = BUCKET) -> DataFrame:
    """(id, component) of the ids that share a key with a similar one.

    keyed: (id, h), sketches: (id, sketch), all of one length; similar tells of two matrices of sketches, row by row,
    which are to stay candidates.
    """
    shared = materialize(keyed.groupBy("h").agg(F.count("*").alias("weight")).where("weight > 1"), "keys")
    total = shared.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    met = keyed.join(sized(shared, BROADCAST_KEYS), "h").join(sketches, "id")
    tasks = _spread(met, "h", bucket, max(1, -(-int(total) // bucket)))
    edges = tasks.groupBy("part", "i", "j").applyInArrow(_span(similar), "a long, b long")
    return connected_components(edges.where("a <> b"))


def _picked(batches: list, begins: np.ndarray, at: np.ndarray):
    """The rows at these places of a table of batches, each of which begins at its place in begins, in their order."""
    import pyarrow as pa

    part = np.searchsorted(begins, at, side="right") - 1
    own = [(i, np.flatnonzero(part == i)) for i in np.unique(part).tolist()]
    rows = pa.Table.from_batches([batches[i].take(pa.array(at[x] - begins[i])) for i, x in own])
    if len(own) == 1:
        return rows
    back = np.empty(len(at), np.int64)
    back[np.concatenate([x for _, x in own])] = np.arange(len(at))
    return rows.combine_chunks().take(pa.array(back))


def _compare(hits, emit: str):
    """hits(rows of one component, still_apart) gives the pairs found in it as indexes and scores."""

    def run(key, rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        lean_memory()
        crossed = key[1].as_py() != key[2].as_py()
        # what hits reads is large: only a component's rows at a time are put in order
        order = pc.sort_indices(rows.select(["component", "id", "digest"]), sort_keys=[("component", "ascending"), ("id", "ascending"), ("digest", "ascending")]).to_numpy().astype(np.int64)
        component, ids, block = (rows.column(c).to_numpy()[order] for c in ("component", "id", "block"))
        digest = rows.column("digest").take(pa.array(order))
        twice = np.flatnonzero((ids[1:] == ids[:-1]) & (component[1:] == component[:-1]))
        if len(twice):  # rows that repeat an id, sorted by digest, too: one of each digest counts
            keep = np.ones(len(ids), dtype=bool)
            keep[twice + 1] = [digest[i].as_py() != digest[i + 1].as_py() for i in twice.tolist()]
            order, digest = order[keep], digest.filter(pa.array(keep))
            component, ids, block = component[keep], ids[keep], block[keep]
        batches = rows.to_batches()
        begins = np.cumsum([0, *map(len, batches)])
        edge = np.append(np.flatnonzero(np.append(True, component[1:] != component[:-1])), len(ids))
        found: list[list[np.ndarray]] = [[], [], [], []]
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own, side = ids[a:z], block[a:z]
            for p, q, score in hits(_picked(batches, begins, order[a:z])):
                fine = own[p] != own[q]
                if crossed:
                    fine &= side[p] != side[q]
                p, q, score = p[fine], q[fine], score[fine]
                if emit == "pairs":
                    new = own[p], own[q], score
                else:
                    links = np.bincount(p, minlength=z - a) + np.bincount(q, minlength=z - a)
                    root, at = labels(np.arange(z - a), p, q), np.flatnonzero(links)
                    new = own[at], own[root[at]], links[at], a + at
                for column, values in zip(found, new):
                    column.append(values)
        cols = [np.concatenate([np.empty(0, k), *x]).astype(k) for x, k in zip(found, (np.int64, np.int64, np.float64 if emit == "pairs" else np.int64, np.int64))]
        if emit == "pairs":
            return pa.table(cols[:3], names=["id", "other", "score"])
        return pa.table([cols[0], digest.take(pa.array(cols[3])), cols[1], cols[2]], names=["id", "digest", "other", "links"])

    return run


def placed(groups: DataFrame, limit: float) -> tuple[DataFrame, int]:
    """groups, of (id, component, own weight as size, ...), with the weight of each component; how many tasks the small
    ones share, which are of a SHARE of the limit: many of them may meet in one by chance."""
    weights = groups.groupBy("component").agg(F.sum("size").alias("weight"))
    chosen = materialize(groups.join(weights, "component"), "groups")
    total = chosen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return chosen.drop("size"), max(1, -(-int(total) * SHARE // int(limit)))


def compare_groups(payload: DataFrame, limit: float, parts: int, hits, emit: str) -> DataFrame:
    """Pairs (id, other, score), or for each row and task (id, digest, other, links), of the rows of a component that hits finds.

    payload: (id, component, weight, ...) with what hits reads.  Links are to be summed over an id's rows, and the
    edges (id, other) join all that are linked.
    """
    tasks = _spread(payload, "component", limit, parts)
    return tasks.groupBy("part", "i", "j").applyInArrow(_compare(hits, emit), "id long, other long, score double" if emit == "pairs" else LINKS)


def class_rows(rows: DataFrame, copies: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(name, class_id, copies, links) of rows (id, digest), given the folded (digest, rep, copies) and what
    compare_groups found."""
    classes = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id", "digest").agg(F.sum("links").alias("links"))
    known = materialize(links.join(classes, "id").select("digest", "links", "component"), "classes")
    own = rows.join(sized(copies), "digest", "left").join(sized(known), "digest", "left")
    return own.groupBy(F.col("id").alias(name)).agg(
        F.min(F.coalesce("component", "rep", "id")).alias("class_id"), F.sum(F.coalesce("copies", F.lit(1))).cast("long").alias("copies"), F.sum(F.coalesce("links", F.lit(0))).cast("long").alias("links")
    )
