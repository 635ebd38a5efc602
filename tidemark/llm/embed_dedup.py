"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised, so a cosine of t is a distance of sqrt(2 - 2t).  A table's key is K random
Gaussian projections, shifted and quantised to a width; L tables are drawn.  K follows the number of rows
so that unrelated vectors rarely share a key, and L follows K so that a pair exactly at the threshold
shares a key in some table with the target probability.  Only ids, keys and 128 sign bits go through the tables;
the bits drop most of those that meet by chance.  Groups of candidates are then compared by exact cosines, each
vector moving once.  Equal vectors are folded before: the one of least id stands for them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized
from .meetings import candidate_groups, class_rows, compare_groups, placed

THRESHOLD = 0.95
RECALL = 0.95
#: Quantisation width, as a multiple of the distance at the threshold.
WIDTH = 4.0
#: Most vectors compared in one task; a larger group is cut into blocks of half as many.
BLOCK = 4096
#: Sign bits of a sketch, and how many deviations beyond the expected ones may differ: a pair at the threshold is
#: lost to the sketch with a probability below one in a million.
SIGNS, DEVIATIONS = 128, 5.0


def collide(ratio: float) -> float:
    """Probability that two vectors share a projection's cell; ratio is the width over their distance."""
    if ratio <= 0:
        return 0.0
    below = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def choose_tables(rows: int, threshold: float, recall: float, width: float = WIDTH) -> tuple[int, int, float]:
    """(projections a key, tables, width of a cell)."""
    near = math.sqrt(max(1e-9, 2 - 2 * threshold))
    cell = width * near
    far, close = collide(cell / math.sqrt(2)), collide(width)
    k = max(4, math.ceil(math.log(max(rows, 2)) / math.log(1 / far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - close**k))), cell


def _projections(dim: int, k: int, tables: int, cell: float):
    import numpy as np

    rng = np.random.default_rng(20_000 + dim)
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, cell, k * tables)


def table_keys(unit, k: int, tables: int, cell: float):
    """(rows, tables) 64-bit keys of unit vectors."""
    import numpy as np

    from .common import mix64

    a, b = _projections(unit.shape[1], k, tables, cell)
    # float64 products in fixed blocks of rows may differ in the last bit between shapes: keys are computed once only
    q = np.floor((unit @ a + b) / cell).astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    with np.errstate(over="ignore"):
        h = np.full((len(unit), tables), np.uint64(unit.shape[1]))
        for i in range(k):
            h = mix64(h * np.uint64(31) + q[:, :, i] + np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def most_signs(threshold: float) -> int:
    """How many sign bits may differ: their expected number at the threshold and DEVIATIONS deviations more."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(SIGNS * p + DEVIATIONS * math.sqrt(SIGNS * p * (1 - p)))


def _similar(threshold: float):
    most = most_signs(threshold)

    def similar(a, b):
        import numpy as np

        return np.bitwise_count(a ^ b).sum(axis=1) <= most

    return similar


def _units(b):
    """For each length of vectors in the batch: (rows of it that have a direction, their unit vectors, digests)."""
    import numpy as np
    from xxhash import xxh3_128_digest

    vectors = b.column(1)
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        v = flat[offsets[rows][:, None] + np.arange(dim)]
        norm = np.sqrt((v * v).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        rows, v = rows[fine], v[fine]
        if len(rows):
            yield rows, v / norm[fine][:, None], [xxh3_128_digest(x) for x in v]


def _hash(k: int, tables: int, cell: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import list_array

        for b in batches:
            for rows, unit, digest in _units(b):
                keys = table_keys(unit, k, tables, cell)
                signs = np.packbits(unit @ np.random.default_rng(70_000 + unit.shape[1]).standard_normal((unit.shape[1], SIGNS)) > 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)), pa.array(digest, pa.binary()), list_array(keys.ravel(), np.full(len(rows), tables), pa.int64()),
                        pa.array([x.tobytes() for x in signs], pa.binary()),
                    ],
                    names=["id", "digest", "keys", "sketch"],
                )

    return run


def _own(batches):
    """The rows of (id, v, digest, component, weight) whose vector has that digest."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for rows, _, digest in _units(b):
            want = b.column(2).take(pa.array(rows)).to_pylist()
            yield b.take(pa.array(rows[np.array([x == y for x, y in zip(digest, want)], dtype=bool)]))


def _cosines(threshold: float, step: int = 1024):
    def hits(rows):
        import numpy as np

        lists = rows.column("v").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy()
        first = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            v = flat[first[own][:, None] + np.arange(dim)]
            unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
            for a in range(0, len(own), step):
                for c in range(a, len(own), step):
                    cos = unit[a : a + step] @ unit[c : c + step].T
                    x, y = np.nonzero(cos >= threshold)
                    up = x + a < y + c
                    yield own[x[up] + a], own[y[up] + c], cos[x[up], y[up]]

    return hits


def _folded(vectors: DataFrame, threshold: float, recall: float):
    """(vectors with an id, (id, digest) of those with a direction, copies by digest, candidates' groups)."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)")
    k, tables, cell = choose_tables(base.count(), threshold, recall)
    hashed = materialize(base.mapInArrow(_hash(k, tables, cell), "id long, digest binary, keys array<long>, sketch binary"), "vectors")
    copies = materialize(hashed.groupBy("digest").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies")).where("copies > 1"), "copies")
    reps = hashed.join(sized(copies), "digest", "left").where("rep is null or rep = id").select("id", "digest", "keys", "sketch")
    keyed = reps.select("id", F.explode("keys").alias("h"))
    groups = candidate_groups(keyed, reps.select("id", "sketch"), _similar(threshold))
    groups = groups.join(reps.select("id", "digest"), "id").distinct().withColumn("size", F.lit(1))
    return base, hashed.select("id", "digest"), copies, groups


def _compared(base: DataFrame, groups: DataFrame, threshold: float, block: int, emit: str) -> DataFrame:
    chosen, parts = placed(groups, block)
    kind = base.schema["v"].dataType.simpleString()
    own = base.join(sized(chosen), "id").select("id", "v", "digest", "component", "weight")
    payload = own.mapInArrow(_own, f"id long, v {kind}, digest binary, component long, weight long")
    return compare_groups(payload, block, parts, _cosines(threshold), emit)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Pairs (vec_a, vec_b, cosine), vec_a < vec_b, of vectors with a cosine of at least threshold.

    Equal vectors are pairs with the least id among them, and only that one is paired further.  For the rest see
    near_duplicate_classes, which doesn't list pairs.
    """
    base, hashed, copies, groups = _folded(vectors, threshold, recall)
    near = _compared(base, groups, threshold, block, "pairs").select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b"), F.col("score").alias("cosine"))
    same = hashed.join(sized(copies), "digest").where("id <> rep").select(F.col("rep").alias("vec_a"), F.col("id").alias("vec_b"), F.lit(1.0).alias("cosine"))
    return near.union(same.distinct())


def near_duplicate_classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, copies, links), a row an id, of the rows of (vec_id, embedding).

    Vectors with a cosine of at least threshold are linked, and class_id is the least id that links lead to.  copies
    is how many ids have this very vector, links how many other vectors are linked to it.  Each link is
    verified; one at the threshold is found with probability recall, closer ones more surely, and more than these
    wherever others join the two.  A vector without links is a class of its own.

    Rows with a null id or vector, a null, NaN or infinite element, or a zero norm are left out; vectors of
    different lengths are never linked.  An id that repeats with one vector counts once; with several, its links and
    copies are added up and its class is the least of theirs; it is never linked with itself.  An empty table
    gives no rows.  Other columns are ignored.
    """
    base, hashed, copies, groups = _folded(vectors, threshold, recall)
    found = materialize(_compared(base, groups, threshold, block, "links"), "links")
    return class_rows(hashed.distinct(), copies, found, "vec_id")


#: What is added to each id, and how far its vector is perturbed.
COPIES = ((0, 0.0), (1_000_000_000, 0.0), (2_000_000_000, 0.01), (3_000_000_000, 0.015), (4_000_000_000, 0.02))


def with_copies(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of each row, an equal copy and three near ones, under other ids."""
    out = None
    for shift, by in COPIES:
        moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.lit(by) * (((F.col("vec_id") * 7 + i * 13 + shift // 1_000_000_000 * 5) % 11 - 5) / 5))
        part = vectors.select((F.col("vec_id").cast("long") + shift).alias("vec_id"), moved.alias("embedding"))
        out = part if out is None else out.unionAll(part)
    return out


def _oracle(source: str) -> str:
    return f"""
WITH RECURSIVE
  source AS ({source}),
  v AS (SELECT min(vec_id) AS rep, count(*) AS copies, embedding AS e FROM source GROUP BY embedding),
  l AS (SELECT a.rep AS a, b.rep AS b FROM v a JOIN v b ON a.rep <> b.rep AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
  reach(a, b) AS (SELECT rep, rep FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
  c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
  n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT s.vec_id, c.class_id, v.copies, coalesce(n.links, 0) AS links
FROM source s JOIN v ON s.embedding = v.e JOIN c ON c.a = v.rep LEFT JOIN n ON n.a = v.rep"""


ORACLE = _oracle("SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings")

COPIES_ORACLE = _oracle(
    " UNION ALL ".join(
        f"SELECT vec_id + {shift} AS vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + {by}::DOUBLE * (((vec_id * 7 + (i - 1) * 13 + {shift // 1_000_000_000 * 5}) % 11 - 5) / 5.0::DOUBLE)) AS embedding FROM embeddings"
        for shift, by in COPIES
    )
)
