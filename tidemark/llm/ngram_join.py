"""N-gram Jaccard join by MinHash banding.

Every text becomes the set of its word n-grams.  MinHash signatures are cut into bands; texts that
share a band's hash are candidates, and each candidate is verified on the full n-gram sets, so what is
returned is exact and only recall depends on the banding, which is chosen for a target recall.

Texts of equal n-gram sets are folded before banding: the one of least doc_id stands for them, which keeps
thousands of copies linear.  Bands carry ids only, and where they meet half a byte of each of the signature's
hashes, whose agreement drops most of the texts that share a band by chance.  Groups of candidates are compared
on full sets, each set moving once; groups too large for one task are cut into blocks, every two of which meet.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, drop_ids, materialize, sized
from .components import labels
from .meetings import candidate_groups, class_rows, compare_groups, placed

NGRAM = 3
THRESHOLD = 0.55
RECALL = 0.95
#: Most hashes in a signature.
SIGNATURE = 128
#: Most n-grams compared in one task; a larger group is cut into blocks of half as many.
BLOCK = 4_000_000
#: How many deviations beyond the expected number of a signature's hashes may differ: a pair at the threshold is lost
#: to this with a probability below one in a million.
DEVIATIONS = 5.0
#: Most numbers of a dense table of texts by n-grams.
DENSE = 32_000_000


def choose_bands(threshold: float, recall: float, hashes: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, hence the fewest false candidates, at which a pair
    exactly at the threshold still shares a band with probability recall."""
    best = None
    for rows in range(1, hashes + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if 0 < miss < 1 else 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{hashes} hashes can't find a similarity of {threshold} with a recall of {recall}")
    return best


def _sign(bands: int, rows: int, n: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        from .common import SLICE_BYTES, SMALL, TextChunk, chunked, lean_memory, list_array, mix64, text_slices

        lean_memory()
        seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        fold = mix64(np.arange(7, rows + 7, dtype=np.uint64)) | np.uint64(1)
        band = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for b in batches:
            ids, digest, count, keys, sketch = b.column(0), [], [], [], []
            for texts in (held[a:z] for _, held in text_slices(b.column(1), SLICE_BYTES) for a, z in chunked(held, SMALL)):
                for grams in TextChunk(texts).gram_sets(n):
                    count.append(len(grams))
                    digest.append(xxh3_128_digest(grams))
                    if not len(grams):
                        sketch.append(b"")
                        continue
                    sig = np.full(len(seeds), ~np.uint64(0))
                    for i in range(0, len(grams), 2048):
                        np.minimum(sig, (seeds[:, None] * grams[None, i : i + 2048]).min(axis=1), out=sig)
                    sig = mix64(sig)
                    half = np.append(sig & np.uint64(15), np.zeros(len(sig) % 2, np.uint64)).astype(np.uint8)
                    sketch.append((half[::2] | half[1::2] << 4).tobytes())
                    with np.errstate(over="ignore"):
                        keys.append(mix64((sig.reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64) + band))
            sizes = np.array(count, dtype=np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(digest, pa.binary()), pa.array(sizes), list_array(flat, np.where(sizes > 0, bands, 0), pa.int64()), pa.array(sketch, pa.binary())],
                names=["doc_id", "digest", "n_grams", "bands", "sketch"],
            )

    return run


def _similar(threshold: float, hashes: int):
    """Whether so few half bytes differ that the similarity may be the threshold."""
    p = (1 - threshold) * 15 / 16
    most = math.ceil(hashes * p + DEVIATIONS * math.sqrt(hashes * p * (1 - p)))

    def similar(a, b):
        import numpy as np

        x = a ^ b
        return ((x & 15) > 0).sum(axis=1, dtype=np.int64) + (x > 15).sum(axis=1, dtype=np.int64) <= most

    return similar


def _gram_sets(n: int):
    """The n-gram sets of the rows of (id, text, digest, component, weight) whose set has that digest."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        from .common import SLICE_BYTES, SMALL, TextChunk, chunked, lean_memory, list_array, text_slices

        lean_memory()
        for b in batches:
            digests = b.column(2).to_pylist()
            rest = b.select(["id", "digest", "component", "weight"])
            for first, texts in text_slices(b.column(1), SLICE_BYTES):
                sets, at = [], []
                for a, z in chunked(texts, SMALL):
                    for i, grams in enumerate(TextChunk(texts[a:z]).gram_sets(n), first + a):
                        if xxh3_128_digest(grams) == digests[i]:
                            sets.append(grams)
                            at.append(i)
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                own = rest.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, list_array(flat, sizes, pa.int64())], names=["id", "digest", "component", "weight", "grams"])

    return run


def numbered(grams):
    """(the number of each gram, how many kinds there are), in a fraction of the memory that sorting their places takes."""
    import numpy as np

    from .common import find

    kinds = np.sort(grams)
    kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)]]
    return (find(kinds, grams).astype(np.int32) if len(grams) else np.empty(0, np.int32)), len(kinds)


def shared_counts(offsets, gram, kinds: int, apart=None):
    """(first row, counts of shared n-grams with all rows) of blocks of rows, by whichever is cheaper: products of a
    dense table, or a walk over each n-gram's rows.  apart(x) tells whether row x still has to be compared."""
    import numpy as np

    rows, sizes = len(offsets) - 1, np.diff(offsets)
    width = np.bincount(gram, minlength=kinds)
    often = width > 1
    column = np.cumsum(often) - 1
    keep = often[gram]
    gram, owner, width = column[gram[keep]].astype(np.int32), np.repeat(np.arange(rows, dtype=np.int32), sizes)[keep], width[often]
    del keep, often, column
    walk = int((width.astype(np.int64) ** 2).sum())
    if rows * len(width) <= DENSE and rows * rows * len(width) < 50 * walk:
        table = np.zeros((rows, len(width)), np.float32)
        table[owner, gram] = 1
        step = max(1, 4_000_000 // max(1, rows))
        for a in range(0, rows, step):
            if apart is None or any(apart(x) for x in range(a, min(rows, a + step))):
                yield a, np.rint(table[a : a + step] @ table.T).astype(np.int64)
        return
    by_gram = np.argsort(gram, kind="stable")
    posting, ends = owner[by_gram], np.cumsum(width)
    begins = ends - width
    first = np.searchsorted(owner, np.arange(rows + 1))
    for x in range(rows):
        if apart is None or apart(x):
            own = gram[first[x] : first[x + 1]]
            lo, wide = begins[own], width[own]
            at = np.repeat(lo - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
            yield x, np.bincount(posting[at], minlength=rows)[None]


def _jaccard(threshold: float, span: bool):
    """All pairs of a component at or above the threshold; with span those only that join what is still apart."""

    def hits(rows):
        import numpy as np

        lists = rows.column("grams").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        offsets = np.append(0, np.cumsum(sizes))
        label = np.arange(len(sizes))
        apart = (lambda x: bool((label[x + 1 :] != label[x]).any())) if span else None
        for a, shared in shared_counts(offsets, *numbered(lists.flatten().to_numpy().view(np.uint64)), apart):
            x = np.arange(a, a + len(shared))
            good = shared >= threshold * (sizes[x][:, None] + sizes[None, :] - shared) - 1e-9
            p, q = np.nonzero(good)
            p = p + a
            up = p < q
            p, q = p[up], q[up]
            score = shared[p - a, q] / (sizes[p] + sizes[q] - shared[p - a, q])
            fine = score >= threshold
            p, q, score = p[fine], q[fine], score[fine]
            if span and len(p):
                label = labels(label, p, q)
            yield p, q, score

    return hits


def _folded(docs: DataFrame, n: int, threshold: float, recall: float):
    """(texts, (id, digest) of each, copies by digest, candidates' groups)."""
    bands, rows = choose_bands(threshold, recall)
    base = doc_text(docs)
    signed = materialize(base.mapInArrow(_sign(bands, rows, n), "doc_id long, digest binary, n_grams int, bands array<long>, sketch binary"), "signed")
    first = signed.where("n_grams > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"))
    copies = materialize(first.where("copies > 1"), "copies")
    reps = signed.where("n_grams > 0").join(sized(copies), "digest", "left").where("rep is null or rep = doc_id")
    reps = reps.select(F.col("doc_id").alias("id"), "digest", "n_grams", "bands", "sketch")
    groups = candidate_groups(reps.select("id", F.explode("bands").alias("h")), reps.select("id", "sketch"), _similar(threshold, bands * rows))
    groups = groups.join(reps.select("id", "digest", F.col("n_grams").alias("size")), "id").distinct()
    return base, signed.select(F.col("doc_id").alias("id"), "digest"), copies, groups


def _compared(base: DataFrame, groups: DataFrame, n: int, threshold: float, block: int, emit: str, span: bool = False) -> DataFrame:
    chosen, parts = placed(groups, block)
    texts = base.withColumnRenamed("doc_id", "id").join(sized(chosen), "id").select("id", "text", "digest", "component", "weight")
    payload = texts.mapInArrow(_gram_sets(n), "id long, digest binary, component long, weight long, grams array<long>")
    return compare_groups(payload, block, parts, _jaccard(threshold, span), emit)


def ngram_jaccard_join(
    docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """Pairs (doc_a, doc_b, jaccard), doc_a < doc_b, of documents whose word n-gram sets have a Jaccard
    similarity of at least threshold.

    A text with fewer than n words has one gram, all its words.  Texts with equal sets are given as
    pairs of similarity 1 with the least doc_id among them, and only that one is paired further: the
    pairs not listed follow from these.  Rows with a null doc_id or text, and texts without a word,
    pair with nothing.  Rows that repeat a doc_id count once if the sets are equal; otherwise any of
    them that matches makes the pair, and an id is never paired with itself.  Other columns are ignored.
    The pairs of a large group of near copies are many: ngram_classes lists none.
    """
    base, signed, copies, groups = _folded(docs, n, threshold, recall)
    near = _compared(base, groups, n, threshold, block, "pairs").groupBy(F.least("id", "other").alias("doc_a"), F.greatest("id", "other").alias("doc_b")).agg(F.max("score").alias("jaccard"))
    same = signed.join(sized(copies), "digest").where("id <> rep").select(F.col("rep").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.union(same.distinct())


def ngram_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copies, links), a row a document.

    Texts whose word n-gram sets have a Jaccard similarity of at least threshold are linked, and class_id is the least
    doc_id that links lead to, from text to text: two of one class need not be linked themselves.  copies is how many
    documents have this very set, links how many other sets are linked to it.  Each link is verified on full sets; one
    at the threshold is found with probability recall, closer ones more surely, and more than these wherever
    others join the two.  A document without links or copies is a class of its own.

    A text with fewer than n words has one gram, all its words; one without a word is linked with nothing, like no
    other, and has one copy.  Rows with a null doc_id or text are left out.  A doc_id that repeats with one text
    counts once; with several, their links and copies are added up and its class is the least of theirs; it is never
    linked with itself.  An empty table gives no rows.  Other columns are ignored.
    """
    return _classes(docs, n, threshold, recall, block, False)


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, block: int, span: bool) -> DataFrame:
    base, signed, copies, groups = _folded(docs, n, threshold, recall)
    found = materialize(_compared(base, groups, n, threshold, block, "links", span), "links")
    return class_rows(signed.distinct(), copies, found, "doc_id")


def near_duplicate_ids(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id) of the documents that go when one of each class, that of least doc_id, stays.

    Only as many links are looked for as join the classes.
    """
    return _classes(docs, n, threshold, recall, block, True).where("class_id <> doc_id").select("doc_id")


def keep_one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """One document of each class of near duplicates, that of least doc_id, with all columns.

    Classes are those of ngram_classes: a document goes if links lead from it, over others, to one that stays.
    Of rows equal in doc_id and text one stays.
    Rows with a null doc_id or text, and texts without a word, are in no group and stay.
    """
    gone = materialize(near_duplicate_ids(docs, **options), "near")
    kept = drop_ids(docs, gone)
    ids = docs.select(F.col("doc_id").alias("__id")).where("__id is not null")
    repeated = materialize(ids.groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1").select("__id"), "repeated")
    if repeated.isEmpty():
        return kept
    often = sized(repeated)
    once = kept.join(often, kept["doc_id"] == often["__id"], "left_anti")
    again = kept.join(often, kept["doc_id"] == often["__id"], "left_semi")
    null = again.where("text is null")
    return once.unionByName(null).unionByName(again.where("text is not null").dropDuplicates(["doc_id", "text"]))
