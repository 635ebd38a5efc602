"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words with an error budget of k = floor(rate * m) word edits is split into k + 1
pieces.  If a document holds the item within k edits, at least one piece is there unchanged, so exact
piece hits (by rolling hash, in one pass over the text) find every candidate place.  Each is verified
with Myers' bit-parallel distance over words, semi-globally: the item against the best stretch of the
document around the hit.  Matching is on lower-cased runs of letters and digits.

The test items are broadcast in shards of bounded size; a benchmark of any size takes more passes.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, drop_ids, materialize, words

ERROR_RATE = 0.15
#: Most code points of test items that one pass broadcasts.
SHARD = 8_000_000

HITS = "doc_id long, item_id long, word_start long, word_end long, distance int"


def budget(m: int, rate: float) -> int:
    return int(m * rate)


def split_points(m: int, pieces: int) -> list[tuple[int, int]]:
    """Bounds of m words in so many near-equal pieces."""
    return [(i * m // pieces, (i + 1) * m // pieces) for i in range(pieces)]


def myers_search(pattern: list, text: list, k: int) -> list[tuple[int, int]]:
    """(end, distance) of every end in text of a stretch within k edits of pattern; symbols are any hashables.

    One bit of an integer a pattern symbol; Python's integers have as many bits as that takes.
    """
    m = len(pattern)
    peq: dict = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score <= k:
            out.append((j + 1, score))
    return out


def best_match(pattern: list, text: list, k: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the closest stretch of text within k edits: the least distance,
    then the earliest end, then the latest start."""
    ends = myers_search(pattern, text, k)
    if not ends:
        return None
    end, distance = min(ends, key=lambda x: (x[1], x[0]))
    back = myers_search(pattern[::-1], text[:end][::-1], distance)
    first = next((e for e, d in back if d == distance), end)
    return end - first, end, distance


class Items:
    """A shard of test items as hashes of their pieces: by piece length, sorted, with the places they come from."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        import numpy as np

        from .common import TextChunk

        self.ids, self.words, self.k = [], [], []
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        chunk = TextChunk([t for _, t in rows])
        for at, (item, _) in enumerate(rows):
            a, z = chunk.wfirst[at], chunk.wfirst[at + 1]
            if a == z:
                continue
            own, k = chunk.whash[a:z], budget(int(z - a), rate)
            me = len(self.ids)
            self.ids.append(item)
            self.words.append(own.tolist())
            self.k.append(k)
            for s, e in split_points(int(z - a), k + 1):
                found[e - s].append((int(a) + s, me, s))
        self.pieces = {}
        for length, places in found.items():
            grams = chunk.grams(length)[[p[0] for p in places]]
            order = np.argsort(grams, kind="stable")
            self.pieces[length] = (grams[order], np.array([p[1:] for p in places])[order])

    def search(self, chunk):
        """(text, item, start, end, distance) of each item's best match in each text of the chunk, in words of the text."""
        import numpy as np

        windows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for length, (keys, places) in self.pieces.items():
            grams = chunk.grams(length)
            lo = np.searchsorted(keys, grams)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == grams)
            if not len(hit):
                continue
            lo, hi = lo[hit], np.searchsorted(keys, grams[hit], side="right")
            text = np.searchsorted(chunk.wfirst, hit, side="right") - 1
            inside = hit + length <= chunk.wfirst[text + 1]
            for w, t, a, z in zip(hit[inside].tolist(), text[inside].tolist(), lo[inside].tolist(), hi[inside].tolist()):
                for me, s in places[a:z].tolist():
                    k, m = self.k[me], len(self.words[me])
                    windows[t, me].append((w - s - k, w - s + m + k))
        for (t, me), spans in windows.items():
            first, last = int(chunk.wfirst[t]), int(chunk.wfirst[t + 1])
            best = None
            merged: list[list[int]] = []
            for a, z in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(z, merged[-1][1])
                else:
                    merged.append([a, z])
            for a, z in merged:
                a, z = max(a, first), min(z, last)
                got = best_match(self.words[me], chunk.whash[a:z].tolist(), self.k[me])
                if got and (best is None or got[2] < best[2]):
                    best = (a - first + got[0], a - first + got[1], got[2])
            if best:
                yield t, self.ids[me], *best


def _search(rows, rate: float):
    def run(batches):
        import pyarrow as pa

        from .common import TextChunk, chunked

        items = Items(rows.value, rate)
        for b in batches:
            ids, texts, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for a, z in chunked(texts):
                out += [(ids[a + t], *x) for t, *x in items.search(TextChunk(texts[a:z]))]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.int32())],
                    names=["doc_id", "item_id", "word_start", "word_end", "distance"],
                )

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, word_start, word_end, distance): each document and each test item that it holds
    within floor(rate * words) word edits, at the item's best place.

    Items of few words thus have a budget of 0 and match as they are; items without a word, and null
    items, ids or texts, match nothing.  A row that repeats is matched as often as it stands there.
    Empty tables give no rows.  Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))
    base, found = doc_text(docs), None
    for i in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == i)
        rows = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part.distinct().toLocalIterator()))
        hits = base.mapInArrow(_search(rows, rate), HITS)
        found = hits if found is None else found.union(hits)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a test item; rows with a null id or text stay."""
    hits = materialize(benchmark_matches(docs, benchmark, **options).select("doc_id"), "leaks")
    return drop_ids(docs, hits)


def brute_force(text: str, item: str, rate: float = ERROR_RATE) -> int | None:
    """The least distance of item to any stretch of text by dynamic programming, None beyond the budget; for tests."""
    p, t = words(item), words(text)
    if not p:
        return None
    row = list(range(len(p) + 1))
    best = row[-1]
    for w in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best if best <= budget(len(p), rate) else None
