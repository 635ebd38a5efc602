"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import functools
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")

_created: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the session names none (tests, a laptop) is a temporary one made, and only on a local master:
    executors of a cluster would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far, once all results that are made of them are written; how many went."""
    mine = [path for s, path in _created if s is spark]
    _created[:] = [x for x in _created if x[0] is not spark]
    for path in mine:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(mine)


def _sweep() -> None:
    for spark, path in _created:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the shared folder's own expiry takes over
            pass


atexit.register(_sweep)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_root(spark)}/tidemark-work/{label}-{uuid.uuid4().hex[:12]}"
    _created.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that have both; other columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )


#: Up to this many ids are broadcast by keep_ids / drop_ids; above, the join shuffles.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """ids with a broadcast hint where a count shows that it is small."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def drop_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the rows whose doc_id is in ids; null ids stay."""
    gone = sized(ids.select(F.col(column).alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall(text.lower())


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its values laid end to end."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Odd base of the rolling hash and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def alnum_table() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least n."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[0] = have
    return have


@functools.lru_cache(1)
def sign_table() -> np.ndarray:
    """Whether each code point is neither a letter or digit nor space."""
    return ~alnum_table() & ~np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)


class TextChunk:
    """Some whole texts as arrays: code points, words and the words' 64-bit hashes.

    codes      lower-cased code points of all texts, a line feed after each
    ends       where each text ends in codes (exclusive, before its line feed)
    starts     where each text starts in codes
    wstart, wend   the words' bounds in codes
    whash      the words' hashes: equal words have equal hashes
    wfirst     index of each text's first word, and one past the last at the end

    With signs, each sign that isn't space is a word, too.
    """

    def __init__(self, texts: list[str], lower: bool = True, signs: bool = False):
        texts = [t.lower() for t in texts] if lower else texts
        self.texts = texts
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.ends = np.cumsum(lengths) - 1
        self.starts = self.ends - lengths + 1
        self.codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
        word = alnum_table()[self.codes]
        edge = np.diff(word, prepend=False)
        if signs:
            sign = sign_table()[self.codes]
            begin, end = edge & word | sign, edge & ~word
            end[1:] |= sign[:-1]  # the last code is a line feed
            self.wstart, self.wend = np.flatnonzero(begin), np.flatnonzero(end)
        else:
            edge = np.flatnonzero(edge)
            self.wstart, self.wend = edge[::2], edge[1::2]
        up, down = _power_tables(len(self.codes))
        with np.errstate(over="ignore"):
            value = (self.codes.astype(np.uint64) + np.uint64(1)) * _GOLDEN
            value ^= value >> np.uint64(29)
            value *= up[: len(value)]
            self._sums = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64)), down
        self.whash = self.heads(None)
        self.wfirst = np.append(np.searchsorted(self.wstart, self.starts), len(self.wstart))

    def heads(self, n: int | None) -> np.ndarray:
        """The hash of each word's first n code points, of all of a word that has no more."""
        total, down = self._sums
        size = self.wend - self.wstart
        if n is not None:
            size = np.minimum(size, n)
        with np.errstate(over="ignore"):
            return mix64((total[self.wstart + size] - total[self.wstart]) * down[self.wstart] + size.astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """A hash of each n words in a row, by the first one's index; some span two texts."""
        h = self.whash
        if len(h) < n:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            acc = h[: len(h) - n + 1] + _GOLDEN
            for i in range(1, n):
                acc = mix64(acc) * np.uint64(31) + h[i : len(h) - n + 1 + i]
            return mix64(acc)

    def gram_sets(self, n: int) -> list[np.ndarray]:
        """Each text's sorted distinct n-gram hashes; a text of fewer words has one gram, all of it."""
        grams, out = self.grams(n), []
        for a, b in zip(self.wfirst[:-1].tolist(), self.wfirst[1:].tolist()):
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                out.append(own[np.append(True, own[1:] != own[:-1])])
            elif b > a:
                with np.errstate(over="ignore"):
                    acc = np.uint64(b - a)
                    for h in self.whash[a:b]:
                        acc = mix64(acc * np.uint64(31) + h)
                out.append(np.array([acc], dtype=np.uint64))
            else:
                out.append(np.empty(0, dtype=np.uint64))
        return out


#: Code points handled at a time; a longer text is handled whole, alone.
CHUNK = 1 << 20
#: Bytes of text that are Python strings at a time where a worker must stay small, and code points of them handled at a time.
SLICE_BYTES, SMALL = 4 << 20, 1 << 18


def chunked(texts: list[str], size: int = CHUNK):
    """(first, last) index ranges of texts of about size code points."""
    a = total = 0
    for i, t in enumerate(texts):
        if i > a and total + len(t) > size:
            yield a, i
            a, total = i, 0
        total += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


#: Keys of one bucket that find looks at one after the other; the rest of a bucket is halved.
PROBES = 8


def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in keys, which are sorted and distinct; all are there.  It is quick where keys are spread
    evenly, as hashes are."""
    bits = len(keys).bit_length() + 1
    shift = np.uint64(64 - bits)
    first = np.append(0, np.cumsum(np.bincount((keys >> shift).astype(np.int64), minlength=1 << bits)))
    at = first[values >> shift]
    left = np.flatnonzero(keys[at] != values)
    for _ in range(PROBES):
        if not len(left):
            return at
        at[left] += 1
        left = left[keys[at[left]] != values[left]]
    at[left] = np.searchsorted(keys, values[left])
    return at


@functools.lru_cache(1)
def lean_memory() -> None:
    """Let this worker give freed memory back to the system: Arrow's own pool and glibc's growing threshold keep what the
    largest batch took, of which a machine has as many as workers."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def slice_bounds(column: pa.Array, size: int):
    """(first, last) row ranges of a column of texts, of about size bytes each; a longer text comes alone."""
    import pyarrow.compute as pc

    total = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a, n = 0, len(column)
    while a < n:
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, side="right")))
        yield a, z
        a = z


def text_slices(column: pa.Array, size: int):
    """(first row, texts) of the slices of slice_bounds, of a column without nulls.  Only a slice at a time becomes Python strings."""
    for a, z in slice_bounds(column, size):
        yield a, column.slice(a, z - a).to_pylist()
