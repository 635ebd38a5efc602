"""Preparing documents: filters, keep-first dedupe, chunking, reports, the embedding cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.hashing import chunk_id, source_uri
from ..functions.text import windows

MIN_CHARS = 20


def long_enough(df: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Rows whose text has more than ``least`` code points."""
    return df.where(F.char_length("text") > least)


def keep_first(df: DataFrame, *order: str) -> DataFrame:
    """Of rows with equal text, by SHA-256, the first in the given order."""
    first = Window.partitionBy("__sha").orderBy(*order)
    return df.withColumn("__sha", F.sha2(F.encode("text", "UTF-8"), 256)).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__sha", "__n")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of the named tables with source_rank, the place of theirs in the order given."""
    out = None
    for i, (_, df) in enumerate(sources.items()):
        part = df.withColumn("source_rank", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def chunk_rows(docs: DataFrame, uri, max_chars: int = 512, overlap: int = 0, chunker_version: str | None = None) -> DataFrame:
    """A row a window of each document's text: its columns but text, and chunk_index, canonical_text, source_uri, byte_start, byte_end, chunk_id."""
    version = F.lit(chunker_version or f"char/{max_chars}")
    rest = [c for c in docs.columns if c != "text"]
    exploded = docs.select(*rest, uri.alias("source_uri"), F.posexplode(windows(F.col("text"), max_chars, overlap)).alias("chunk_index", "w"))
    flat = exploded.select(*rest, "chunk_index", F.col("w.piece").alias("canonical_text"), "source_uri", F.col("w.byte_start").alias("byte_start"), F.col("w.byte_end").alias("byte_end"))
    return flat.withColumn("chunk_id", chunk_id(F.col("canonical_text"), F.col("source_uri"), F.col("byte_start"), F.col("byte_end"), version))


def whole_text_chunks(rows: DataFrame, chunker_version: str) -> DataFrame:
    """Rows (text, source, ...) as one chunk each, cited by source and content."""
    uri, end = source_uri(F.col("source"), F.col("text")), F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    return rows.select("*", F.col("text").alias("canonical_text"), uri.alias("source_uri"), zero.alias("byte_start"), end.alias("byte_end"), chunk_id(F.col("text"), uri, zero, end, F.lit(chunker_version)).alias("chunk_id"))


def source_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, original, kept, delta) of each source and, with a null source, of all."""
    sides = before.select("source", F.lit(1).alias("o"), F.lit(0).alias("k")).unionByName(after.select("source", F.lit(0).alias("o"), F.lit(1).alias("k")))
    sums = sides.rollup("source").agg(F.sum("o").cast("long").alias("original"), F.sum("k").cast("long").alias("kept"))
    return sums.withColumn("delta", F.col("kept") - F.col("original"))


def cache_split(chunks: DataFrame, cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(hits with embedding, misses) of chunks against a cache (chunk_id, dim, embedding); a vector of another dim is an error."""
    size = F.when(F.col("dim") != dim, F.raise_error(F.concat(F.lit("cached dim "), F.col("dim").cast("string"), F.lit(f" is not {dim}")))).otherwise(F.col("embedding"))
    return chunks.join(cache.select("chunk_id", size.alias("embedding")), "chunk_id"), chunks.join(cache.select("chunk_id"), "chunk_id", "left_anti")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with the rows of new in place of those of the same chunk_id."""
    return cache.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.select(*cache.columns))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """chunks with ``embedding``, by batches in Python; a wrong number or dim of vectors is an error."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(frames):
        for pdf in frames:
            got = embedder(pdf["canonical_text"].tolist())
            if len(got) != len(pdf):
                raise RuntimeError(f"embedder returned {len(got)} vectors for {len(pdf)} chunks")
            if any(len(v) != dim for v in got):
                raise RuntimeError(f"embedder returned a vector that has not dim {dim}")
            yield pdf.assign(embedding=[[float(x) for x in v] for v in got])

    return chunks.mapInPandas(run, schema)


def embed_with_cache(chunks: DataFrame, cache: DataFrame, embedder, dim: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with embedding, the cache to be): only chunks that the cache lacks are embedded, each distinct one once."""
    if "chunk_id" not in chunks.columns:
        raise CorpusError("chunks need a chunk_id")
    hits, misses = cache_split(chunks, cache, dim)
    fresh = embed(misses.select("chunk_id", "canonical_text").dropDuplicates(["chunk_id"]), embedder, dim)
    rows = fresh.select("chunk_id", F.lit(dim).alias("dim"), "embedding")
    done = hits.unionByName(misses.join(rows.select("chunk_id", "embedding"), "chunk_id").select(*hits.columns))
    return done, cache_put(cache, rows)
