"""From documents to a searchable corpus: chunk, identify, embed what the cache lacks, build, validate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .corpus import Corpus, build
from .errors import CorpusError
from .operators.etl import chunk_rows, embed, embed_with_cache, keep_first, long_enough, source_report, whole_text_chunks

CHUNK_COLUMNS = ("canonical_text", "source_uri", "byte_start", "byte_end")


@dataclass
class BuildConfig:
    """options go to build: preset, dtype, with_ann, title and so on."""

    output_path: str
    embedding_model: str
    embedding_dim: int
    chunker_version: str
    model_hash: str
    options: dict[str, Any] = field(default_factory=dict)


class EmbeddingCache:
    """Vectors by chunk_id in a folder of Parquet that all executors and later runs share."""

    SCHEMA = "chunk_id string, dim int, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        if not storage.exists(self.spark, self.path):
            if not storage.exists(self.spark, f"{self.path}.old"):
                return self.spark.createDataFrame([], self.SCHEMA)
            self._rename(f"{self.path}.old", self.path)  # a replacement was cut short: the old cache stands
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def put(self, rows: DataFrame) -> None:
        """Add rows in place of those of the same chunk_id.

        Rows of new identifiers are appended; only a replacement writes the cache anew, beside it.  Then the old cache is
        renamed away, the new one in, and the old one deleted: a crash between leaves one of them, which read() finds.
        """
        fresh = storage.written(rows.select("chunk_id", F.col("dim").cast("int").alias("dim"), "embedding").dropDuplicates(["chunk_id"]), "cache")
        old = self.read()
        if old.join(fresh.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
            fresh.write.mode("append").parquet(self.path)
            return
        trial = f"{self.path}.new"
        old.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(trial)
        storage.delete(self.spark, f"{self.path}.old")
        self._rename(self.path, f"{self.path}.old")
        self._rename(trial, self.path)
        storage.delete(self.spark, f"{self.path}.old")

    def _rename(self, source: str, target: str) -> None:
        fs, at = storage.file_system(self.spark, source)
        if not fs.rename(at, storage.file_system(self.spark, target)[1]):
            raise CorpusError(f"{source} can't be renamed to {target}")


class Pipeline:
    """Collects DataFrames of chunks and emits one corpus.

    embedder turns a list of texts into as many vectors and runs on the executors, a batch at a time.
    """

    def __init__(self, config: BuildConfig, embedder: Callable[[list[str]], list[list[float]]], cache: EmbeddingCache | None = None):
        self.config, self.embedder, self.cache = config, embedder, cache
        self._parts: list[DataFrame] = []

    def add(self, chunks: DataFrame) -> None:
        """Chunks with a chunk_id or not, in any number of tables of one schema."""
        self._parts.append(chunks)

    def add_documents(self, docs: DataFrame, uri, max_chars: int = 512, overlap: int = 0) -> None:
        self.add(chunk_rows(docs, uri, max_chars, overlap, self.config.chunker_version).drop("chunk_index"))

    def _chunks(self) -> DataFrame:
        out = self._parts[0]
        for part in self._parts[1:]:
            out = out.unionByName(part)
        if "chunk_id" not in out.columns:
            from .functions.hashing import chunk_id

            out = out.withColumn("chunk_id", chunk_id(*(F.col(c) for c in CHUNK_COLUMNS), F.lit(self.config.chunker_version)))
        return out

    def emit(self, provenance: Any = None) -> Corpus:
        """Build and validate the corpus; only chunks that the cache lacks are embedded."""
        if not self._parts or all(p.isEmpty() for p in self._parts):
            raise RuntimeError("the pipeline has no chunks")
        c, chunks = self.config, self._chunks()
        if self.cache is None:
            ready = storage.written(embed(chunks, self.embedder, c.embedding_dim), "embedded")
        else:
            done, after = embed_with_cache(chunks, self.cache.read(), self.embedder, c.embedding_dim)
            ready = storage.written(done, "embedded")
            known = self.cache.read().select("chunk_id")
            new = ready.select("chunk_id", F.lit(c.embedding_dim).alias("dim"), "embedding").join(known, "chunk_id", "left_anti")
            self.cache.put(new)
        corpus = build(
            ready.drop("chunk_id"), c.output_path, embedding_model=c.embedding_model, embedding_dim=c.embedding_dim, chunker_version=c.chunker_version,
            model_hash=c.model_hash, provenance=provenance, **c.options,
        )
        wrong = corpus.validate().first()
        if wrong:
            raise CorpusError(f"the corpus is unsound: {wrong.rule}, row {wrong.row_id}")
        return corpus


def prepare_sources(rows: DataFrame, chunker_version: str) -> tuple[DataFrame, DataFrame]:
    """(whole-text chunks, report by source) of loaded sources: short texts go, of equal ones the first source's stays."""
    kept = keep_first(long_enough(rows), "source_rank", "url", "title", "label")
    return whole_text_chunks(kept, chunker_version), source_report(rows, kept)
