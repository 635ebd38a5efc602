"""Labelled news tables and the older SQLite container as DataFrames of one shape: (text, label, source, title, url)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.text import join_parts, label_of, rating_label, squash
from ..operators.etl import union_sources

TRUTH = {"fake": "False", "true": "True"}
BINARY = {"0": "False", "1": "True"}
#: Articles in a block of the older container.
LEGACY_BLOCK = 256


def source_row(df: DataFrame, text: Column, label: Column, source: str, title: Column | None = None, url: Column | None = None) -> DataFrame:
    empty = F.lit("")
    return df.select(
        squash(text).alias("text"), label.cast("string").alias("label"), F.lit(source).alias("source"),
        squash(empty if title is None else title).alias("title"), squash(empty if url is None else url).alias("url"),
    )


def _csv(spark: SparkSession, *paths: str, sep: str = ",") -> DataFrame:
    """Quoted fields may hold line breaks, and a quote in them is doubled."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(list(paths))


def _col(df: DataFrame, name: str) -> Column:
    """A column, null where the table hasn't it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _plain(folder: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def load(spark: SparkSession, root: str) -> DataFrame:
        df = _csv(spark, f"{root}/{folder}/train.csv", f"{root}/{folder}/test.csv")
        return source_row(df, _col(df, "text"), F.trim(_col(df, "label")), name)

    return load


def preprocessed(spark: SparkSession, root: str) -> DataFrame:
    df = _csv(spark, f"{root}/Fake.br-Corpus/preprocessed/pre-processed.csv")
    return source_row(df, _col(df, "preprocessed_news"), label_of(_col(df, "label"), TRUTH), "Fake.br-Corpus")


def recogna(spark: SparkSession, root: str) -> DataFrame:
    df = _csv(spark, f"{root}/FakeRecogna/dataset/FakeRecogna.csv")
    body = join_parts(*(_col(df, c) for c in ("Titulo", "Subtitulo", "Noticia")))
    # a column of 0 and 1 may have been written as decimals
    label = F.regexp_replace(_col(df, "Classe").cast("string"), r"\.0$", "")
    return source_row(df, body, label_of(label, BINARY), "FakeRecogna", _col(df, "Titulo"), _col(df, "URL"))


def both_sides(df: DataFrame, source: str = "FakeTrue.Br") -> DataFrame:
    """A row with a false and a true text becomes two; only the false one has a title."""
    empty = F.lit("")
    side = lambda text, label, title, url: F.struct(text.alias("text"), F.lit(label).alias("label"), title.alias("title"), url.alias("url"))
    sides = F.array(side(_col(df, "fake"), "False", _col(df, "title_fake"), _col(df, "link_f")), side(_col(df, "true"), "True", empty, _col(df, "link_t")))
    two = df.select(F.explode(sides).alias("x")).select("x.*")
    return source_row(two, F.col("text"), F.col("label"), source, F.col("title"), F.col("url"))


def paired(spark: SparkSession, root: str) -> DataFrame:
    return both_sides(_csv(spark, f"{root}/FakeTrue.Br/FakeTrueBr_corpus.csv"))


def rated(df: DataFrame, source: str = "factck-br") -> DataFrame:
    """Claims with a rating up to 2 are false, above 3 true; a rating of 3 or none is ambiguous and goes."""
    named = source_row(df, join_parts(_col(df, "claimReviewed"), _col(df, "reviewBody")), rating_label(_col(df, "ratingValue")), source, _col(df, "title"), _col(df, "URL"))
    return named.where("label is not null")


def fact_checks(spark: SparkSession, root: str) -> DataFrame:
    return rated(_csv(spark, f"{root}/factck-br/FACTCKBR.tsv", sep="\t"))


def combined(spark: SparkSession, root: str) -> DataFrame:
    name = "portuguese-fake-news-classifier-bilstm-combined"
    df = spark.read.parquet(f"{root}/{name}/corpus/corpus_test_df.parquet")
    label = F.when(F.col("label"), "True").otherwise("False") if dict(df.dtypes)["label"] == "boolean" else F.trim(F.col("label").cast("string"))
    return source_row(df, F.col("text"), label, name)


#: In the order in which keep-first dedupe prefers them.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "FakeBr-hf": _plain("FakeBr-hf", "FakeBr-hf"),
    "FakeTrue.Br-hf": _plain("FakeTrue.Br-hf", "FakeTrue.Br-hf"),
    "Fake.br-Corpus": preprocessed,
    "FakeRecogna": recogna,
    "FakeTrue.Br": paired,
    "factck-br": fact_checks,
    "portuguese-fake-news-classifier-bilstm-combined": combined,
}


def load_sources(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """All named sources under root with source_rank, their place in the registry."""
    return union_sources({n: SOURCES[n](spark, root) for n in (names or SOURCES)})


def _legacy_rows(batches, prefix: str):
    import json
    import sqlite3
    import struct

    import numpy as np
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1)):
            con = sqlite3.connect(":memory:")
            con.deserialize(content.as_py())
            blob = dict(con.execute("SELECT name, data FROM blobs"))
            about = json.loads(blob["manifest"])
            n, dim = about["n_articles"], about["embedding_dim"]
            if "embeddings" not in blob:
                raise CorpusError(f"{name} has no embeddings")
            texts: dict[int, str] = {}
            for block, data in con.execute("SELECT block_id, data FROM text_blocks ORDER BY block_id"):
                raw = unpack(data)
                (count,) = struct.unpack_from("<I", raw)
                starts = struct.unpack_from(f"<{count}I", raw, 4)
                body = raw[4 * (count + 1) :]
                for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(body)])):
                    texts[block * LEGACY_BLOCK + i] = body[a:z].decode()
            lacking = [i for i in range(n) if i not in texts]
            if lacking:
                raise CorpusError(f"{name}: {len(lacking)} articles have no text, {lacking[0]} is the first")
            rows = con.execute("SELECT id, source, label FROM articles ORDER BY id").fetchall()
            if len(rows) != n:
                raise CorpusError(f"{name}: {len(rows)} articles instead of {n}")
            v = np.frombuffer(unpack(blob["embeddings"]), "<f2").reshape(n, dim).astype(np.float32)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(size == 0, 1, size)
            ids = [r[0] for r in rows]
            text = [texts[i] for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n), pa.array(ids, pa.int64()), pa.array(text), pa.array([f"{prefix}{i}" for i in ids]), pa.array([0] * n, pa.int64()),
                    pa.array([len(t.encode()) for t in text], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([str(r[2]) for r in rows], pa.string()),
                    pa.array([x.tolist() for x in v[ids]], pa.list_(pa.float32())),
                ],
                names=["file", "row_id", "canonical_text", "source_uri", "byte_start", "byte_end", "source", "label", "embedding"],
            )


def read_legacy(spark: SparkSession, path: str, prefix: str = "legacy://articles/") -> DataFrame:
    """The articles of SQLite containers as chunks with normalised vectors; a task a file.  Their source_uri is prefix and the article's number."""
    schema = "file string, row_id long, canonical_text string, source_uri string, byte_start long, byte_end long, source string, label string, embedding array<float>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lambda batches: _legacy_rows(batches, prefix), schema)
