"""Where intermediate and small files go, for local and distributed file systems alike."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import CorpusError

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset a temporary one is made and set, on a local master only:
    executors of a cluster would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise CorpusError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the driver exits."""
    path = f"{shared_folder(spark)}/tidemark-core/{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of path, its Path)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    fs, at = file_system(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document, as a folder of one text file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\0").text(path)


def upload(spark: SparkSession, local: str, path: str) -> None:
    """A file of the driver's disk as one of any file system."""
    fs, at = file_system(spark, path)
    fs.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), at)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first().value.rstrip("\0")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and survives the loss of executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far, once all results that are made of them are written; how many went."""
    mine = [path for s, path in _made if s is spark]
    _made[:] = [x for x in _made if x[0] is not spark]
    for path in mine:
        delete(spark, path)
    return len(mine)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; what is left is the shared folder's to expire
            pass
