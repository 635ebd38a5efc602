"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive, so they are kept as signed deltas: an
insert adds a document and its tokens, a delete takes them away, a revision adds the difference of its
counts.  A batch of changes is aggregated to one row a key and published under its batch id by one
rename that fails where the id is there already, so a retried, repeated or concurrent commit changes nothing.
Totals are the sum of the published batches; compaction folds them into one that remembers their ids.  The rename is
atomic on HDFS and on local disks; an object store needs a committer that can create a key only where it is absent.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, work_path

#: The vocabulary by default; any file of this form does, and the driver's copy goes to all executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEY = ["source", "lang", "version"]
TOTALS = "source string, lang string, version string, docs long, tokens long, chars long"


@functools.lru_cache(4)
def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, text_key, tokens, chars, clean_tokens, clean_chars) of each row.

    The clean counts are those of the text after redaction of personal data; only texts that it changes
    are tokenised twice.  A null text counts as empty, a null source or lang stays null, a null doc_id too.
    path is the vocabulary's on the driver, which sends it to the executors.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def run(batches):
        import pyarrow as pa
        from pyspark import SparkFiles
        from xxhash import xxh3_128_hexdigest

        from .pii import find_pii, redact

        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            out = []
            for text in b.column(3).to_pylist():
                text = text or ""
                n = len(encode(text))
                spans = find_pii(text)
                clean = redact(text, spans) if spans else text
                out.append((xxh3_128_hexdigest(text.encode()), n, len(text), len(encode(clean)) if spans else n, len(clean)))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "source", "lang", "text_key", "tokens", "chars", "clean_tokens", "clean_chars"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return base.mapInArrow(run, "doc_id long, source string, lang string, text_key string, tokens long, chars long, clean_tokens long, clean_chars long")


def signed(changes: DataFrame) -> DataFrame:
    """Additive totals by key of changes (op, source, lang, version, tokens, chars, old_tokens, old_chars).

    op is 'insert', 'delete' or 'revise'; a revision goes from the old counts to the new ones; other ops and
    null counts add nothing.  Keys may be null and are then a key of their own.
    """
    now = lambda c: F.coalesce(F.col(c), F.lit(0))
    by = lambda new, old: F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old).otherwise(0)
    return changes.groupBy(*KEY).agg(
        F.sum(F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)).cast("long").alias("docs"),
        F.sum(by(now("tokens"), now("old_tokens"))).cast("long").alias("tokens"),
        F.sum(by(now("chars"), now("old_chars"))).cast("long").alias("chars"),
    )


class TokenRollup:
    """Published batches of deltas under a path that all executors and later sessions share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _names(self, folder: str) -> list[str]:
        if not self._exists(f"{self.path}/{folder}"):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.getPath().getName()[0] not in "._")

    def _state(self) -> tuple[list[str], list[str], set[str]]:
        """One look at what is published: (the last base, batches that aren't in it, ids in it).

        Batches are listed first: one that a compaction takes away meanwhile is in the base that is listed after.
        """
        batches = self._names("batches")
        base = self._names("bases")[-1:]
        folded = {r.id for r in self.spark.read.parquet(f"{self.path}/bases/{base[0]}/ids").collect()} if base else set()
        return base, [n for n in batches if n.removeprefix("b-") not in folded], folded

    def committed(self) -> set[str]:
        """Ids of all batches in the totals."""
        _, batches, folded = self._state()
        return folded | {n.removeprefix("b-") for n in batches}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing happens, if its id was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        trial = f"{self.path}/.trial/{batch_id}-{uuid.uuid4().hex}"
        signed(changes).write.parquet(trial)
        # a batch that was folded into a base meanwhile may be published again: the base's ids keep it out of the totals
        return self._publish(trial, f"{self.path}/batches/b-{batch_id}") and batch_id not in self._state()[2]

    def _publish(self, trial: str, target: str) -> bool:
        """Rename trial to target; False, and trial goes, if target is there."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        self._fs.mkdirs(self._path(target).getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(trial), self._path(target), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError:
            if not self._exists(target):
                raise
            self._fs.delete(self._path(trial), True)
            return False
        return True

    def _sums(self, base: list[str], batches: list[str]) -> DataFrame:
        parts = [f"{self.path}/bases/{n}/totals" for n in base] + [f"{self.path}/batches/{n}" for n in batches]
        found = self.spark.read.schema(TOTALS).parquet(*parts) if parts else self.spark.createDataFrame([], TOTALS)
        sums = found.groupBy(*KEY).agg(*(F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "chars")))
        return sums.where("docs <> 0 or tokens <> 0 or chars <> 0")

    def totals(self) -> DataFrame:
        """Sums by source, language and version; keys whose documents and tokens all went are left out."""
        base, batches, _ = self._state()
        return self._sums(base, batches)

    def compact(self) -> None:
        """Fold the batches published so far into a new base; their ids stay known.

        Batches are listed once: one that is committed meanwhile is in neither the base nor its ids, and counts on its own.
        """
        base, batches, folded = self._state()
        if not batches:
            return
        trial = f"{self.path}/.trial/base-{uuid.uuid4().hex}"
        self._sums(base, batches).write.parquet(f"{trial}/totals")
        ids = sorted(folded | {n.removeprefix("b-") for n in batches})
        self.spark.createDataFrame([(i,) for i in ids], "id string").write.parquet(f"{trial}/ids")
        number = int(base[0]) + 1 if base else 0
        if self._publish(trial, f"{self.path}/bases/{number:09d}"):
            for n in batches:
                self._fs.delete(self._path(f"{self.path}/batches/{n}"), True)


def documents_rollup(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Totals (source, lang, version, docs, tokens, chars) after three batches over ``docs``: all documents
    inserted, the counts of those with personal data revised to their redacted text, and exact copies deleted
    (rows with the text of a lesser doc_id).  The second batch is then committed again, without effect.

    Rows that repeat a doc_id and text count as copies; a null doc_id is never one.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    store = TokenRollup(spark, path or work_path(spark, "rollup"))
    version = tokenizer.rsplit("/", 1)[-1].split(".")[0]
    counted = materialize(count_tokens(docs, tokenizer), "counted").withColumn("version", F.lit(version))
    none = F.lit(None).cast("long")
    store.commit("load", counted.select(F.lit("insert").alias("op"), *KEY, "tokens", "chars", none.alias("old_tokens"), none.alias("old_chars")))
    changed = counted.where("clean_tokens <> tokens or clean_chars <> chars")
    revised = changed.select(F.lit("revise").alias("op"), *KEY, F.col("clean_tokens").alias("tokens"), F.col("clean_chars").alias("chars"), F.col("tokens").alias("old_tokens"), F.col("chars").alias("old_chars"))
    store.commit("redact", revised)
    # a text's copies fall in the same place by its hash; their counts are equal, so only their keys matter
    each = counted.where("doc_id is not null").groupBy("text_key", "doc_id", *KEY, "clean_tokens", "clean_chars").agg(F.count("*").alias("n"))
    least = each.groupBy("text_key").agg(F.min(F.struct("doc_id", *KEY)).alias("first"), F.sum("n").alias("all")).where("all > 1").select("text_key", "first")
    copies = each.join(least, "text_key").withColumn("n", F.col("n") - F.when(F.struct("doc_id", *KEY).eqNullSafe(F.col("first")), 1).otherwise(0)).where("n > 0")
    gone = copies.select(F.lit("delete").alias("op"), *KEY, F.col("clean_tokens").alias("tokens"), F.col("clean_chars").alias("chars"), none.alias("old_tokens"), none.alias("old_chars"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    store.commit("copies", gone.drop("i"))
    store.commit("redact", revised)
    return store.totals()
