"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch of changes holds rows ``(op, source, lang, tokenizer, tokens, old_tokens, times)`` where
op is ``insert``, ``delete`` or ``revise`` (``old_tokens`` becomes ``tokens``). Every change is
a signed pair (documents, tokens), so a batch is summed once, before its shuffle, into one
small row per key. A batch is committed by its own folder, written once under its batch id:
sending it again, after a lost driver or by mistake, changes nothing, and a half-written batch
has no commit marker and is written anew. Totals are kept: every ``COMPACT`` batches a snapshot
adds them to the one before, so reading the totals takes one snapshot and a few deltas, however
many batches there were. There is one writer at a time, and any number of readers.

Defined results for odd input:

* null source, lang or tokenizer: a group of its own (null is a key value).
* null tokens or old_tokens: zero. Null or unknown op: the commit fails before it writes.
* repeated rows: each counts, as every row is one change; ``times``, where there is such a
  column, says how often a row counts (null: once), so a group of copies is one row.
* empty batch: committed, changes nothing. No batch: totals are empty.
* groups whose documents and tokens are both zero disappear from the totals.
* null or empty texts have no tokens; very long texts are counted whole. Ties do not arise.
* Other columns of the changes, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import tokens as bpe
from granary.llm.shared import bounded_batches, exists, new_folder, spread, stored

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
COMPACT = 8  # batches after which a snapshot is made

#: Tokenizers that plain expressions can count, by version.
WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"
EXPRESSIONS = {
    "words-1": lambda text: F.regexp_count(text, F.lit(WORD)),
    "pieces-1": lambda text: F.regexp_count(text, F.lit(PIECE)),
}


def bpe_count(text: Column) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(bpe.encode(t)))

    return count(text)


#: The public byte-level BPE and, beside it, words.
TOKENIZERS = {"byte-bpe-50k": bpe_count, "words-1": EXPRESSIONS["words-1"]}
Tokenizers = Mapping[str, Callable[[Column], Column]]


def token_count(text: Column, tokenizer: str, tokenizers: Tokenizers = TOKENIZERS) -> Column:
    return F.coalesce(tokenizers[tokenizer](text).cast("long"), F.lit(0).cast("long"))


def signed(changes: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    new, old = F.coalesce(F.col("tokens").cast("long"), zero), F.coalesce(F.col("old_tokens").cast("long"), zero)
    times = F.coalesce(F.col("times").cast("long"), F.lit(1).cast("long")) if "times" in changes.columns else F.lit(1).cast("long")
    op = F.col("op")
    known = op.isin("insert", "delete", "revise")
    bad = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null")))).cast("long")
    return changes.select(
        *KEYS,
        (times * F.when(op == "insert", 1).when(op == "delete", -1).when(known, 0).otherwise(bad).cast("long")).alias("n_docs"),
        (times * F.when(op == "insert", new).when(op == "delete", -new).when(known, new - old).otherwise(bad)).alias("n_tokens"),
    )


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals kept in a folder that all executors see: ``batch=<id>`` has a batch, ``totals=<n>`` a snapshot and the ids it covers."""

    def __init__(self, spark: SparkSession, folder: str, compact: int = COMPACT):
        self.spark, self.folder, self.compact_after = spark, folder, compact

    def _names(self, prefix: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return [n[len(prefix) :] for n in names if n.startswith(prefix)]

    def _path(self, batch_id: str) -> str:
        if not batch_id.replace("-", "").isalnum():
            raise ValueError(f"batch ids are letters, digits and dashes: {batch_id!r}")
        return f"{self.folder}/batch={batch_id}"

    def _snapshot(self) -> tuple[int, set[str]]:
        """Number of the newest whole snapshot (0: none) and the batches in it."""
        for n in sorted(map(int, self._names("totals=")), reverse=True):
            if exists(self.spark, f"{self.folder}/totals={n}/sums/_SUCCESS"):
                rows = self.spark.read.schema("batch string").parquet(f"{self.folder}/totals={n}/batches").collect()
                return n, {r["batch"] for r in rows}
        return 0, set()

    def _pending(self, covered: set[str]) -> list[str]:
        """Committed batches that are not in the snapshot."""
        return sorted(b for b in self._names("batch=") if b not in covered and exists(self.spark, f"{self._path(b)}/_SUCCESS"))

    def committed(self, batch_id: str) -> bool:
        return exists(self.spark, f"{self._path(batch_id)}/_SUCCESS") or batch_id in self._snapshot()[1]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was there already. Rows of one key meet as partial sums."""
        if self.committed(batch_id):
            return False
        summed(signed(changes)).write.mode("overwrite").parquet(self._path(batch_id))
        if len(self._pending(self._snapshot()[1])) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """A snapshot of all committed batches; its sums, written last, make it count. Batches in the snapshot before it are removed."""
        n, covered = self._snapshot()
        pending = self._pending(covered)
        if pending:
            path = f"{self.folder}/totals={n + 1}"
            ids = self.spark.createDataFrame([(b,) for b in sorted(covered | set(pending))], "batch string")
            ids.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches")
            self._sums(n, pending).write.mode("overwrite").parquet(f"{path}/sums")
            fs = self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for old in [f"totals={k}" for k in map(int, self._names("totals=")) if k < n] + [f"batch={b}" for b in covered]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}"), True)

    def batches(self) -> list[str]:
        _, covered = self._snapshot()
        return sorted(covered | set(self._pending(covered)))

    def _sums(self, snapshot: int, pending: list[str]) -> DataFrame:
        paths = [f"{self.folder}/totals={snapshot}/sums"] * bool(snapshot) + [self._path(b) for b in pending]
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        # Read one by one: together, their folders would be taken for partitions of one table.
        rows = self.spark.read.schema(TOTALS).parquet(paths[0])
        for path in paths[1:]:
            rows = rows.unionByName(self.spark.read.schema(TOTALS).parquet(path))
        return summed(rows).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        n, covered = self._snapshot()
        return self._sums(n, self._pending(covered))


def four_batches(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Totals after two loads, a revision and a deletion, over all documents (source, lang, text); two batches are sent twice.

    The revision counts the texts anew without digits, by the first tokenizer. The deletion
    drops every document whose text another document of the same source and language has too,
    but one. The texts are read once: all batches are made from one stored table of counts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rollup = Rollup(spark, new_folder(spark, "rollup"), compact=3)
    first, second = tokenizers
    text, plain = F.col("text"), F.translate("text", "0123456789", "")
    has_digit = F.coalesce(text.rlike("[0-9]"), F.lit(False))
    counts = docs.select("source", "lang", "text", F.when(has_digit, plain).alias("plain")).select(
        "source", "lang", F.unhex(F.md5("text")).alias("key"), F.col("plain").isNotNull().alias("revised"),
        token_count(text, first, tokenizers).alias("full"), token_count(F.col("plain"), first, tokenizers).alias("without"),
        token_count(text, second, tokenizers).alias("other"),
    )
    counts = stored(counts, "counts")
    none = F.lit(None).cast("long")

    def changes(rows: DataFrame, op: str, tokenizer: str, tokens: Column, old: Column = none, times: Column = none) -> DataFrame:
        return rows.select(
            F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), old.alias("old_tokens"), times.alias("times")
        )

    last = F.when(F.col("revised"), F.col("without")).otherwise(F.col("full")).alias("last")
    # Equal texts have equal counts, so a group of copies is one row that counts as often as there are copies less one.
    copies = counts.where("key is not null").select("source", "lang", "key", last, "other").groupBy("source", "lang", "key").agg(
        (F.count("*") - 1).alias("more"), F.first("last").alias("last"), F.first("other").alias("other")
    ).where("more > 0")
    copies = stored(copies, "copies")
    dropped = changes(copies, "delete", first, F.col("last"), none, F.col("more")).unionByName(
        changes(copies, "delete", second, F.col("other"), none, F.col("more"))
    )
    revised = changes(counts.where("revised"), "revise", first, F.col("without"), F.col("full"))
    rollup.commit("load-1", changes(counts, "insert", first, F.col("full")))
    rollup.commit("load-2", changes(counts, "insert", second, F.col("other")))
    rollup.commit("load-2", changes(counts, "insert", second, F.col("other")))
    rollup.commit("revise-1", revised)
    rollup.commit("drop-copies", dropped)
    rollup.commit("revise-1", revised)
    return rollup.totals()


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the byte-level BPE and of words, maintained over four batches."""
    return four_batches(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")), TOKENIZERS)


def token_rollup_by_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same four batches with tokenizers that SQL can count too."""
    return four_batches(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")), EXPRESSIONS)


SQL = r"""
WITH kept AS (
  SELECT source, lang, text FROM documents WHERE text IS NULL
  UNION ALL SELECT DISTINCT source, lang, text FROM documents WHERE text IS NOT NULL
), n AS (
  SELECT source, lang, 'words-1' AS tokenizer,
    len(regexp_extract_all(translate(coalesce(text, ''), '0123456789', ''), '[^\x20\x09-\x0D]+')) AS c FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) FROM kept
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(c) AS BIGINT) AS n_tokens FROM n GROUP BY ALL
"""
