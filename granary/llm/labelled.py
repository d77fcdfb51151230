"""Which labelled documents a model may learn from, and which are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import broadcast_if_small, stored


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y, part) of at most about ``most`` labelled rows of each class that are not held out.

    The ids are broadcast, as ``most`` bounds them and their count is checked, so that no text
    moves; the sample is kept in the shared folder, so that the corpus is read once for it.

    The sample is a range of id hashes, so it is the same for any layout of the tables. Rows
    with null label or id are left out; a document with several labels counts once for each.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col(label).cast("int").alias("y"), fold(F.col("doc_id")).cast("int").alias("part")
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = lambda y: min(1.0, most / counts[y]) if counts.get(y) else 1.0
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = stored(known.where(at < F.when(F.col("y") == 1, share(1)).otherwise(share(0))), "chosen")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stored(rows.join(broadcast_if_small(chosen, 32), "doc_id"), "sample")
