"""Stored tables, as for the rest of the library, and rows told apart by id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.shared import bounded_batches, broadcast_if_small, exists, new_folder, removed, shared_folder, spread, stored

__all__ = ["bounded_batches", "broadcast_if_small", "dropped_rows", "exists", "new_folder", "removed", "row_key", "same_row", "shared_folder", "spread", "stored"]


def row_key(text: Column) -> Column:
    """With the doc_id it tells rows apart: rows that agree in both are repeated rows."""
    return F.xxhash64(text)


def same_row(one: str, other: str) -> Column:
    """Join condition of two aliased tables with doc_id and row_key; null ids agree."""
    return F.col(f"{one}.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col(f"{one}.row_key") == F.col(f"{other}.row_key"))


def dropped_rows(docs: DataFrame, lost: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the ``lost`` rows and with one of each of the ``repeated`` ones.

    Both are parts of stored tables (doc_id, row_key). The columns of ``docs`` go through as one
    struct, so their names cannot clash with any used here. Only texts of repeated rows move.
    """
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text").cast("string")).alias("row_key"), F.struct(*docs.columns).alias("row")
    ).alias("r")
    out = whole.join(broadcast_if_small(lost.select("doc_id", "row_key"), 48).alias("l"), same_row("r", "l"), "left_anti")
    if repeated is not None and not repeated.isEmpty():
        again = broadcast_if_small(repeated.select("doc_id", "row_key"), 48).alias("a")
        once = out.alias("r").join(again, same_row("r", "a"), "left_semi").groupBy("doc_id", "row_key").agg(F.first("row").alias("row"))
        out = out.alias("r").join(again, same_row("r", "a"), "left_anti").select("row").unionByName(once.select("row"))
    return out.select("row.*")
