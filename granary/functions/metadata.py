"""Metadata maps and content identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitised(metadata: Column) -> Column:
    """Null values become empty strings; the map holds strings only."""
    return F.transform_values(metadata, lambda _, v: F.coalesce(v.cast("string"), F.lit("")))


def content_id(text: Column) -> Column:
    """A stable id of a text, the same in every run and on every machine."""
    return F.concat(F.lit("chunk_"), F.sha2(text, 256))


def source_or_unknown(source: Column) -> Column:
    return F.coalesce(source, F.lit("unknown"))
