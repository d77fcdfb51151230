"""Splitting texts into overlapping chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.config import DEFAULT, Settings
from granary.shared import bounded_batches

#: Texts whose ordinals agree but for so many low bits are numbered together.
RANGE_BITS = 22


def pieces(text: str, separators: tuple[str, ...], size: int) -> list[str]:
    """Parts of at most ``size`` characters that put together give the text again.

    The first separator that occurs splits the text and stays in front of what it precedes;
    parts still too long are split by the separators after it, at last into single characters.
    """
    for k, sep in enumerate(separators):
        if sep and sep not in text:
            continue
        if not sep:
            return list(text)
        head, *tail = text.split(sep)
        parts = ([head] if head else []) + [sep + t for t in tail]
        out: list[str] = []
        for part in parts:
            out += [part] if len(part) <= size else pieces(part, separators[k + 1 :], size)
        return out
    return [text[i : i + size] for i in range(0, len(text), size)]


def packed(text: str, settings: Settings = DEFAULT) -> list[str]:
    """Chunks of a text: runs of pieces up to the size, each beginning with up to the overlap of the last."""
    size, overlap = settings.chunk_size, settings.chunk_overlap
    parts = pieces(text, settings.separators, size) if text else []
    chunks, first, length = [], 0, 0
    for k, part in enumerate(parts):
        if length + len(part) > size:
            chunks.append("".join(parts[first:k]))
            while length > overlap or length + len(part) > size:
                length -= len(parts[first])
                first += 1
        length += len(part)
    chunks.append("".join(parts[first:]))
    return [c for c in (c.strip() for c in chunks) if c]


def split_documents(docs: DataFrame, settings: Settings = DEFAULT, text_col: str = "text") -> DataFrame:
    """One row per chunk: the document's other columns, ``pos`` within the document, ``text``, ``chunk_size``."""
    bounded_batches(docs.sparkSession)  # a batch's texts and chunks stand several times in Python

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(t or "", settings))

    rest = [c for c in docs.columns if c not in (text_col, "pos", "chunk_size")]
    out = docs.select(*rest, F.posexplode(chunks(F.col(text_col))).alias("pos", text_col))
    return out.withColumn("chunk_size", F.length(text_col).cast("int"))


def fixed_chunks(docs: DataFrame, size: int = 400, text_col: str = "text") -> DataFrame:
    """Hard cuts every ``size`` characters, without overlap, in expressions only; one reading of each text."""
    rest = [c for c in docs.columns if c not in (text_col, "pos", "chunk_size")]
    cuts = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select(*rest, F.posexplode(cuts).alias("pos", text_col)).withColumn("chunk_size", F.length(text_col).cast("int"))


def with_ordinals(chunks: DataFrame, order_col: str) -> DataFrame:
    """Add ``chunk_index``, from 0 over the whole batch in document order.

    Chunks are counted per document, documents summed per range of ``order_col``, and ranges
    per range of ranges, so whatever the spread of the order, dense or hashed over 64 bits, no
    window has more than 2^22 rows. ``chunks`` is read twice: give a stored table.
    """
    bits = RANGE_BITS
    counts = chunks.groupBy(F.col(order_col).cast("long").alias("_order")).agg(F.count("*").alias("_n"))
    low = counts.withColumn("_low", F.shiftright("_order", bits))
    middle = low.groupBy("_low").agg(F.sum("_n").alias("_n")).withColumn("_high", F.shiftright("_low", bits))
    high = middle.groupBy("_high").agg(F.sum("_n").alias("_n"))

    def before(order: str, *within: str) -> Column:
        return F.sum("_n").over(Window.partitionBy(*within).orderBy(order)) - F.col("_n")

    high = high.select("_high", before("_high").alias("_b2"))
    middle = middle.select("_low", "_high", before("_low", "_high").alias("_b1")).join(high, "_high").select("_low", (F.col("_b1") + F.col("_b2")).alias("_b"))
    starts = low.select("_order", "_low", before("_order", "_low").alias("_b0")).join(middle, "_low").select(
        "_order", (F.col("_b0") + F.col("_b")).alias("_start")
    )
    numbered = chunks.join(starts, F.col(order_col).cast("long") == F.col("_order"))
    return numbered.withColumn("chunk_index", (F.col("_start") + F.col("pos")).cast("long")).drop("_start", "_order")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: number, whole mean, least, largest and summed size; zeros for no chunks."""
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    n, total = F.count("*"), F.sum("chunk_size")
    return chunks.agg(
        n.alias("total_chunks"), zero(F.floor(F.try_divide(total, n))).alias("avg_size"),
        zero(F.min("chunk_size")).alias("min_size"), zero(F.max("chunk_size")).alias("max_size"), zero(total).alias("total_chars"),
    )
