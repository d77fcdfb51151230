"""Exact nearest-neighbour search by cosine distance, and what follows it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.config import DEFAULT, Settings
from granary.functions.text import strip
from granary.shared import bounded_batches

#: Queries multiplied with the collection in one pass; more queries mean more passes.
QUERY_BLOCK = 4096
#: Queries and vectors whose distances stand in memory at once, 8 MB of them.
TILE = 512, 2048
#: Hits that a task gathers before it ranks them anew.
PENDING = 1 << 16


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to length one in double precision, from the array's own buffer; a zero or broken vector becomes NaN.

    All vectors are of one width. A vector that lacks a value matches nothing.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int | None = None, query_id: str = "query_id", vector_id: str = "vec_id",
    settings: Settings = DEFAULT,
) -> DataFrame:
    """(query_id, <vector_id>, distance, rank) of the k nearest rows of each query; 0 or null k is the default.

    A block of queries is broadcast (its size is bounded by QUERY_BLOCK) and multiplied with
    each Arrow batch of vectors, a TILE of both at a time, so that the memory of a task follows from
    neither number. A task keeps the k best per query over all its batches and passes on these alone,
    so what is shuffled for the final ranking does not grow with the vectors.
    Zero vectors and vectors without any value match nothing; ties go by id, which may be of any type.
    """
    k = k or settings.top_k
    spark = vectors.sparkSession
    bounded_batches(spark)
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "size(embedding) > 0"
    )
    source = vectors.select(vector_id, "embedding").where("size(embedding) > 0")
    schema = T.StructType().add("query_id", "long").add(vector_id, vectors.schema[vector_id].dataType).add("distance", "double")
    found = spark.createDataFrame([], schema)
    for block, rows in enumerate(_query_blocks(asked)):
        shared = spark.sparkContext.broadcast(
            (np.array([r["query_id"] for r in rows]), unit_rows(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))))
        )
        near = source.mapInArrow(_best_of_task(shared, k, vector_id), schema)
        found = found.unionByName(near) if block else near
    nearest = Window.partitionBy("query_id").orderBy(F.round("distance", 9), vector_id)
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _query_blocks(asked: DataFrame) -> Iterator[list]:
    """The queries in lists of bounded size: one list, got by one job, where they are few."""
    rows = asked.limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        blocks = -(-asked.count() * 5 // (4 * QUERY_BLOCK))  # dealt by hash, so with some room
        for block in range(blocks):
            if rows := asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect():
                yield rows
    elif rows:
        yield rows


def smallest(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least distances of each row, to nine digits as the ranking has them; of ties the first columns."""
    rounded = np.nan_to_num(np.round(distance, 9), nan=np.inf)
    n = min(k, rounded.shape[1])
    limit = np.partition(rounded, n - 1, axis=1)[:, n - 1 : n]
    row, col = np.nonzero((rounded <= limit) & np.isfinite(rounded))
    order = np.lexsort((col, rounded[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], col[place < n]


def _best_of_task(shared, k: int, vector_id: str):
    def best(row: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
        """Of (query, id, distance) rows the k best a query, ties by id."""
        order = pc.sort_indices(pa.table([pa.array(row), pa.array(np.round(batch.column(1), 9)), batch.column(0)], ["q", "d", "i"]), sort_keys=[("q", "ascending"), ("d", "ascending"), ("i", "ascending")]).to_numpy()
        row = row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], batch.take(pa.array(order[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        names, (some, wide) = ["i", "d"], TILE
        rows, held, found, n = np.zeros(0, np.int64), None, [], 0
        limit = np.full(len(ids), np.inf)  # of each query the k-th distance so far

        def merged() -> None:
            nonlocal rows, held, n
            row = np.concatenate([rows, *(r for r, _ in found)])
            rows, held = best(row, pa.concat_batches([*([held] if held is not None else []), *(b for _, b in found)]))
            full = np.bincount(rows, minlength=len(ids))
            last = np.flatnonzero(full >= k)
            limit[last] = np.round(held.column(1).to_numpy(), 9)[np.cumsum(full)[last] - 1]
            found.clear()
            n = 0

        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))  # so that of ties the first columns have the least ids
            for at in range(0, batch.num_rows, wide):
                part = batch.slice(at, wide)
                v = unit_rows(part.column(1)).T
                for first in range(0, len(ids), some):
                    distance = 1 - q[first : first + some] @ v
                    row, col = np.nonzero(distance <= limit[first : first + some, None] + 1e-9)
                    if len(row) > k * len(distance):
                        row, col = smallest(distance, k)
                    if len(row):
                        found.append((row + first, pa.RecordBatch.from_arrays([part.column(0).take(pa.array(col)), pa.array(distance[row, col])], names)))
                        n += len(row)
                    if n > max(PENDING, len(rows)):
                        merged()
        if found:
            merged()
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), *held.columns], ["query_id", vector_id, "distance"])

    return run


def relevance(distance):
    """1 - distance, to three digits; adding zero turns a negative zero into zero."""
    return F.round(1 - distance, 3) + F.lit(0.0)


def dedupe(hits: DataFrame, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """Of hits with equal stripped text keep the closest. After the top k, so fewer may remain."""
    same = Window.partitionBy(query_id, strip(F.col(text_col))).orderBy("rank")
    return hits.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").drop("_copy")
