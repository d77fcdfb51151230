"""Continuous ingest: new text files of a folder are chunked, embedded and merged as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.config import DEFAULT, Settings
from granary.functions.text import basename
from granary.operators.embed import Embedder
from granary.plans.pipeline import ingest
from granary.sources.files import decoded
from granary.sources.store import Collection


def watch_folder(
    spark: SparkSession, folder: str, collection: Collection, embedder: Embedder, checkpoint: str, settings: Settings = DEFAULT,
    once: bool = True,
) -> StreamingQuery:
    """A streaming query over a folder. The merge is keyed by content, so a batch that is sent again changes nothing."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    docs = files.select(decoded(F.col("content")).alias("text"), "path", F.lit("text").alias("file_type")).withColumns({"source": basename(F.col("path")), "ordinal": F.pmod(F.xxhash64("path"), F.lit(1 << 40))})  # texts as in a batch: strict UTF-8, one line end

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(batch, collection, embedder, settings=settings)

    writer = docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
