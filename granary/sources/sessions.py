"""Chat sessions kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<turn:bigint,role:string,text:string>>"


def to_json(messages: DataFrame) -> DataFrame:
    """(conv_id, json): the messages of each session as one JSON array in turn order."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.to_json(said).alias("json"))


def from_json(stored: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text); a corrupt or missing array is an empty session."""
    parsed = F.coalesce(F.from_json("json", MESSAGES), F.array().cast(MESSAGES))
    return stored.select("conv_id", F.inline(parsed))


def save(messages: DataFrame, path: str) -> None:
    to_json(messages).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark.read.parquet(path))
