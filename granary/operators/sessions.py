"""Chat sessions folded from message rows, and the coordinates of a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.config import DEFAULT, Settings
from granary.functions.text import title
from granary.operators.assemble import in_order


def fold_sessions(messages: DataFrame, settings: Settings = DEFAULT, time_col: str | None = None) -> DataFrame:
    """One row per conv_id: title of the first user turn, number of messages, the transcript in turn order.

    With ``time_col``, a timestamp of every message, also ``updated_ms``: the last one's epoch milliseconds.
    """
    updated = [F.max(F.unix_millis(F.col(time_col).cast("timestamp"))).alias("updated_ms")] if time_col else []
    said = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(
        F.coalesce(title(first, settings.title), F.lit("")).alias("title"), F.count("*").alias("n_messages"),
        F.max("turn").alias("last_turn"), F.array_join(in_order(said, F.col("turn")), "\n").alias("transcript"), *updated,
    )


def newest_first(sessions: DataFrame) -> DataFrame:
    """Sessions in the order of the list: the latest created on top."""
    return sessions.orderBy(F.col("conv_id").desc())


def selected(sessions: DataFrame, conv_id: int) -> DataFrame:
    """The session of an id: one row, or none."""
    return sessions.where(F.col("conv_id") == conv_id)


def without(sessions: DataFrame, conv_id: int) -> DataFrame:
    return sessions.where(F.col("conv_id") != conv_id)


def without_all(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Sessions but those of a table of ids (conv_id)."""
    return sessions.join(ids.select("conv_id").distinct(), "conv_id", "left_anti")


def chart_points(
    points: DataFrame, chart: str, position: str, value: str, width: float = 800.0, height: float = 200.0, above: float = 20.0, below: float = 40.0
) -> DataFrame:
    """Add x, evenly spaced by position (a lone point in the middle), and y, scaled to the chart's largest value or 1."""
    whole, ordered = Window.partitionBy(chart), Window.partitionBy(chart).orderBy(position)
    n, k = F.count("*").over(whole), F.row_number().over(ordered) - 1
    top = F.greatest(F.max(value).over(whole), F.lit(1.0))
    plot = height - above - below
    return points.withColumns({
        "x": F.when(n == 1, F.lit(width / 2)).otherwise(F.try_divide(k.cast("double"), n - 1) * F.lit(width)),
        "y": F.lit(above + plot) - F.col(value) / top * F.lit(plot),
    })
