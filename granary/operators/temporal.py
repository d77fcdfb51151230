"""Joins on time: as of, and within intervals.

``as_of`` gives each left row the last right row at or before its time. Both sides are united,
sorted over all partitions and stored; in each partition the last right row is carried on, and what
a partition carries in from earlier ones comes from one row a key and partition. So neither a key
that a third of the rows share nor the absence of any key brings rows together in one task.

``within`` pairs points with the intervals [start, end) that hold them. An interval lies in one
level of buckets, whose width is its length or up to twice that, so in two buckets at most; a point
looks into its one bucket of each level that occurs, at most 64. Where points share few times, their
times look instead, once each, and points join what their time has found. So they are not shuffled
once a level, and points of one time come one after the other with the same intervals in the same
order, which files store in a small part of the bytes. The rows are all pairs in any case: where
points and intervals both grow over the same span of time, they grow with the product.

Defined results for odd input: a left row with a null time or key, or without any earlier right row,
gets nulls; right rows and intervals with nulls there match nothing; empty intervals hold nothing;
of right rows at one time the greatest in column order is in force. Repeated rows are kept each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.shared import broadcast_if_small, stored

#: Points a time from which ``within`` looks up times instead of points.
SHARED = 4


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """The left columns, and the right ones but ``by``, their names followed by ``suffix``."""
    own = [c for c in right.columns if c not in by]
    keys = [f"_k{n}" for n in range(len(by))]
    known = lambda d, time: d.where(" and ".join(f"`{c}` is not null" for c in [time, *by]))
    later = known(right, right_time).select(
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*own).alias("_r"),
        *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
    )
    asking = left.select(
        F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*own)).schema[0].dataType).alias("_r"),
        *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
    )
    order = [*keys, "_t", "_side", "_r", "_salt"]
    both = asking.unionByName(later).withColumn("_salt", F.monotonically_increasing_id())
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    kept = stored(ranged.withColumn("_part", F.spark_partition_id()), "united")
    inside = Window.partitionBy("_part", *keys).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    carried = kept.withColumn("_near", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    ends = kept.groupBy(*keys, "_part").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = stored(ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(before)["_r"].alias("_brought")).where("_brought is not null"), "carried")
    same = F.col("c._part") == F.col("b._part")
    for k in keys:
        same &= F.col(f"c.{k}") == F.col(f"b.{k}")
    joined = carried.alias("c").join(broadcast_if_small(brought, 1024).alias("b"), same, "left")
    asked = F.lit(True)
    for c in ["_t", *keys]:
        asked &= F.col(f"c.{c}").isNotNull()
    found = F.when(asked, F.coalesce(F.col("c._near"), F.col("b._brought")))
    return joined.select("c._l", found.alias("_found")).select("_l.*", *(F.col("_found")[c].alias(f"{c}{suffix}") for c in own))


def within(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """The columns of both sides, ``by`` once, for every point in an interval. Times are whole numbers or timestamps, to the microsecond.

    ``points`` is read twice: give a stored table.
    """
    whole = points.schema[at].dataType.typeName() in ("long", "integer", "short", "byte")
    number = lambda c: c.cast("long") if whole else F.unix_micros(c.cast("timestamp"))
    left = points.withColumn("_at", number(F.col(at))).where(" and ".join(f"`{c}` is not null" for c in ["_at", *by]))
    right = intervals.withColumns({"_start": number(F.col(start)), "_end": number(F.col(end))})
    right = right.where(F.col("_start") < F.col("_end")).where(" and ".join(f"`{c}` is not null" for c in ["_start", "_end", *by]))
    level = F.ceil(F.log2((F.col("_end") - F.col("_start")).cast("double"))).cast("int")
    right = stored(right.withColumn("_level", F.greatest(level, F.lit(0))), "intervals")
    levels = [r["_level"] for r in right.select("_level").distinct().collect()]  # at most 64
    times = stored(left.groupBy(*by, "_at").agg(F.count("*").alias("_n")), "times")
    n_times, n_points = times.agg(F.count("*"), F.sum("_n")).first()
    shared = n_times * SHARED <= (n_points or 0)
    looking = times.drop("_n") if shared else left
    looking = looking.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", F.expr("shiftright(_at, _level)"))
    spans = right.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.expr("shiftright(_start, _level)"), F.expr("shiftright(_end - 1, _level)")))))
    met = looking.join(spans, [*by, "_level", "_bucket"]).where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end")))
    met = met.drop("_start", "_end", "_level", "_bucket")
    if shared:
        met = left.join(met.hint("merge"), [*by, "_at"])  # sorted by time on both sides, never broadcast
    return met.drop("_at")
