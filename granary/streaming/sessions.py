"""Sessions of a stream of events: a user's events with gaps of less than ``gap`` between them.

Events may come in any order, within the watermark's ``delay``. A user's state is the list of sessions
still open, an interval with its sums each; an event joins the sessions that it touches into one. An
event-time timer closes a session once the watermark has passed its end and the gap, when no event
can touch it any more, and only then it goes out. So the result is that of folding all events at
once, whatever their order and however they are dealt to batches. An event older than the watermark
is late and left out. State survives lost executors in the checkpoint.

Defined results for odd input: events without time or user are left out; null values count as zero;
events at one time, and repeated ones, are events each; events just ``gap`` apart are two sessions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP, DELAY = 30, "1 day"  # minutes between sessions; how long an event may be late
SESSION = "user_id long, started timestamp, ended timestamp, n_events long, total double"
MINUTE = 60_000_000  # microseconds
OPEN = "started long, ended long, n long, total double"  # microseconds


def merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions (started, ended, n, total) in order, those less than ``gap`` apart as one."""
    out: list[tuple] = []
    for s in sorted(sessions):
        if out and s[0] - out[-1][1] < gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] + s[3])
        else:
            out.append(s)
    return out


class OpenSessions(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sessions = [tuple(s) for s in self.open.get()]
        for batch in rows:
            at = batch["at"].astype("int64").to_numpy()
            sessions = merged([*sessions, *((int(t), int(t), 1, float(v)) for t, v in zip(at, batch["value"], strict=True))], self.gap)
        self._keep(sessions)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = [tuple(s) for s in self.open.get()]
        done = [s for s in sessions if s[1] + self.gap <= passed]
        self._keep([s for s in sessions if s[1] + self.gap > passed])
        if done:
            started, ended, n, total = zip(*done, strict=True)
            as_time = lambda x: pd.to_datetime(list(x), unit="us")
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "started": as_time(started), "ended": as_time(ended), "n_events": n, "total": total})
        else:
            yield pd.DataFrame()

    def _keep(self, sessions: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if sessions:
            self.open.put(sessions)
            # The next session to close; it is looked at when the watermark has passed it.
            self.handle.registerTimer(-(-(min(s[1] for s in sessions) + self.gap) // 1000))
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def streamed(events: DataFrame, gap: int = GAP, delay: str = DELAY) -> DataFrame:
    """A stream of closed sessions (see SESSION) from a stream of (user_id, ts, value).

    Sets the session's state store to RocksDB, which timers need.
    """
    spark = events.sparkSession
    # The processor is also run beside the driver, where files sent to the tasks are not at hand.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    timed = known.where("user_id is not null and ts is not null").withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("user_id").transformWithStateInPandas(OpenSessions(gap * MINUTE), SESSION, "Append", "EventTime")


def folded(events: DataFrame, gap: int = GAP) -> DataFrame:
    """The sessions (see SESSION) of a table of events."""
    known = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    by_time = Window.partitionBy("user_id").orderBy("ts")
    first = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_time)) >= gap * MINUTE).cast("int"), F.lit(1))
    numbered = known.where("user_id is not null and ts is not null").withColumn("_first", first).withColumn("_session", F.sum("_first").over(by_time))
    return numbered.groupBy("user_id", "_session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"), F.sum("value").alias("total")
    ).drop("_session")
