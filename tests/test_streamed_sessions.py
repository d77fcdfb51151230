"""Sessions of a stream against the fold of all events: any order, several batches, late events."""

import os
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.streaming import sessions

START = datetime(2024, 1, 1)


def brute(events, gap):
    out = []
    for user in {u for u, _, _ in events if u is not None}:
        own = sorted((t, v or 0.0) for u, t, v in events if u == user and t is not None)
        for t, v in own:
            if out and out[-1][0] == user and t - out[-1][2] < gap:
                u, a, _, n, total = out[-1]
                out[-1] = (u, a, t, n + 1, total + v)
            else:
                out.append((user, t, t, 1, v))
    return sorted((u, a, b, n, round(x, 6)) for u, a, b, n, x in out)


def rows(df):
    return sorted((r["user_id"], r["started"], r["ended"], r["n_events"], round(r["total"], 6)) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 3)), max_size=25), st.randoms())
def test_merging_does_not_depend_on_the_order(pairs, random):
    points = [(t, t, 1, float(v)) for t, v in pairs]
    whole = sessions.merged(points, 5)
    random.shuffle(points)
    held = []
    for p in points:
        held = sessions.merged([*held, p], 5)
    assert held == whole == [(a, b, n, t) for _, a, b, n, t in brute([(0, t, float(v)) for t, v in pairs], 5)]


def test_stream_gives_the_sessions_of_the_fold(spark, tmp_path):
    rng = np.random.default_rng(3)
    events = []
    for k in range(400):  # three batches of four hours; one user has half of the events
        at = START + timedelta(minutes=int(rng.integers(0, 720)), seconds=int(rng.integers(60)))
        events.append((int(rng.integers(1, 8)) if k % 2 else 0, at, float(rng.integers(1, 9)) if k % 9 else None))
    odd = [(None, START, 1.0), (3, None, 1.0), (4, START, 2.0), (4, START, 2.0)]
    folder = tmp_path / "in"
    os.makedirs(folder)
    schema = "user_id long, ts timestamp, value double"
    for n in range(3):
        part = [e for e in events if n * 240 <= (e[1] - START).seconds // 60 < (n + 1) * 240] + (odd if n == 0 else [])
        part += [(9, START + timedelta(days=5), 1.0)] if n == 2 else []  # moves the watermark past all
        rng.shuffle(part)
        spark.createDataFrame([tuple(p) for p in part], schema).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        made = next(p for p in (tmp_path / f"w{n}").iterdir() if p.suffix == ".parquet")
        os.rename(made, folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    def run():
        stream = sessions.streamed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), 30, "5 hours")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return rows(spark.read.schema(sessions.SESSION).parquet(str(tmp_path / "out")))

    want = brute(events + odd, timedelta(minutes=30))
    assert run() == want and len(want) > 30
    assert rows(sessions.folded(spark.createDataFrame(events + odd, schema), 30)) == want
    # Events behind the watermark are late; what is closed stays as it is.
    spark.createDataFrame([(0, START, 100.0), (12, START + timedelta(days=9), 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "w9"))
    os.rename(next(p for p in (tmp_path / "w9").iterdir() if p.suffix == ".parquet"), folder / "9.parquet")
    assert run() == sorted([*want, (9, START + timedelta(days=5), START + timedelta(days=5), 1, 1.0)])
