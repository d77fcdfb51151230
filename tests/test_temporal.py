"""Joins on time against a plain loop: hot keys, no key, ties, nulls, many partitions."""

import numpy as np
import pytest

from granary.operators import temporal

EVENTS, STATES = "event long, key string, at long, n string", "key string, since long, state string, event long"


def brute_as_of(events, states, keyed):
    out = []
    for e, key, at, _ in events:
        there = [(s, state, x) for k, s, state, x in states if s is not None and at is not None and s <= at and (not keyed or (k is not None and k == key))]
        out.append((e, *(max(there)[:2] if there else (None, None))))
    return sorted(out)


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_as_of(spark, keyed, partitions):
    rng = np.random.default_rng(1)
    keys = ["hot"] * 6 + ["a", "b", None]
    events = [(k, keys[rng.integers(9)], int(rng.integers(0, 60)) if k % 17 else None, "x") for k in range(300)]
    states = [(keys[rng.integers(9)], int(rng.integers(10, 60)) if k % 13 else None, f"s{k}", k) for k in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left, right = spark.createDataFrame(events, EVENTS).repartition(3), spark.createDataFrame(states, STATES)
        right = right if keyed else right.drop("key")
        got = temporal.as_of(left, right, "at", "since", ["key"] if keyed else [], suffix="_then")
        state, since = ("state_then", "since_then")
        assert sorted(((r["event"], r[since], r[state]) for r in got.collect()), key=lambda r: r[0]) == brute_as_of(events, states, keyed)
        assert temporal.as_of(left, right.limit(0), "at", "since", ["key"] if keyed else []).where("state is not null").count() == 0
        assert temporal.as_of(left.limit(0), right, "at", "since").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_within(spark):
    rng = np.random.default_rng(2)
    keys = ["hot"] * 5 + ["a", None]
    points = [(k, keys[rng.integers(7)], int(rng.integers(-500, 500)) if k % 19 else None) for k in range(250)]
    spans = []
    for k in range(80):
        start = int(rng.integers(-600, 500))
        spans.append((k, keys[rng.integers(7)], start, start + int(2 ** rng.uniform(-1, 10)) if k % 11 else None))
    left, right = spark.createDataFrame(points, "p long, key string, at long"), spark.createDataFrame(spans, "s long, key string, a long, b long")
    want = lambda keyed: sorted((p, s) for p, k, at in points for s, q, a, b in spans if at is not None and b is not None and a <= at < b and (not keyed or (k is not None and k == q)))
    assert sorted((r["p"], r["s"]) for r in temporal.within(left, right, "at", "a", "b", ["key"]).collect()) == want(True)
    bare = temporal.within(left.drop("key"), right.drop("key"), "at", "a", "b")
    assert sorted((r["p"], r["s"]) for r in bare.collect()) == want(False) and want(False)
    assert temporal.within(left, right.limit(0), "at", "a", "b", ["key"]).count() == 0


def test_within_takes_timestamps(spark):
    points = spark.sql("SELECT 1 AS p, timestamp'2024-01-01 10:00:00' AS at UNION ALL SELECT 2, timestamp'2024-01-01 11:00:00'")
    spans = spark.sql("SELECT 'x' AS s, timestamp'2024-01-01 09:00:00' AS a, timestamp'2024-01-01 11:00:00' AS b")
    assert [(r["p"], r["s"]) for r in temporal.within(points, spans, "at", "a", "b").collect()] == [(1, "x")]


def test_intervals_lie_in_two_buckets_at_most(spark):
    spans = spark.createDataFrame([(k, 0, 1 << k) for k in range(40)] + [(99, 5, 1_000_000_007)], "s long, a long, b long")
    points = spark.createDataFrame([(1, 6), (2, 1 << 20)], "p long, at long")
    got = sorted((r["p"], r["s"]) for r in temporal.within(points, spans, "at", "a", "b").collect())
    assert got == sorted([(1, k) for k in range(3, 40)] + [(2, k) for k in range(21, 40)] + [(1, 99), (2, 99)])
    plan = temporal.within(points, spans, "at", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan


def test_points_that_share_times_are_stored_in_few_bytes(spark, tmp_path):
    """All pairs of 20,000 points at 50 times and 1,000 intervals; in the points' order they take over a byte a pair."""
    points = spark.range(20_000).selectExpr("id AS p", "CAST(xxhash64(id) % 2 AS string) AS key", "pmod(xxhash64(id, 1), 50) AS at")
    spans = spark.range(1_000).selectExpr("id AS s", "CAST(xxhash64(id) % 2 AS string) AS key", "pmod(xxhash64(id, 2), 50) AS a").selectExpr("*", "a + s % 23 AS b")
    got = temporal.within(points, spans, "at", "a", "b", ["key"])
    assert got.columns == ["key", "p", "at", "s", "a", "b"]
    got.select("p", "s").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    want = points.alias("p").join(spans.alias("s"), "key").where("at >= a AND at < b").select("p", "s")
    n = want.count()
    assert n > 1_000_000 and pairs.count() == n and pairs.exceptAll(want).isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < n // 2
