"""The collection's log: racing writers, conflicts, older versions, merges of deltas, and which files a lookup opens."""

import threading

import pytest
from pyspark.sql import functions as F

from granary.sources import store as module
from granary.sources.store import Collection, Conflict


def rows(spark, pairs):
    return spark.createDataFrame([(i, f"t{i}", "s", n, 1, {}, [1.0]) for i, n in pairs], module.SCHEMA)


def content(df):
    return {r["chunk_id"]: r["chunk_index"] for r in df.collect()}


def test_racing_writers_each_get_a_number(spark, tmp_path):
    at_once, failed = threading.Barrier(4), []

    def write(k):
        try:
            own = Collection(spark, str(tmp_path))
            for n in range(2):
                at_once.wait(60)
                own.upsert(rows(spark, [(f"w{k}-{n}", n), ("shared", 10 * k + n)]))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    kept = Collection(spark, str(tmp_path))
    assert not failed and kept.commits() == list(range(1, kept.commits()[-1] + 1)) and len(kept.commits()) >= 8
    got = content(kept.read())
    assert set(got) == {"shared", *(f"w{k}-{n}" for k in range(4) for n in range(2))} and got["shared"] % 10 == 1


def test_a_number_is_given_once(spark, tmp_path):
    kept = Collection(spark, str(tmp_path))
    kept.upsert(rows(spark, [("a", 1)]))
    results = []
    threads = [threading.Thread(target=lambda k=k: results.append(kept._put_if_absent(2, {"number": 2, "writer": k, "parts": []}))) for k in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(results) == [False] * 5 + [True] and kept.commits() == [1, 2] and kept._commit(2)["writer"] in range(6)


def test_expected_version(spark, tmp_path):
    kept = Collection(spark, str(tmp_path))
    kept.upsert(rows(spark, [("a", 1)]), expected=0)
    kept.upsert(rows(spark, [("b", 1)]), expected=1)
    with pytest.raises(Conflict):
        kept.upsert(rows(spark, [("a", 9)]), expected=1)
    assert content(kept.read()) == {"a": 1, "b": 1}
    data = tmp_path / kept.name / "data"
    assert len([p for p in data.iterdir() if p.is_dir()]) == 2  # the refused write left nothing


def test_older_versions_and_merges_of_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "COMPACT", 2)
    kept, want, seen = Collection(spark, str(tmp_path), buckets=4), {}, {}
    kept.upsert(rows(spark, [(f"base{k}", k) for k in range(60)]))
    want |= {f"base{k}": k for k in range(60)}
    for n in range(5):
        batch = [(f"base{n}", 100 + n), (f"new{n}", n)]
        want |= dict(batch)
        before = kept.commits()[-1]
        kept.upsert(rows(spark, batch))
        seen[before + 1] = dict(want)
        assert content(kept.read()) == want
    for version, state in seen.items():
        assert content(kept.read(version)) == state
    assert kept.versions() == [1] and len(kept.deltas()) < 3  # small deltas are merged with each other only
    assert kept.history().agg(F.sum("n_rows_written")).first()[0] < 60 + 4 * 10
    kept.upsert(rows(spark, [(f"more{k}", k) for k in range(40)]))
    assert len(kept.versions()) == 2 and kept.deltas() == []
    kept.vacuum(1)
    assert content(kept.read()) == want | {f"more{k}": k for k in range(40)}
    with pytest.raises(ValueError):
        kept.read(1)


def test_a_compaction_keeps_what_was_added_meanwhile(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "COMPACT", 100)
    kept = Collection(spark, str(tmp_path))
    for n in range(3):
        kept.upsert(rows(spark, [("a", n), (f"x{n}", n)]))
    write, other = kept._write, Collection(spark, str(tmp_path))

    def slowly(*args):
        folder = write(*args)
        kept._write = write
        other.upsert(rows(spark, [("a", 50), ("late", 1)]))
        return folder

    kept._write = slowly
    assert kept.compact() == 5
    assert content(kept.read()) == {"a": 50, "x0": 0, "x1": 1, "x2": 2, "late": 1}

    def overtaken(*args):
        folder = write(*args)
        kept._write = write
        assert other.compact()
        return folder

    kept._write = overtaken
    assert kept.compact() == 0 and content(kept.read())["late"] == 1


def test_a_lookup_opens_only_the_files_of_its_keys(spark, tmp_path):
    kept = Collection(spark, str(tmp_path), buckets=16)
    kept.upsert(rows(spark, [(f"k{n}", n) for n in range(400)]))
    kept.upsert(rows(spark, [("k7", 1000), ("other", 1)]))
    asked = spark.createDataFrame([("k7",), ("k8",), ("none",), ("k7",), (None,)], "chunk_id string")
    found = kept.lookup(asked)
    assert content(found) == {"k7": 1000, "k8": 8}
    everything = {f for p in kept._parts() for f in kept._rows(p).inputFiles()}
    assert len(everything) >= 15
    touched = {r["b"] for r in asked.select(module.bucket_of(F.col("chunk_id"), 16).alias("b")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    opened = {r["f"] for p in kept._parts() for r in kept._rows(p, sorted(touched)).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert len(opened) <= 2 * len(touched) < len(everything)
    assert content(kept.lookup(asked, version=1)) == {"k7": 7, "k8": 8}
