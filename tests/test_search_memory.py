"""The k best of a task: memory that follows from neither the queries nor the vectors, results those of one sort."""

import os
import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from granary import queries
from granary.operators import search


def batches(m, ids, size):
    for at in range(0, len(m), size):
        part = m[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + size]), pa.array(part.tolist(), pa.list_(pa.float32()))], ["vec_id", "embedding"])


def best_of_task(q, m, ids, k, size):
    shared = SimpleNamespace(value=(np.arange(len(q)) * 7, q))
    return [r for b in search._best_of_task(shared, k, "vec_id")(batches(m, ids, size)) for r in zip(*b.to_pydict().values(), strict=True)]


def peak_mb(q, m, k):
    [batch] = batches(m, list(range(len(m))), len(m))
    run = search._best_of_task(SimpleNamespace(value=(np.arange(len(q)), q)), k, "vec_id")
    tracemalloc.start()
    got = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == k * len(q)
    return peak >> 20


def test_memory_of_a_task_does_not_follow_the_queries():
    rng = np.random.default_rng(0)
    m, q = rng.normal(size=(10_000, 4)).astype(np.float32), rng.normal(size=(search.QUERY_BLOCK, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    assert peak_mb(q, m, 5) < 120  # one matrix of all distances has 312 MB


def test_memory_of_a_task_does_not_follow_the_vectors():
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(60_000, 4)).astype(np.float32), search.unit_rows(pa.array(rng.normal(size=(512, 4)).tolist()))
    assert peak_mb(q, m, 5) < 120  # one matrix of all distances has 245 MB


def test_memory_of_a_task_when_every_vector_is_nearer_than_the_last():
    angle = np.linspace(3, 0.5, 10_000)
    m, q = np.stack([np.cos(angle), np.sin(angle)], axis=1).astype(np.float32), np.tile([[1.0, 0.0]], (search.QUERY_BLOCK, 1))
    assert peak_mb(q, m, 5) < 120


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("order", ["near first", "far first", "mixed"])
def test_tiles_give_what_one_sort_gives(monkeypatch, k, order):
    """Many ties, few values and zero vectors, however tiles and batches fall and whenever hits are ranked anew."""
    monkeypatch.setattr(search, "TILE", (3, 5))
    monkeypatch.setattr(search, "PENDING", 4)
    rng = np.random.default_rng(3)
    m, q = rng.integers(-2, 3, size=(150, 3)).astype(np.float32), search.unit_rows(pa.array(rng.normal(size=(8, 3)).tolist()))
    v = search.unit_rows(pa.array(m.tolist(), pa.list_(pa.float32())))
    near = np.nan_to_num(q[0] @ v.T, nan=-2)
    at = {"near first": np.argsort(-near), "far first": np.argsort(near), "mixed": np.arange(150)}[order]
    m, v, ids = m[at], v[at], rng.permutation(150).tolist()
    got = best_of_task(q, m, ids, k, 17)
    for n in range(8):
        d = 1 - q[n] @ v.T
        want = sorted((round(float(x), 9), i) for x, i in zip(d, ids, strict=True) if not np.isnan(x))[:k]
        assert sorted((round(x, 9), i) for a, i, x in got if a == n * 7) == want


def status(pid, field):
    return int(re.search(rf"\n{field}:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1])


def workers(field):
    """MB of a field of the status of each Python worker below this process."""
    found = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                above = int(p.name)
                while above > 1 and above != os.getpid():
                    above = status(above, "PPid")
                if above > 1:
                    found[p] = status(p.name, field) >> 10
        except (OSError, TypeError):  # a worker may end meanwhile
            pass
    return found


def vectors_in_files(folder, rng, files, rows):
    (folder / "embeddings.parquet").mkdir(parents=True)
    for n in range(files):
        m = rng.normal(size=(rows, 4)).astype(np.float32)
        pq.write_table(
            pa.table({"vec_id": np.arange(n * rows, (n + 1) * rows), "embedding": pa.array(m.tolist(), pa.list_(pa.float32()))}),
            folder / f"embeddings.parquet/part-{n}.parquet",
        )
    return str(folder)


@pytest.mark.parametrize("name", ["relevance_scores", "vector_top_k_zero_uses_default"])
def test_workers_of_a_query_on_many_vectors(spark, tmp_path, name):
    """The workers of the whole query on 80,000 vectors, 1,600 of them queries, against the same workers on 400."""
    rng = np.random.default_rng(2)
    few, many = vectors_in_files(tmp_path / "few", rng, 4, 100), vectors_in_files(tmp_path / "many", rng, 4, 20_000)
    assert queries.QUERIES[name](spark, few).count() == 5 * 8
    before = workers("VmRSS")
    for p in before:
        (p / "clear_refs").write_text("5")  # the peak counts from here
    assert len(queries.QUERIES[name](spark, many).collect()) == 5 * 1600
    grown = [mb - before.get(p, max(before.values())) for p, mb in workers("VmHWM").items()]
    assert max(grown) < 120  # one matrix of all queries and a batch has 122 MB, and several stood at once
