"""The inverted-file index against a plain ranking: exact mode, recall, filters, copies, odd vectors, bounded groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import ivf, search
from granary.shared import new_folder


def frame(spark, x, labels=None, ids=None):
    rows = [(int(ids[k]) if ids is not None else k, [float(v) for v in r], int(labels[k]) if labels is not None else k % 3) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def plain(x, q, k, allowed=None):
    """{query: [ids]} by distance to nine digits, then id."""
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    d = np.round(1 - unit(np.float32(q).astype(float)) @ unit(np.float32(x).astype(float)).T, 9)
    ids = np.arange(len(x)) if allowed is None else np.flatnonzero(allowed)
    return {n: [int(i) for i in sorted(ids, key=lambda i: (row[i], i))[:k]] for n, row in enumerate(d)}  # noqa: B023


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    return np.float32(centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 24)))


@pytest.fixture(scope="module")
def index(spark, clustered):
    return ivf.VectorIndex.build(frame(spark, clustered), new_folder(spark, "ivf"), partition="label")


def queries(spark, x, every=30):
    return frame(spark, x[::every]).select(F.col("vec_id").alias("query_id"), "embedding")


def test_exact_mode_is_the_plain_ranking(spark, clustered, index):
    assert got(index.search(queries(spark, clustered), 7, target=None)) == plain(clustered, clustered[::30], 7)
    exact = search.top_k(queries(spark, clustered), frame(spark, clustered), 7)
    assert got(exact) == plain(clustered, clustered[::30], 7)


@pytest.mark.parametrize("options,least", [({}, 0.9), ({"quantised": True}, 0.9), ({"target": 0.6}, 0.5)])
def test_recall_and_work(spark, clustered, index, options, least):
    exact = search.top_k(queries(spark, clustered), frame(spark, clustered), 10)
    found = index.search(queries(spark, clustered), 10, **options)
    assert ivf.recall(found, exact).agg(F.avg("recall")).first()[0] >= least
    model = index.model()
    assert model.probes(options.get("target", 0.95)) < len(model.centres) and index.vectors().count() == len(clustered)


def test_codes_are_small_and_near(clustered, index):
    model = index.model()
    assert {len(r["code"]) for r in index.vectors().select("code").distinct().limit(50).collect()} == {16}
    x = clustered / np.linalg.norm(clustered, axis=1, keepdims=True)
    cell = ivf.nearest(x, model.centres)[0]
    tables = model.tables(x[:5].astype(float))
    codes = model.encode(x, cell)
    products = np.stack([tables[q][np.arange(codes.shape[1]), codes].sum(axis=1) + x[q] @ model.centres[cell].T for q in range(5)])
    assert np.abs(products - x[:5] @ x.T).max() < 0.15 and 4 * clustered.shape[1] / 16 == 6


def test_filters_reach_the_scan(spark, clustered, index):
    where = F.col("label") == 1
    allowed = np.arange(len(clustered)) % 3 == 1
    assert got(index.search(queries(spark, clustered), 4, target=None, where=where)) == plain(clustered, clustered[::30], 4, allowed)
    plan = index.vectors(where).where("cell in (3, 4)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan and "PushedFilters: [In(cell, [3,4])]" in plan
    opened = {r[0] for r in index.vectors(where).select("_metadata.file_path").distinct().collect()}
    assert opened and all("label=1" in f for f in opened)


def test_copies_are_one_entry_and_all_rank(spark):
    rng = np.random.default_rng(5)
    x = np.float32(rng.normal(size=(300, 8)))
    x[100:] = x[7]
    x[150] = 2 * x[7]  # another vector of the same direction
    made = ivf.VectorIndex.build(frame(spark, x, labels=np.zeros(300)), new_folder(spark, "copies"), payload=["label"], cells=5)
    assert made.vectors().count() == 101 and made.vectors().agg(F.sum("copies")).first()[0] == 300
    q = frame(spark, x[[7, 7, 3, 120]]).select(F.col("vec_id").alias("query_id"), "embedding")
    want = plain(x, x[[7, 7, 3, 120]], 6)
    assert got(made.search(q, 6, target=None)) == want and want[0] == [7, 100, 101, 102, 103, 104]
    assert got(made.search(q, 6, target=None, quantised=True))[0] == want[0]


def test_blocks_bound_a_task_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = np.float32(rng.normal(size=(200, 6)) * 0.01 + 1)
    made = ivf.VectorIndex.build(frame(spark, x), new_folder(spark, "blocks"), cells=2)
    assert got(made.search(queries(spark, x, 4), 3, target=None)) == plain(x, x[::4], 3)


def test_large_cells_are_split(spark):
    rng = np.random.default_rng(7)
    x = np.float32(np.concatenate([rng.normal(size=(60, 16)), 5 + 0.05 * rng.normal(size=(2400, 16))]))
    made = ivf.VectorIndex.build(frame(spark, x), new_folder(spark, "split"), cells=30)
    sizes = [r["count"] for r in made.vectors().groupBy("cell").count().collect()]
    assert max(sizes) <= 4 * 2460 // 30 * 2 and sum(sizes) == 2460


def test_odd_vectors_match_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [], 0), (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [1.0, 0.1], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    made = ivf.VectorIndex.build(vectors, new_folder(spark, "odd-vectors"), payload=["label"])
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    found = made.search(asked, 5, target=None)
    assert {(r["query_id"], r["vec_id"]) for r in found.collect()} == {(a, b) for a in (1, 8) for b in (1, 8)} and found.count() == 9
    none = ivf.VectorIndex.build(vectors.limit(0), new_folder(spark, "no-vectors"))
    assert none.search(asked).count() == 0 and made.search(asked.limit(0)).count() == 0


def test_least_distances_and_ties():
    d = np.array([[0.5, 0.1, 0.1, 0.1, np.nan], [np.nan] * 5, [0.2, 0.2 + 1e-12, 0.0, 3, 0.2]])
    row, col = search.smallest(d, 2)
    assert list(zip(row.tolist(), col.tolist(), strict=True)) == [(0, 1), (0, 2), (2, 2), (2, 0)]


def test_running_top_k_keeps_k_rows_a_query_and_task(spark):
    rng = np.random.default_rng(8)
    x = np.float32(rng.normal(size=(2000, 8)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        vectors = frame(spark, x).coalesce(2)
        assert got(search.top_k(queries(spark, x, 100), vectors, 5)) == plain(x, x[::100], 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_of_many_cells_only_near_groups_are_compared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "FLAT", 16)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(3000, 8)) + 3 * rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)]
    x = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    centres = ivf.k_means(x, 100, direction=True)
    cells = ivf.Cells(centres)
    assert len(cells.groups) == 10 and sorted(np.concatenate(cells.members)) == list(range(100))
    got, want = cells.of(x), ivf.nearest(x, centres)[0]
    assert (got == want).mean() > 0.9 and ((x * (centres[want] - centres[got])).sum(axis=1) < 0.2).all()
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(m.tolist())], "vec_id long, embedding array<double>").repartition(3)
    index = ivf.VectorIndex.build(vectors, str(tmp_path / "index"), cells=100)
    assert index.vectors().agg({"copies": "sum"}).first()[0] == 3000
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = search.top_k(asked, vectors, 5)
    rows = lambda d: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in d.collect())
    assert rows(index.search(asked, 5, target=None)) == rows(exact)
    assert ivf.recall(index.search(asked, 5), exact).agg({"recall": "avg"}).first()[0] >= 0.9


def test_placing_reads_and_writes_no_more_than_it_needs(spark):
    """Cells are counted without the rows: of a batch only the cells come back."""
    import pyarrow as pa
    from types import SimpleNamespace

    batch = pa.RecordBatch.from_arrays([pa.array([[1.0, 0.0], [0.0, 2.0]])], ["embedding"])
    [got] = ivf._place(SimpleNamespace(value=(ivf.Cells(np.eye(2, dtype=np.float32)), None)), False)(iter([batch]))
    assert got.to_pydict() == {"cell": [0, 1]}
