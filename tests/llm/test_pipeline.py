"""The pipeline's stages on small documents, and the operators' queries against their SQL."""

import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from granary.llm import registry
from tests.llm.test_operators import SCHEMA, brute_components, prose

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with known copies, a leaked item, secrets and junk."""
    rng = np.random.default_rng(12)
    item = ". ".join(prose(rng, 14) for _ in range(2)) + "."
    rows, labels = [], []
    for k in range(320):
        junk = k % 4 == 0
        words = prose(rng, 80).split()
        text = " ".join(w + "$$$" if junk else w for w in words)
        rows.append([k, text])
        if k < 300:
            labels.append((k, int(not junk), 0))
    rows[301][1] = rows[5][1]  # an exact copy
    rows[302][1] = rows[6][1] + " tail"  # a near copy
    rows[303][1] += " " + item
    rows[305][1] += " password = hunter2hunter2"
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows] + [(999, None, None, None, None)], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        out = f"{folder}/out-{name.replace(' ', '-')}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            texts = [(r["doc_id"], r["text"]) for r in before.orderBy("doc_id").collect()]
            roots = brute_components([t for _, t in texts])
            assert kept[name] == {d for k, (d, _) in enumerate(texts) if roots[k][1] == k}
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "secret scans":
            assert docs.where("doc_id = 305").first()["text"].endswith(" [assign]")
    quality = kept["quality classifier"]
    assert len([k for k in range(320) if k % 4 and k in quality]) > 230 and len([k for k in range(320) if k % 4 == 0 and k in quality]) < 8
    assert not kept["n-gram Jaccard join"] & {301, 302} and 303 not in kept["benchmark decontamination"]
    assert kept["secret scans"] == kept["benchmark decontamination"] == kept["best-fit packing"]
    again = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in again.select("doc_id").collect()} == kept["best-fit packing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    flat = lambda f: sorted(tuple("" if x is None or x != x else str(x) for x in row) for row in f[columns].itertuples(index=False))
    assert flat(got) == flat(want)
