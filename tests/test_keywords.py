"""Keyword tables against a search for each keyword; sketches against exact figures; files that Spark's listing leaves out."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import assemble, chunk, keywords, sketches
from granary.plans import pipeline
from granary.shared import new_folder
from granary.sources import files
from granary.sources.store import Collection

TABLE = "ord int, keyword string, phrase string"


def brute(text, table):
    if text is None:
        return None
    low = text.lower()
    return " ".join([text, *(p for _, k, p in sorted(t for t in table if t[1] is not None and t[2] is not None) if k in low)])


@pytest.mark.parametrize("limit", [keywords.SHARD_BYTES, 60])
def test_every_keyword_is_found_once_in_order(spark, limit):
    table = [(2, "sale", "S"), (1, "sales", "T"), (1, "ale", "A"), (3, "é", "E"), (0, "", "every"), (5, "x", None), (6, None, "y"), (2, "sale", "again"), (9, "日本", "J"), (4, "r&d", "R")]
    texts = ["Sales rise", "pale É 日本語", "", None, "R&D", "nothing", "SALE sale SALES"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0]])] + [(None, "sale")], "row long, text string")
    got = keywords.expanded_by(rows.withColumn("keyword", F.lit("own")), spark.createDataFrame(table, TABLE), limit=limit)
    assert got.columns == ["row", "text", "keyword", "expanded"]
    assert sorted((r["text"] or "", r["expanded"] or "") for r in got.collect()) == sorted((t or "", brute(t, table) or "") for t in [*texts, texts[0], "sale"])
    assert keywords.expanded_by(rows, spark.createDataFrame([], TABLE)).where("expanded <> text").count() == 0
    assert keywords.expanded_by(rows.limit(0), spark.createDataFrame(table, TABLE)).count() == 0


def test_a_hundred_thousand_keywords(spark):
    table = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("k"), F.conv(F.col("id"), 10, 36), F.lit("z")).alias("keyword"), F.col("id").cast("string").alias("phrase"))
    table = table.withColumn("keyword", F.lower("keyword"))
    texts = spark.createDataFrame([(1, " ".join(f"K{np.base_repr(n, 36)}Z" for n in range(0, 100_000, 997)))], "id long, text string")
    got = keywords.expanded_by(texts, table).first()["expanded"]
    assert got.split("Z ")[-1].split(" ")[-1] == str(max(range(0, 100_000, 997)))
    joined = table.join(texts, F.expr("contains(lower(text), keyword)")).select("phrase").collect()
    assert sorted(got[len(texts.first()["text"]) :].split()) == sorted(r["phrase"] for r in joined)


def test_sketches_are_near_the_exact_figures(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("v"), (F.col("id") / 60).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(7, None, None), (None, 1, 1.0)], "g long, v long, x double"))
    kept = sketches.SketchTable(spark, new_folder(spark, "sketch-test"), ["g"])
    with pytest.raises(ValueError):
        kept.totals()
    for n in range(4):
        assert kept.append(f"b-{n}", rows.where(F.coalesce(F.pmod(F.hash("x"), F.lit(4)), F.lit(0)) == n), "v", "x")
    assert not kept.append("b-1", rows, "v", "x")
    exact = {r["g"]: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.expr("percentile(x, 0.5)").alias("m")).collect()}
    got = {r["g"]: r for r in kept.totals().collect()}
    assert set(got) == set(exact) == {0, 1, 2, 7, None}
    for g, r in got.items():
        assert r["n"] == exact[g]["n"] and abs(r["n_different"] - exact[g]["d"]) <= 0.07 * exact[g]["d"]
        assert r["q50"] is None if exact[g]["m"] is None else abs(r["q50"] - exact[g]["m"]) <= 40
    whole = kept.totals(by=[]).first()
    assert whole["n"] == 60_002 and abs(whole["n_different"] - 9000) < 600


def test_dot_underscore_and_empty_files_are_documents(spark, tmp_path):
    for name, content in (("b.txt", "plain"), (".a.txt", "dot é"), ("_c.TXT", "under"), ("empty.txt", ""), ("_p.pdf", "p1|p2"), ("_SUCCESS", ""), (".b.txt.crc", "x"), ("d.md", "no")):
        (tmp_path / name).write_text(content)
    (tmp_path / "sub.txt").mkdir()
    parse = lambda b: b.decode().split("|")
    got = files.scan_folder(spark, str(tmp_path), parse).orderBy("ordinal").collect()
    assert [(r["source"], r["text"]) for r in got] == [(".a.txt", "dot é"), ("_c.TXT", "under"), ("_p.pdf", "p1"), ("_p.pdf", "p2"), ("b.txt", "plain"), ("empty.txt", "")]
    assert {r["path"].rsplit("/", 1)[0] for r in got} == {f"file:{tmp_path}"} and [r["ordinal"] for r in got] == list(range(6))
    named = files.scan_files(spark, [str(tmp_path / n) for n in ("_SUCCESS", "d.md", ".a.txt")]).orderBy("ordinal").collect()
    assert [(r["source"], r["text"]) for r in named] == [(".a.txt", "dot é"), ("_SUCCESS", ""), ("d.md", "no")]
    only = tmp_path / "only"
    only.mkdir()
    (only / "_x.txt").write_text("hidden")
    assert [r["text"] for r in files.documents_from(spark, None, str(only), str(tmp_path)).collect()] == ["hidden"]


def test_fixed_chunks_are_linear_and_whole(spark):
    raw = [("é😀\n" * 700, 1), ("", 2), (None, 3), ("x" * 400, 4), ("y" * 401, 5)]
    docs = spark.createDataFrame(raw, "text string, id long").withColumn("pos", F.lit("other"))
    got = {}
    for r in chunk.fixed_chunks(docs.drop("pos")).collect():
        got.setdefault(r["id"], []).append((r["pos"], r["text"], r["chunk_size"]))
    for text, k in raw:
        assert sorted(got.get(k, [])) == [(n, text[at : at + 400], len(text[at : at + 400])) for n, at in enumerate(range(0, len(text or ""), 400))]

    def seconds(n):
        long = spark.range(1).select(F.repeat(F.lit("ab é "), n).alias("text"))
        began = time.monotonic()
        assert chunk.fixed_chunks(long).agg(F.sum("chunk_size")).first()[0] == 5 * n
        return time.monotonic() - began

    seconds(1000)
    assert seconds(1_600_000) < 20  # 8 M characters


def test_an_ingest_reports_every_source(spark, tmp_path):
    docs = spark.range(1500).select(F.col("id").alias("ordinal"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("f"), "id").alias("source"))
    report = pipeline.ingest(docs, Collection(spark, str(tmp_path)), lambda texts: [[1.0] for _ in texts])
    assert len(report["sources"]) == 1500 and report["source_table"].count() == 1500 and report["message"].startswith("1500 chunks from 1500")
    assert assemble.distinct_sources(docs).count() == 1500
