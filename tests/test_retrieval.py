import math

import pytest
from pyspark.sql import functions as F

from granary.functions import metadata, text
from granary.operators import answer, assemble, chunk, embed, expand, search, sessions
from granary.plans import pipeline
from granary.sources import files
from granary.sources import sessions as session_store
from granary.sources.store import Collection, health, stats
from granary.streaming.ingest import watch_folder

EMBEDDER = embed.HashingEmbedder(64)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw", [" a b ", " x ", "\x1cy\x1f", "", "   ", "\x85z", "é"])
def test_strip_is_unicode_strip(spark, raw):
    assert one(spark, raw, text.strip) == raw.strip()


def test_small_text_functions(spark):
    assert one(spark, "a/b\\c.txt", text.basename) == "c.txt"
    assert one(spark, "x" * 41, text.title) == "x" * 40 + "…"
    assert one(spark, " short ", text.title) == "short"
    assert one(spark, "a\n\n\nb\nc", text.paragraphs) == [["a"], ["b", "c"]]
    assert one(spark, 0.125, text.percent, "double") == 13
    assert [one(spark, v, text.percent, "double") for v in (0.0, -1.0, math.nan, math.inf, None)] == [None] * 5
    assert one(spark, {"a": None, "b": "1"}, metadata.sanitised, "map<string,string>") == {"a": "", "b": "1"}
    assert one(spark, "t", metadata.content_id) == one(spark, "t", metadata.content_id)


TEXTS = ["", "   ", "short", "a" * 1000, "para one.\n\n" * 90, "word " * 300, "Sentence here. " * 80 + "b" * 900, "\n\n" + "x y. " * 200 + "\n\nend"]


@pytest.mark.parametrize("raw", TEXTS)
def test_chunks_cover_the_text(raw):
    parts = chunk.packed(raw)
    assert all(1 <= len(c) <= 400 and c in raw for c in parts)
    at = -1
    for c in parts:
        found = raw.find(c, at + 1)
        assert found > at or raw.count(c) > 1
        at = max(at, found)
    assert set("".join(parts)) >= {c for c in raw if not c.isspace()}
    assert "".join(chunk.pieces(raw, ("\n\n", "\n", ". ", " ", ""), 400)) == raw


def test_chunk_frame(spark):
    docs = spark.createDataFrame([(0, "b" * 900, "x"), (5, "", "y"), (70_000, "hello", None), (70_001, None, None)], "ordinal long, text string, source string")
    got = chunk.with_ordinals(chunk.split_documents(docs), "ordinal").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and got[-1]["text"] == "hello"
    assert all(r["chunk_size"] == len(r["text"]) for r in got)
    row = chunk.chunk_stats(chunk.split_documents(docs)).first()
    assert row["total_chunks"] == len(got) and row["min_size"] <= row["avg_size"] <= row["max_size"]
    assert set(chunk.chunk_stats(chunk.split_documents(docs.limit(0))).first()) == {0}


def test_top_k_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 7)).round(2)
    m[5] = 0
    rows = [(k, v) for k, v in enumerate(m.tolist())] + [(900, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = vectors.where("vec_id < 4 or vec_id = 900").withColumnRenamed("vec_id", "query_id")
    got = search.top_k(asked, vectors, 3).collect()
    unit = m / np.where(np.linalg.norm(m, axis=1) == 0, np.nan, np.linalg.norm(m, axis=1))[:, None]
    for q in range(4):
        want = sorted((round(1 - float(unit[q] @ unit[k]), 9), k) for k in range(300) if k != 5)[:3]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [k for _, k in want]
    assert len(got) == 12
    assert search.top_k(asked, vectors, 0).count() == 20 and search.top_k(asked, vectors.limit(0), 3).count() == 0
    assert search.top_k(asked.limit(0), vectors, 3).count() == 0 and search.top_k(asked, vectors, 1000).count() == 4 * 299


def test_top_k_in_blocks_of_queries(spark, monkeypatch):
    import numpy as np

    rows = [(k, v) for k, v in enumerate(np.random.default_rng(2).normal(size=(40, 5)).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("name", F.concat(F.lit("v"), F.col("vec_id")))
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    found = lambda: sorted((r["query_id"], r["rank"], r["name"]) for r in search.top_k(asked, vectors, 3, vector_id="name").collect())
    whole = found()
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert found() == whole and len(whole) == 120


def test_dedupe_expand_and_assemble(spark):
    hits = spark.createDataFrame(
        [(1, 1, 0.1, "a ", "s"), (1, 2, 0.2, " a", "t"), (1, 3, 0.3, "b", None)], "query_id long, rank int, distance double, text string, source string"
    )
    kept = search.dedupe(hits)
    assert sorted(r["rank"] for r in kept.collect()) == [1, 3]
    assert assemble.context(kept).first()["context"] == "Source: s\na \n\nSource: unknown\nb"
    assert assemble.framed_context(kept).first()["context"].endswith("b\n---")
    assert [s["relevance_score"] for s in assemble.sources(hits).first()["sources"]] == [0.9, 0.8, 0.7]
    assert one(spark, "Total Revenue", expand.expanded) == "Total Revenue total net sales net sales"
    assert one(spark, "hello", expand.expanded) == "hello" and one(spark, None, expand.expanded) is None
    total = assemble.summary(spark.createDataFrame([(2, "ab", "x"), (1, "c", "y"), (3, None, None), (4, "d", "")], "o long, text string, source string"), "o").first()
    assert (total["total_documents"], total["total_chars"], total["sources"]) == (4, 4, ["y", "x"])


def test_files(spark, tmp_path):
    raw, samples = tmp_path / "raw", tmp_path / "samples"
    raw.mkdir(), samples.mkdir()
    (samples / "b.TXT").write_bytes("one\r\ntwo é".encode())
    (samples / "a.txt").write_text("first")
    (samples / "c.md").write_text("not read")
    (samples / "d.pdf").write_bytes(b"p1|p2")
    parse = lambda b: b.decode().split("|")
    got = files.documents_from(spark, [], str(raw), str(samples), parse).orderBy("ordinal").collect()
    assert [(r["source"], r["text"], r["file_type"]) for r in got] == [
        ("a.txt", "first", "text"), ("b.TXT", "one\ntwo é", "text"), ("d.pdf", "p1", "pdf"), ("d.pdf", "p2", "pdf")
    ]
    (raw / "z.txt").write_text("raw")
    assert [r["source"] for r in files.documents_from(spark, None, str(raw), str(samples)).collect()] == ["z.txt"]
    assert [r["text"] for r in files.documents_from(spark, [str(samples / "c.md")], str(raw), str(samples)).collect()] == ["not read"]
    assert files.scan_folder(spark, str(tmp_path / "none")).count() == 0
    (raw / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="MALFORMED"):
        files.scan_folder(spark, str(raw)).collect()


def test_ingest_ask_and_reset(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "store"))
    assert not store.ready() and stats(store.read()).first()["total_documents"] == 0
    assert [health(store.read(), mode=m).first()["ready"] for m in ("rag", "dummy", "what")] == [False, True, True]
    with pytest.raises(RuntimeError):
        pipeline.ask(spark, "anything", store, EMBEDDER, answer.Extractive(), "rag")
    docs = spark.createDataFrame(
        [(0, "The total net sales were 394 million. Costs rose.", "f.txt"), (1, "Cats sleep all day long.", "g.txt"), (2, "Cats sleep all day long.", "h.txt")],
        "ordinal long, text string, source string",
    )
    report = pipeline.ingest(docs, store, EMBEDDER)
    assert report["chunks_added"] == 3 and report["sources"] == ["f.txt", "g.txt", "h.txt"] and store.read().count() == 2
    assert {r["source"] for r in store.read().collect()} == {"f.txt", "h.txt"}
    assert pipeline.ingest(docs, store, EMBEDDER)["chunks_added"] == 3 and store.read().count() == 2
    got = pipeline.ask(spark, " what is the revenue? ", store, EMBEDDER, answer.Extractive(), "rag")
    assert got["context_chunks"] == 2 and got["sources"][0]["filename"] == "f.txt" and got["question"] == "what is the revenue?"
    assert pipeline.ask(spark, "x", store, EMBEDDER, answer.Extractive())["model"] == "dummy"
    for bad in ("", "   ", "x" * 501):
        with pytest.raises(ValueError):
            pipeline.ask(spark, bad, store, EMBEDDER, answer.Extractive())
    store.vacuum(1)
    assert len(store.versions()) == 1
    assert store.drop()["status"] == "cleared" and not store.ready()


def test_failed_embedding_stores_nothing(spark, tmp_path):
    def broken(texts):
        raise OSError("no service")

    store = Collection(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([(0, "text", "a")], "ordinal long, text string, source string")
    with pytest.raises(Exception, match="no service"):
        pipeline.ingest(docs, store, broken)
    assert not store.ready()


def test_embed_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    class Counting:
        def __call__(self, texts):
            assert len(texts) <= 100
            sizes.add(1)
            return [[float(len(t))] for t in texts]

    rows = spark.range(250).select("id", F.repeat(F.lit("a"), F.col("id").cast("int")).alias("text")).coalesce(1)
    got = embed.embed(rows, Counting()).collect()
    assert all(r["embedding"] == [float(r["id"])] for r in got) and sizes.value == 3


def test_sessions(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", " ask "), (2, 0, "system", "s")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in sessions.fold_sessions(messages).collect()}
    assert got[1]["title"] == "ask" and got[1]["transcript"] == "user:  ask \nassistant: hi" and got[2]["title"] == ""
    assert [r["conv_id"] for r in sessions.newest_first(sessions.fold_sessions(messages)).collect()] == [2, 1]
    assert sessions.without(sessions.fold_sessions(messages), 2).count() == 1
    broken = spark.createDataFrame([(1, "{oops"), (2, None), (3, '[{"turn":0,"role":"user","text":"x"}]')], "conv_id long, json string")
    assert [r["conv_id"] for r in session_store.from_json(broken).collect()] == [3]
    point = spark.createDataFrame([(1, 0, 5.0), (2, 0, 0.0), (2, 1, 4.0)], "c int, p int, v double")
    assert [(r["x"], r["y"]) for r in sessions.chart_points(point, "c", "p", "v").orderBy("c", "p").collect()] == [(400.0, 20.0), (0.0, 160.0), (800.0, 20.0)]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("alpha text")
    store = Collection(spark, str(tmp_path / "store"))
    for name in (None, "b.txt"):
        if name:
            (folder / name).write_text("beta text")
        watch_folder(spark, str(folder), store, EMBEDDER, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["text"] for r in store.read().collect()) == ["alpha text", "beta text"]


class Counted:
    """An embedder that counts the texts it was given."""

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)

    def __call__(self, texts):
        self.seen.add(len(texts))
        return EMBEDDER(texts)


def test_every_text_is_embedded_once(spark, tmp_path):
    store, docs = Collection(spark, str(tmp_path / "store")), spark.createDataFrame(
        [(k, f"text number {k} about cats", f"f{k}") for k in range(12)] + [(12, "text number 3 about cats", "copy")], "ordinal long, text string, source string"
    )
    counted = Counted(spark)
    assert pipeline.ingest(docs, store, counted)["chunks_added"] == 13 and counted.seen.value == 13
    asked = Counted(spark)
    questions = spark.createDataFrame([(1, "number 3"), (2, "cats"), (3, "text 5")], "query_id long, question string")
    assert pipeline.answer_questions(questions, store.read(), asked, answer.Extractive()).count() == 3 and asked.seen.value == 3
    got = pipeline.answer_questions(questions, store.read(), EMBEDDER, None).collect()
    assert {(r["answer"], r["model"]) for r in got} == {(answer.NO_GENERATOR, "none")} and all(r["sources"] for r in got)
    assert pipeline.ask(spark, "cats", store, EMBEDDER, None, " RAG ")["model"] == "none"
    assert pipeline.ask(spark, "cats", store, EMBEDDER, None, "else")["model"] == "dummy"


@pytest.mark.parametrize("orders", [range(50), [pow(3, k, 1 << 61) for k in range(40)], [-5, 0, 1 << 45, (1 << 45) + 1, 1 << 62]])
def test_ordinals_of_any_order(spark, orders):
    rows = [(o, p) for k, o in enumerate(orders) for p in range(1 + k % 3)]
    got = chunk.with_ordinals(spark.createDataFrame(rows, "o long, pos int").repartition(3), "o").collect()
    assert [r["chunk_index"] for r in sorted(got, key=lambda r: (r["o"], r["pos"]))] == list(range(len(rows)))


def test_collection_adds_deltas_and_compacts(spark, tmp_path, monkeypatch):
    from granary.sources import store as module

    monkeypatch.setattr(module, "COMPACT", 3)
    store = Collection(spark, str(tmp_path / "store"))
    rows = lambda *pairs: spark.createDataFrame(
        [(i, f"t{i}", "s", n, 1, {}, [1.0]) for i, n in pairs], module.SCHEMA)
    want = {}
    for n in range(6):
        batch = [("a", n), ("b" if n % 2 else "c", n), (f"x{n}", n)]
        want |= dict(batch)
        assert store.upsert(rows(*batch)) == 3
        assert {r["chunk_id"]: r["chunk_index"] for r in store.read().collect()} == want
    assert store.versions() == [1, 5] and store.deltas() == [6, 7]
    store.vacuum(1)
    assert store.versions() == [5] and {r["chunk_id"]: r["chunk_index"] for r in store.read().collect()} == want
    monkeypatch.setattr(Collection, "_fs", lambda *_: 1 / 0)
    assert store.drop()["status"] == "cleared" and not store.ready()


def test_pdf_metadata_reaches_the_chunks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    parse = lambda b: [(t, {"page": k, "source": "no", "title": None}) for k, t in enumerate(b.decode().split("|"))]
    docs = files.scan_folder(spark, str(tmp_path), parse)
    got = pipeline.chunked(docs).orderBy("chunk_index").collect()
    assert [(r["text"], r["source"], r["metadata"]["page"], r["metadata"]["title"], r["metadata"]["file_type"]) for r in got] == [("one", "a.pdf", "0", "", "pdf"), ("two", "a.pdf", "1", "", "pdf")]


def test_session_updates_and_selection(spark):
    rows = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, 'x' AS text, timestamp'2024-01-01 00:00:01.5' AS at UNION ALL SELECT 2L, 0L, 'user', 'y', null")
    got = sessions.fold_sessions(rows, time_col="at")
    assert sessions.selected(got, 1).first()["updated_ms"] == 1704067201500 and sessions.selected(got, 3).count() == 0
