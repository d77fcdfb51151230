"""Ingesting documents into a collection, and answering questions from it."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.config import DEFAULT, Settings, normalised_mode
from granary.functions.metadata import content_id, sanitised
from granary.operators import answer, assemble, chunk, embed, ivf, search
from granary.operators.expand import expanded
from granary.shared import broadcast_if_small, stored
from granary.sources.store import Collection


#: Bytes of source names up to which a report lists them all.
REPORTED = 32 << 20


def chunked(docs: DataFrame, order_col: str = "ordinal", settings: Settings = DEFAULT) -> DataFrame:
    """Chunks of documents (order_col, text, source, ...) as the collection keeps them, not yet embedded.

    Other columns become entries of the metadata, beside those of a ``metadata`` map. The texts
    are split once, into a stored table, which numbering reads twice.
    """
    parts = chunk.with_ordinals(stored(chunk.split_documents(docs, settings), "chunks"), order_col)
    rest = [c for c in docs.columns if c not in ("text", "source", "metadata")]
    entries: list[Column] = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    if isinstance(docs.schema["metadata"].dataType if "metadata" in docs.columns else None, T.MapType):
        own = F.coalesce(F.col("metadata").cast("map<string,string>"), F.create_map().cast("map<string,string>"))
        metadata = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(rest)) if rest else own, metadata)
    return parts.select(
        content_id(F.col("text")).alias("chunk_id"), "text", "source", "chunk_index", "chunk_size", sanitised(metadata).alias("metadata")
    )


def ingest(
    docs: DataFrame, collection: Collection, embedder: embed.Embedder, order_col: str = "ordinal", settings: Settings = DEFAULT
) -> dict:
    """Chunk, embed and merge documents; nothing is stored if any batch fails to embed.

    The report's ``source_table`` is a stored table of all sources, and ``sources`` lists them
    all where their names fit the driver (``REPORTED``), else it is None.
    """
    added = collection.upsert(embed.embed(chunked(docs, order_col, settings), embedder, batch=settings.embed_batch))
    sources = stored(assemble.distinct_sources(docs), "sources")
    count, size = sources.agg(F.count("*"), F.sum(F.octet_length("source") + 64)).first()
    named = [r["source"] for r in sources.orderBy("source").collect()] if (size or 0) <= REPORTED else None
    return {"status": "ok", "chunks_added": added, "sources": named, "source_table": sources, "message": f"{added} chunks from {count} sources"}


def retrieve(
    questions: DataFrame, chunks: DataFrame, embedder: embed.Embedder, k: int | None = None, settings: Settings = DEFAULT,
    distinct: bool = True, index: ivf.VectorIndex | None = None, where: Column | None = None, target: float | None = 0.95,
) -> DataFrame:
    """(query_id, question, rank, distance, chunk_id, text, source) of questions (query_id, question).

    With an ``index`` of the chunks, by chunk_id, only the cells that reach the recall ``target``
    are searched, and ``where`` may limit the search by the index's payload columns; without one
    ``where`` limits ``chunks``, which are all compared.

    Questions are extended for the search only. Texts are joined to the few hits afterwards, so
    vectors are ranked without them; ``chunks`` is read for both, so give a stored table, such
    as a collection. Questions are embedded once, into a stored table.
    """
    asked = stored(embed.embed(questions.select("query_id", expanded(F.col("question"), settings).alias("text")), embedder), "questions")
    if index is None:
        chunks = chunks if where is None else chunks.where(where)
        found = search.top_k(asked, chunks, k, vector_id="chunk_id", settings=settings)
    else:
        found = index.search(asked, k or settings.top_k, target, where)
    hits = stored(found, "hits")
    texts = chunks.select("chunk_id", "text", "source").join(broadcast_if_small(hits, 160), "chunk_id")
    full = texts.join(questions.select("query_id", "question"), "query_id")
    full = full.select("query_id", "question", "rank", "distance", "chunk_id", "text", "source")
    return search.dedupe(full) if distinct else full


def answer_questions(
    questions: DataFrame, chunks: DataFrame, embedder: embed.Embedder, generator: answer.Generator | None, k: int | None = None,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """(query_id, question, answer, sources, context_chunks, model), one row per question with hits."""
    hits = stored(retrieve(questions, chunks, embedder, k, settings), "passages")
    context = assemble.context(hits).join(assemble.sources(hits, settings=settings), "query_id").join(questions, "query_id")
    said = answer.generate(context.select("query_id", "question", "context", "sources", "context_chunks"), generator)
    return said.drop("context")


def ask(
    spark: SparkSession, question: str, collection: Collection, embedder: embed.Embedder, generator: answer.Generator | None,
    mode: str = DEFAULT.mode, settings: Settings = DEFAULT,
) -> dict:
    """One question, checked and timed. Modes other than ``rag``, in any case, answer without the collection."""
    began = time.monotonic()
    row = answer.validated(spark.createDataFrame([(0, question)], "query_id long, question string"), settings=settings)
    checked = row.first()
    if not checked["valid"]:
        raise ValueError(f"question is {checked['reason']}")
    asked = row.select("query_id", "question")
    if normalised_mode(mode) != "rag":
        out = answer.dummy_answers(asked)
    elif not collection.ready():
        raise RuntimeError("the collection is empty: ingest documents first")
    else:
        out = answer_questions(asked, collection.read(), embedder, generator, settings=settings)
    got = out.first()
    result = got.asDict(recursive=True) if got else {
        "question": checked["question"], "answer": answer.Extractive.nothing if generator else answer.NO_GENERATOR, "sources": [], "context_chunks": 0,
        "model": generator.name if generator else "none",
    }
    result.pop("query_id", None)
    return result | {"processing_time_ms": round((time.monotonic() - began) * 1000, 2)}
