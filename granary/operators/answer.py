"""Checking questions, answering them, and the statuses of failures."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import DEFAULT, Settings
from granary.functions.text import strip
from granary.shared import bounded_batches


def validated(questions: DataFrame, column: str = "question", settings: Settings = DEFAULT) -> DataFrame:
    """Add ``valid``, ``reason`` and the stripped question (null if rejected). Length is judged before stripping."""
    q = F.col(column)
    reason = (
        F.when(q.isNull(), "missing").when(F.length(q) < 1, "too short")
        .when(F.length(q) > settings.question_max, "too long").when(strip(q) == "", "blank")
    )
    return questions.withColumn("reason", reason).withColumns({
        "valid": F.col("reason").isNull(), column: F.when(F.col("reason").isNull(), strip(q)),
    })


#: Fixed value: how a reply without a collection begins.
DUMMY = 'This is a **dummy reply** for: "'


def dummy_answer(question: Column) -> Column:
    return F.concat(
        F.lit(DUMMY), strip(question), F.lit('"\n\nNo collection was searched. Ingest documents and ask in mode `rag`.')
    )


def dummy_answers(questions: DataFrame, column: str = "question") -> DataFrame:
    """The answer without a collection: an echo, one placeholder source, no context."""
    source = F.struct(
        F.lit("dummy://local").alias("filename"), F.lit(1.0).alias("relevance_score"), F.lit("Placeholder source while no collection is searched.").alias("snippet")
    )
    return questions.withColumns({
        "answer": dummy_answer(F.col(column)), "sources": F.array(source),
        "context_chunks": F.lit(0).cast("long"), "model": F.lit("dummy"),
    })


class Generator(Protocol):
    """Anything that answers a list of (question, context) pairs, in order; pickled to the tasks."""

    name: str

    def __call__(self, pairs: list[tuple[str, str]]) -> list[str]: ...


class Extractive:
    """Answers with the sentences of the context that share most words with the question."""

    name = "extractive"
    #: Fixed value: the reply where the context has nothing to offer.
    nothing = "I cannot find this information in the provided documents."

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def __call__(self, pairs: list[tuple[str, str]]) -> list[str]:
        return [self.one(q, c) for q, c in pairs]

    def one(self, question: str, context: str) -> str:
        asked = set(question.lower().split())
        lines = [s for line in context.split("\n") if not line.startswith("Source: ") for s in line.split(". ") if s.strip()]
        ranked = sorted(range(len(lines)), key=lambda k: (-len(asked & set(lines[k].lower().split())), k))
        best = [k for k in ranked[: self.sentences] if asked & set(lines[k].lower().split())]
        return "\n".join(f"- {lines[k].strip()}" for k in sorted(best)) or self.nothing


#: The answer where no generator is configured; its model is "none".
NO_GENERATOR = "No answer was written: no generator is configured. The sources below were found."


def generate(rows: DataFrame, generator: Generator | None, column: str = "question") -> DataFrame:
    """Add ``answer`` and ``model`` to rows of (question, context, ...); a fixed notice where there is no generator."""
    names = [c for c in rows.columns if c not in ("answer", "model")]
    if generator is None:
        return rows.select(*names, F.lit(NO_GENERATOR).alias("answer"), F.lit("none").alias("model"))
    at = names.index(column), names.index("context")
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(q or "", c or "") for q, c in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
            said = generator(pairs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(said, pa.string()), pa.array([generator.name] * len(said), pa.string())], [*names, "answer", "model"]
            )

    return rows.select(names).mapInArrow(run, rows.select(names).schema.add("answer", "string").add("model", "string"))


def http_status(kind: Column, message: Column, route: Column) -> Column:
    """Status of a failure: a question fails with 400 on a runtime error, 401 on a bad key; all else is 500."""
    said = F.coalesce(message, F.lit(""))
    bad_key = F.contains(said, F.lit("expired_api_key")) | F.contains(said, F.lit("Invalid API Key"))
    return F.when(route != "query", 500).when(kind == "runtime", 400).when(bad_key, 401).otherwise(500)


def error_text(body: Column, status: Column) -> Column:
    """What a client shows for a failed request: the detail, the first message of a list, else by status."""
    detail = F.get_json_object(body, "$.detail")
    listed = F.get_json_object(body, "$.detail[0].msg")
    return (
        F.when(listed.isNotNull() & (listed != ""), listed)
        .when(detail.isNotNull() & ~F.startswith(detail, F.lit("[")), detail)
        .when(status == 400, "The collection is empty. Ingest documents before asking.")
        .when(status >= 500, "The service failed. Its log says more.")
        .otherwise(F.concat(F.lit("Not answered, status "), status.cast("string")))
    )
