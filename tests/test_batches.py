"""Python gets batches of bounded bytes, however long the texts are."""

from pyspark.sql import functions as F

from granary.operators import answer, chunk, embed

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


class Weighing:
    """Says how many characters came with one call."""

    name = "weighing"

    def __call__(self, pairs):
        return [str(sum(len(c) for _, c in pairs))] * len(pairs)


def test_long_contexts_come_in_several_batches(spark):
    spark.conf.unset(LIMIT)
    rows = spark.range(60, numPartitions=1).select(F.lit("q").alias("question"), F.repeat(F.lit("abcde"), 100_000).alias("context"))
    said = [int(r["answer"]) for r in answer.generate(rows, Weighing()).select("answer").collect()]
    assert len(said) == 60 and max(said) <= 10_000_000  # 30,000,000 at once before


def test_splitting_and_embedding_bound_their_batches(spark):
    docs = spark.createDataFrame([(0, "b" * 900, "x")], "ordinal long, text string, source string")
    for step in (lambda: chunk.split_documents(docs), lambda: embed.embed(docs, embed.HashingEmbedder(8))):
        spark.conf.unset(LIMIT)
        assert step().count() > 0 and spark.conf.get(LIMIT) == "8m"
