"""A training corpus from raw documents: five stages, each an operator of ``granary.llm``.

1. quality: documents that the classifier rejects go.
2. near-duplicates: of each group of linked documents the one with the least doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: found secrets are blacked out; the documents stay.
5. packing: what is left is tokenised and packed into sequences.

Every stage is written as Parquet and read again, so that a lost executor repeats part of one
stage only. All but the last keep the columns of ``documents``, and any other columns, whatever
their names.

Defined results for odd input, by stage:

* null, empty or wordless texts: scored like any text (1), in no group of copies (2), never
  contaminated (3), without secrets (4), a piece with the end token alone (5).
* repeated rows and exact copies: each is scored (1); one row of each group stays (2); each that
  is left is judged (3, 4) and packed (5). Ties at a limit: kept (1), linked (2), dropped (3).
* null ids: rows are told apart by id and text, so these rows are kept or dropped like others;
  of a group of copies a row with an id stays before one without.
* very long texts are scored, compared, scanned and packed whole. Empty tables: empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, jaccard_join, packing, quality_cnn, secret_scan
from granary.llm.shared import removed, spread, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier calls good. It learns from the labelled rows of the raw documents."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_cnn.train(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_cnn.scorer(spark, model)(F.col("text")) >= quality_cnn.CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of every component."""
    return jaccard_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, special=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: Classifier, components and tokenizer have no SQL; tests hold the rows against a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        removed(*before)  # nothing reads the stage before this one again
        before = [docs]
    return docs
