"""From ranked hits to a context, cited sources and corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import DEFAULT, Settings
from granary.functions.metadata import source_or_unknown
from granary.functions.text import snippet
from granary.operators.search import relevance


def in_order(value: Column, by: Column) -> Column:
    """Values of a group as an array in order; a group is the few hits of one query."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), value.alias("v")))), lambda x: x["v"])


def context(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, context, context_chunks): each hit under the name of its source, blank lines between."""
    block = F.concat(F.lit("Source: "), source_or_unknown(F.col("source")), F.lit("\n"), F.col("text"))
    return hits.groupBy(query_id).agg(
        F.array_join(in_order(block, F.col("rank")), "\n\n").alias("context"), F.count("*").alias("context_chunks")
    )


def framed_context(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, context): the other layout, an icon before each source and a rule after each text."""
    block = F.concat(F.lit("📄 Source: "), source_or_unknown(F.col("source")), F.lit("\n"), F.col("text"), F.lit("\n---"))
    return hits.groupBy(query_id).agg(F.array_join(in_order(block, F.col("rank")), "\n").alias("context"))


def citations(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per hit: rank, filename, relevance_score, snippet."""
    return hits.withColumns({
        "filename": source_or_unknown(F.col("source")),
        "relevance_score": relevance(F.col("distance")),
        "snippet": snippet(F.col("text"), settings.snippet),
    })


def sources(hits: DataFrame, query_id: str = "query_id", settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, sources): the citations of each query as an array in rank order."""
    cited = F.struct("filename", "relevance_score", "snippet")
    return citations(hits, settings).groupBy(query_id).agg(in_order(cited, F.col("rank")).alias("sources"))


def summary(docs: DataFrame, order_col: str) -> DataFrame:
    """One row: documents, characters and the distinct non-empty sources by first appearance.

    The row holds all sources; where these are too many for one, ``sources_by_appearance`` has them as rows.
    """
    named = F.when(F.col("source") != "", F.col("source"))
    per_source = docs.groupBy(named.alias("source")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(order_col).alias("first")
    )
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("first", "source")))), lambda x: x["source"]).alias("sources"),
    )


def sources_by_appearance(docs: DataFrame, order_col: str) -> DataFrame:
    """(source, first, n_documents, n_chars) of every non-empty source: the summary's list as a table, which may be of any length."""
    return docs.where("source <> ''").groupBy("source").agg(
        F.min(order_col).alias("first"), F.count("*").alias("n_documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars")
    )


def distinct_sources(docs: DataFrame) -> DataFrame:
    return docs.where("source <> ''").select("source").distinct()
