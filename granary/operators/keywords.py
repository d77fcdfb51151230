"""Extending texts by the phrases of a keyword table of any size.

The keywords that occur in a text, also within words, are found in one reading of it by an
Aho-Corasick automaton, not by one search a keyword. Keywords are dealt to shards of bounded size;
a shard's automaton is built in the tasks from a broadcast list, one pass over the texts a shard.
What a pass returns is the text's row number and the numbers of its keywords; texts do not move.

Defined results for odd input: null text: null, and no keyword; null keyword or phrase: the row is
left out; an empty keyword occurs in every text that is not null; repeated keywords add their
phrases one by one; order: ``ord``, then keyword, then phrase. Matching is on lower-cased texts, by
Spark's ``lower``; keywords are taken as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.shared import broadcast_if_small, stored

SHARD_BYTES = 8 << 20  # of keywords in one automaton


def sharded(keywords: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Distinct keywords (number, keyword, shard), stored, and the number of shards."""
    different = stored(keywords.select(F.col("keyword").cast("string").alias("keyword")).where("keyword is not null").distinct(), "keywords")
    size = different.agg(F.sum(F.octet_length("keyword") + 16)).first()[0] or 0
    shards = max(1, -(-size * 5 // (4 * limit)))  # dealt by hash, so with some room
    numbered = different.select(F.xxhash64("keyword").alias("number"), "keyword", F.pmod(F.xxhash64(F.lit(3), "keyword"), F.lit(shards)).alias("shard"))
    return numbered, shards


def found_keywords(texts: DataFrame, keywords: DataFrame, text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(row, keyword) of the different keywords that occur in each text of (row, text_col)."""
    numbered, shards = sharded(keywords, limit)
    low = texts.select("row", F.lower(text_col).alias("low")).where("low is not null")
    out = None
    for shard in range(shards):
        words = [r["keyword"] for r in numbered.where(F.col("shard") == shard).select("keyword").collect()]  # of bounded size
        hits = low.mapInArrow(_scan(texts.sparkSession.sparkContext.broadcast(words)), "row long, keyword string")
        out = hits if out is None else out.unionByName(hits)
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = shared.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(words):
            if word:
                automaton.add_word(word, k)
        everywhere = [k for k, word in enumerate(words) if not word]
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sorted({*everywhere, *(k for _, k in automaton.iter(text.as_py()))} if len(automaton) else everywhere)
                rows += [row] * len(own)
                found += own
                if len(rows) > 1 << 16:
                    yield _batch(rows, found, words)
                    rows, found = [], []
            if rows:
                yield _batch(rows, found, words)

    return run


def _batch(rows: list[int], found: list[int], words: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([words[k] for k in found], pa.string())], ["row", "keyword"])


def expanded_by(texts: DataFrame, keywords: DataFrame, text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``texts`` with ``expanded``: the text and, in order, the phrases of all its keywords, of a table (ord, keyword, phrase)."""
    whole = stored(texts.select(F.struct(*texts.columns).alias("whole"), F.col(text_col).cast("string").alias("_text")).withColumn("row", F.monotonically_increasing_id()), "texts")
    phrases = stored(keywords.select("ord", F.col("keyword").cast("string").alias("keyword"), F.col("phrase").cast("string").alias("phrase")).where("keyword is not null and phrase is not null"), "phrases")
    hits = found_keywords(whole.select("row", "_text"), phrases, "_text", limit)
    met = hits.join(broadcast_if_small(phrases, F.octet_length("keyword") + F.octet_length("phrase") + 32), "keyword")
    added = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("ord", "keyword", "phrase"))).alias("_found"))
    joined = F.concat_ws(" ", "_text", F.col("_found.phrase"))
    return whole.join(added, "row", "left").select("whole.*", F.when(F.col("_text").isNotNull(), joined).alias("expanded"))
