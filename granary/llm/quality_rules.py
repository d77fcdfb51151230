"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every document gets counts of words, symbols, repeated lines and repeated three-word windows.
Lines are normalised and hashed; a line found in more distinct documents of a host than the
host's limit is boilerplate. Boilerplate lines are removed and a document that loses too large
a share of its words is rejected as depleted.

Defined results for odd input:

* null or empty text: no words, fails the base rules, not kept; cleaned text is empty.
* null host: documents without a host form one host of their own.
* exact copies: documents of a host with equal text count once, so that copies alone never
  make a line frequent; with ``doc_key``, a column that names documents, copies of different
  names count each.
* repeated rows: every input row gives one output row. Ties: a line in exactly as many
  documents as its limit is kept, a document that keeps exactly ``min_left`` too.
* very long texts and lines are counted whole. Empty table: empty result. Other columns of the
  input are carried along unchanged, whatever their names; a column named like an output of
  this module is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import spread, stored

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Windows are hashed and sorted with their positions; equal neighbours are repeats, and the
    union of the intervals [p, p + 3) is summed in one pass over the sorted positions.
    """

    def hashes(w):
        return F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )

    def same(a, b):
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def repeated(s):
        return F.transform(
            F.filter(s, lambda e, k: same(F.get(s, k - 1), e) | same(F.get(s, k + 1), e)),
            lambda e: e["i"],
        )

    def union_length(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.aggregate(
            F.sort_array(let(placed, repeated)),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    return let(
        let(words, hashes),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(union_length(h)),
    )


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    found = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text")).withColumns({
        "_counts": let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))),
        "word_chars": without(SPACE_CHARS).cast("long"),
        "n_symbols": (F.length(text) - without(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }).withColumns({
        "n_words": F.col("_counts.n").cast("long"),
        "n_repeat_words": F.col("_counts.r").cast("long"),
    }).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    return _with(docs, found, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def _with(docs: DataFrame, found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs``, which ``found`` has as one struct, with the named columns of ``found`` beside or in place of their own."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in names]
    return found.select(*kept, *names)


def normalised(line: Column) -> Column:
    """A line without case and with single spaces between its words."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_hash(line: Column) -> Column:
    return let(normalised(line), lambda x: F.when(x != "", F.xxhash64(x)))


def line_rules(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 20,
    max_share: float = 0.05,
    min_left: float = 0.5,
    doc_key: str | None = None,
) -> DataFrame:
    """Add host-wide line frequency results: lines_removed, words_left, depleted, clean_text.

    A line is boilerplate on a host when more than ``max(min_docs, max_share * documents)``
    distinct documents of the host hold it, of those that hold any word. A document is depleted when boilerplate makes up
    more than ``1 - min_left`` of its words.

    Lines are aggregated by (host, document key, line) before they meet by (host, line), so
    copies collapse in the map tasks; the joins are plain equi joins whose skewed partitions
    adaptive execution splits. Texts themselves are never shuffled for the counts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = [F.coalesce(F.col(doc_key).cast("string"), F.lit("")), F.lit("\0")] if doc_key else []
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"),
        F.unhex(F.md5(F.concat(*named, text))).alias("_key"), text.alias("text"),
    )
    text = F.col("text")
    lines = keyed.select(
        "_host", "_key",
        F.explode(F.transform(
            F.split(text, "\n", -1),
            lambda line: let(normalised(line), lambda x: F.struct(
                F.when(x != "", F.xxhash64(x)).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w")
            )),
        )).alias("line"),
    ).where(F.col("line.h").isNotNull()).groupBy("_host", "_key", F.col("line.h").alias("_h")).agg(
        F.sum("line.w").alias("_w")
    )
    lines = stored(lines, "lines")  # used three times: the texts are cut into lines once
    limits = lines.groupBy("_host", "_key").agg(F.lit(1).alias("_one")).groupBy("_host").agg(
        F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(float(max_share))).alias("_limit")
    )
    frequent = (
        lines.groupBy("_host", "_h").agg(F.count("*").alias("_docs"))
        .where(F.col("_docs") > min_docs)
        .join(limits, "_host")
        .where(F.col("_docs") > F.col("_limit"))
        .select("_host", "_h", F.lit(True).alias("_hit"))
    )
    # Words of repeated rows add up on both sides of the share, which stays the same.
    per_text = lines.join(frequent, ["_host", "_h"], "left").groupBy("_host", "_key").agg(
        F.sum("_w").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_w"))), F.lit(0)).alias("_lost"),
        F.collect_list(F.when(F.col("_hit"), F.col("_h"))).alias("_bad"),
    ).where(F.col("_lost") > 0)
    left = F.coalesce(1 - F.col("_lost") / F.col("_all"), F.lit(1.0))
    bad = F.coalesce(F.col("_bad"), F.array().cast("array<bigint>"))
    found = keyed.join(per_text, ["_host", "_key"], "left").withColumns({
        "lines_removed": F.size(bad).cast("long"),
        "words_left": left,
        "depleted": left < min_left,
        "clean_text": F.when(F.size(bad) == 0, text).otherwise(F.array_join(F.filter(
            F.split(text, "\n", -1), lambda x: ~F.coalesce(F.array_contains(bad, line_hash(x)), F.lit(False))
        ), "\n")),
    })
    return _with(docs, found, ("lines_removed", "words_left", "depleted", "clean_text"))


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """Base rules, line rules and the verdict ``kept``."""
    out = line_rules(base_rules(docs, limits.get("text_col", "text")), **limits)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "lines_removed", F.round("words_left", 6).alias("words_left"),
    )


#: DuckDB SQL for op5_quality_rules.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2
), rep AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY rid
), raw AS (
  SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), ln AS (
  SELECT rid, host, text, line,
    trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw
  FROM raw
), words_in AS (SELECT * FROM ln WHERE nw > 0
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM words_in GROUP BY rid
), lim AS (
  SELECT host, greatest(20.0, count(DISTINCT text) * 0.05) AS lim FROM words_in GROUP BY host
), freq AS (
  SELECT host, norm, count(DISTINCT text) AS n FROM words_in GROUP BY host, norm
), bad AS (
  SELECT host, norm FROM freq JOIN lim USING (host) WHERE n > lim
), lost AS (
  SELECT rid, sum(nw) AS total, sum(CASE WHEN b.norm IS NOT NULL THEN nw ELSE 0 END) AS gone,
    count(DISTINCT b.norm) AS n
  FROM words_in l LEFT JOIN bad b ON l.host = b.host AND l.norm = b.norm GROUP BY rid
), f AS (
  SELECT d.doc_id, len(w.ws) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(lost.n, 0) AS lines_removed, coalesce(1 - gone / total, 1.0) AS words_left
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.5 AS kept,
  CAST(lines_removed AS BIGINT) AS lines_removed, CAST(round(words_left, 6) AS DOUBLE) AS words_left
FROM f
"""
