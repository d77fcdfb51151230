"""Secret scans over an incremental ledger of content-addressed blobs, DataFrame functions only.

A history of texts (path, version, text) is reduced to blobs by SHA-256. The ledger records
which rules, by rule version, have seen which blob, and what each version found. A scan runs
only the unseen (blob, rule version) pairs, adds them to the ledger and joins the findings of
the asked rule versions back to every path and version that holds the blob. Running the same
scan again adds nothing; a new rule, or one whose pattern changed, is run over all blobs while
the others are not, and findings of a version that is no longer asked for are left out.

Defined results for odd input:

* null text is an empty text: no findings.
* null path: kept, and matched null-safely.
* exact copies and repeated rows: one blob, scanned once, reported for every input row.
* ties: spans that start together stand in the order of the rules.
* empty table: empty result. Very long texts are scanned whole.
* ``scan`` returns the path columns, ``blob_id`` and ``spans``; path columns may not have these
  two names. Other columns of the input are left out. ``redacted`` returns all columns of its
  input, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.shared import broadcast_if_small, exists, new_folder, removed, spread, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose ``group`` is
    shorter than ``min_len`` are dropped after matching. ``hint`` is a cheap literal without
    which a text cannot match."""

    kind: str
    pattern: str
    min_len: int = 1
    group: int = 0
    hint: str | None = None

    @property
    def version(self) -> str:
        said = f"{self.kind}\0{self.pattern}\0{self.min_len}\0{self.group}"
        return hashlib.sha256(said.encode()).hexdigest()[:12]


# The three base rules, in the order that breaks ties.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    # A maximal run is kept or dropped as a whole, so its least length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{12,}+", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}+"),
)
#: Further kinds of the same method.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hint="eyJ"),
)
RULES = BASE_RULES + MORE_RULES

SOME = 64  # spans of a text that are put together at once
SPAN = "struct<start:int,kind:string,end:int,rule_version:string>"  # as the ledger keeps it
FOUND = "struct<start:int,ord:int,kind:string,end:int>"  # as a scan returns it


def may_match(text: Column, rule: Rule) -> Column:
    found = text.rlike(rule.pattern)
    return F.contains(text, F.lit(rule.hint)) & found if rule.hint else found


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of a rule in code points: the lengths of the gaps and of the matches, added up."""
    none = F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pieces = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g)).alias("gap"),
        F.transform(matches, lambda m: F.length(m)).alias("len"),
        F.transform(judged, lambda m: F.length(m)).alias("judged"),
    )


    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), none.alias("out")),
            lambda a, p: F.struct(
                (a["at"] + p["gap"] + p["len"]).alias("at"),
                F.when(p["judged"] >= rule.min_len, F.concat(a["out"], F.array(F.struct(
                    (a["at"] + p["gap"]).alias("start"), F.lit(rule.kind).alias("kind"), (a["at"] + p["gap"] + p["len"]).alias("end"),
                    F.lit(rule.version).alias("rule_version"),
                )))).otherwise(a["out"]).alias("out"),
            ),
        )

    every = F.aggregate(
        in_blocks(F.filter(pieces, lambda p: p["len"].isNotNull())),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")),
        lambda a, block: F.transform(F.array(placed(block, a["at"])), lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], F.array(b["out"])).alias("out")))[0],
        lambda a: F.flatten(a["out"]),
    )
    return F.when(may_match(text, rule), every).otherwise(none)


def in_blocks(values: Column) -> Column:
    """An array as arrays of ``SOME`` elements: what is gathered element by element is copied within a block only, so the cost of a text with many spans stays near their number."""

    def cut(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / SOME).cast("int")), lambda b: b * SOME < F.size(v))
        return F.transform(starts, lambda b: F.slice(v, b * SOME + 1, F.lit(SOME)))

    return F.transform(F.array(values), cut)[0]  # so that the values are made once, not for each block


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(
    history: DataFrame,
    ledger: str,
    rules: tuple[Rule, ...] = RULES,
    path_cols: tuple[str, ...] = ("path", "version"),
    text_col: str = "text",
) -> DataFrame:
    """Scan unseen (blob, rule version) pairs; return path_cols, blob_id and all spans of each row.

    ``ledger`` is a folder that all executors see. It holds ``paths/`` (which blob every path
    and version had) and ``scans/`` (per blob: the rule versions run and the spans found), one
    sub-folder a call.

    Only keys are grouped and joined. Where the keys of unseen blobs are few, they are
    broadcast and their texts are scanned where they lie. Where they are many, as on a first
    load, every text is tested in place for a match of any rule; only those with one, few,
    are then moved to one owner row a blob, so copies are no hot spot and no corpus is shuffled.
    """
    if {"blob_id", "spans"} & set(path_cols):
        raise ValueError("path columns may not be named blob_id or spans")
    spark = history.sparkSession
    batch = uuid.uuid4().hex
    known = {r.version: k for k, r in enumerate(rules)}
    wanted = F.array(*map(F.lit, known))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = history.select(F.struct(*path_cols).alias("owner"), F.unhex(F.sha2(text, 256)).alias("blob_id"), text.alias("text"))
    keyed.select("owner.*", "blob_id").write.parquet(f"{ledger}/paths/{batch}")
    held = spark.read.parquet(f"{ledger}/paths/{batch}")

    todo = held.groupBy("blob_id").agg(F.min(F.struct(*path_cols)).alias("owner"))
    if exists(spark, f"{ledger}/scans"):
        done = spark.read.parquet(f"{ledger}/scans/*").groupBy("blob_id").agg(
            F.array_distinct(F.flatten(F.collect_list("rule_versions"))).alias("done")
        )
        unseen = F.array_except(wanted, F.coalesce(F.col("done"), F.array().cast("array<string>")))
        todo = todo.join(done, "blob_id", "left").withColumn("todo", unseen).where(F.size("todo") > 0).drop("done")
    else:
        todo = todo.withColumn("todo", wanted)
    todo = stored(todo, "unseen")

    few = broadcast_if_small(todo, 128 + 16 * len(rules), limit=8 << 20)
    texts = keyed
    if few is todo:
        texts = keyed.where(functools.reduce(Column.__or__, [may_match(F.col("text"), r) for r in rules]))
    texts, few = texts.alias("t"), few.alias("u")
    owned = texts.join(few, (F.col("t.blob_id") == F.col("u.blob_id")) & F.col("t.owner").eqNullSafe(F.col("u.owner")))
    spans = F.concat(*[
        F.when(F.array_contains("u.todo", r.version), spans_of(F.col("t.text"), r)).otherwise(F.array().cast(f"array<{SPAN}>")) for r in rules
    ])
    hits = owned.select("u.blob_id", spans.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["blob_id"])  # repeated rows own a blob twice
    todo.select("blob_id", F.col("todo").alias("rule_versions")).join(hits, "blob_id", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))
    ).write.parquet(f"{ledger}/scans/{batch}")
    removed(todo)

    order = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    findings = (
        spark.read.parquet(f"{ledger}/scans/*").select("blob_id", F.filter("spans", lambda s: s["rule_version"].isin(list(known))).alias("spans"))
        .where(F.size("spans") > 0)
        .select("blob_id", F.transform("spans", lambda s: F.struct(s["start"], order[s["rule_version"]].alias("ord"), s["kind"], s["end"])).alias("spans"))
        .groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    return held.join(findings, "blob_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{FOUND}>")))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[kind]``; overlapping spans become one.

    Spans, ascending, are taken a block at a time, and a block cuts its own part of the text.
    """
    text = F.coalesce(text, F.lit(""))

    def cleaned(block: Column, at: Column) -> Column:
        """(end, text) of the part from ``at`` to the last end of the block."""
        end = F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))
        done = F.aggregate(
            block,
            F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"), F.substring(text, at + 1, end - at).alias("part"), at.alias("first")),
            lambda a, s: F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(
                    F.substring(a["part"], a["at"] - a["first"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))
                ))).alias("out"),
                a["part"].alias("part"), a["first"].alias("first"),
            ),
        )
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.array_join(d["out"], "").alias("out")))[0]

    done = F.aggregate(
        in_blocks(spans),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, block: F.transform(F.array(cleaned(block, a["at"])), lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], F.array(b["out"])).alias("out")))[0],
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets blacked out; rows without secrets stay as they are.

    Findings come from the ledger by blob, so the few texts that change are found by a join on
    their content hash, for which the findings are broadcast while their measured size allows;
    n_chars is counted anew where the text changed. All columns go through as one struct, so
    their names cannot clash with any used here.
    """
    ledger = new_folder(docs.sparkSession, "secrets")
    text = F.col(text_col).cast("string")
    path = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("string")
    found = scan(docs.select(path.alias("path"), text.alias("text")), ledger, path_cols=("path",))
    found = stored(found.where(F.size("spans") > 0).groupBy("blob_id").agg(F.first("spans").alias("spans")), "found")
    small = broadcast_if_small(found, 64 + 48 * F.size("spans").cast("long")).alias("f")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("blob_id")).alias("d")
    out = whole.join(small, F.col("d.blob_id") == F.col("f.blob_id"), "left")
    old, changed = F.col("d.row")[text_col], F.col("f.spans").isNotNull()
    row = F.col("d.row").withField(text_col, F.when(changed, redact(old.cast("string"), F.col("f.spans"))).otherwise(old))
    if "n_chars" in docs.columns:
        n_chars = F.when(changed, F.length(row[text_col]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.row")["n_chars"])
        row = row.withField("n_chars", n_chars)
    return out.select(row.alias("row")).select("row.*")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = scan(docs, new_folder(spark, "secrets"), path_cols=("doc_id",))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spans_string(base), 256).alias("base_sha256"),
        spans_string(F.col("spans")).alias("spans"),
        F.hex("blob_id").alias("blob_id"),
    )


_KINDS = [
    # kind, pattern to find, check on the match
    ("assign", "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+)", "[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]{8,}$"),
    ("access", "(AKIA[A-Z0-9]+)", "^.{16,}$"),
    ("hex", "([0-9a-f]+)", "^.{32,}$"),
    ("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "."),
    ("github", "(gh[pousr]_[A-Za-z0-9]{36,})", "."),
    ("slack", "(xox[abprs]-[A-Za-z0-9-]{10,})", "."),
    ("jwt", "(eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})", "."),
]


def _sql() -> str:
    """DuckDB SQL for op1: cut each text at the matches, then place the matches by running lengths."""
    parts = [
        f"SELECT rid, {k} AS ord, '{kind}' AS kind, regexp_split_to_array(text, '{find}') AS gaps,"
        f" regexp_extract_all(text, '{find}') AS hits, '{test}' AS test FROM d"
        for k, (kind, find, test) in enumerate(_KINDS)
    ]
    return """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (""" + " UNION ALL ".join(parts) + """),
hit AS (SELECT rid, ord, kind, test, unnest(hits) AS m, unnest(gaps[1:len(hits)]) AS gap, unnest(generate_series(1, len(hits))) AS i
  FROM cut WHERE len(hits) > 0),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM hit),
span AS (SELECT rid, ord, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE regexp_matches(m, test)),
by_doc AS (SELECT rid,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM span GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, upper(sha256(text)) AS blob_id
FROM d LEFT JOIN by_doc USING (rid)
"""


SQL = _sql()
