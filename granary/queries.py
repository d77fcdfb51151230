"""Queries of the retrieval engine over the test tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.config import EXPANSIONS
from granary.functions import metadata, text
from granary.operators import answer, assemble, chunk, embed, expand, ivf, keywords, search, sessions, sketches, temporal
from granary.plans import pipeline
from granary.shared import new_folder, spread, stored
from granary.sources import files, store
from granary.sources import sessions as session_store
from granary.streaming import sessions as streamed_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Literal questions, since few keywords occur in the test tables.
QUESTIONS = (
    (1, "What was the total revenue in 2023?"), (2, "Describe the RISK factors"), (3, "  cash and debt position  "),
    (4, "Is the award margin growing?"), (5, "Hello there"), (6, "R&D spending, and sales income"), (7, ""), (8, "   "), (9, "ok"),
    (10, "x" * 500), (11, "x" * 501), (12, " " * 501), (13, "hardware"),
)
_QUESTIONS_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") AS q(query_id, question)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id long, question string")


def _nearest(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.top_k(asked, vectors, k)


_NEAREST = """
SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(d, 9), b.vec_id) AS rank
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 50 = 0) a,
    (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b, LATERAL (SELECT 1 - list_cosine_similarity(x, y) AS d)
) WHERE rank <= {k}
"""


def _ranked(df):
    return df.select("query_id", "vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_NEAREST.format(k=10))
def vector_top_k(spark, sf_dir):
    return _ranked(_nearest(spark, sf_dir, 10))


@query(_NEAREST.format(k=5))
def vector_top_k_zero_uses_default(spark, sf_dir):
    return _ranked(_nearest(spark, sf_dir, 0))


@query("SELECT query_id, vec_id, round(1 - distance, 3) + 0.0 AS relevance FROM (" + _NEAREST.format(k=5) + ")")
def relevance_scores(spark, sf_dir):
    near = _ranked(_nearest(spark, sf_dir, 5))
    return near.select("query_id", "vec_id", search.relevance(F.col("distance")).alias("relevance"))


def _indexed(spark, sf_dir, **search_options):
    """Rows of ``search`` in an index of all vectors, partitioned by label, for every fiftieth vector."""
    vectors = spread(table(spark, sf_dir, "embeddings"))
    index = ivf.VectorIndex.build(vectors, new_folder(spark, "vector-index"), partition="label")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _ranked(index.search(asked, 10, **search_options))


@query()
def vector_index_top_k(spark, sf_dir):
    """The ten nearest vectors by the inverted-file index, at its default recall."""
    return _indexed(spark, sf_dir)


@query()
def vector_index_quantised(spark, sf_dir):
    """The same from quantised codes, the best ranked anew."""
    return _indexed(spark, sf_dir, quantised=True)


@query(_NEAREST.format(k=10))
def vector_index_exact(spark, sf_dir):
    return _indexed(spark, sf_dir, target=None)


@query(_NEAREST.replace("AS y FROM embeddings", "AS y FROM embeddings WHERE label IN (1, 4, 7)").format(k=10))
def vector_index_filtered(spark, sf_dir):
    """The ten nearest among the vectors of three labels; the folders of other labels are not opened."""
    return _indexed(spark, sf_dir, target=None, where=F.col("label").isin(1, 4, 7))


WIDTH = 64


def _fixed(spark, sf_dir):
    """Every distinct 400-character cut of every document, the last of equal ones, with its embedding; stored."""
    cut = chunk.fixed_chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    keyed = cut.select(metadata.content_id(F.col("text")).alias("chunk_id"), "text", "source", F.struct("doc_id", "pos").alias("place"))
    last = store.last_wins(keyed, "chunk_id", "place").drop("place")
    return stored(embed.embed(last, embed.HashingEmbedder(WIDTH)), "fixed-chunks")


def _hits(spark, sf_dir, k=5):
    """The nearest cuts of every benchmark item, ranked, copies included."""
    return pipeline.retrieve(_asked(spark, sf_dir), _fixed(spark, sf_dir), embed.HashingEmbedder(WIDTH), k, distinct=False)


_EXPAND = "concat_ws(' ', {x}, " + ", ".join(f"CASE WHEN contains(lower({{x}}), '{w}') THEN '{p}' END" for w, p in EXPANSIONS) + ")"

#: The same in SQL: feature hashing is MD5 arithmetic, and ranks are windows.
_EMBEDDED = """
fixed AS (
  SELECT 'chunk_' || sha256(text) AS chunk_id, text, source FROM (
    SELECT doc_id, source, pos, substring(text, pos * 400 + 1, 400) AS text
    FROM (SELECT doc_id, source, text, unnest(generate_series(0, (length(text) - 1) // 400)) AS pos FROM documents WHERE length(text) > 0))
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC, pos DESC) = 1
), asked AS (SELECT item_id AS query_id, text AS question, """ + _EXPAND.format(x="text") + """ AS text FROM benchmark
), all_texts AS (
  SELECT chunk_id AS id, text FROM fixed UNION ALL SELECT 'q' || query_id, text FROM asked
), words AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM all_texts
), features AS (
  SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), hashed AS (SELECT id, CAST(CAST('0x' || substr(md5(f), 1, 8) AS UINTEGER) AS BIGINT) AS h FROM features
), summed AS (SELECT id, h % 64 AS bucket, sum(CASE WHEN h >= 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM hashed GROUP BY ALL
), normed AS (SELECT id, map_from_entries(list((bucket, x))) AS m, sqrt(sum(x * x)) AS norm FROM summed GROUP BY id
), vectors AS (
  SELECT id, list_transform(range(64), lambda b: CAST(CAST(coalesce(m[b], 0) / norm AS FLOAT) AS DOUBLE)) AS v FROM normed WHERE norm > 0
)"""
_HITS = """(WITH """ + _EMBEDDED + """, pairs AS (
  SELECT query_id, question, chunk_id, fixed.text AS text, source, 1 - list_cosine_similarity(a.v, b.v) AS distance
  FROM asked JOIN vectors a ON a.id = 'q' || query_id, fixed JOIN vectors b ON b.id = chunk_id
) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM pairs QUALIFY rank <= @n)"""


def _hits_sql(n: int) -> str:
    return _HITS.replace("@n", str(n))


_BLANK = r"[\s\x{0b}\p{Z}\x{1c}-\x{1f}\x{85}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


@query(f"""
SELECT chunk_id, query_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, {_strip_sql('text')} ORDER BY rank) AS c FROM {_hits_sql(40)}
) WHERE c = 1
""")
def dedupe_after_top_k(spark, sf_dir):
    return search.dedupe(_hits(spark, sf_dir, 40)).select("chunk_id", "query_id", F.col("rank").cast("long").alias("rank"))




@query(f"SELECT CAST(query_id AS BIGINT) AS query_id, {_EXPAND.format(x='question')} AS expanded FROM {_QUESTIONS_SQL}")
def expand_questions(spark, sf_dir):
    return questions(spark).select("query_id", expand.expanded(F.col("question")).alias("expanded"))


@query(f"SELECT conv_id, turn, {_EXPAND.format(x='text')} AS expanded FROM conversations")
def expand_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", expand.expanded(F.col("text")).alias("expanded"))


@query(f"""
SELECT query_id, string_agg('Source: ' || coalesce(source, 'unknown') || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
  count(*) AS context_chunks FROM {_hits_sql(5)} GROUP BY query_id
""")
def context_text(spark, sf_dir):
    return assemble.context(_hits(spark, sf_dir))


@query(f"""
SELECT query_id, string_agg('📄 Source: ' || coalesce(source, 'unknown') || chr(10) || text || chr(10) || '---', chr(10) ORDER BY rank) AS context
FROM {_hits_sql(5)} GROUP BY query_id
""")
def context_text_alt(spark, sf_dir):
    return assemble.framed_context(_hits(spark, sf_dir))


@query(f"""
SELECT query_id, rank, coalesce(source, 'unknown') AS filename, CAST(round(1 - distance, 3) + 0.0 AS DOUBLE) AS relevance_score,
  substring(text, 1, 200) AS snippet FROM {_hits_sql(5)}
""")
def citations(spark, sf_dir):
    return assemble.citations(_hits(spark, sf_dir)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "filename", "relevance_score", "snippet"
    )


@query(f"""
SELECT query_id, string_agg(coalesce(source, 'unknown') || '|' || substring(text, 1, 200), chr(10) ORDER BY rank) AS listed
FROM {_hits_sql(5)} GROUP BY query_id
""")
def answer_sources(spark, sf_dir):
    """Sources of each answer as an array in rank order, written out flat."""
    got = assemble.sources(_hits(spark, sf_dir))
    return got.select("query_id", F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["filename"], s["snippet"])), "\n").alias("listed"))


@query("SELECT doc_id, substring(text, 1, 200) AS snippet FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, 'chunk_' || sha256(text) AS chunk_id FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", metadata.content_id(F.col("text")).alias("chunk_id"))


@query("SELECT chunk_id, doc_id FROM (SELECT 'chunk_' || sha256(text) AS chunk_id, max(doc_id) AS doc_id FROM documents GROUP BY 1)")
def upsert_last_wins(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select(metadata.content_id(F.col("text")).alias("chunk_id"), "doc_id")
    return store.last_wins(keyed, "chunk_id", "doc_id")


@query("SELECT count(*) AS total_documents, 'documents' AS collection_name, 'hashing' AS embedding_model FROM documents")
def collection_stats(spark, sf_dir):
    return store.stats(table(spark, sf_dir, "documents"))


@query("""SELECT 'ok' AS status, mode <> 'rag' OR n > 0 AS ready, n AS total_documents, CASE WHEN mode = 'rag' THEN 'extractive' ELSE 'dummy' END AS model, mode
FROM (SELECT count(*) AS n FROM documents), (VALUES ('rag'), ('dummy')) AS m(mode)""")
def is_ready(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return store.health(docs, mode="rag").unionByName(store.health(docs, mode="anything else"))


@query("""
SELECT sum(n)::BIGINT AS total_documents, sum(c)::BIGINT AS total_chars, string_agg(source, ',' ORDER BY f) FILTER (source <> '') AS sources
FROM (SELECT source, count(*) AS n, sum(length(text)) AS c, min(doc_id) AS f FROM documents GROUP BY source)
""")
def corpus_summary(spark, sf_dir):
    return assemble.summary(table(spark, sf_dir, "documents"), "doc_id").withColumn("sources", F.array_join("sources", ","))


@query("""
SELECT source, min(doc_id) AS first, count(*) AS n_documents, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM documents WHERE source <> '' GROUP BY source
""")
def corpus_sources(spark, sf_dir):
    """All sources of the corpus with their first document, as a table."""
    return assemble.sources_by_appearance(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def distinct_sources(spark, sf_dir):
    return assemble.distinct_sources(table(spark, sf_dir, "documents"))


_FIXED = """(SELECT doc_id, pos, substring(text, pos * 400 + 1, 400) AS text
  FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 400)) AS pos FROM documents WHERE length(text) > 0))"""


@query(f"SELECT doc_id, pos, text, length(text) AS chunk_size FROM {_FIXED}")
def fixed_chunks(spark, sf_dir):
    got = chunk.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", F.col("chunk_size").cast("long").alias("chunk_size"))


@query(f"SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_index FROM {_FIXED}")
def chunk_ordinals(spark, sf_dir):
    got = chunk.with_ordinals(chunk.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk_index")


@query(f"""
SELECT count(*) AS total_chunks, coalesce(sum(n) // count(*), 0)::BIGINT AS avg_size, coalesce(min(n), 0)::BIGINT AS min_size,
  coalesce(max(n), 0)::BIGINT AS max_size, coalesce(sum(n), 0)::BIGINT AS total_chars FROM (SELECT length(text) AS n FROM {_FIXED})
""")
def chunk_stats(spark, sf_dir):
    return chunk.chunk_stats(chunk.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(r"""SELECT doc_id, true AS fits, true AS found, length(regexp_replace(text, '[\s\x{0b}\p{Z}\x{1c}-\x{1f}\x{85}]', '', 'g')) > 0 AS any_chunk FROM documents""")
def recursive_chunk_invariants(spark, sf_dir):
    """Per document: all chunks hold 1 to 400 characters, all occur in the text, blank texts alone have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = chunk.split_documents(docs).groupBy("doc_id").agg(
        F.min("chunk_size").alias("least"), F.max("chunk_size").alias("most"), F.collect_list("text").alias("parts")
    )
    return docs.join(parts, "doc_id", "left").select(
        "doc_id",
        F.coalesce((F.col("least") >= 1) & (F.col("most") <= 400), F.lit(True)).alias("fits"),
        F.coalesce(F.forall("parts", lambda p: F.contains(F.col("text"), p)), F.lit(True)).alias("found"),
        F.col("parts").isNotNull().alias("any_chunk"),
    )


@query()
def recursive_chunks(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunk.with_ordinals(stored(chunk.split_documents(docs), "split"), "doc_id").select("doc_id", "pos", "chunk_index", "chunk_size", "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(source, '') END AS source, coalesce(lang, '') AS lang,
  coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars FROM documents""")
def metadata_sanitise(spark, sf_dir):
    nulled = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    entries = F.create_map(F.lit("source"), nulled, F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    got = table(spark, sf_dir, "documents").select("doc_id", metadata.sanitised(entries).alias("m"))
    return got.select("doc_id", *(F.col("m")[k].alias(k) for k in ("source", "lang", "n_chars")))


def _validate(source: str, cols: str, column: str) -> str:
    stripped = _strip_sql(column)
    return f"""
SELECT {cols}, reason, reason IS NULL AS valid, CASE WHEN reason IS NULL THEN s END AS question FROM (
  SELECT *, {stripped} AS s, CASE WHEN {column} IS NULL THEN 'missing' WHEN length({column}) < 1 THEN 'too short'
    WHEN length({column}) > 500 THEN 'too long' WHEN {stripped} = '' THEN 'blank' END AS reason FROM {source})"""


@query(_validate(f"(SELECT CAST(query_id AS BIGINT) AS query_id, question FROM {_QUESTIONS_SQL})", "query_id", "question"))
def validate_questions(spark, sf_dir):
    return answer.validated(questions(spark)).select("query_id", "reason", "valid", "question")


@query(_validate("conversations", "conv_id, turn", "text"))
def validate_conversations(spark, sf_dir):
    got = answer.validated(table(spark, sf_dir, "conversations").withColumnRenamed("text", "question"))
    return got.select("conv_id", "turn", "reason", "valid", "question")


@query("SELECT conv_id, turn, 'This is a **dummy reply** for: \"' || " + _strip_sql("text") + """
 || '"' || chr(10) || chr(10) || 'No collection was searched. Ingest documents and ask in mode `rag`.' AS answer,
 'dummy://local' AS filename, 1.0::DOUBLE AS relevance_score, 0::BIGINT AS context_chunks, 'dummy' AS model FROM conversations WHERE role = 'user'""")
def dummy_answers(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumnRenamed("text", "question")
    first = F.col("sources")[0]
    return answer.dummy_answers(asked).select(
        "conv_id", "turn", "answer", first["filename"].alias("filename"), first["relevance_score"].cast("double").alias("relevance_score"),
        "context_chunks", "model",
    )


@query(f"""
SELECT conv_id, coalesce(CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || '…' ELSE t END, '') AS title, n AS n_messages, last_turn, transcript
FROM (SELECT conv_id, {_strip_sql("arg_min(text, turn) FILTER (role = 'user')")} AS t, count(*) AS n, max(turn) AS last_turn,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id)
""")
def session_transcripts(spark, sf_dir):
    return sessions.fold_sessions(table(spark, sf_dir, "conversations"))


@query(f"""
SELECT conv_id, coalesce(CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || '…' ELSE t END, '') AS title, n AS n_messages FROM (
  SELECT conv_id, {_strip_sql("arg_min(text, turn) FILTER (role = 'user')")} AS t, count(*) AS n FROM conversations WHERE conv_id % 7 <> 3 GROUP BY conv_id)
""")
def sessions_after_deletion(spark, sf_dir):
    """The list of sessions once every seventh has been deleted by its id."""
    rows = table(spark, sf_dir, "conversations")
    gone = rows.where("conv_id % 7 = 3").select("conv_id")
    return sessions.without_all(sessions.fold_sessions(rows), gone).select("conv_id", "title", "n_messages")


@query(f"SELECT item_id, 0 AS pos, {_strip_sql('text')} AS text, length({_strip_sql('text')}) AS chunk_size FROM benchmark WHERE length(text) <= 400 AND {_strip_sql('text')} <> ''")
def adhoc_chunks(spark, sf_dir):
    """Chunks of raw texts that are no documents and have no metadata: a short one is its own chunk."""
    raw = table(spark, sf_dir, "benchmark").where(F.length("text") <= 400).select("item_id", "text")
    return chunk.split_documents(raw).select("item_id", F.col("pos").cast("long").alias("pos"), "text", F.col("chunk_size").cast("long").alias("chunk_size"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def session_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return session_store.from_json(session_store.to_json(rows))


@query("""
SELECT conv_id, turn, p AS paragraph, l AS line, lines[l] AS text FROM (
  SELECT conv_id, turn, p, lines, unnest(generate_series(1, len(lines))) AS l FROM (
    SELECT conv_id, turn, p, string_split(ps[p], chr(10)) AS lines FROM (
      SELECT conv_id, turn, ps, unnest(generate_series(1, len(ps))) AS p FROM (
        SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda x: x <> '') AS ps FROM conversations))))
""".replace("\\\\", "\\"))
def paragraphs(spark, sf_dir):
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.paragraphs(F.col("text"))).alias("p", "lines"))
    return got.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("paragraph"), F.posexplode("lines").alias("l", "text")).select(
        "conv_id", "turn", "paragraph", (F.col("l") + 1).cast("long").alias("line"), "text"
    )


@query(r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS name,
  CASE WHEN page_id % 7 > 0 THEN CAST(floor((page_id % 7) / 8.0 * 100 + 0.5) AS DOUBLE) END AS percent FROM pages""")
def basename_percent(spark, sf_dir):
    score = (F.col("page_id") % 7) / 8.0
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("name"), text.percent(score).cast("double").alias("percent"))


@query("""
SELECT c_custkey, CASE WHEN n = 1 THEN 400.0::DOUBLE ELSE CAST(k AS DOUBLE) / (n - 1) * 800.0::DOUBLE END AS x,
  160.0::DOUBLE - c_acctbal / greatest(m, 1.0::DOUBLE) * 140.0::DOUBLE AS y FROM (
  SELECT c_custkey, c_acctbal, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m, count(*) OVER (PARTITION BY c_nationkey) AS n,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)
""")
def chart_scaling(spark, sf_dir):
    return sessions.chart_points(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal").select("c_custkey", "x", "y")


_FAILURES = (
    (1, "query", "runtime", "No documents ingested", '{"detail": "No documents ingested"}'),
    (2, "query", "other", "Invalid API Key", '{"detail": [{"msg": "bad key"}, {"msg": "again"}]}'),
    (3, "query", "other", "expired_api_key", "{}"), (4, "query", "other", "timeout", "not json"),
    (5, "ingest", "runtime", "bad file", '{"detail": null}'), (6, "documents", "other", "Invalid API Key", ""),
)
_FAILURES_SQL = "(VALUES " + ", ".join(f"({i}, '{r}', '{k}', '{m}', '{b}')" for i, r, k, m, b in _FAILURES) + ") AS f(failure_id, route, kind, message, body)"


@query(f"""
SELECT CAST(failure_id AS BIGINT) AS failure_id, status, CASE WHEN msg <> '' THEN msg WHEN detail IS NOT NULL THEN detail
  WHEN status = 400 THEN 'The collection is empty. Ingest documents before asking.' WHEN status >= 500 THEN 'The service failed. Its log says more.'
  ELSE 'Not answered, status ' || status END AS shown FROM (
  SELECT *, CASE WHEN route <> 'query' THEN 500 WHEN kind = 'runtime' THEN 400
    WHEN contains(message, 'expired_api_key') OR contains(message, 'Invalid API Key') THEN 401 ELSE 500 END AS status,
    CASE WHEN json_valid(body) THEN body ->> '$.detail[0].msg' END AS msg,
    CASE WHEN json_valid(body) AND json_type(body, '$.detail') = 'VARCHAR' THEN body ->> '$.detail' END AS detail FROM {_FAILURES_SQL})
""")
def failures(spark, sf_dir):
    rows = spark.createDataFrame(list(_FAILURES), "failure_id long, route string, kind string, message string, body string")
    rows = rows.withColumn("status", answer.http_status(F.col("kind"), F.col("message"), F.col("route")))
    return rows.select("failure_id", "status", answer.error_text(F.col("body"), F.col("status")).alias("shown"))


_EVENT_FAILURES = """(SELECT event_id AS failure_id, CASE event_type WHEN 'signup' THEN 'ingest' WHEN 'click' THEN 'documents' ELSE 'query' END AS route,
  CASE WHEN event_type = 'error' THEN 'runtime' ELSE 'other' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'Invalid API Key' WHEN 1 THEN 'got expired_api_key' WHEN 2 THEN props END AS message,
  CASE event_id % 5 WHEN 0 THEN concat('{"detail": "', event_type, '"}') WHEN 1 THEN concat('{"detail": [{"msg": "', event_type, '"}, {"msg": "again"}]}') WHEN 2 THEN props
    WHEN 3 THEN 'not json' END AS body FROM events)"""


@query(f"""
SELECT failure_id, status, CASE WHEN msg <> '' THEN msg WHEN detail IS NOT NULL THEN detail
  WHEN status = 400 THEN 'The collection is empty. Ingest documents before asking.' WHEN status >= 500 THEN 'The service failed. Its log says more.'
  ELSE 'Not answered, status ' || status END AS shown FROM (
  SELECT *, CASE WHEN route <> 'query' THEN 500 WHEN kind = 'runtime' THEN 400
    WHEN contains(message, 'expired_api_key') OR contains(message, 'Invalid API Key') THEN 401 ELSE 500 END AS status,
    CASE WHEN json_valid(body) THEN body ->> '$.detail[0].msg' END AS msg,
    CASE WHEN json_valid(body) AND json_type(body, '$.detail') = 'VARCHAR' THEN body ->> '$.detail' END AS detail FROM {_EVENT_FAILURES})
""")
def failures_of_events(spark, sf_dir):
    """The status and the shown text of every event, read as a failed request."""
    table(spark, sf_dir, "events").createOrReplaceTempView("granary_events")
    rows = spark.sql("SELECT * FROM " + _EVENT_FAILURES.replace("FROM events", "FROM granary_events"))
    rows = rows.withColumn("status", answer.http_status(F.col("kind"), F.col("message"), F.col("route")))
    return rows.select("failure_id", "status", answer.error_text(F.col("body"), F.col("status")).alias("shown"))


@query("""
WITH signups AS (SELECT user_id, ts AS signup_ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT event_id, signup_id, signup_ts FROM events e ASOF LEFT JOIN signups s ON e.user_id = s.user_id AND e.ts >= s.signup_ts
""")
def events_as_of_signup(spark, sf_dir):
    """Every event with the last sign-up of its user at or before it."""
    events = table(spark, sf_dir, "events")
    signups = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"))
    got = temporal.as_of(events.select("event_id", "user_id", "ts"), signups, "ts", "signup_ts", by=["user_id"])
    return got.select("event_id", "signup_id", "signup_ts")


@query("""
WITH versions AS (SELECT ts AS since, max(event_id) AS version FROM events WHERE event_id % 100 = 0 GROUP BY ts)
SELECT event_id, version FROM events e ASOF LEFT JOIN versions v ON e.ts >= v.since
""")
def version_in_force(spark, sf_dir):
    """Every event with the version that was in force, whatever its key: every hundredth event begins one."""
    events = table(spark, sf_dir, "events")
    versions = events.where("event_id % 100 = 0").select(F.col("ts").alias("since"), F.col("event_id").alias("version"))
    return temporal.as_of(events.select("event_id", "ts"), versions, "ts", "since").select("event_id", "version")


@query("""
SELECT o.o_orderkey, p.o_orderkey AS promotion FROM orders o JOIN orders p ON p.o_orderkey % 100 = 0 AND o.o_orderpriority = p.o_orderpriority
  AND o.o_orderdate >= p.o_orderdate AND o.o_orderdate < p.o_orderdate + to_days(CAST(p.o_orderkey % 37 AS INTEGER))
""")
def orders_in_promotions(spark, sf_dir):
    """Every order with the promotions of its priority that it falls into; every hundredth order begins one of up to 36 days."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    promotions = orders.where("o_orderkey % 100 = 0").select(
        F.col("o_orderkey").alias("promotion"), "o_orderpriority", F.col("o_orderdate").alias("begins"),
        F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 37 AS INT))").alias("ends"),
    )
    return temporal.within(orders, promotions, "o_orderdate", "begins", "ends", by=["o_orderpriority"]).select("o_orderkey", "promotion")


@query("""
WITH k AS (SELECT DISTINCT lower(w) AS keyword FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM benchmark)
), found AS (
  SELECT conv_id, turn, string_agg('<' || keyword || '>', ' ' ORDER BY keyword) AS phrases FROM conversations JOIN k ON contains(lower(text), keyword) GROUP BY ALL
)
SELECT conv_id, turn, concat_ws(' ', text, phrases) AS expanded FROM conversations LEFT JOIN found USING (conv_id, turn)
""")
def expand_by_table(spark, sf_dir):
    """Every turn and the phrases of all long words of the benchmark that occur in it."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("w"))
    known = words.select(F.lower("w").alias("keyword")).distinct().select(F.lit(0).alias("ord"), "keyword", F.concat(F.lit("<"), "keyword", F.lit(">")).alias("phrase"))
    return keywords.expanded_by(table(spark, sf_dir, "conversations"), known).select("conv_id", "turn", "expanded")


@query()
def event_sketches(spark, sf_dir):
    """Users and values of events by type from merged sketches of daily batches, one of them sent twice."""
    events = table(spark, sf_dir, "events")
    kept = sketches.SketchTable(spark, new_folder(spark, "sketches"), ["event_type"])
    for third in (0, 1, 2, 1):
        kept.append(f"part-{third}", events.where(F.dayofmonth("ts") % 3 == third), "user_id", "value")
    return kept.totals()


_SESSIONS = """
WITH marked AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 14400000000 THEN 0 ELSE 1 END AS first FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), numbered AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM marked
), sessions AS (
  SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events, round(sum(coalesce(value, 0)), 4) AS total FROM numbered GROUP BY user_id, session
) SELECT * FROM sessions"""


@query(_SESSIONS)
def event_sessions(spark, sf_dir):
    """Sessions of all users: events less than four hours apart."""
    got = streamed_sessions.folded(table(spark, sf_dir, "events"), 240)
    return got.withColumns({"started": F.col("started").cast("timestamp_ntz"), "ended": F.col("ended").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query(_SESSIONS + """ WHERE epoch_us(ended) + 14400000000 <= (SELECT (epoch_us(max(ts)) // 1000 - 86400000) * 1000 FROM events)""")
def event_sessions_streamed(spark, sf_dir):
    """The same from a stream of the events in any order: all sessions that the watermark, a day behind the last event, has closed."""
    events = stored(table(spark, sf_dir, "events").select("user_id", "ts", "value").repartition(4), "event-stream")
    stream = streamed_sessions.streamed(spark.readStream.schema(events.schema).parquet(events.stored_at), 240)
    out = new_folder(spark, "closed-sessions")
    run = stream.writeStream.format("parquet").option("checkpointLocation", new_folder(spark, "session-checkpoint")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    got = spark.read.schema(streamed_sessions.SESSION).parquet(out)
    return got.withColumns({"started": F.col("started").cast("timestamp_ntz"), "ended": F.col("ended").cast("timestamp_ntz"), "total": F.round("total", 4)})


#: Ends a document in the files that ``documents_as_files`` writes.
_END = "\x1d"


@query("""
SELECT sha256(regexp_replace(translate(text, chr(29), ' '), '\r\n?', chr(10), 'g')) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1
""")
def documents_as_files(spark, sf_dir):
    """All documents written to text files, up to 500 in each, and scanned again as a folder."""
    root = new_folder(spark, "text-files")
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.translate("text", _END, " ").alias("value"))
    docs.write.option("lineSep", _END).option("maxRecordsPerFile", 500).text(f"{root}/raw")
    parts = F.split("text", _END)
    texts = files.documents_from(spark, None, f"{root}/raw", f"{root}/samples").select(F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("text"))
    return texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))


def _chunks(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return stored(embed.embed(store.last_wins(pipeline.chunked(docs, "doc_id"), "chunk_id", "chunk_index"), embed.HashingEmbedder(64)), "embedded")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query()
def embedded_chunks(spark, sf_dir):
    """Every chunk of every document with its id, ordinal and offline embedding."""
    return _chunks(spark, sf_dir).select("chunk_id", "chunk_size", "source", F.size("embedding").alias("width"))


@query()
def retrieved_passages(spark, sf_dir):
    """The five nearest chunks of every benchmark item, extended, ranked and without copies."""
    got = pipeline.retrieve(_asked(spark, sf_dir), _chunks(spark, sf_dir), embed.HashingEmbedder(64))
    return got.select("query_id", "rank", F.round("distance", 6).alias("distance"), "chunk_id", "source")


@query()
def grounded_answers(spark, sf_dir):
    """An extractive answer with sources to every benchmark item."""
    got = pipeline.answer_questions(_asked(spark, sf_dir), _chunks(spark, sf_dir), embed.HashingEmbedder(64), answer.Extractive())
    return got.select("query_id", "answer", F.size("sources").alias("n_sources"), "context_chunks", "model")


@query("WITH " + _EMBEDDED + """ SELECT chunk_id, 64 AS width, round(list_sum(list_transform(range(64), lambda b: (b + 1) * coalesce(v[b + 1], 0))), 4) + 0.0 AS weighed
FROM fixed LEFT JOIN vectors ON id = chunk_id""")
def embedded_fixed_chunks(spark, sf_dir):
    """Every distinct fixed cut with its embedding, summed up by position."""
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return _fixed(spark, sf_dir).select("chunk_id", F.size("embedding").cast("long").alias("width"), (F.round(weighed, 4) + F.lit(0.0)).alias("weighed"))


@query("SELECT query_id, rank, round(distance, 6) + 0.0 AS distance, chunk_id, source FROM " + _hits_sql(5).replace("ON b.id = chunk_id", "ON b.id = chunk_id WHERE source LIKE '%1%'"))
def retrieved_from_sources(spark, sf_dir):
    """The five nearest fixed cuts of every benchmark item among those of some sources, by an index partitioned by source."""
    fixed = _fixed(spark, sf_dir)
    index = ivf.VectorIndex.build(fixed, new_folder(spark, "chunk-index"), id_col="chunk_id", partition="source")
    some = F.col("source").like("%1%")
    got = pipeline.retrieve(_asked(spark, sf_dir), fixed, embed.HashingEmbedder(WIDTH), distinct=False, index=index, where=some, target=None)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), (F.round("distance", 6) + F.lit(0.0)).alias("distance"), "chunk_id", "source")


@query("SELECT query_id, rank, round(distance, 6) + 0.0 AS distance, chunk_id, source FROM " + _hits_sql(5))
def retrieved_plain(spark, sf_dir):
    """The five nearest fixed cuts of every benchmark item, extended by phrases, copies included."""
    got = _hits(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "distance", "chunk_id", "source")
    return got.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(f"""
SELECT query_id, rank, round(distance, 6) + 0.0 AS distance, chunk_id, source FROM {_hits_sql(5)}
QUALIFY row_number() OVER (PARTITION BY query_id, {_strip_sql('text')} ORDER BY rank) = 1
""")
def retrieved_with_scores(spark, sf_dir):
    """The same without copies."""
    got = pipeline.retrieve(_asked(spark, sf_dir), _fixed(spark, sf_dir), embed.HashingEmbedder(WIDTH))
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), (F.round("distance", 6) + F.lit(0.0)).alias("distance"), "chunk_id", "source")


@query(f"""
WITH kept AS (
  SELECT * FROM {_hits_sql(5)} QUALIFY row_number() OVER (PARTITION BY query_id, {_strip_sql('text')} ORDER BY rank) = 1
), contexts AS (
  SELECT query_id, any_value(question) AS question, count(*) AS context_chunks,
    string_agg('Source: ' || coalesce(source, 'unknown') || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
    string_agg(coalesce(source, 'unknown'), '|' ORDER BY rank) AS filenames FROM kept GROUP BY query_id
), lines AS (
  SELECT query_id, question, i, lines[i] AS line FROM (
    SELECT query_id, question, lines, unnest(generate_series(1, len(lines))) AS i FROM (
      SELECT query_id, question, string_split(context, chr(10)) AS lines FROM contexts))
  WHERE NOT starts_with(lines[i], 'Source: ')
), sentences AS (
  SELECT query_id, question, i, j, parts[j] AS sentence FROM (
    SELECT query_id, question, i, parts, unnest(generate_series(1, len(parts))) AS j FROM (
      SELECT query_id, question, i, string_split(line, '. ') AS parts FROM lines))
  WHERE {_strip_sql('parts[j]')} <> ''
), weighed AS (
  SELECT *, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(question), '{_BLANK}+'), lambda x: x <> '')),
    list_distinct(list_filter(regexp_split_to_array(lower(sentence), '{_BLANK}+'), lambda x: x <> '')))) AS n FROM sentences
), best AS (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i, j) <= 3
), said AS (
  SELECT query_id, string_agg('- ' || {_strip_sql('sentence')}, chr(10) ORDER BY i, j) AS answer FROM best WHERE n > 0 GROUP BY query_id
)
SELECT query_id, coalesce(answer, '{answer.Extractive.nothing}') AS answer, filenames, context_chunks, 'extractive' AS model
FROM contexts LEFT JOIN said USING (query_id)
""")
def extractive_answers(spark, sf_dir):
    """An answer from the context of the nearest fixed cuts of every benchmark item, and its sources in rank order."""
    got = pipeline.answer_questions(_asked(spark, sf_dir), _fixed(spark, sf_dir), embed.HashingEmbedder(WIDTH), answer.Extractive())
    return got.select("query_id", "answer", F.array_join("sources.filename", "|").alias("filenames"), "context_chunks", "model")


@query(f"""
WITH kept AS (
  SELECT * FROM {_hits_sql(5)} QUALIFY row_number() OVER (PARTITION BY query_id, {_strip_sql('text')} ORDER BY rank) = 1
) SELECT query_id, '{answer.NO_GENERATOR}' AS answer, 'none' AS model, count(*) AS n_sources FROM kept GROUP BY query_id
""")
def answers_without_generator(spark, sf_dir):
    got = pipeline.answer_questions(_asked(spark, sf_dir), _fixed(spark, sf_dir), embed.HashingEmbedder(WIDTH), None)
    return got.select("query_id", "answer", "model", F.size("sources").cast("long").alias("n_sources"))


#: Files of a folder: name and content. Only .txt and .pdf count; a form feed ends a page of our PDFs.
_FILES = (("b.TXT", "one\r\ntwo é"), ("a.txt", "first"), ("c.md", "not read"), ("d.pdf", "p1\fp2"), ("e.Txt", "\ufeffmark\rend"))


def _split_pages(content: bytes) -> list:
    return [(text, {"page": str(k), "source": "overwritten"}) for k, text in enumerate(content.decode().split("\f"))]


def _put(spark, path: str, content: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content.encode()))
    out.close()


@query("""SELECT 'folder' AS via, * FROM (VALUES ('a.txt', 'text', 0::BIGINT, 'first', NULL), ('b.TXT', 'text', 1, 'one' || chr(10) || 'two é', NULL),
  ('d.pdf', 'pdf', 2, 'p1', '0'), ('d.pdf', 'pdf', 3, 'p2', '1'), ('e.Txt', 'text', 4, chr(65279) || 'mark' || chr(10) || 'end', NULL)) AS t(source, file_type, ordinal, text, page)
UNION ALL SELECT 'paths', * FROM (VALUES ('c.md', 'text', 0::BIGINT, 'not read', NULL), ('d.pdf', 'pdf', 1, 'p1', '0'), ('d.pdf', 'pdf', 2, 'p2', '1'))
UNION ALL SELECT 'raw', * FROM (VALUES ('z.txt', 'text', 0::BIGINT, 'raw', NULL))""")
def file_documents(spark, sf_dir):
    """Documents of a folder of samples, of named paths, and of a raw folder that goes before the samples."""
    root = new_folder(spark, "files")
    for name, content in _FILES:  # a few literals
        _put(spark, f"{root}/samples/{name}", content)
    samples = files.documents_from(spark, [], f"{root}/raw", f"{root}/samples", _split_pages).withColumn("via", F.lit("folder"))
    named = files.documents_from(spark, [f"{root}/samples/c.md", f"{root}/samples/d.pdf"], f"{root}/raw", f"{root}/samples", _split_pages)
    _put(spark, f"{root}/raw/z.txt", "raw")
    raw = files.documents_from(spark, None, f"{root}/raw", f"{root}/samples").withColumn("via", F.lit("raw"))
    every = samples.unionByName(named.withColumn("via", F.lit("paths"))).unionByName(raw)
    return every.select("via", "source", "file_type", "ordinal", "text", F.col("metadata")["page"].alias("page"))


def _rows_for_store(docs, shift=0):
    return docs.select(
        metadata.content_id(F.col("text")).alias("chunk_id"), "text", "source", (F.col("doc_id") + shift).alias("chunk_index"),
        F.length("text").cast("int").alias("chunk_size"), F.create_map().cast("map<string,string>").alias("metadata"),
        F.array(F.lit(0.5).cast("float")).alias("embedding"),
    )


def _three_writes(spark, sf_dir):
    """A collection of all documents but English ones, then those, then some again with other ordinals."""
    docs = table(spark, sf_dir, "documents")
    kept = store.Collection(spark, new_folder(spark, "log"))
    kept.upsert(_rows_for_store(docs.where("lang <> 'en'")))
    kept.upsert(_rows_for_store(docs.where("lang = 'en'")))
    kept.upsert(_rows_for_store(docs.where("doc_id % 3 = 0"), 10_000_000))
    return kept


_THREE_WRITES = """
WITH writes AS (
  SELECT 1 AS write, 'chunk_' || sha256(text) AS chunk_id, doc_id AS chunk_index FROM documents WHERE lang <> 'en'
  UNION ALL SELECT 2, 'chunk_' || sha256(text), doc_id FROM documents WHERE lang = 'en'
  UNION ALL SELECT 3, 'chunk_' || sha256(text), doc_id + 10000000 FROM documents WHERE doc_id % 3 = 0
)"""


@query(_THREE_WRITES + """
SELECT version, chunk_id, chunk_index FROM writes, (VALUES (1), (2), (3)) AS v(version) WHERE write <= version
QUALIFY row_number() OVER (PARTITION BY version, chunk_id ORDER BY write DESC, chunk_index DESC) = 1
""")
def collection_as_of(spark, sf_dir):
    """A collection as of each of three commits."""
    kept = _three_writes(spark, sf_dir)
    rows = [kept.read(n).select(F.lit(n).cast("long").alias("version"), "chunk_id", "chunk_index") for n in kept.commits()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(_THREE_WRITES + """
SELECT chunk_id, chunk_index FROM writes WHERE chunk_id IN (SELECT 'chunk_' || sha256(text) FROM benchmark UNION SELECT 'chunk_' || sha256(text) FROM documents WHERE doc_id % 50 = 0)
QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY write DESC, chunk_index DESC) = 1
""")
def collection_lookup(spark, sf_dir):
    """Rows of some keys, from the buckets that hold them."""
    docs, items = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("text"), table(spark, sf_dir, "benchmark").select("text")
    ids = docs.unionByName(items).select(metadata.content_id(F.col("text")).alias("chunk_id"))
    return _three_writes(spark, sf_dir).lookup(ids).select("chunk_id", "chunk_index")


@query("""SELECT 'chunk_' || sha256(text) AS chunk_id, coalesce(max(doc_id + 10000000) FILTER (lang = 'en'), max(doc_id)) AS chunk_index
FROM documents GROUP BY 1""")
def collection_merges(spark, sf_dir):
    """A collection after all documents were merged, then the English ones again with other ordinals, twice."""
    docs = table(spark, sf_dir, "documents")
    kept = store.Collection(spark, new_folder(spark, "collection"))
    kept.upsert(_rows_for_store(docs))
    for _ in range(2):
        kept.upsert(_rows_for_store(docs.where("lang = 'en'"), 10_000_000))
    return kept.read().select("chunk_id", "chunk_index")


@query("""SELECT * FROM (SELECT 'new' AS step, false AS ready, 0::BIGINT AS total_documents, 'none' AS status
UNION ALL SELECT 'loaded', true, count(DISTINCT text), 'given ' || count(*) FROM documents UNION ALL SELECT 'dropped', false, 0, 'cleared')""")
def collection_lifecycle(spark, sf_dir):
    """What a collection says of itself when new, loaded and dropped."""
    kept = store.Collection(spark, new_folder(spark, "collection"))
    said = lambda step, status: (step, kept.ready(), store.stats(kept.read()).first()["total_documents"], status)
    rows = [said("new", "none")]
    rows.append((lambda n: said("loaded", f"given {n}"))(kept.upsert(_rows_for_store(table(spark, sf_dir, "documents")))))
    rows.append((lambda r: said("dropped", r["status"]))(kept.drop()))
    return spark.createDataFrame(rows, "step string, ready boolean, total_documents long, status string")


@query("""SELECT user_id AS conv_id, epoch_us(max(ts)) // 1000 AS updated_ms, count(*) AS n_messages FROM events GROUP BY 1""")
def session_updates(spark, sf_dir):
    """Sessions of events by user, with the time of the last one."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.lit("user").alias("role"), F.col("event_type").alias("text"), "ts"
    )
    return sessions.fold_sessions(rows, time_col="ts").select("conv_id", "updated_ms", "n_messages")
