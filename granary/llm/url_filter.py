"""URL filters: ordered host and path rules, then a blocked Bloom filter with an exact join.

The list of unwanted canonical URLs may be long. Its Bloom filter, cut into 64-byte blocks so
that a lookup touches one block, passes possible hits only; an exact hash join of these with
the list removes the false positives. The filter is the only thing broadcast and its size is
bounded by ``max_blocks`` whatever the length of the list: beyond that it lets more false
positives through, which cost time in the join but never change the result.

A listed canonical URL ``host/path`` covers the host, its subdomains and all paths below it:
a URL is looked up under every suffix of its host and every prefix of its path, as deep as the
list goes. Keys are chained hashes of labels and segments, so a lookup costs time in proportion
to the URL's length; URLs are tested where they lie, and only possible hits are shuffled.

Defined results for odd input:

* null url or no ``://``: host and path are empty, no rule fits, verdict ``allow``.
* repeated rows and equal urls: one output row per input row; equal urls share one join.
* null or empty listed URLs are ignored; an empty list blocks nothing; an empty table gives
  an empty result. Very long urls are looked up whole. Ties: of several listed URLs that cover
  one, the longest is named, of equally long ones the last in order of code points.
* Other columns are carried along, whatever their names; those named like an output (host,
  path, rule, verdict, listed_url) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bloom
from granary.llm.hashing import mix
from granary.llm.shared import broadcast_if_small, removed, spread, stored

#: (verdict, host, path): fixed values of the query's contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Listed sites of the query: every name under each of these domains, and all pages of one id in REPORTED.
LISTED_NAMES = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
REPORTED = 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(
        F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def canonical(url: Column) -> Column:
    """host/path without port, default prefixes, repeated or trailing slashes, query and fragment."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/(?:\\./)*/*", "/"), "/$", "")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path)))


def _chain(parts: list[str]) -> list[int]:
    """Hash of the first part, of the first two parts, and so on."""
    out, h = [], 0
    for part in parts:
        h = xxhash.xxh3_64_intdigest(part, seed=h)
        out.append(h)
    return out


def split_url(url: str) -> tuple[list[str], list[str]]:
    """Labels of a canonical URL's host from the last one on, and segments of its path."""
    host, _, path = url.partition("/")
    return host.split(".")[::-1], [x for x in path.split("/") if x]


def keys_of(url: str, hosts: int, paths: int) -> tuple[np.ndarray, int]:
    """Keys of all suffixes of the host (up to ``hosts`` labels) with all prefixes of the path (up to ``paths`` segments, and none)."""
    labels, segments = split_url(url)
    h = np.array(_chain(labels[:hosts]), dtype=np.uint64)
    p = np.array([0, *_chain(segments[:paths])], dtype=np.uint64)
    return mix(h[:, None] * np.uint64(0x9FB21C651E98DF25) + p[None, :]).ravel(), len(p)


def covering(url: str, key: int, per_host: int) -> str:
    """The canonical URL that stands behind a key of ``keys_of``."""
    labels, segments = split_url(url)
    return ".".join(labels[key // per_host :: -1]) + "/" + "/".join(segments[: key % per_host])


def _list_keys(listed: DataFrame) -> DataFrame:
    """(key, labels, segments) of canonical URLs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0).to_pylist()
            depth = [tuple(map(len, split_url(u))) for u in urls]
            key = np.array([keys_of(u, h, p)[0][-1] for u, (h, p) in zip(urls, depth, strict=True)], dtype=np.uint64)
            columns = [pa.array(key.view(np.int64)), *(pa.array([d[k] for d in depth], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "labels", "segments"])

    return listed.mapInArrow(run, "key long, labels long, segments long")


def may_be_listed(urls: DataFrame, table: np.ndarray, hosts: int, paths: int) -> DataFrame:
    """(url, listed_url): for the canonical URL of each row (url, canonical) the possible listed ones."""
    shared = urls.sparkSession.sparkContext.broadcast(table)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, str] = {}
            for url, plain in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                found.setdefault(url, plain)  # equal URLs of a batch are looked up once
            rows, keys, at = list(found.items()), [], [0]
            for _, plain in rows:
                keys.append(keys_of(plain, hosts, paths))
                at.append(at[-1] + len(keys[-1][0]))
            if not rows:
                continue
            hit = np.flatnonzero(bloom.may_hold(shared.value, np.concatenate([k for k, _ in keys])))
            row = np.searchsorted(at, hit, side="right") - 1
            names = [covering(rows[r][1], int(k - at[r]), keys[r][1]) for r, k in zip(row.tolist(), hit.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([rows[r][0] for r in row], pa.string()), pa.array(names, pa.string())], ["url", "listed_url"])

    return urls.mapInArrow(test, "url string, listed_url string")


def listed_urls(
    urls: DataFrame, listed: DataFrame, url_col: str = "url", bits_per_key: int = 16, max_blocks: int = 1 << 18
) -> DataFrame:
    """Distinct urls that a listed canonical URL covers: columns url and listed_url (the longest)."""
    listed = stored(listed.select(F.col("listed_url").cast("string").alias("listed_url")).where("listed_url <> ''").distinct(), "listed")
    keys = stored(_list_keys(listed), "list-keys")
    depth = keys.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.max("segments").alias("segments")).first()
    if not depth["n"]:
        return listed.select(F.col("listed_url").alias("url"), "listed_url")
    table = bloom.build(keys, bloom.blocks_for(depth["n"], bits_per_key, max_blocks))
    removed(keys)
    asked = urls.select(F.col(url_col).cast("string").alias("url"), canonical(F.col(url_col).cast("string")).alias("canonical")).where("canonical is not null")
    possible = may_be_listed(asked, table, depth["labels"], depth["segments"]).distinct()
    return possible.join(listed, "listed_url").groupBy("url").agg(
        F.max_by("listed_url", F.struct(F.length("listed_url"), F.col("listed_url"))).alias("listed_url")
    )


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict and listed_url to every page."""
    hits = stored(listed_urls(pages, listed, url_col), "listed-pages")
    hits = broadcast_if_small(hits, 32 + F.octet_length("url") + F.octet_length("listed_url")).alias("h")
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    ruled = pages.select(F.struct(*pages.columns).alias("row"), url.alias("url"), host.alias("host"), path.alias("path"))
    ruled = ruled.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).alias("p")
    out = {
        "host": F.col("p.host"), "path": F.col("p.path"), "rule": F.col("p.best.rule"),
        "verdict": F.coalesce(F.col("p.best.verdict"), F.when(F.col("h.listed_url").isNotNull(), "block").otherwise("allow")),
        "listed_url": F.col("h.listed_url"),
    }
    kept = [F.col("p.row")[c].alias(c) for c in pages.columns if c not in out]
    return ruled.join(hits, F.col("p.url") == F.col("h.url"), "left").select(*kept, *(c.alias(k) for k, c in out.items()))


def site_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{n}.{d}/",) for n in LISTED_NAMES for d in LISTED_DOMAINS], "listed_url string")


def reported(pages: DataFrame, every: int = REPORTED) -> DataFrame:
    """Canonical URLs of the pages whose id ends a block of ``every``: they stand for a list of reports."""
    return pages.where(F.col("page_id") % every == every - 1).select(canonical(F.col("url")).alias("listed_url"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    listed = site_list(spark).unionByName(reported(pages))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed_url")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(v, h, q)
), best AS (
  SELECT rid, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY rid
), canonical AS (
  SELECT rid, page_id, h || CASE WHEN q = '' THEN '/' ELSE q END AS url, h, list_filter(string_split(q, '/'), lambda x: x <> '') AS segments FROM (
    SELECT rid, page_id, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS h,
      regexp_replace(regexp_replace(path, '/(?:\./)*/*', '/', 'g'), '/$', '') AS q FROM p) WHERE h <> ''
), listed AS (
  SELECT n || '.' || d || '/' AS listed_url FROM (VALUES ('ads-track'), ('casino-win'), ('spam-farm'), ('adult-x'), ('cheap-pills'), ('free-bets')) AS a(n),
    (VALUES ('example.com'), ('example.net'), ('example.org')) AS b(d)
  UNION SELECT url FROM canonical WHERE page_id % 10 = 9
), hosts AS (
  SELECT rid, segments, array_to_string(l[i:], '.') AS host FROM (
    SELECT rid, segments, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT rid, segments, string_split(h, '.') AS l FROM canonical))
), keys AS (
  SELECT rid, host || '/' || array_to_string(segments[:j], '/') AS key FROM (
    SELECT rid, host, segments, unnest(generate_series(0, len(segments))) AS j FROM hosts)
), hit AS (
  SELECT rid, listed_url FROM keys JOIN listed ON key = listed_url
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(listed_url) DESC, listed_url DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed_url
FROM p LEFT JOIN best USING (rid) LEFT JOIN hit USING (rid)
"""
