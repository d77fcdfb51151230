"""Benchmark decontamination: BM25 over the test items with block-max pruning.

The test items are the documents of an inverted index; every passage of the training corpus is
a query. Weights are BM25 of the term in the item, divided by the item's score against itself,
so a passage that holds the whole item scores 1 whatever the item's length. Items lie in
blocks, ordered by their rarest terms; the index keeps each term's largest weight overall and
in each block. A passage is dropped when its largest weights cannot reach the threshold, then
in every block whose block-max weights cannot (the WAND bounds, taken for whole batches of
passages at once); what is left is scored exactly and all items at or above the threshold are
retrieved. Pairs are verified by five-word shingles: the passage must hold at least
``overlap`` of those of the item's question (all sentences but the last) and of those that
touch its answer (the last sentence).

Passages are windows of twice the length of the longest item, in steps of that length, over
whole documents: every stretch as long as an item lies inside a window. Document frequencies,
the number and mean length of items and the step of the windows are those of all items. The
index is made in shards by tasks, and a bounded number of shards is broadcast at a time; more
items mean more passes over the corpus, not a larger broadcast. How items are dealt into shards
changes no result.

Defined results for odd input:

* null, empty or wordless document: no passage, never contaminated.
* null, empty or wordless item: ignored. Items under five words: the whole item is one shingle.
* items of equal text are one item: it has the least of their ids and counts them (``n_items``).
* repeated rows and exact copies: each row is judged; equal (doc_id, item_id) results are one,
  with the best score. A score at the threshold, a tie, is found.
* ids are whole numbers; null ids are carried along. ``clean`` judges rows, not ids: a row with
  a null id goes if it is contaminated, a clean row stays whoever shares its id.
* empty tables: nothing is contaminated. Other columns are kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import hashing
from granary.llm.shared import bounded_batches, dropped_rows, removed, row_key, spread, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.75
SHINGLE = 5
BLOCK_ITEMS = 8
SHARD_BYTES = 256 << 10  # bytes of item text in a shard
SHARDS_A_PASS = 8  # shards broadcast together; more items mean more passes
MIN_WINDOW = 32


def words_in(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return hashing.words(raw, np.array([0, len(raw)]), hashing.LETTERS)[0]


def grams(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Shingles in order, with repeats; a shorter sequence is one shingle."""
    if not len(h):
        return h
    size = min(size, len(h))
    factors = hashing.mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        out += h[k : k + len(out)] * factors[k]
    return hashing.mix(out + np.uint64(size))


def question_words(text: str) -> int:
    """Words of all sentences but the last; of two thirds of the item if it has one sentence."""
    ends = [m.end() for m in re.finditer(r"[.?!:]+[\x20\x09-\x0D]+|\n+", text.rstrip())]
    for end in reversed(ends):
        before, n = len(words_in(text[:end])), len(words_in(text))
        if 0 < before < n:
            return before
    return 2 * len(words_in(text)) // 3


@dataclass(frozen=True)
class Shard:
    terms: np.ndarray  # sorted hashes
    top: np.ndarray  # (terms,) largest weight of each
    block_top: np.ndarray  # (terms, blocks)
    block_of_posting: np.ndarray  # postings in order of their block
    posting_terms: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    item_ids: list  # (item_id, n_items)
    question: list[np.ndarray]  # shingles
    answer: list[np.ndarray]
    lengths: np.ndarray  # words


def build(rows: list[tuple], n_items: int, mean: float) -> Shard:
    """Index a shard's items ((item_id, n_items), text, terms, tf, df), of ``n_items`` in all with ``mean`` words."""
    rows = [(ids, text, words_in(text), *(np.asarray(x) for x in (terms, tf, df))) for ids, text, terms, tf, df in rows]
    terms, first = np.unique(np.concatenate([r[3] for r in rows]), return_index=True)
    df = np.concatenate([r[5] for r in rows])[first]
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    sets = [(r[3], r[4]) for r in rows]
    # Items with a rare term in common stand together, so their blocks are tight.
    rarest = [terms[at[idf[at].argmax()]] for at in (np.searchsorted(terms, s[0]) for s in sets)]
    order = np.argsort(np.array(rarest, dtype=np.uint64), kind="stable")
    rows, sets = [rows[k] for k in order], [sets[k] for k in order]
    at, item, weight = [], [], []
    for k, (t, tf) in enumerate(sets):
        x = np.searchsorted(terms, t)
        w = idf[x] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(rows[k][2]) / mean))
        at.append(x)
        item.append(np.full(len(x), k))
        weight.append(w / w.sum())
    at, item, weight = np.concatenate(at), np.concatenate(item), np.concatenate(weight)
    order = np.lexsort((at, item // BLOCK_ITEMS))
    at, item, weight = at[order], item[order], weight[order]
    block_top = np.zeros((len(terms), -(-len(rows) // BLOCK_ITEMS)), dtype=np.float32)
    np.maximum.at(block_top, (at, item // BLOCK_ITEMS), weight.astype(np.float32))
    question, answer = [], []
    for _, text, w, *_ in rows:
        g, q = grams(w), question_words(text)
        in_question = g[: max(q - SHINGLE + 1, 0)]
        question.append(np.unique(in_question if len(in_question) else g))
        answer.append(np.unique(g[max(q - SHINGLE + 1, 0) :] if len(g) > max(q - SHINGLE + 1, 0) else g))
    return Shard(
        terms, block_top.max(axis=1), block_top, item // BLOCK_ITEMS, at, item, weight,
        [r[0] for r in rows], question, answer, np.array([len(r[2]) for r in rows]),
    )


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts; starts has one more entry than there are parts, parts may be empty."""
    if values.ndim == 1:
        run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return run[starts[1:]] - run[starts[:-1]]
    out = np.zeros((len(starts) - 1, values.shape[1]), dtype=values.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


def search(shard: Shard, terms: np.ndarray, starts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(passage, item, score) of all scores at the threshold; terms are distinct positions in the index."""
    slack = threshold - 1e-5
    alive = np.flatnonzero(_sums(shard.top[terms], starts) >= slack)
    row_of = np.full(len(shard.terms), -1)
    for k in range(0, len(alive), 2048):
        passages = alive[k : k + 2048]
        mine, at = _part(terms, starts, passages)
        bound = _sums(shard.block_top[mine], at)
        for block in np.flatnonzero((bound >= slack).any(axis=0)):
            left = np.flatnonzero(bound[:, block] >= slack)
            own, cut = _part(mine, at, left)
            posts = slice(*np.searchsorted(shard.block_of_posting, [block, block + 1]))
            there, row = np.unique(shard.posting_terms[posts], return_inverse=True)
            weights = np.zeros((len(there) + 1, BLOCK_ITEMS))  # the last row is for other terms
            weights[row, shard.items[posts] % BLOCK_ITEMS] = shard.weights[posts]
            row_of[there] = np.arange(len(there))
            scores = _sums(weights[row_of[own]], cut).round(6)  # so that the order of the sum does not show
            row_of[there] = -1
            for p, item in np.argwhere(scores >= threshold):
                yield int(passages[left[p]]), int(block * BLOCK_ITEMS + item), float(scores[p, item])


def _part(values: np.ndarray, starts: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some consecutive parts, one after the other, and where each starts."""
    sizes = starts[parts + 1] - starts[parts]
    at = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts[parts] - at[:-1], sizes) + np.arange(at[-1])], at


def windows(n_words: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of all windows of 2 * step words, step apart, over the texts."""
    count = np.maximum(-(-n_words // step) - 1, 1)
    text = np.repeat(np.arange(len(n_words)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    return text, first, np.minimum(first + 2 * step, n_words[text])


def described(items: DataFrame) -> DataFrame:
    """(item_key, item_id, n_items, text, n, terms, tf): the distinct texts of the items and their words."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.groupBy(F.unhex(F.sha2("text", 256)).alias("item_key")).agg(
        F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.first("text").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_in(t) for t in batch.column(3).to_pylist()]
            sets = [np.unique(w, return_counts=True) for w in words]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([t.view(np.int64) for t, _ in sets], longs), pa.array([c for _, c in sets], longs)],
                ["item_key", "item_id", "n_items", "text", "n", "terms", "tf"],
            )

    kind = "item_key binary, item_id long, n_items long, text string, n long, terms array<long>, tf array<long>"
    return texts.mapInArrow(run, kind).where("n > 0")


def shards_of(items: DataFrame, n_items: int, mean: float, n_shards: int) -> DataFrame:
    """(shard, index): the inverted index in parts, each made by a task from the items dealt to it."""
    each = items.select("item_key", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("item_key", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    postings = each.join(df, "term").groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "df"))).alias("postings"))
    dealt = items.join(postings, "item_key").select(
        F.pmod(F.xxhash64("item_key"), F.lit(n_shards)).alias("shard"), "item_id", "n_items", "text", "postings.term", "postings.tf", "postings.df"
    )

    def run(table: pa.Table) -> pa.Table:
        shard, ids, copies, text, term, tf, freq = (c.to_pylist() for c in table.columns)
        term = [np.array(t, dtype=np.int64).view(np.uint64) for t in term]
        term, tf, freq = zip(*((t[o], np.array(x)[o], np.array(d)[o]) for t, x, d in zip(term, tf, freq, strict=True) for o in [np.argsort(t)]), strict=True)
        rows = sorted(zip(zip(ids, copies, strict=True), text, term, tf, freq, strict=True), key=lambda r: r[1])
        return pa.table({"shard": pa.array(shard[:1], pa.int64()), "index": pa.array([pickle.dumps(build(rows, n_items, mean))], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(run, "shard long, index binary")


def row_matches(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(doc_id, row_key, item_id, n_items, score, question_overlap, answer_overlap) of every verified passage and item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = "doc_id long, row_key long, item_id long, n_items long, score double, question_overlap double, answer_overlap double"
    known = stored(described(items), "items")
    total = known.agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("longest"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not total["items"]:
        return spark.createDataFrame([], kind)
    n_shards = int(total["bytes"] // shard_bytes) + 1
    step = max(MIN_WINDOW, total["longest"])
    index = stored(shards_of(known, total["items"], total["mean"], n_shards), "index")
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long"), row_key(text), text)
    found = []
    for first in range(0, n_shards, SHARDS_A_PASS):
        # At most SHARDS_A_PASS shards, each of about ``shard_bytes`` of items, or one item that is longer.
        part = index.where((F.col("shard") >= first) & (F.col("shard") < first + SHARDS_A_PASS)).orderBy("shard").collect()
        shared = spark.sparkContext.broadcast([pickle.loads(r["index"]) for r in part])
        found.append(source.mapInArrow(_judge(shared, step, threshold, overlap), kind))
        if n_shards > SHARDS_A_PASS:
            found[-1] = stored(found[-1], "matches")
            shared.unpersist()
    removed(known, index)
    return functools.reduce(DataFrame.unionByName, found)


def matches(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """Distinct (doc_id, item_id) with the best passage's score and overlaps."""
    return row_matches(docs, items, **limits).groupBy("doc_id", "item_id").agg(
        F.max("n_items").alias("n_items"), F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"),
    )


def _judge(shared, step: int, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, end, buf, bounds in hashing.text_slices(batch.column(2)):
                h, text_of, _ = hashing.words(buf, bounds, hashing.LETTERS)
                begin = np.searchsorted(text_of, np.arange(end - row + 1))
                for shard in shared.value:
                    for text, item, *values in _slice_matches(shard, h, begin, step, threshold, overlap):
                        doc = [batch.column(k)[row + text].as_py() for k in (0, 1)]
                        for column, value in zip(out, (*doc, *shard.item_ids[item], *values), strict=True):
                            column.append(value)
            kinds = [pa.int64()] * 4 + [pa.float64()] * 3
            names = ["doc_id", "row_key", "item_id", "n_items", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return run


def _slice_matches(shard: Shard, h: np.ndarray, begin: np.ndarray, step: int, threshold: float, overlap: float):
    """(text, item, score, question overlap, answer overlap) of all verified passages of some texts."""
    at = np.searchsorted(shard.terms, h)
    at[at == len(shard.terms)] = 0
    known = shard.terms[at] == h
    before = np.concatenate([[0], np.cumsum(known)])
    text, first, stop = windows(np.diff(begin), step)
    lo, hi = begin[text] + first, begin[text] + stop
    # The distinct known terms of each window, one window after the other.
    terms, starts = _window_terms(at[known], before[lo], before[hi])
    key = np.sort(np.repeat(np.arange(len(lo)), np.diff(starts)) * len(shard.terms) + terms)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    window, terms = key // len(shard.terms), key % len(shard.terms)
    for w, item, score in search(shard, terms, np.searchsorted(window, np.arange(len(lo) + 1)), threshold):
        mine = grams(h[lo[w] : hi[w]], min(SHINGLE, int(shard.lengths[item])))
        q, a = (float(np.isin(x[item], mine).mean()) for x in (shard.question, shard.answer))
        if q >= overlap and a >= overlap:
            yield int(text[w]), item, score, q, a


def _window_terms(known: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(hi - lo)])
    return known[np.repeat(lo - starts[:-1], hi - lo) + np.arange(starts[-1])], starts


def clean(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """The rows without a verified match. Their few keys are broadcast, so texts need not move for them."""
    bad = stored(row_matches(docs.select("doc_id", "text"), items, **limits).select("doc_id", "row_key").distinct(), "contaminated")
    return dropped_rows(docs, bad)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return matches(docs, items).select(
        "doc_id", "item_id", "n_items", F.round("score", 4).alias("score"), F.round("question_overlap", 4).alias("question_overlap"),
        F.round("answer_overlap", 4).alias("answer_overlap"),
    )
