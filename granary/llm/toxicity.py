"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

Every word gets the log-odds of toxic against clean text, learned with a chain of Dirichlet
priors: the counts of a word are smoothed towards those of its first six bytes, these towards
those of its first four, these towards all words. Less a small drift, the log-odds are the
scores of a document's words; one linear scan (Ruzzo and Tompa, 1999) finds all its maximal
segments. Under clean text the best segment of n words follows a Gumbel law (Karlin and
Altschul, 1990), whose two constants are fitted on labelled rows that the log-odds have not
seen. The calibrated best and summed segments give the document's score by logistic regression.

Learning uses labelled rows outside the held-out fold only, at most ``MOST`` a class; text is
the only input of a score. Counts live in hashed tables of fixed size, so the model is too.

Defined results for odd input:

* null, empty or wordless text: no segment, the score of a document without toxic words.
* no labels of a class: nothing can be learned, every score is 0.
* null doc_id: scored like any other row, not held out. Ids are whole numbers. Repeated rows and
  ties: one result each, the same for equal texts.
* empty table: empty result. Other columns, whatever their names, are ignored. Very long texts
  are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import hashing
from granary.llm.labelled import held_out, training_rows
from granary.llm.shared import bounded_batches, spread

BUCKETS = 1 << 17
PREFIXES = (6, 4)
PRIOR = 8.0
DRIFT = 0.4
FLOOR = 0.8  # log-odds below this say nothing
MOST = 15_000  # labelled rows a class to learn from
CUT = 0.3
#: Training folds: words are counted on these, the calibration uses the rest.
COUNT_FOLDS = (0, 1)


@dataclass(frozen=True)
class Model:
    toxic: np.ndarray  # (3, BUCKETS) words seen in toxic rows: by word, by 6 bytes, by 4 bytes
    total: np.ndarray
    base: float
    decay: float  # Gumbel: lambda
    scale: float  # Gumbel: log K
    weights: tuple[float, float, float] | None

    def token_scores(self, keys: list[np.ndarray]) -> np.ndarray:
        q = np.full(len(keys[0]), self.base)
        for row in (2, 1, 0):
            at = (keys[row] & np.uint64(BUCKETS - 1)).astype(np.int64)
            q = (self.toxic[row, at] + PRIOR * q) / (self.total[row, at] + PRIOR)
        odds = np.log(q / (1 - q)) - np.log(self.base / (1 - self.base))
        return np.where(odds >= FLOOR, odds, 0.0) - DRIFT

    def calibrated(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Minus the log of the expected number of such segments in n clean words."""
        return self.decay * best - self.scale - np.log(np.maximum(n, 1))

    def probability(self, best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(best))
        a, b, c = self.weights
        z = a + b * features(self.calibrated(best, n)) + c * features(total)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one scan.

    Runs of words above zero are joined first; only they can begin or end a segment. Each
    segment remembers the last one that starts lower, so the search back skips over the rest.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.diff(np.concatenate([[0], up.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list] = []  # start, end, sum before, sum after, last held one that starts lower
    for s, e, low, high in zip(starts.tolist(), ends.tolist(), run[starts].tolist(), run[ends].tolist(), strict=True):
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= low:
                k = held[k][4]
            if k < 0 or held[k][3] >= high:
                held.append([s, e, low, high, k])
                break
            s, low = held[k][0], held[k][2]
            del held[k:]
    return [(s, e, high - low) for s, e, low, high, _ in held]


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(texts, bounds of each text's words, keys of the words) by slices of the batch."""
    for first, end, buf, bounds in hashing.text_slices(texts):
        h, text_of, _, *more = hashing.words(buf, bounds, hashing.LETTERS, PREFIXES)
        yield end - first, np.searchsorted(text_of, np.arange(end - first + 1)), [h, *more]


def word_counts(rows: DataFrame) -> DataFrame:
    """(level, bucket, toxic, total) over rows (text, y): summed per slice, then per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            row = 0
            for n, bounds, keys in _hashed(batch.column(0)):
                of = np.repeat(y[row : row + n], np.diff(bounds))
                row += n
                for level, key in enumerate(keys):
                    at = (key & np.uint64(BUCKETS - 1)).astype(np.int64)
                    total, toxic = np.bincount(at, minlength=BUCKETS), np.bincount(at[of == 1], minlength=BUCKETS)
                    hit = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hit), level)), pa.array(hit), pa.array(toxic[hit]), pa.array(total[hit])],
                        ["level", "bucket", "toxic", "total"],
                    )

    return rows.select("text", "y").mapInArrow(run, "level long, bucket long, toxic long, total long").groupBy("level", "bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("total").alias("total")
    )


def measured(docs: DataFrame, model: Model, carry: str) -> DataFrame:
    """(carry, best, total, n, passages) of every row of (carry, text)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for n, bounds, keys in _hashed(batch.column(1)):
                scores = model.token_scores(keys)
                for k in range(n):
                    found = maximal_segments(scores[bounds[k] : bounds[k + 1]])
                    words = int(bounds[k + 1] - bounds[k])
                    values = model.calibrated(np.array([x[2] for x in found]), np.full(len(found), words))
                    sure = [{"start": s, "end": e, "score": x, "bits": v} for (s, e, x), v in zip(found, values.tolist(), strict=True) if v > 0]
                    for column, x in zip(out, (max((x[2] for x in found), default=0.0), sum(x["bits"] for x in sure), words, sure), strict=True):
                        column.append(x)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("bits", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.float64(), pa.float64(), pa.int64(), kind), strict=True))],
                [carry, "best", "total", "n", "passages"],
            )

    return docs.select(F.col(carry).cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"{carry} long, best double, total double, n long, passages array<struct<start:long,end:long,score:double,bits:double>>"
    )


def _gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and log K from the clean rows' best segments, by moments."""
    some = best[best > 0]
    if len(some) < 10 or some.std() < 1e-6:
        return 1.0, 0.0
    decay = float(np.clip(np.pi / (np.sqrt(6) * some.std()), 0.05, 2.0))
    scale = float(decay * best.mean() - np.log(np.maximum(n, 1)).mean() - 0.5772)
    return decay, scale


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression with intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    rows = training_rows(docs, labels, "toxic", most)
    counted = word_counts(rows.where(F.col("part").isin(*COUNT_FOLDS))).toPandas()  # 3 * BUCKETS rows at most
    toxic, total = np.zeros((3, BUCKETS)), np.zeros((3, BUCKETS))
    at = counted["level"].to_numpy(np.int64), counted["bucket"].to_numpy(np.int64)
    toxic[at], total[at] = counted["toxic"], counted["total"]
    base = float((toxic[0].sum() + 1) / (total[0].sum() + 2))
    model = Model(toxic, total, base, 1.0, 0.0, None)
    # A row's label goes along in its key, beside the id's hash: ids may be any 64-bit numbers.
    key = F.shiftleft(F.shiftright(F.xxhash64("doc_id"), 1), 1) + F.col("y")
    judged = rows.where(~F.col("part").isin(*COUNT_FOLDS)).withColumn("key", key)
    held = measured(judged, model, "key").select("key", "best", "n").toPandas()  # numbers of a bounded sample
    y = held["key"].to_numpy(np.int64) % 2
    best, n = held["best"].to_numpy(float), held["n"].to_numpy(float)
    if not toxic[0].sum() or not (total - toxic)[0].sum() or not (y == 1).any() or not (y == 0).any():
        return model
    # The clean rows' bulk, without the top tenth in which mislabelled rows would be.
    clean = y == 0
    bulk = clean & (best <= np.quantile(best[clean], 0.9))
    decay, scale = _gumbel(best[bulk], n[bulk])
    model = Model(toxic, total, base, decay, scale, None)
    again = measured(judged, model, "key").select("key", "best", "total", "n").toPandas()
    y = again["key"].to_numpy(np.int64) % 2
    x = np.column_stack([
        features(model.calibrated(again["best"].to_numpy(float), again["n"].to_numpy(float))), features(again["total"].to_numpy(float))
    ])
    w = logistic(x, y)
    return Model(toxic, total, base, decay, scale, tuple(w.tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_words, best and the significant passages (word ranges) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(best, total, n):
        import pandas as pd

        return pd.Series(shared.value.probability(best.to_numpy(float), total.to_numpy(float), n.to_numpy(float)))

    return measured(docs, model, "doc_id").select(
        "doc_id", probability("best", "total", "n").alias("score"), F.col("n").alias("n_words"), "best", "passages"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
