"""A byte-level convolutional network in numpy that judges the quality of whole documents.

Learned filters of ``WIDTH`` bytes run over every document at a stride of ``STRIDE``; each
overlapping chunk of two blocks keeps the largest answer of every filter. A document is the
largest and the mean answer of its chunks, joined by a small hidden layer into one
probability. Bytes are one-hot, so a filter is a table of 256 rows per position and the
convolution a sum of table look-ups; blocks are bounded pieces of work, whatever the length of
the text, and cover it from its first byte to its last.

Training draws a bounded, hash-chosen sample of labelled rows outside the held-out fold (at
most about ``MOST`` a class and ``MOST_BYTES`` in all, taken as whole texts; texts over a
sixteenth of that are scored but not learned from; sizes are tested before a text leaves the
executors) and runs a fixed number
of Adam steps on balanced batches; a final logistic regression on rows the filters have not
seen turns the network's answer into a probability at the classes' true rates.

Defined results for odd input:

* null text is an empty text; an empty text is one chunk of padding and gets its score.
* no labels of a class: nothing can be learned, every score is 1 and every row is kept.
* null doc_id: scored like any other row, not held out. Repeated rows and ties: one result
  each, the same for equal texts.
* empty table: empty result. Other columns are kept; one named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import hashing
from granary.llm.labelled import held_out, training_rows
from granary.llm.shared import bounded_batches, spread
from granary.llm.toxicity import logistic

WIDTH = 8
STRIDE = 2
FILTERS = 16
HIDDEN = 16
BLOCK = 128  # bytes; a chunk is two blocks, chunks overlap by one
MOST = 1200  # labelled rows a class
MOST_BYTES = 8 << 20
STEPS = 400
BATCH = 24
CUT = 0.7
#: Rows of this fold are kept back from the filters for the final calibration.
CALIBRATION_FOLD = 3


@dataclass
class Net:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    w1: np.ndarray  # (2 * FILTERS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray  # (HIDDEN,)
    b2: np.ndarray  # (1,)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.w1, self.b1, self.w2, self.b2]


@dataclass(frozen=True)
class Model:
    net: Net
    calibration: tuple[float, float] | None

    def probability(self, z: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.ones(len(z))
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))


def laid_out(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each filled up to whole blocks; and the first block of each.

    At least WIDTH zero bytes follow every text inside its own blocks. The windows of its last
    block that would reach into the next text hold nothing of it, and are left out (``apart``).
    """
    size = np.diff(bounds)
    blocks = (size + WIDTH + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, dtype=np.uint8)
    for k in range(len(size)):
        at = first[k] * BLOCK
        out[at : at + size[k]] = buf[bounds[k] : bounds[k + 1]]
    return out, first


def answers(net: Net, text: np.ndarray, blocks: int, at: int = 0) -> np.ndarray:
    """(blocks, windows, FILTERS) answers of the filters from block ``at`` on."""
    lo = at * BLOCK
    n = blocks * BLOCK // STRIDE
    total = np.broadcast_to(net.bias, (n, FILTERS)).copy()
    for k in range(WIDTH):
        total += net.table[k].take(text[lo + k : lo + k + n * STRIDE : STRIDE], axis=0)
    return total.reshape(blocks, -1, FILTERS)


def apart(acts: np.ndarray, first: np.ndarray, at: int = 0) -> np.ndarray:
    """Answers of the blocks from ``at`` on, without windows that begin in a text's last block and end in the next text.

    They begin after the text. A window of zero bytes alone is always left in that block.
    """
    last = first[1:] - 1 - at
    acts[last[(last >= 0) & (last < len(acts))], 1 - WIDTH // STRIDE :] = -np.inf
    return acts


def block_peaks(net: Net, text: np.ndarray, blocks: int, step: int = 1024, first: np.ndarray | None = None) -> np.ndarray:
    """Largest answers of every block; ``first`` names the texts' first blocks where there are several texts."""
    first = np.array([0, blocks]) if first is None else first
    out = np.empty((blocks, FILTERS), dtype=np.float32)
    for at in range(0, blocks, step):
        n = min(step, blocks - at)
        out[at : at + n] = apart(answers(net, text, n, at), first, at).max(axis=1)
    return out


def chunk_peaks(peaks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of chunks (a block and the next one of the same text); and the first chunk of each text."""
    blocks = np.diff(first)
    last = np.zeros(len(peaks), dtype=bool)
    last[first[1:] - 1] = True
    chunk = np.maximum(peaks, np.concatenate([peaks[1:], peaks[-1:]]))
    chunk[last] = peaks[last]
    keep = ~last
    keep[first[:-1][blocks == 1]] = True
    return chunk[keep], np.concatenate([[0], np.cumsum(np.maximum(blocks - 1, 1))])


def pooled(chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(chunks, first[:-1], axis=0)
    mean = np.add.reduceat(chunks, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([np.tanh(top), np.tanh(mean)], axis=1)


def logits(net: Net, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number a text. Sums run in a fixed order, so it is the same whatever other texts are in the batch."""
    if len(bounds) < 2:
        return np.zeros(0)
    text, first = laid_out(buf, bounds)
    x = pooled(*chunk_peaks(block_peaks(net, text, int(first[-1]), first=first), first)).astype(np.float64)
    hidden = np.tile(net.b1.astype(np.float64), (len(x), 1))
    for k in range(x.shape[1]):
        hidden += x[:, k, None] * net.w1[k]
    z = np.full(len(x), float(net.b2[0]))
    for k in range(HIDDEN):
        z += np.maximum(hidden[:, k], 0) * net.w2[k]
    return z


def _batch_step(net: Net, texts: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the logistic loss; only the windows that won a pool carry any."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, first = laid_out(np.concatenate(texts), bounds)
    n_blocks = int(first[-1])
    acts = apart(answers(net, text, n_blocks), first)
    won = acts.argmax(axis=1)  # (blocks, FILTERS)
    peaks = np.take_along_axis(acts, won[:, None], axis=1)[:, 0]
    chunks, at = chunk_peaks(peaks, first)
    # The block that won each chunk.
    blocks = np.diff(first)
    own = np.concatenate([np.arange(first[k], first[k] + max(blocks[k] - 1, 1)) for k in range(len(texts))])
    nxt = np.minimum(own + 1, np.repeat(first[1:] - 1, np.maximum(blocks - 1, 1)))
    source = np.where(peaks[nxt] > peaks[own], nxt[:, None], own[:, None])  # (chunks, FILTERS)
    x = pooled(chunks, at)
    hidden = np.maximum(x @ net.w1 + net.b1, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2[0], -30, 30)))
    d = ((p - y) / len(y)).astype(np.float32)
    g_w2, g_b2 = hidden.T @ d, np.array([d.sum()])
    dh = (d[:, None] * net.w2) * (hidden > 0)
    g_w1, g_b1 = x.T @ dh, dh.sum(axis=0)
    dx = (dh @ net.w1.T) * (1 - x * x)
    d_top, d_mean = dx[:, :FILTERS], dx[:, FILTERS:]
    per_chunk = np.repeat(d_mean / np.diff(at)[:, None], np.diff(at), axis=0)
    for k in range(len(texts)):
        part = chunks[at[k] : at[k + 1]]
        per_chunk[at[k] + part.argmax(axis=0), np.arange(FILTERS)] += d_top[k]
    # To the winning windows, and from there to the table rows of their bytes.
    window = source * (BLOCK // STRIDE) + np.take_along_axis(won, source, axis=0)
    f = np.broadcast_to(np.arange(FILTERS), window.shape).ravel()
    weight = per_chunk.ravel()
    g_table = np.empty_like(net.table)
    for k in range(WIDTH):
        byte = text[window.ravel() * STRIDE + k].astype(np.int64)
        g_table[k] = np.bincount(byte * FILTERS + f, weights=weight, minlength=256 * FILTERS).reshape(256, FILTERS)
    return [g_table, per_chunk.sum(axis=0), g_w1, g_b1, g_w2, g_b2]


def fit(texts: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Net:
    """Adam on batches with as many rows of either class."""
    rng = np.random.default_rng(seed)
    f32 = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    net = Net(f32(WIDTH, 256, FILTERS, scale=0.1), np.full(FILTERS, -0.5, np.float32), f32(2 * FILTERS, HIDDEN, scale=0.3),
              np.zeros(HIDDEN, np.float32), f32(HIDDEN, scale=0.3), np.zeros(1, np.float32))
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    of = [np.flatnonzero(y == k) for k in (0, 1)]
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(o, BATCH // 2) for o in of])
        rate = 0.01 * min(1.0, 2 * (1 - (t - 1) / steps))
        grads = _batch_step(net, [texts[r] for r in rows], y[rows])
        for p, g, m, v in zip(net.params(), grads, first, second, strict=True):
            g = g.astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, most_bytes: int = MOST_BYTES) -> Model:
    sample = training_rows(docs, labels, label, most).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))))
    order = ["at", "doc_id", "y", "size"]
    sized = sample.where(F.col("size") <= most_bytes // 16).withColumn("at", F.xxhash64("doc_id"))
    fits = sized.withColumn("used", F.sum("size").over(Window.orderBy(*order))).where(F.col("used") <= most_bytes)
    texts, y, part = [], [], []
    for row in fits.orderBy(*order).select(F.coalesce("text", F.lit("")).alias("text"), "y", "part").collect():
        texts.append(np.frombuffer(row["text"].encode(), dtype=np.uint8))
        y.append(row["y"])
        part.append(row["part"])
    y, part = np.array(y, dtype=np.float32), np.array(part)
    learn = part != CALIBRATION_FOLD
    both = lambda m: bool((y[m] == 0).any() and (y[m] == 1).any()) if len(y) else False
    blank = Net(*(np.zeros(s, np.float32) for s in ((WIDTH, 256, FILTERS), FILTERS, (2 * FILTERS, HIDDEN), HIDDEN, HIDDEN, 1)))
    if not both(learn) or not both(~learn):
        return Model(blank, None)
    net = fit([t for t, k in zip(texts, learn, strict=True) if k], y[learn])
    held = [t for t, k in zip(texts, learn, strict=True) if not k]
    z = np.concatenate([logits(net, t, np.array([0, len(t)])) for t in held])
    # Rows stand for their class's share among all labels outside the held-out fold, not in the sample.
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rates = {r["y"]: r["count"] for r in known.groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    w = logistic(z[:, None], y[~learn])
    n1, n0 = y[~learn].sum(), (1 - y[~learn]).sum()
    shift = np.log(rates[1] / rates[0]) - np.log(n1 / n0)
    return Model(net, (float(w[0] + shift), float(w[1])))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """From a text column to its probability: one per whole document."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(text):
        import pandas as pd

        out = [np.zeros(0)]
        for _, _, buf, bounds in hashing.text_slices(pa.array(text, pa.large_string())):
            out.append(shared.value.probability(logits(shared.value.net, buf, bounds)))
        return pd.Series(np.concatenate(out))

    return lambda text: probability(text.cast("string"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to every row of docs (column text)."""
    return docs.withColumn("score", scorer(docs.sparkSession, model)(F.col("text")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
