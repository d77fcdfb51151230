"""Best-fit packing of tokenised documents by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. The linear program has one variable per
configuration (a multiset of piece lengths that fits a sequence) and one covering row per
length; it is solved over the length histogram by multiplicative weights until every row is
covered, priced by a knapsack dynamic program, then rounded, and what is left over goes by best
fit decreasing. The histogram has at most ``capacity`` numbers and all later work on the driver
depends on ``capacity`` only, so it is the same for any number of documents. Spark tokenises,
counts, numbers the pieces of each length and maps (length, number) to (sequence, offset).

Defined results for odd input:

* null or empty text: a piece with the end token alone.
* texts over the capacity: cut, the first piece takes the remainder, all others are full.
* repeated rows and exact copies: each row is packed; null ids are carried along. Ids are whole
  numbers. Ties, pieces of one length, go to sequences in any order.
* empty table: empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import tokens
from granary.llm.shared import bounded_batches, spread, stored

CAPACITY = 1024
END = 2
STEP = 0.02  # share of a length that one step of the LP covers
SLACK = 0.01  # of the best price that a step's configuration may lack
LEAST = 0.25  # uses of a configuration that a step adds at least, where as much is left
RATES = (2.0, 8.0)  # of the LP's weights, tried in turn until ...
GAP = 0.01  # ... its value is within this, or within one sequence, of the lower bound
TIGHT = (0.0, 0.95, 0.98, 0.99)  # least values of the configurations that are rounded
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the rest."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(
    docs: DataFrame, capacity: int = CAPACITY, ranks_path: str = tokens.RANKS, with_ids: bool = False, special: bool = False
) -> DataFrame:
    """One row per piece of every document (doc_id, text), with the ids themselves if asked for.

    With ``special``, strings of special tokens in a text are these tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            texts = batch.column(1)
            out: list[list] = [[] for _ in range(6)]
            for k, doc_id in enumerate(ids_of):
                ids = np.array([*tokens.encode(texts[k].as_py(), ranks_path, special), END], dtype="<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    piece = ids[start : start + length]
                    row = (doc_id, p, start, length, zlib.crc32(piece.tobytes()), piece.astype(np.int32) if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) >= 4096:
                    yield table(out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield table(out)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    n = len(names) if with_ids else len(names) - 1

    def table(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds, strict=False)], names[:n])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, PIECE + (", ids array<int>" if with_ids else "")
    )


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every room up to the capacity, and the length put in last there (0: one token stays free).

    price[l] is the value of a piece of length l; index 0 is unused, lengths that are not there have -inf.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + best[c - 1 :: -1]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], last[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def filling(last: np.ndarray, room: int) -> list[int]:
    """Lengths of the best filling of a room."""
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
        room -= int(last[room]) or 1
    return out


def covering(counts: np.ndarray, capacity: int, rate: float, step: float = STEP, slack: float = SLACK):
    """Fractional use of configurations that covers every length exactly, a lower bound of any such use, and its prices.

    Multiplicative weights on the covering rows, from weights in proportion to their tokens. A
    step adds a configuration as often as covers ``step`` of its scarcest length, or LEAST
    times, but never more than is left of any; so each step brings a row nearer by ``step`` or closes one, and
    lengths * (1 / step + 1) steps always cover all rows. One knapsack prices many steps: the
    best configurations around each length, while they are worth (1 - slack) of the best one.
    """
    used: dict[tuple[int, ...], float] = defaultdict(float)
    size, left, lower, dual = np.arange(capacity + 1) / capacity, counts.astype(float), 0.0, np.zeros(capacity + 1)
    budget = int((counts > 0).sum() * (1 / step + 1)) + 1
    while (left > 0).any():
        there = np.flatnonzero(left > 0)
        top = (left[there] / counts[there]).max()
        price = np.full(capacity + 1, -np.inf)
        price[there] = size[there] * np.exp(rate * (left[there] / counts[there] - top))
        best, last = knapsack(price, capacity)
        bound = float(price[there] @ counts[there]) / best[capacity]  # by duality
        if bound > lower:
            lower, dual = bound, np.maximum(price, 0) / best[capacity]
        least = (1 - slack) * best[capacity]
        around = price[there] + best[capacity - there]
        for k in np.argsort(-around, kind="stable"):
            if around[k] < least:
                break
            config = sorted([int(there[k]), *filling(last, capacity - int(there[k]))], reverse=True)
            lengths, times = np.unique(config, return_counts=True)
            while (left[lengths] > 0).all() and price[lengths] @ times >= least:
                if not budget:
                    raise RuntimeError("the configuration LP did not cover all lengths within its steps")
                budget -= 1
                amount = min(max(step * float((counts[lengths] / times).min()), LEAST), float((left[lengths] / times).min()))
                used[tuple(config)] += amount
                left[lengths] -= amount * times
                left[lengths[left[lengths] < 1e-9 * counts[lengths]]] = 0
                price[lengths] = size[lengths] * np.exp(rate * (left[lengths] / counts[lengths] - top))
    return used, lower, dual


def configuration_lp(counts: np.ndarray, capacity: int, gap: float = GAP):
    """The covering of least value by rising rates of the weights, until one is within ``gap`` (or one sequence) of the lower bound."""
    found, lower, dual = None, 0.0, np.zeros(capacity + 1)
    for rate in RATES:
        used, bound, prices = covering(counts, capacity, rate)
        lower, dual = (bound, prices) if bound > lower else (lower, dual)
        found = used if found is None or sum(used.values()) < sum(found.values()) else found
        if sum(found.values()) <= max((1 + gap) * lower, lower + 1):
            break
    return found, lower, dual


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best fit decreasing over a histogram; equal bins are handled together, never one by one."""
    room: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        at = length
        while left:
            while at < capacity and not room[at]:
                at += 1
            if room[at]:
                config, have = next(iter(room[at].items()))
            else:
                config, have = (), left
            each = min(at // length, left)
            bins = min(have, left // each)
            if config or room[at]:
                room[at][config] -= bins
                if not room[at][config]:
                    del room[at][config]
            room[at - each * length][config + (length,) * each] += bins
            left -= bins * each
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for bins_of in room:
        for config, n in bins_of.items():
            out[config] += n
    return out


def rounded(counts: np.ndarray, used: dict[tuple[int, ...], float], value: dict[tuple[int, ...], float], up: bool):
    """Whole uses of the LP's configurations, and the histogram of what they leave over.

    Uses are rounded down, the configurations of highest value first; then, with ``up``, up by
    descending fraction, where all pieces of one more use are left.
    """
    rest, out = counts.copy(), defaultdict(int)

    def put(config: tuple[int, ...], most: int) -> None:
        lengths, times = np.unique(config, return_counts=True)
        n = min(most, int((rest[lengths] // times).min()))
        if n > 0:
            out[config] += n
            rest[lengths] -= n * times

    whole = {config: int(amount + 1e-6) for config, amount in used.items()}
    for config in sorted(used, key=lambda c: (-value[c], -used[c])):
        put(config, whole[config])
    for config in sorted(used, key=lambda c: whole[c] - used[c]):
        if up and used[config] - whole[config] > 1e-6:
            put(config, 1)
    return out, rest


def rounded_lp(counts: np.ndarray, capacity: int):
    """The LP rounded, the best fit of its leftover, and the leftover's histogram.

    The last steps of the LP fill badly. So its configurations worth less than some share of a
    sequence, at the prices of the lower bound, may be left to best fit. All shares in TIGHT are
    tried, with rounding up and without, and the fewest sequences taken. Where lengths occur
    about once each, rounding down may leave all to best fit.
    """
    used, _, dual = configuration_lp(counts, capacity)
    value = {config: float(dual[list(config)].sum()) for config in used}
    plans = []
    for least, up in [*((t, True) for t in TIGHT), *((t, False) for t in TIGHT)]:
        placed, rest = rounded(counts, {c: n for c, n in used.items() if value[c] >= least}, value, up)
        plans.append((placed, best_fit_decreasing(rest, capacity), rest))
    return min(plans, key=lambda p: sum(p[0].values()) + sum(p[1].values()))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, number of sequences) that use every piece of the histogram exactly once."""
    small = counts.astype(np.int64)
    alone = int(small[capacity])
    small[capacity] = 0
    chosen, leftover, _ = rounded_lp(small, capacity)
    for config, n in leftover.items():
        chosen[config] += n
    return [*([((capacity,), alone)] if alone else []), *sorted(chosen.items(), reverse=True)]


def places(chosen: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Per configuration and length: which numbers of the length it takes, and where they go."""
    rows, taken, sequence = [], defaultdict(int), 0
    for config, n in chosen:
        offset = 0
        lengths, times = np.unique(np.array(config), return_counts=True)
        for length, k in zip(lengths.tolist(), times.tolist(), strict=True):
            rows.append((length, taken[length], k, sequence, offset))
            taken[length] += n * k
            offset += length * k
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"])


def numbered(pieces: DataFrame, total: int, group_rows: int = 4000) -> DataFrame:
    """Add ``number``, from 0 without gaps within each length.

    A length, or one repeated row, may hold a third of all pieces, so pieces are dealt into
    groups by the number ``_deal`` that they were stored with; groups are numbered apart and
    shifted by the running count of the groups before them.
    """
    groups = max(1, total // group_rows)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_deal"), F.lit(groups)))
    before = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")
    ).drop("_n")
    inside = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32", "_deal"))
    return dealt.withColumn("_inside", inside).join(before, ["length", "_group"]).withColumn(
        "number", F.col("_before") + F.col("_inside") - 1
    ).drop("_group", "_before", "_inside", "_deal")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, ranks_path: str = tokens.RANKS, with_ids: bool = False, special: bool = False
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = pieces_of(docs, capacity, ranks_path, with_ids, special)
    pieces = stored(pieces.withColumn("_deal", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    where = places(plan(counts, capacity))
    key = (where["length"].to_numpy(np.int64) << 48) + where["first"].to_numpy(np.int64)
    columns = [where[c].to_numpy(np.int64) for c in ("first", "each", "sequence", "offset")]
    # Bounded by the number of configurations, which the capacity bounds.
    shared = spark.sparkContext.broadcast((key, columns))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        key, (first, each, sequence, offset) = shared.value
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        at = np.searchsorted(key, (length << 48) + number, side="right") - 1
        k = number - first[at]
        return pd.DataFrame({
            "sequence_id": sequence[at] + k // each[at], "offset": offset[at] + k % each[at] * length,
        })

    out = numbered(pieces, int(counts.sum())).withColumn("_place", place("length", "number"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", *(["ids"] if with_ids else [])
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are those of the tokenizer with its default settings, which know special tokens in texts."""
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), special=True)
