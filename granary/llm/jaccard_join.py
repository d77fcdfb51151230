"""N-gram Jaccard self-join by signature trees, and its connected components.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least
``threshold``. Documents with equal sets form a class and go on as one.

1. *Suspects.* Every class gets the ``routes`` least of its scrambled shingle hashes. A linked
   pair shares at least so many of these as ``sure_routes`` says (9 of 48 at 0.75; sets of up
   to twelve shingles share all that the threshold asks for), but for a chance of ``LOST`` a pair,
   less than that of a collision among the pair's own 64-bit shingle hashes. Classes that share fewer routes with others are done.
2. *Contraction.* The whole sets of the suspects are read once. Every suspect is compared with
   the first and the last class of its routes where one class is that of half its routes, which
   joins most of each family of copies.
   Suspects that share too few routes with other components are done.
3. *Cells.* Of the rest, the scrambled prefix of each set is taken that shares ``extra``
   shingles with every linked set: n - ceil(threshold * n) + extra of n. Each class leaves out
   its ``extra`` - 1 most frequent ones, so the rarest shingle that a pair shares is among the
   rest of both: this step is exact. Passages that many documents have in common go first, so
   the cells, one per shingle, stay small. Cells with the same least class are put together
   while they are within ``cell_rows`` classes and ``cell_bytes`` bytes; larger ones are taken
   shingle by shingle, and a cell that is still larger is cut by size and key.
4. *Signature trees.* A task has the whole sets of its cell. A leaf holds the bitmap of a
   class's shingles and its size, an inner node the OR of its bitmaps and the range of its
   sizes and components. The tree is traversed against itself; a pair of nodes is dropped when
   one component covers both, when no sizes in their ranges fit each other, or when the largest
   possible overlap, from the bits in common and the shingles that share a bit, is below what
   the threshold asks of the smallest sizes. Leaves that survive are compared by their whole
   sets if they are still apart, and the task keeps the components: it gives at most one link
   for every class, a spanning forest, never the pairs of a family.

Defined results for odd input:

* null, empty or blank text: an empty set, linked with nothing, a component of its own.
* fewer than five words: the whole sequence is one shingle.
* ids are whole numbers. Null doc_id: the row takes the component of its class, null if no
  document in it has an id; such rows link other documents like any other row.
* repeated rows and exact copies: one class; one output row per input row. Ties at the
  threshold link.
* empty table: empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import hashing
from granary.llm.components import components
from granary.llm.shared import bounded_batches, broadcast_if_small, dropped_rows, removed, row_key, same_row, spread, stored

ROUTES = 48
LOST = 1e-16  # chance that a linked pair shares fewer routes than are counted on
EXTRA = 32  # shingles by which a prefix is longer than it must be, to leave out the frequent ones
CELL = 4096  # classes of a cell that are put in one tree
CELL_BYTES = 64 << 20  # bytes of their sets
FANOUT = 16
FEW = 128  # classes of a cell below which pairs are compared without postings
POSTINGS = 1 << 22  # entries of the matrix of a cell's frequent shingles


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for first, end, buf, bounds in hashing.text_slices(texts):
        h, text_of, _ = hashing.words(buf, bounds, hashing.SPACED)
        yield from hashing.shingle_sets(h, text_of, end - first, size)


def class_key(shingles: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """The 128-bit name of a shingle set, as two integers; nulls for the empty set."""
    if not len(shingles):
        return None, None
    name = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(int(x) for x in np.array([name >> 64, name & (1 << 64) - 1], dtype=np.uint64).view(np.int64))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the shingles; as many bits as the power of two from twice the size on, 64 at least."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    out = np.zeros(bits, dtype=np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def fold(bits: np.ndarray, to: int) -> np.ndarray:
    """Rows of bitmap words folded to ``to`` words by OR: the bitmap at the smaller width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, to), axis=1) if bits.shape[1] > to else bits


def digest(docs: DataFrame, size: int, routes: int) -> DataFrame:
    """(doc_id, row_key, h1, h2, n, routes) of every row; texts do not leave the scan's tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, n, least = [], [], [], []
            for s in sets_of(batch.column(2), size):
                for column, x in zip((h1, h2), class_key(s), strict=True):
                    column.append(x)
                n.append(len(s))
                r = hashing.mix(s)
                r = np.partition(r, routes - 1)[:routes] if len(r) > routes else r
                least.append(r.view(np.int64))
            columns = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "row_key", "h1", "h2", "n", "routes"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), row_key(text).alias("row_key"), text).mapInArrow(
        run, "doc_id long, row_key long, h1 long, h2 long, n long, routes array<long>"
    )


def sure_routes(routes: int, threshold: float) -> int:
    """How many routes a linked pair shares at least, but for a chance of ``LOST``; binomial, one at the least."""
    if threshold >= 1:
        return max(routes, 1)
    few = 0.0
    for shared in range(routes + 1):
        ways = lgamma(routes + 1) - lgamma(shared + 1) - lgamma(routes - shared + 1)
        few += exp(ways + shared * log(threshold) + (routes - shared) * log1p(-threshold))
        if few > LOST:
            break
    return max(shared, 1)


def needed(n: np.ndarray | int, m: np.ndarray | int, threshold: float):
    """Least overlap of sets of n and m shingles at the threshold, in whole hundredths."""
    t = round(100 * threshold)
    return -(-t * (n + m) // (100 + t))


class Tree:
    """A signature tree over classes sorted by component and size."""

    def __init__(self, sizes: np.ndarray, comps: np.ndarray, bits: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, spare, comps, comps)]
        while len(self.levels[-1][0]) > FANOUT:
            bits, low, high, spare, least, most = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(spare, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at),
            ))


def _possible(one, other, i: np.ndarray, j: np.ndarray, threshold: float, step: int = 1 << 15) -> np.ndarray:
    """May nodes i of a level and nodes j of another hold a linked pair of different components?"""
    ab, al, ah, aspare, ac, acm = one
    bb, bl, bh, bspare, bc, bcm = other
    t = round(100 * threshold)
    ok = (100 * ah[i] >= t * bl[j]) & (100 * bh[j] >= t * al[i])
    ok &= ~((ac[i] == acm[i]) & (bc[j] == bcm[j]) & (ac[i] == bc[j]))
    ask = np.maximum(needed(al[i], bl[j], threshold), 1)
    step = max(256, step * 16 // ab.shape[1])
    for k in range(0, len(i), step):
        part = slice(k, k + step)
        at = np.flatnonzero(ok[part]) + k
        overlap = np.bitwise_count(ab[i[at]] & bb[j[at]]).sum(axis=1).astype(np.int64)
        ok[at] = overlap + np.minimum(aspare[i[at]], bspare[j[at]]) >= ask[at]
    return ok


def traverse(a: Tree, b: Tree, threshold: float, same: bool, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may be linked: from the roots down, dropping node pairs that cannot.

    ``step`` node pairs are opened at a time, the deepest first, so memory stays bounded.
    """
    depth = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    na, nb = len(level(a, depth)[0]), len(level(b, depth)[0])
    todo = [(depth, np.repeat(np.arange(na), nb), np.tile(np.arange(nb), na), False)]
    while todo:
        d, i, j, opened = todo.pop()
        if opened:
            i, j = _children(i, j, len(a.levels) > d + 1, len(b.levels) > d + 1, len(level(a, d)[0]), len(level(b, d)[0]))
        if same:
            keep = i <= j if d else i < j
            i, j = i[keep], j[keep]
        keep = _possible(level(a, d), level(b, d), i, j, threshold)
        i, j = i[keep], j[keep]
        if d:
            todo += [(d - 1, i[k : k + step], j[k : k + step], True) for k in range(0, len(i), step)]
        elif len(i):
            yield i, j


def _children(i, j, split_a: bool, split_b: bool, na: int, nb: int):
    for first in (True, False):
        x, y = (i, j) if first else (j, i)
        if split_a if first else split_b:
            child = (x[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            y = np.repeat(y, FANOUT)
            inside = child < (na if first else nb)
            x, y = child[inside], y[inside]
        i, j = (x, y) if first else (y, x)
    return i, j


def _first_meeting(earlier: pa.ListArray, i: np.ndarray, j: np.ndarray, step: int = 4096) -> np.ndarray:
    """Which pairs share no earlier route, so that this cell is the one to report them."""
    size = np.diff(earlier.offsets.to_numpy())
    flat = earlier.values.to_numpy()[earlier.offsets[0].as_py() :]
    left = np.full((len(size), max(int(size.max(initial=0)), 1)), np.iinfo(np.int64).min)
    right = np.full(left.shape, np.iinfo(np.int64).max)
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left[row, column] = right[row, column] = flat
    out = np.empty(len(i), dtype=bool)
    for k in range(0, len(i), step):
        part = slice(k, k + step)
        out[part] = ~(left[i[part]][:, :, None] == right[j[part]][:, None, :]).any(axis=(1, 2))
    return out


class Postings:
    """How much pairs of a cell can have in common, at most, from the postings of its shingles.

    Shingles are told apart by some bits of their hashes only, which can but raise the bound. Those
    that most sets hold, the core of a family, are counted by one matrix product; of the others
    those that occur once cannot be shared, and the rest may all be. Memory is bounded by ``room``
    and the square of the cell's classes.
    """

    def __init__(self, sets: list[np.ndarray], room: int = POSTINGS):
        self.sizes = np.array([len(s) for s in sets])
        bits = np.uint64(min(21, max(10, int(4 * self.sizes.sum()).bit_length())))
        place = lambda s: (s >> (np.uint64(64) - bits)).astype(np.int32)
        held = np.zeros(1 << int(bits), np.int32)
        for s in sets:
            held[np.unique(place(s))] += 1
        several = np.flatnonzero(held > 1)
        most = several[np.argsort(-held[several], kind="stable")[: max(1, room // len(sets))]]
        column = np.full(len(held), -1, np.int32)
        column[most] = np.arange(len(most))
        rows, spare = np.zeros((len(sets), len(most)), np.float32), np.zeros(len(sets), np.int64)
        for k, s in enumerate(sets):
            at = place(s)
            inside = column[at]
            np.add.at(rows[k], inside[inside >= 0], 1)
            spare[k] = ((inside < 0) & (held[at] > 1)).sum()
        own = [np.minimum(rows[k : k + 256] @ rows.T, 65535).astype(np.uint16) for k in range(0, len(sets), 256)]
        self.both, self.spare = np.concatenate(own), spare

    def may_link(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        both = self.both[i, j].astype(np.int64)
        most = both + np.minimum(self.spare[i], self.spare[j])
        return (most >= np.maximum(needed(self.sizes[i], self.sizes[j], threshold), 1)) | (both == 65535)


def cell_candidates(
    sid, n, comp, side, bits: list[bytes], earlier: pa.ListArray, threshold: float, postings: Postings | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one cell: a tree per bitmap width, against itself and the next width.

    A pair that shares several routes is reported by the cell of the first one only, and a cell
    of two parts reports only pairs across them. ``postings`` leaves out pairs that cannot link.
    """
    width = np.array([len(b) for b in bits])
    across = side.any()

    def reported(i, j):
        if across:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        if postings is not None:
            keep = postings.may_link(i, j, threshold)
            i, j = i[keep], j[keep]
        keep = _first_meeting(earlier, i, j)
        return sid[i[keep]], sid[j[keep]]

    trees = {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        at = at[np.lexsort((n[at], comp[at]))]
        words = np.frombuffer(b"".join(bits[k] for k in at), dtype=np.uint64).reshape(len(at), -1)
        trees[int(w)] = (at, words)
    for w, (at, words) in trees.items():
        tree = Tree(n[at], comp[at], words)
        for i, j in traverse(tree, tree, threshold, True):
            yield reported(at[i], at[j])
        if 2 * w in trees:  # sizes that fit each other differ by less than two
            far, wide = trees[2 * w]
            for i, j in traverse(tree, Tree(n[far], comp[far], fold(wide, words.shape[1])), threshold, False):
                yield reported(at[i], far[j])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if rest and rest[0].column(key)[0].as_py() != part.column(key)[0].as_py():
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


def overlap(one: np.ndarray, other: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(one) > len(other):
        one, other = other, one
    if not len(one):
        return 0
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    return int((other[at] == one).sum())


def reaches(one: np.ndarray, other: np.ndarray, threshold: float) -> bool:
    both = overlap(one, other)
    return both > 0 and 100 * both >= round(100 * threshold) * (len(one) + len(other) - both)


def cell_links(comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], earlier: pa.ListArray, threshold: float) -> list[tuple[int, int]]:
    """Links (positions) that join the components of a cell: at most one for each class, whatever the number of linked pairs.

    The first class of the largest component is compared with all others before the trees are built.
    """
    n = np.array([len(s) for s in sets])
    label = np.unique(comp, return_inverse=True)[1]
    out: list[tuple[int, int]] = []

    def judge(i: int, j: int) -> None:
        if label[i] != label[j] and reaches(sets[i], sets[j], threshold):
            out.append((i, j))
            label[label == label[j]] = label[i]

    first = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
    t = round(100 * threshold)
    for j in np.flatnonzero((100 * np.minimum(n, n[first]) >= t * np.maximum(n, n[first])) & (label != label[first])).tolist():
        judge(first, j)
    if (label != label[0]).any():
        bits = [bitmap(s).tobytes() for s in sets]
        postings = Postings(sets) if len(sets) >= FEW else None
        for i, j in cell_candidates(np.arange(len(sets)), n, label.copy(), side, bits, earlier, threshold, postings):
            apart = label[i] != label[j]
            for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                judge(x, y)
    return out


def tree_links(cells: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Links (a, b) of all cells (cell, sid, comp, side, earlier, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "cell"):
            sid, comp, side = (t.column(c).to_numpy() for c in ("sid", "comp", "side"))
            shingles = t.column("shingles").combine_chunks()
            sets = [np.frombuffer(shingles[k].as_buffer(), dtype=np.uint64) for k in range(len(sid))]
            links = cell_links(comp, side, sets, t.column("earlier").combine_chunks(), threshold)
            if links:
                a, b = (sid[list(x)] for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = cells.select("cell", "sid", "comp", "side", "earlier", "shingles").repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long")


def cut_cells(rows: DataFrame, threshold: float, cell_rows: int = CELL, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Give rows (token, sid, n, comp, earlier) a ``cell``; tokens with too many classes are cut by size and key.

    A size step spans a third of the allowed ratio, so linked sizes are at most four steps
    apart; within a step classes are dealt by key into parts of about half a cell. Each class
    then goes to the cells of the pairs of parts that its size allows. All classes of such a
    token have more than ``threshold`` of their shingles in common with as many others.
    """
    step = float(np.log(1 / threshold) / 3)
    sized = rows.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int"))
    per = sized.groupBy("token", "step").agg(F.greatest(F.count("*") / cell_rows, F.sum("n") * 8 / cell_bytes).alias("cells"))
    parts = per.groupBy("token").agg(
        F.sum("cells").alias("total"), F.map_from_entries(F.collect_list(F.struct("step", F.ceil(F.col("cells") * 2).cast("int")))).alias("parts")
    )
    joined = sized.join(parts, "token")
    whole = joined.where("total <= 1").withColumns({"cell": F.xxhash64("token"), "side": F.lit(0)})
    own = F.pmod(F.xxhash64("sid"), F.col("parts")[F.col("step")]).cast("int")
    near = F.flatten(F.transform(
        F.sequence(F.col("step") - 4, F.col("step") + 4),
        lambda s: F.when(F.map_contains_key("parts", s), F.transform(
            F.sequence(F.lit(0), F.col("parts")[s] - 1), lambda p: F.struct(s.alias("s"), p.cast("int").alias("p"))
        )).otherwise(F.array().cast("array<struct<s:int,p:int>>")),
    ))
    mine = F.struct(F.col("step").alias("s"), F.col("own").alias("p"))
    large = joined.where("total > 1").withColumn("own", own).withColumn("other", F.explode(near)).withColumn(
        "cell", F.xxhash64("token", F.least(mine, F.col("other")), F.greatest(mine, F.col("other")))
    ).withColumn("side", F.when(mine > F.col("other"), 1).otherwise(0))
    keep = ["cell", "sid", "comp", "side", "earlier"]
    return whole.select(keep).unionByName(large.select(keep))


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(sid, n, shingles) of the wanted classes (sid, doc_id, row_key): the texts of one row a class are read again.

    The keys of these rows are broadcast while they are small; beyond that it is a sorted join.
    A row that is repeated gives its set once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sid, raw, used = [], [], 0
            ids = batch.column(0).to_pylist()
            for k, s in enumerate(sets_of(batch.column(1), size)):
                if ids[k] not in seen:
                    seen.add(ids[k])
                    sid.append(ids[k])
                    raw.append(s.tobytes())
                    used += s.nbytes
                if used > 4 << 20 or k == batch.num_rows - 1:  # a batch of sets is larger than its texts
                    n = [len(x) // 8 for x in raw]
                    yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["sid", "n", "shingles"])
                    sid, raw, used = [], [], 0

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(text).alias("row_key"), text.alias("text")).alias("r")
    reps = broadcast_if_small(wanted, 48).alias("w")
    return rows.join(reps, same_row("r", "w")).select("sid", "text").mapInArrow(run, "sid long, n long, shingles binary")


def linked(pairs: DataFrame, sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """The candidate pairs (a, b) whose whole sets reach the threshold.

    The set of ``a`` is sent once to each group of its partners, ahead of theirs, and the task
    streams over the partners; large groups are dealt into several.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("groups"))
    dealt = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    heads = dealt.select("a", "salt").distinct().select(F.col("a").alias("sid"), "a", "salt", F.lit(0).alias("ord"))
    wanted = stored(dealt.select(F.col("b").alias("sid"), "a", "salt", F.lit(1).alias("ord")).unionByName(heads), "asked")
    rows = sets.join(broadcast_if_small(wanted, 32), "sid").repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a_out, b_out = [], []
            columns = [batch.column(c).to_pylist() for c in ("sid", "a", "salt", "ord")]
            shingles = batch.column("shingles")
            for k, (sid, a, salt, order) in enumerate(zip(*columns, strict=True)):
                s = np.frombuffer(shingles[k].as_buffer(), dtype=np.uint64)
                if order == 0:
                    head, mine = (a, salt), s.copy()
                elif head == (a, salt) and reaches(mine, s, threshold):
                    a_out.append(a)
                    b_out.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    out = rows.select("sid", "a", "salt", "ord", "shingles").mapInArrow(run, "a long, b long")
    out.stored_at = wanted.stored_at
    return out


def prefix(shingles: np.ndarray, threshold: float, extra: int) -> tuple[np.ndarray, int]:
    """The scrambled prefix of a set, and how many of it every linked set's prefix shares at least."""
    n = len(shingles)
    ask = -(-round(100 * threshold) * n // 100)
    sure = min(extra, ask)
    k = n - ask + sure
    r = hashing.mix(shingles)
    return (np.partition(r, k - 1)[:k] if k < n else r), sure


def prefixes(sets: DataFrame, threshold: float, extra: int) -> DataFrame:
    """(sid, n, comp, sure, tokens) of sets (sid, n, comp, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(np.frombuffer(x.as_buffer(), dtype=np.uint64), threshold, extra) for x in batch.column(3)]
            tokens = pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([k for _, k in found], pa.int64()), tokens], ["sid", "n", "comp", "sure", "tokens"]
            )

    return sets.select("sid", "n", "comp", "shingles").mapInArrow(run, "sid long, n long, comp long, sure long, tokens array<long>")


def suspects(classes: DataFrame, routes: int, threshold: float) -> DataFrame:
    """(sid, n, needs, routes, first, last) of classes that share enough routes with others.

    ``first`` and ``last`` are (votes, a): the class that is most often the least or the last of a route.
    """
    routed = classes.select("sid", F.explode("routes").alias("route"))
    shared = stored(routed.groupBy("route").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where("first < last"), "shared")

    def voted(ids: Column) -> Column:
        counts = F.transform(F.array_distinct(ids), lambda x: F.struct(F.size(F.filter(ids, lambda y: y == x)).alias("votes"), x.alias("a")))
        return F.array_max(counts)

    met = routed.join(shared, "route").groupBy("sid").agg(*(F.collect_list(c).alias(c) for c in ("route", "first", "last")))
    needs = F.least(F.lit(sure_routes(routes, threshold)), F.ceil(F.col("n") * F.lit(round(100 * threshold)) / 100)).cast("int")
    met = met.join(classes.select("sid", "n"), "sid").withColumn("needs", needs).where(F.size("route") >= F.col("needs"))
    found = stored(
        met.select("sid", "n", "needs", F.col("route").alias("routes"), voted(F.col("first")).alias("first"), voted(F.col("last")).alias("last")), "suspects"
    )
    removed(shared)
    return found


def with_components(met: DataFrame, merged: DataFrame) -> DataFrame:
    return met.join(merged, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "sid")).drop("node", "root")


def still_apart(met: DataFrame) -> DataFrame:
    """(sid, comp) of suspects that share enough routes with classes of other components."""
    routed = met.select("sid", "comp", "needs", F.explode("routes").alias("route"))
    apart = stored(routed.groupBy("route").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("route"), "open-routes")
    found = routed.join(apart, "route").groupBy("sid", "comp", "needs").agg(F.count("*").alias("met"))
    out = stored(found.where("met >= needs").select("sid", "comp"), "apart")
    removed(apart)
    return out


def cells_of(tokens: DataFrame, threshold: float, cell_rows: int, cell_bytes: int) -> DataFrame:
    """(cell, sid, comp, side, earlier) from prefixes: every linked pair of different components meets in some cell."""
    each = tokens.select("sid", "n", "comp", "sure", F.explode("tokens").alias("token"))
    shared = stored(
        each.groupBy("token").agg(F.count("*").alias("classes"), F.min("sid").alias("home"), F.min("comp").alias("x"), F.max("comp").alias("y"))
        .where("x < y").select("token", "classes", "home"), "open-tokens",
    )
    kept = stored(
        each.join(shared, "token").groupBy("sid", "n", "comp", "sure").agg(
            F.sort_array(F.collect_list(F.struct("classes", "token", "home")), asc=False).alias("cells")
        ).where(F.size("cells") >= F.col("sure")).withColumn("cells", F.slice("cells", F.col("sure").cast("int"), F.size("cells"))), "kept",
    )
    homes = kept.select("sid", "n", "comp", F.explode(F.array_distinct("cells.home")).alias("home"))
    size = stored(
        homes.groupBy("home").agg(
            F.count("*").alias("classes"), (8 * F.sum("n")).alias("bytes"), F.min("comp").alias("x"), F.max("comp").alias("y")
        ).where("x < y").select("home", ((F.col("classes") > cell_rows) | (F.col("bytes") > cell_bytes)).alias("large")), "homes",
    )
    small = homes.join(size.where("not large"), "home").select(
        F.xxhash64(F.lit(0), "home").alias("cell"), "sid", "comp", F.lit(0).alias("side"), F.array().cast("array<long>").alias("earlier")
    )
    large = kept.select("sid", "n", "comp", "cells.token", F.inline("cells")).toDF("sid", "n", "comp", "tokens", "classes", "token", "home")
    large = large.join(size.where("large"), "home").select(
        "token", "sid", "n", "comp", F.filter("tokens", lambda x: x < F.col("token")).alias("earlier")
    )
    cells = stored(small.unionByName(cut_cells(large, threshold, cell_rows, cell_bytes)), "cells")
    removed(shared, kept, size)
    return cells


def components_of_rows(
    docs: DataFrame, threshold: float = 0.75, size: int = 5, routes: int | None = ROUTES, cell_rows: int = CELL, cell_bytes: int = CELL_BYTES,
    extra: int = EXTRA,
) -> DataFrame:
    """(doc_id, row_key, n_shingles, class_id, component_id, first) of every row; ``first`` names the row of each component that goes before all others."""
    bounded_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(digest(docs, size, routes or 1), "digest")
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    classes = stored(
        rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min(head).alias("head"), F.first("n").alias("n"), F.first("routes").alias("routes"))
        .withColumn("sid", F.monotonically_increasing_id()), "classes",
    )
    met = suspects(classes, routes, threshold) if routes else classes.select("sid")
    wanted = stored(met.select("sid").join(classes.select("sid", "head.doc_id", "head.row_key"), "sid"), "wanted")
    sets = stored(shingle_sets(docs, wanted, size), "sets")
    if routes:
        leads = met.select("sid", F.explode(F.array("first", "last")).alias("lead"), F.least("n", F.lit(routes)).alias("of"))
        stars = leads.where("lead.a <> sid and 2 * lead.votes >= of").select(F.col("lead.a").alias("a"), F.col("sid").alias("b")).distinct()
        asked = linked(stars, sets, threshold, parts)
        links = stored(asked, "links")
        merged = components(links)
        joined = stored(with_components(met, merged), "joined")
        removed(asked, merged)
        apart = still_apart(joined)
        done = [met, joined]
    else:
        links = stored(docs.sparkSession.createDataFrame([], "a long, b long"), "links")
        joined = stored(classes.select("sid", F.col("sid").alias("comp")), "joined")
        apart, done = joined, []
    done += [wanted, sets, apart, links]
    if not apart.isEmpty():
        tokens = stored(prefixes(sets.join(broadcast_if_small(apart, 24), "sid"), threshold, extra), "prefixes")
        cells = cells_of(tokens, threshold, cell_rows, cell_bytes)
        size = 48 + 8 * F.size("earlier").cast("long")
        more = stored(tree_links(sets.join(broadcast_if_small(cells, size), "sid"), threshold, parts), "tree-links")
        links = links.unionByName(more)
        done += [tokens, cells, more]
    merged = components(links)
    named = classes.select("sid", "h1", "h2", "head").join(merged, F.col("sid") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "sid")
    )
    least = named.groupBy("root").agg(F.min("head").alias("first"))
    by_class = stored(named.join(least, "root").select("h1", "h2", "sid", "first"), "by-class")
    removed(*done, classes, merged)
    out = rows.select("doc_id", "row_key", "n", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    return out.select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("sid").alias("class_id"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "first",
    )


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row of ``docs`` (doc_id, text)."""
    return components_of_rows(docs, **options).drop("row_key", "first")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of every component: the one of least doc_id, rows without an id last.

    Rows that agree in doc_id and text count as repeated; one of them stays. Rows without words
    are in no group and all stay.
    """
    found = components_of_rows(docs.select("doc_id", "text"), **options).where("first is not null")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    rows = found.withColumn("is_first", is_first).groupBy("doc_id", "row_key").agg(F.min("is_first").alias("is_first"), F.count("*").alias("times"))
    rows = stored(rows.where("not is_first or times > 1"), "not-first")
    return dropped_rows(docs, rows.where("not is_first"), rows.where("is_first"))
