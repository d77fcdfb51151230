"""An inverted-file index of vectors: stored cells, of which a search reads a bounded number.

``VectorIndex.build`` clusters the vectors by direction into cells and writes them sorted by cell, so
that a search for some cells reads the row groups that hold them. Codebooks and centres are fitted on
a bounded sample (``SAMPLE`` rows, less if they are wide); every vector is indexed. A cell that comes
out too large is split by centres of its own. Beside each vector stands its product-quantised code of
``CODES`` bytes: one of 256 centres for each part of its difference from the cell's centre.

``search`` sends each query to its nearest cells and compares within cells. How many it probes
follows from the recall that is asked for: ``build`` measures, for queries of the sample, in which of
their cells the true neighbours lie (neighbours in a sample are farther off than in all rows, so this
errs to more cells). Vectors without any clusters need many; ``probes`` sets the number by hand.
Cells and their queries meet in blocks of bounded size, whatever share of all rows a cell or its
queries have. ``quantised`` searches read codes alone, by table look-ups, and rank the best anew by
the vectors. ``target=None`` compares with all vectors, exactly.

Equal vectors with equal payload are one entry, with the least id; the other ids join the few hits
at the end. So a vector that a third of the rows share is compared once. ``where`` is a condition on
payload columns; it reaches the scan, and where the index is partitioned by such a column, the
folders of other values are not opened.

Defined results for odd input: null, empty, zero and broken vectors (null, NaN or infinite values)
match nothing and are not indexed; ties go by id; repeated ids are rows of their own; an empty index
or no query gives no rows; fewer than k rows come back where the probed cells hold fewer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.config import DEFAULT
from granary.operators.search import smallest, unit_rows
from granary.shared import broadcast_if_small, removed, stored

SAMPLE = 65_536  # rows that centres and codebooks are fitted on
SAMPLE_BYTES = 64 << 20  # and their bytes
CENTRE_BYTES = 32 << 20  # of all centres: they are broadcast
CODES = 16  # bytes of a quantised vector
BLOCK = 16_384  # vectors of a cell, and queries to it, that one task compares
MODEL = "centres binary, books binary, sizes array<int>, reach array<double>, width int"
FLAT, GROUPS = 1024, 6  # cells that are all compared with a vector; of more, the groups of cells that are
TESTS, NEIGHBOURS = 256, 10  # queries, and neighbours of each, that ``reach`` is measured by


# Fitting, on samples


def k_means(x: np.ndarray, k: int, rounds: int = 12, direction: bool = False) -> np.ndarray:
    """At most k centres of the rows of x; ``direction``: of unit length, for cosine distance. The same for the same rows."""
    rng = np.random.default_rng(0)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near, off = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        filled = n > 0
        centres[filled] = sums[filled] / n[filled, None]
        if not filled.all():  # centres that lost all rows begin anew at the rows farthest from theirs
            centres[~filled] = x[np.argsort(-off, kind="stable")[: int((~filled).sum())]]
        if direction:
            norm = np.linalg.norm(centres, axis=1, keepdims=True)
            centres /= np.where(norm > 0, norm, 1)
    return centres.astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre and its squared distance, a block of rows at a time."""
    near, off = np.empty(len(x), np.int64), np.empty(len(x))
    half = (centres.astype(np.float64) ** 2).sum(axis=1) / 2
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(np.float64)
        score = part @ centres.T.astype(np.float64) - half
        near[at : at + rows] = best = score.argmax(axis=1)
        off[at : at + rows] = (part**2).sum(axis=1) - 2 * score[np.arange(len(part)), best]
    return near, off


class Cells:
    """Finds the cell of a vector. Over FLAT cells the centres are themselves grouped, by the root of their number, and a
    vector is compared with the centres of its GROUPS nearest groups, so its work grows with that root alone. The cell
    is then near, if not always the nearest; fitting and measuring place by the same rule."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.groups = centres, None
        if len(centres) > FLAT:
            self.groups = k_means(centres, int(len(centres) ** 0.5), direction=True)
            own = nearest(centres, self.groups)[0]
            self.members = [np.flatnonzero(own == g) for g in range(len(self.groups))]

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.groups is None:
            return nearest(x, self.centres)[0]
        cell, best = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
        half = (self.centres.astype(np.float64) ** 2).sum(axis=1) / 2
        near = np.argpartition(-(x @ self.groups.T), GROUPS - 1, axis=1)[:, :GROUPS]
        row = np.repeat(np.arange(len(x)), GROUPS)[np.argsort(near.ravel(), kind="stable")]
        ends = np.searchsorted(np.sort(near.ravel()), np.arange(len(self.groups) + 1))
        for g, some in enumerate(self.members):
            at = row[ends[g] : ends[g + 1]]
            if not len(at) or not len(some):
                continue
            score = x[at].astype(np.float64) @ self.centres[some].T.astype(np.float64) - half[some]
            first = score.argmax(axis=1)
            score = score[np.arange(len(at)), first]
            nearer = score > best[at]
            best[at[nearer]], cell[at[nearer]] = score[nearer], some[first[nearer]]
        return cell


class Model:
    """Centres of the cells, for each part of a vector 256 centres of what is left, and the share of neighbours in the first 1, 2, ... cells."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray], reach: np.ndarray):
        self.centres, self.books, self.reach = centres, books, reach

    @staticmethod
    def parts(width: int, codes: int) -> list[np.ndarray]:
        return np.array_split(np.arange(width), min(codes, width))

    @staticmethod
    def fit(x: np.ndarray, centres: np.ndarray, codes: int) -> Model:
        cell = Cells(centres).of(x)
        left = x - centres[cell]
        return Model(centres, [k_means(left[:, p], 256) for p in Model.parts(x.shape[1], codes)], Model.reached(x, centres, cell))

    @staticmethod
    def reached(x: np.ndarray, centres: np.ndarray, cell: np.ndarray) -> np.ndarray:
        q = x[np.linspace(0, len(x) - 1, min(TESTS, len(x))).astype(int)]
        near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
        place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
        found = np.bincount(np.take_along_axis(place, cell[near], axis=1).ravel(), minlength=len(centres))
        return np.cumsum(found) / found.sum()

    def probes(self, target: float) -> int:
        """Cells to probe for that share of the neighbours."""
        return min(len(self.reach), int(np.searchsorted(self.reach, target - 1e-12)) + 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = x - self.centres[cell]
        return np.stack([nearest(left[:, p], book)[0].astype(np.uint8) for p, book in zip(self.parts(x.shape[1], len(self.books)), self.books, strict=True)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, part, code): the product of a part of a query and each centre of that part."""
        out = np.zeros((len(q), len(self.books), 256))
        for m, (p, book) in enumerate(zip(self.parts(q.shape[1], len(self.books)), self.books, strict=True)):
            out[:, m, : len(book)] = q[:, p] @ book.T
        return out


# Rows


def sound(embedding: Column) -> Column:
    """Vectors that have a direction."""
    values = F.transform(embedding, lambda v: v.cast("double"))
    whole = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & whole & F.exists(values, lambda v: v != 0), F.lit(False))


def _keyed(rows: DataFrame) -> DataFrame:
    """With 128 bits that tell different vectors apart."""
    return rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, id_col: str = "vec_id"):
        self.spark, self.folder, self.id_col = spark, folder, id_col

    @classmethod
    def build(
        cls, vectors: DataFrame, folder: str, id_col: str = "vec_id", payload: Sequence[str] = (), partition: str | None = None,
        cells: int | None = None, codes: int = CODES, sample: int = SAMPLE,
    ) -> VectorIndex:
        """Index (id_col, embedding, payload...) in a new folder. ``cells``: by default the root of the number of vectors."""
        spark = vectors.sparkSession
        self = cls(spark, folder, id_col)
        named = list(dict.fromkeys([*payload, *([partition] if partition else [])]))
        rows = _keyed(vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), *named).where(sound(F.col("embedding"))))
        rows.select("h1", "h2", "id", *named).write.parquet(f"{folder}/copies")
        entries = rows.groupBy("h1", "h2", *named).agg(F.min("id").alias("id"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
        entries = stored(entries, "entries")
        n = entries.count()
        if not n:
            entries.select("*", F.lit(0).alias("cell"), F.lit(b"").alias("code")).write.parquet(f"{folder}/vectors")
            self._write_model(Model(np.zeros((0, 0), np.float32), [], np.zeros(0)))
            removed(entries)
            return self
        width = len(entries.first()["embedding"])
        sample = max(1, min(sample, SAMPLE_BYTES // (4 * width)))
        cells = max(1, min(cells or int(n**0.5), CENTRE_BYTES // (4 * width), sample))
        x = _sampled(entries, sample, n)
        model = Model.fit(x, self._balanced(entries, k_means(x, cells, direction=True), n, sample), codes)
        shared = spark.sparkContext.broadcast((Cells(model.centres), model))
        placed = entries.mapInArrow(_place(shared, True), T.StructType([*entries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())]))
        placed = stored(placed, "placed")  # dealing by range reads it twice
        order = [*([partition] if partition else []), "cell", "h1"]
        sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = sorted_rows.write.partitionBy(partition) if partition else sorted_rows.write
        # Row groups of about a few cells, so that statistics of ``cell`` leave out the rest.
        writer.option("parquet.block.size", str(4 << 20)).parquet(f"{folder}/vectors")
        self._write_model(model)
        removed(entries, placed)
        return self

    def _balanced(self, entries: DataFrame, centres: np.ndarray, n: int, sample: int) -> np.ndarray:
        """Centres with those of too large cells replaced by several, learned from a sample of their rows."""
        most = max(256, 4 * n // len(centres))
        for _ in range(3):
            shared = self.spark.sparkContext.broadcast((Cells(centres), None))
            placed = entries.select("embedding").mapInArrow(_place(shared, False), "cell int")
            sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
            over = {c: m for c, m in sizes.items() if m > most}
            room = CENTRE_BYTES // centres[0].nbytes - len(centres)
            if not over or room < 2 * len(over):
                break
            share = min(1.0, sample / sum(over.values()))
            few = entries.where(_share(share)).select("h1", "embedding")
            rows = few.mapInArrow(_place(shared, True), T.StructType([*few.schema.fields, T.StructField("cell", T.IntegerType())]))
            got = rows.where(F.col("cell").isin(list(over))).toArrow().sort_by("h1")
            cell, x, parts = got["cell"].to_numpy(), unit_rows(got["embedding"]).astype(np.float32), []
            for c, m in over.items():
                own = x[cell == c]
                parts.append(k_means(own, min(-(-2 * m // most), room // len(over)), direction=True) if len(own) else centres[[c]])
            centres = np.concatenate([np.delete(centres, list(over), axis=0), *parts])
        return centres

    def _write_model(self, model: Model) -> None:
        books = b"".join(b.astype("<f4").tobytes() for b in model.books)
        row = (bytearray(model.centres.astype("<f4").tobytes()), bytearray(books), [len(b) for b in model.books], model.reach.tolist(), model.centres.shape[1])
        self.spark.createDataFrame([row], MODEL).coalesce(1).write.parquet(f"{self.folder}/model")

    def model(self) -> Model:
        row = self.spark.read.schema(MODEL).parquet(f"{self.folder}/model").first()
        width, books, at = row["width"], [], 0
        if not width:
            return Model(np.zeros((0, 0), np.float32), [], np.zeros(0))
        for p, size in zip(Model.parts(width, len(row["sizes"])), row["sizes"], strict=True):
            books.append(np.frombuffer(row["books"], "<f4", size * len(p), at).reshape(size, len(p)))
            at += 4 * size * len(p)
        return Model(np.frombuffer(row["centres"], "<f4").reshape(-1, width), books, np.array(row["reach"]))

    def vectors(self, where: Column | None = None) -> DataFrame:
        """(id, embedding, payload..., h1, h2, copies, cell, code), one row for equal vectors with equal payload."""
        rows = self.spark.read.parquet(f"{self.folder}/vectors")
        return rows if where is None else rows.where(where)

    def search(
        self, queries: DataFrame, k: int | None = None, target: float | None = 0.95, where: Column | None = None, quantised: bool = False,
        rerank: int = 8, query_id: str = "query_id", probes: int | None = None,
    ) -> DataFrame:
        """(query_id, <id_col>, distance, rank) of the k nearest rows of each query (query_id, embedding).

        ``target``: the recall that sets the number of cells, unless ``probes`` does; None: exact.
        A quantised search ranks ``rerank * k`` rows a query by their codes, then these by vector.
        """
        k = k or DEFAULT.top_k
        asked = queries.select(F.col(query_id).alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        asked = stored(_keyed(asked.where(sound(F.col("embedding")))).withColumnsRenamed({"h1": "q1", "h2": "q2"}), "asked")
        different = asked.groupBy("q1", "q2").agg(F.first("embedding").alias("embedding"))
        if quantised:
            near = self._reranked(different, self._near(different, k * rerank, target, probes, where, True), where)
        else:
            near = self._near(different, k, target, probes, where, False)
        best = Window.partitionBy("q1", "q2").orderBy(F.round("distance", 9), "id")
        hits = near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
        hits = stored(hits.select("q1", "q2", "id", "h1", "h2", "copies", "distance"), "index-hits")
        single = hits.where("copies = 1").select("q1", "q2", "id", "distance")
        return self._ranked(asked, single.unionByName(self._copied(hits, k, where)), k)

    def _near(self, different: DataFrame, k: int, target: float | None, probes: int | None, where: Column | None, quantised: bool) -> DataFrame:
        """(q1, q2, id, h1, h2, copies, distance, cell): the k best of each block of each probed cell."""
        model = self.model()
        id_type = self.spark.read.parquet(f"{self.folder}/vectors").schema["id"].dataType
        schema = T.StructType([
            T.StructField("q1", T.LongType()), T.StructField("q2", T.LongType()), T.StructField("id", id_type), T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("distance", T.DoubleType()), T.StructField("cell", T.IntegerType()),
        ])
        if not len(model.centres):
            return self.spark.createDataFrame([], schema)
        probes = probes or (len(model.centres) if target is None else model.probes(target))
        shared = self.spark.sparkContext.broadcast(model)
        probed = stored(different.select("q1", "q2", "embedding").mapInArrow(_probe(shared, probes), "q1 long, q2 long, embedding array<float>, cell int"), "probes")
        wanted = probed.groupBy("cell").agg(F.count("*").alias("_queries"))
        cells = [r["cell"] for r in wanted.select("cell").collect()]  # no more than there are centres
        held = self.vectors(where).where(F.col("cell").isin(cells))
        held = held.select("cell", "id", "h1", "h2", "copies", *(["code"] if quantised else ["embedding"]))
        sizes = held.groupBy("cell").agg(F.count("*").alias("_vectors")).join(wanted, "cell")
        blocks = stored(sizes.select("cell", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(n) for c, n in (("_vectors", "_v"), ("_queries", "_q")))), "blocks")
        few = broadcast_if_small(blocks, 24)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one_of = lambda h, n: F.pmod(F.xxhash64(h), F.col(n)).cast("int")
        left = probed.join(few, "cell").withColumn("qb", one_of("q2", "_q")).withColumn("vb", every("_v")).drop("_q", "_v")
        right = held.join(few, "cell").withColumn("vb", one_of("h2", "_v")).withColumn("qb", every("_q")).drop("_q", "_v")
        keys = ["cell", "vb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(shared, k, quantised, schema), schema)

    def _reranked(self, different: DataFrame, near: DataFrame, where: Column | None) -> DataFrame:
        """The same rows with exact distances; only vectors of rows that the codes chose are read on."""
        chosen = stored(near, "candidates")
        vectors = self.vectors(where).where(F.col("cell").isin([r["cell"] for r in chosen.select("cell").distinct().collect()]))
        both = broadcast_if_small(chosen, 96).join(vectors.select("cell", "id", "h1", "h2", F.col("embedding").alias("v")), ["cell", "id", "h1", "h2"])
        both = both.join(different.select("q1", "q2", F.col("embedding").alias("q")), ["q1", "q2"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    distance = 1 - (unit_rows(batch.column("q")) * unit_rows(batch.column("v"))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q1", "q2", "id", "h1", "h2", "copies")), pa.array(distance)], ["q1", "q2", "id", "h1", "h2", "copies", "distance"])

        schema = T.StructType([f for f in near.schema.fields if f.name != "cell"])
        return both.mapInArrow(run, schema)

    def _copied(self, hits: DataFrame, k: int, where: Column | None) -> DataFrame:
        """Hits on vectors that several rows share, as those rows: the k least ids of each vector, which is all that can rank."""
        several = hits.where("copies > 1")
        rows = self.spark.read.parquet(f"{self.folder}/copies")
        rows = (rows if where is None else rows.where(where)).join(broadcast_if_small(several.select("h1", "h2"), 16), ["h1", "h2"], "left_semi")
        payload = [c for c in rows.columns if c not in ("h1", "h2", "id")]
        least = Window.partitionBy("h1", "h2", *payload).orderBy("id")
        rows = rows.withColumn("_k", F.row_number().over(least)).where(F.col("_k") <= k)
        # A hit is an entry, so of rows with other payload only those of the entry's own first id count.
        first = rows.withColumn("_first", F.min("id").over(Window.partitionBy("h1", "h2", *payload)))
        met = several.select("q1", "q2", "h1", "h2", F.col("id").alias("_first"), "distance").join(first.select("h1", "h2", "_first", "id"), ["h1", "h2", "_first"])
        return met.select("q1", "q2", "id", "distance")

    def _ranked(self, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("q1", "q2").orderBy(F.round("distance", 9), "id")
        kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return asked.select("query_id", "q1", "q2").join(kept, ["q1", "q2"]).select("query_id", F.col("id").alias(self.id_col), "distance", F.col("rank").cast("int").alias("rank"))


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, recall): share of a query's exact hits that are among the found ones."""
    both = exact.select("query_id", id_col).join(found.select("query_id", id_col).withColumn("_hit", F.lit(1)), ["query_id", id_col], "left")
    return both.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))


# Tasks


def _share(share: float) -> Column:
    return F.pmod(F.col("h1"), F.lit(1_000_003)) < F.lit(round(share * 1_000_003))


def _sampled(entries: DataFrame, sample: int, n: int) -> np.ndarray:
    """About ``sample`` unit vectors: a range of their hashes, so the same for any layout."""
    share = min(1.0, sample / n)
    got = entries.where(_share(share)).select("h1", "embedding").toArrow()
    if not got.num_rows:
        got = entries.orderBy("h1").limit(1).select("h1", "embedding").toArrow()
    return unit_rows(got.sort_by("h1")["embedding"]).astype(np.float32)


def _place(shared, whole: bool):
    """Rows with their cells and, given a model, their codes; not ``whole``: the cells alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column(batch.schema.get_field_index("embedding"))).astype(np.float32)
            cell = cells.of(x)
            more, names = [pa.array(cell, pa.int32())], ["cell"]
            if model is not None:
                more.append(pa.array([c.tobytes() for c in model.encode(x, cell)], pa.binary()))
                names.append("code")
            yield pa.RecordBatch.from_arrays([*(batch.columns if whole else []), *more], [*(batch.schema.names if whole else []), *names])

    return run


def _probe(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.centres.astype(np.float64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                score = unit_rows(batch.column("embedding")) @ centres.T
                n = min(probes, score.shape[1])
                cell = np.argpartition(-score, n - 1, axis=1)[:, :n]
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.ravel(), pa.int32())], ["q1", "q2", "embedding", "cell"])

    return run


def _compare(shared, k: int, quantised: bool, schema: T.StructType):
    names = schema.fieldNames()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("id", "ascending")]))
        left, right, found = left.combine_chunks(), right.combine_chunks(), []
        cell = key[0].as_py()
        if quantised and right.num_rows:
            codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1).astype(np.int64)
        elif right.num_rows:
            v = unit_rows(right["embedding"])
        for at in range(0, left.num_rows if right.num_rows else 0, 256):
            q = unit_rows(left["embedding"].slice(at, 256))
            if quantised:
                tables, score = shared.value.tables(q), np.repeat((q @ shared.value.centres[cell].astype(np.float64))[:, None], right.num_rows, axis=1)
                for m in range(codes.shape[1]):
                    score += tables[:, m, codes[:, m]]
                distance = 1 - score
            else:
                distance = 1 - q @ v.T
            row, col = smallest(distance, k)
            chosen = left.select(["q1", "q2"]).take(pa.array(row + at))
            other = right.select(["id", "h1", "h2", "copies"]).take(pa.array(col))
            found.append(pa.table([*chosen.columns, *other.columns, pa.array(distance[row, col]), pa.array(np.full(len(row), cell), pa.int32())], names))
        if found:
            return pa.concat_tables(found)
        kinds = [left["q1"].type, left["q2"].type, right["id"].type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
        return pa.table([pa.array([], kind) for kind in kinds], names)

    return run
