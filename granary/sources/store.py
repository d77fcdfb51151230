"""A keyed collection of chunks in Parquet folders, with a log of numbered commits.

``log/<number>.json`` is a commit. Its file is written whole under another name and put in place
only if no other writer has taken the number, so of two writers one gets it and the other goes on to
the next. A commit names the parts, data folders under ``data/``, that make up the collection after
it; readers take the newest commit, or an older one (``read(version=n)``), and never meet half a
write. A part is a full state (``v``) or the rows that a write added or replaced (``d``).

Rows are dealt to ``BUCKETS`` folders by their key, are sorted by it and have a Bloom filter of it
in each file. A write opens no earlier file; ``lookup`` opens the buckets of its keys alone. After
``COMPACT`` deltas these are merged, with each other or, once they hold a good part of the
collection's rows, with the full state, so a row is rewritten a logarithmic number of times.

A write depends on nothing it has read, so a writer that lost its number commits under the next one;
``expected`` makes it fail with ``Conflict`` instead if anything was committed since. A compaction
stands if the parts it read are still there, whatever was added meanwhile; else it is given up.
"""

from __future__ import annotations

import json
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.config import DEFAULT, Settings, normalised_mode
from granary.shared import broadcast_if_small, exists, removed, stored

log = logging.getLogger(__name__)
COMPACT = 8
BUCKETS = 16
FILE_ROWS = 1_000_000  # of a bucket's file
SHARE = 0.25  # of the full state's rows: deltas that hold more are merged into it

SCHEMA = (
    "chunk_id string, text string, source string, chunk_index long, chunk_size int, metadata map<string,string>, embedding array<float>"
)


class Conflict(RuntimeError):
    """Another writer has committed since the expected version."""


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str = DEFAULT.collection, buckets: int = BUCKETS):
        self.spark, self.name, self.root, self.buckets = spark, name, f"{root.rstrip('/')}/{name}", buckets

    # The log

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _commit_path(self, number: int) -> str:
        return f"{self.root}/log/{number:012d}.json"

    def commits(self) -> list[int]:
        """Numbers of the commits that can be read."""
        if not exists(self.spark, f"{self.root}/log"):
            return []
        fs, path = self._fs(f"{self.root}/log")
        return sorted(int(n[:-5]) for f in fs.listStatus(path) if (n := f.getPath().getName()).endswith(".json") and not n.startswith("."))

    def _commit(self, number: int) -> dict:
        fs, path = self._fs(self._commit_path(number))
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self) -> dict:
        numbers = self.commits()
        return self._commit(numbers[-1]) if numbers else {"number": 0, "buckets": self.buckets, "parts": []}

    def _put_if_absent(self, number: int, commit: dict) -> bool:
        """Write a commit unless its number is taken. The file appears whole or not at all.

        Renaming fails where the target exists, but replaces it on a local disk; there a hard
        link, which does not, takes its place. The store must be one of these kinds.
        """
        path = self._commit_path(number)
        fs, target = self._fs(path)
        _, temporary = self._fs(f"{self.root}/log/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(commit).encode()))
        stream.close()
        if fs.getUri().getScheme() == "file":
            jvm, place = self.spark._jvm, lambda p: fs.makeQualified(p).toUri().getPath()
            local = lambda p: jvm.java.io.File(place(p)).toPath()
            try:
                jvm.java.nio.file.Files.createLink(local(target), local(temporary))
                done = True
            except Exception as error:
                if "FileAlreadyExists" not in str(error):
                    raise
                done = False
        else:
            done = not fs.exists(target) and fs.rename(temporary, target)
        fs.delete(temporary, False)
        return done

    def _append(self, change, expected: int | None = None) -> int:
        """Commit what ``change`` makes of the newest commit's parts, under the next free number; 0 if it gives up."""
        while True:
            newest = self._newest()
            if expected is not None and newest["number"] != expected:
                raise Conflict(f"version {newest['number']} is there, {expected} was expected")
            number = newest["number"] + 1
            parts = change(number, newest["parts"])
            if parts is None:
                return 0
            if self._put_if_absent(number, {"number": number, "buckets": newest["buckets"], "time_ms": int(time.time() * 1000), "parts": parts}):
                return number

    # Parts

    def _parts(self, version: int | None = None) -> list[dict]:
        if version is None:
            return self._newest()["parts"]
        if version not in self.commits():
            raise ValueError(f"no version {version}")
        return self._commit(version)["parts"]

    def versions(self) -> list[int]:
        """Numbers of the commits that wrote a full state."""
        numbers, found = self.commits(), []
        for n in numbers:
            found += [n] if any(p["kind"] == "v" and p["number"] == n for p in self._commit(n)["parts"]) else []
        return found

    def deltas(self) -> list[int]:
        """Numbers of the deltas over the newest full state."""
        return [p["number"] for p in self._parts() if p["kind"] == "d"]

    def _write(self, rows: DataFrame, n: int, buckets: int) -> str:
        """A new data folder, a file for each bucket and so many rows."""
        folder, files = f"data/{uuid.uuid4().hex}", max(1, -(-n // (buckets * FILE_ROWS)))
        dealt = rows.withColumn("bucket", bucket_of(F.col("chunk_id"), buckets)).repartition(
            min(buckets, max(1, n)) * files, "bucket", F.pmod(F.xxhash64(F.lit(1), "chunk_id"), F.lit(files))
        )
        dealt.sortWithinPartitions("bucket", "chunk_id").write.partitionBy("bucket").option(
            "parquet.bloom.filter.enabled#chunk_id", "true"
        ).option("parquet.bloom.filter.expected.ndv#chunk_id", str(min(FILE_ROWS, max(1, n)))).parquet(f"{self.root}/{folder}")
        return folder

    def _rows(self, part: dict, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.root}/{part['folder']}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _merged(self, parts: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """Rows of parts, oldest first; of equal keys those of the latest part."""
        out = None
        for part in parts:
            rows = self._rows(part, buckets)
            if out is not None:
                ids = broadcast_if_small(rows.select("bucket", "chunk_id"), 100)
                rows = out.join(ids, ["bucket", "chunk_id"], "left_anti").unionByName(rows)
            out = rows
        return self.spark.createDataFrame([], SCHEMA) if out is None else out.drop("bucket")

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, now or as of a commit; an empty table if there is none."""
        return self._merged(self._parts(version))

    def lookup(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the keys of a table (chunk_id); only the files of their buckets are opened."""
        buckets = self._newest()["buckets"]
        wanted = stored(ids.select("chunk_id").distinct(), "wanted")
        touched = [r["b"] for r in wanted.select(bucket_of(F.col("chunk_id"), buckets).alias("b")).distinct().collect()]  # a row a bucket
        return self._merged(self._parts(version), touched).join(broadcast_if_small(wanted, 100), "chunk_id", "left_semi")

    def history(self) -> DataFrame:
        """(number, time_ms, n_parts, n_rows_written) of the commits in the log."""
        rows = [(c["number"], c["time_ms"], len(c["parts"]), sum(p["rows"] for p in c["parts"] if p["number"] == c["number"])) for c in map(self._commit, self.commits())]
        return self.spark.createDataFrame(rows, "number long, time_ms long, n_parts int, n_rows_written long")

    # Writing

    def upsert(self, chunks: DataFrame, order_col: str = "chunk_index", expected: int | None = None) -> int:
        """Merge by chunk_id, the last of equal ids wins; returns the number of chunks given.

        The given rows are evaluated once, into a table of their own, so an embedder is called
        once for each text and what is counted is what is stored. Of that, one shuffle by id
        keeps the last of equal ids.
        """
        given = stored(chunks.select(_columns()), "upsert")
        n = given.count()
        folder = self._write(last_wins(given, "chunk_id", order_col), n, self._newest()["buckets"])
        removed(given)
        try:
            self._append(lambda number, parts: [*parts, {"kind": "d" if parts else "v", "number": number, "folder": folder, "rows": n}], expected)
        except Conflict:
            self._delete(folder)
            raise
        if len(self.deltas()) >= COMPACT:
            self.compact()
        return n

    def compact(self) -> int:
        """Merge the deltas, with the full state if they hold ``SHARE`` of its rows; the commit's number, 0 if there was nothing to do."""
        parts = self._parts()
        full, deltas = [p for p in parts if p["kind"] == "v"], [p for p in parts if p["kind"] == "d"]
        whole = not full or sum(p["rows"] for p in deltas) >= SHARE * full[0]["rows"]
        old = parts if whole else deltas
        if len(old) < 2:
            return 0
        rows = stored(self._merged(old), "compacted")
        n = rows.count()
        folder = self._write(rows, n, self._newest()["buckets"])
        removed(rows)
        gone = {p["folder"] for p in old}

        def change(number: int, now: list[dict]) -> list[dict] | None:
            if not gone <= {p["folder"] for p in now}:
                return None  # another writer merged or dropped them
            # What was added meanwhile is newer than all that was merged.
            merged = {"kind": "v" if whole else "d", "number": number, "folder": folder, "rows": n}
            kept = [p for p in now if p["folder"] not in gone]
            return [*(p for p in kept if p["kind"] == "v"), merged, *(p for p in kept if p["kind"] == "d")]

        number = self._append(change)
        if not number:
            self._delete(folder)
        return number

    def _delete(self, name: str) -> None:
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)

    def drop(self) -> dict:
        """Remove the collection. A failure is logged and still reported as cleared."""
        try:
            fs, path = self._fs(self.root)
            fs.delete(path, True)
        except Exception:
            log.exception("collection %s was not removed", self.name)
        return {"status": "cleared", "message": f"collection {self.name} removed"}

    def ready(self) -> bool:
        """Does it hold anything? False on any error."""
        try:
            return not self.read().isEmpty()
        except Exception:
            log.exception("collection %s cannot be read", self.name)
            return False

    def vacuum(self, keep: int = 2) -> None:
        """Remove the commits before the newest full states, and data that none of the others names."""
        full = self.versions()[-keep:]
        if not full:
            return
        numbers = self.commits()
        named = {p["folder"] for n in numbers if n >= full[0] for p in self._commit(n)["parts"]}
        gone = {p["folder"] for n in numbers if n < full[0] for p in self._commit(n)["parts"]} - named
        for name in [*(f"log/{n:012d}.json" for n in numbers if n < full[0]), *gone]:
            self._delete(name)


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _columns() -> list[str]:
    return ["chunk_id", "text", "source", "chunk_index", "chunk_size", "metadata", "embedding"]


def last_wins(rows: DataFrame, key: str, order_col: str) -> DataFrame:
    """Of rows with equal keys the last in order. Keys are content hashes, so equal ones are copies of one text."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order_col).desc()))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def stats(chunks: DataFrame, name: str = DEFAULT.collection, model: str = "hashing") -> DataFrame:
    """One row: number of stored chunks and constants."""
    return chunks.agg(F.count("*").alias("total_documents")).select(
        "total_documents", F.lit(name).alias("collection_name"), F.lit(model).alias("embedding_model")
    )


def health(chunks: DataFrame, model: str = "extractive", settings: Settings = DEFAULT, mode: str | None = None) -> DataFrame:
    """One row: ready if there are chunks or in dummy mode; unknown modes are the dummy mode."""
    mode = normalised_mode(settings.mode if mode is None else mode)
    dummy = mode == "dummy"
    return chunks.agg(F.count("*").alias("total_documents")).select(
        F.lit("ok").alias("status"), (F.lit(dummy) | (F.col("total_documents") > 0)).alias("ready"), "total_documents",
        F.lit("dummy" if dummy else model).alias("model"), F.lit(mode).alias("mode"),
    )
