"""Token ids of documents in wavelet-matrix files: one compressed file a shard, with access, counting and lookup.

Documents are dealt out and sorted by doc_id, tokenised where they then lie, and written in shards
of about ``SHARD`` ids: a row each of a Parquet table, whose ``file`` column holds the whole file.
A document is never cut; one longer than a shard is a shard of its own. A task holds one shard.

A file has one bit plane for each bit of the largest id, highest first. In a plane the ids stand in
the order of the bits above: first those whose last bit was 0, then those with 1, each in the order
of the plane before. A plane is cut into blocks of ``BLOCK`` bytes, compressed one by one, and has
the number of ones before each block. So the id at a place (``access``), how often an id occurs
before a place (``rank``) and where it occurs (``select``) each touch one block or a few a plane.
``decode`` turns the planes back into all ids, from the lowest plane up, without any lookup.

Layout, little-endian: magic, uint32 length of the header, header, blocks. The header is compressed
JSON: ``n`` ids, for each plane ``zeros``, ``ones`` before each block and ``ends`` of the blocks,
and the documents: ``doc_ids`` (null where there is none) and their ``lengths``.

Defined results for odd input:

* null and empty texts: the end id alone. Very long texts are encoded in parts that break where
  the tokenizer breaks in any case, so their ids are those of the whole text.
* ties: rows of one doc_id stand by the 64-bit hash of their text; rows equal in both are
  interchangeable. Null doc_ids stand first. Repeated rows: each is written. Empty table: no
  shards, no rows. Further columns, whatever their names, are not written.
* a lost executor: its rows are dealt, encoded and written anew, with the same bytes.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.hashing import text_slices
from granary.llm.shared import bounded_batches, broadcast_if_small, new_folder, spread, stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 0
SHARD = 1 << 20  # ids
BLOCK = 4096  # bytes of a plane that are compressed together
CELL_BITS = 20  # places that agree but for so many low bits look for their shard together
SLICE = 4 << 20  # bytes of text encoded at once
CACHE = 600_000  # parts of texts whose ids a worker remembers
MAGIC = b"WVM1"

SHARDS = "part int, seq int, n_docs long, n_tokens long, file binary"


# Tokens of many texts at once


def _kinds() -> np.ndarray:
    """Of each ASCII byte: 1 white space, 2 letter, 3 digit, 4 mark; 0 for the rest, of which nothing is assumed."""
    out = np.zeros(256, np.uint8)
    for b in (9, 10, 11, 12, 13, *range(32, 127)):
        c = chr(b)
        out[b] = 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    return out


KINDS = _kinds()
SPECIAL = b"<|endoftext|>"  # one token, wherever it stands


def cuts(buf: np.ndarray) -> np.ndarray:
    """Before which bytes the tokenizer breaks in any case.

    Its tokens hold letters, digits or marks, and white space before them only; but an apostrophe
    may go with the letters after it. A letter of U+00C0 to U+07FF is no white space either.
    """
    kind, out = KINDS[buf], np.zeros(len(buf), bool)
    before, after = kind[:-1], kind[1:]
    out[1:] = (before > 1) & (after == 1)
    out[2:] |= (buf[1:-1] & 0xC0 == 0x80) & (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xDF) & (after[1:] == 1)
    if SPECIAL not in buf.tobytes():
        out[1:] |= (before > 1) & (after > 1) & (before != after) & ~((buf[:-1] == 0x27) & (after == 2))
    return out


class Parts:
    """The tokenizer, and the ids of parts of texts seen so far, once a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of each id; the vocabulary writes a byte as a character
        for token, n in vocabulary.items():
            self.bytes[n] = len(token)
        self._keep([], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _keep(self, names: list[str], flat: np.ndarray, size: np.ndarray, hits: np.ndarray) -> None:
        self.known = dict(zip(names, range(len(names)), strict=True))
        self.flat, self.size, self.hits = flat, size, hits

    def ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, first, number) such that part k, all different, has ``flat[first[k] : first[k] + number[k]]``."""
        known = self.known
        at = np.fromiter(map(known.get, parts.to_pylist(), repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = parts.take(pa.array(missing))
            if len(known) + len(new) > CACHE:
                self._forget()
                return self.ids(parts) if len(self.known) + len(parts) <= CACHE else self._alone(parts)
            ids, size = self._encode(new)
            at[missing] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new.to_pylist(), at[missing].tolist(), strict=True))
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.hits[at] += 1
        return self.flat, (np.cumsum(self.size) - self.size)[at], self.size[at]

    def _alone(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, size = self._encode(parts)
        return ids, np.cumsum(size) - size, size

    def _forget(self) -> None:
        """Keep what came up most, a third of the room at most; parts that came up once go."""
        room = CACHE // 3
        least = max(2, int(np.partition(self.hits, -room)[-room]) + 1 if len(self.hits) > room else 2)
        stay = self.hits >= least
        names = [p for p, s in zip(self.known, stay.tolist(), strict=True) if s]
        self._keep(names, self.flat[np.repeat(stay, self.size)], self.size[stay], self.hits[stay] // 2)

    def _encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and the number of each.

        Parts are encoded together wherever the tokenizer breaks between two, and told apart by
        the bytes of their tokens.
        """
        ends = np.cumsum(pc.binary_length(parts).to_numpy())
        joined = b"".join(parts.cast(pa.large_binary()).to_pylist())
        breaks = np.append(cuts(np.frombuffer(joined, np.uint8)), True)[ends]
        runs, at, first = [], 0, 0
        for k in np.flatnonzero(~breaks | (np.arange(1, len(ends) + 1) % 2048 == 0)).tolist() + [len(ends) - 1]:
            if k >= first:
                runs.append(joined[at : ends[k]].decode())
                at, first = int(ends[k]), k + 1
        found = [e.ids for e in self.tok.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        token_ends = np.cumsum(self.bytes[ids])
        upto = np.searchsorted(token_ends, ends) + 1
        if not np.array_equal(token_ends[upto - 1], ends):
            raise ValueError("a token lies in two parts")
        return ids, np.diff(upto, prepend=0)


@lru_cache(maxsize=2)
def known_parts(path: str) -> Parts:
    return Parts(path)


def encode(buf: np.ndarray, bounds: np.ndarray, path: str = TOKENIZER, limit: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the number of each; bounds are offsets of UTF-8 texts in buf.

    A single text beyond the limit is encoded in segments, so that memory is that of its ids.
    """
    if len(bounds) > 2 or bounds[-1] - bounds[0] <= 2 * limit:
        return _encode(buf, bounds, path)
    found, at, end = [], int(bounds[0]), int(bounds[-1])
    while at < end:
        stop = min(end, at + limit)
        while stop < end:
            back = np.flatnonzero(cuts(buf[at:stop]))
            if len(back):
                stop = at + int(back[-1])
                break
            stop = min(end, stop + limit)
        found.append(_encode(buf, np.array([at, stop]), path)[0])
        at = stop
    return np.concatenate(found), np.array([sum(map(len, found))])


def _encode(buf: np.ndarray, bounds: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Texts are cut wherever the tokenizer breaks; equal parts, nearly all words, are encoded once."""
    buf, bounds = buf[bounds[0] : bounds[-1]], bounds - bounds[0]
    cut = np.append(cuts(buf), False)
    cut[bounds] = True
    at = np.flatnonzero(cut)
    starts = at[:-1]
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
    flat, first, number = known_parts(path).ids(parts.dictionary)
    code = parts.indices.to_numpy()
    length = number[code]
    ends = np.cumsum(length)
    source = np.repeat(first[code] - (ends - length), length) + np.arange(ends[-1])
    before = np.concatenate([[0], ends])
    return flat[source], np.diff(before[np.searchsorted(starts, bounds)])


# One file


def _block_ones(plane: np.ndarray) -> np.ndarray:
    """Ones before each block, and in all."""
    padded = np.zeros(-(-len(plane) // BLOCK) * BLOCK, np.uint8)
    padded[: len(plane)] = plane
    return np.concatenate([[0], np.cumsum(np.bitwise_count(padded.reshape(-1, BLOCK)).sum(axis=1, dtype=np.int64))])


def write_file(ids: np.ndarray, doc_ids: Sequence[int | None], lengths: Sequence[int]) -> bytes:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    planes, blocks, size = [], [], 0
    values = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids.astype(np.uint32)
    for bit in reversed(range(max(1, int(ids.max(initial=0)).bit_length()))):
        ones = (values >> bit & 1).astype(bool)
        values = np.concatenate([values[~ones], values[ones]])
        plane = np.packbits(ones, bitorder="little")
        ends = []
        for at in range(0, len(plane), BLOCK):
            blocks.append(pack(plane[at : at + BLOCK].tobytes()))
            size += len(blocks[-1])
            ends.append(size)
        counts = _block_ones(plane)
        planes.append({"bit": bit, "zeros": len(ids) - int(counts[-1]), "ones": counts.tolist(), "ends": ends})
    header = {"n": len(ids), "planes": planes, "doc_ids": list(doc_ids), "lengths": [int(x) for x in lengths]}
    head = pack(json.dumps(header).encode())
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blocks])


class TokenFile:
    """A file, read block by block as it is asked; keeps the blocks that it has unpacked."""

    def __init__(self, file: bytes):
        import zstandard

        if file[:4] != MAGIC:
            raise ValueError("not a token file")
        self.unpack = zstandard.ZstdDecompressor().decompress
        (size,) = struct.unpack("<I", file[4:8])
        header = json.loads(self.unpack(file[8 : 8 + size]))
        self.n, self.planes, self.doc_ids = header["n"], header["planes"], header["doc_ids"]
        self.lengths = np.array(header["lengths"], np.int64)
        self.file, self.data, self.seen = file, 8 + size, {}

    def __len__(self) -> int:
        return self.n

    def _block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.seen:
            ends = self.planes[plane]["ends"]
            before = ends[block - 1] if block else self.planes[plane - 1]["ends"][-1] if plane and self.planes[plane - 1]["ends"] else 0
            self.seen[plane, block] = np.frombuffer(self.unpack(self.file[self.data + before : self.data + ends[block]]), np.uint8)
        return self.seen[plane, block]

    def _bit(self, plane: int, at: int) -> int:
        return int(self._block(plane, at // 8 // BLOCK)[at // 8 % BLOCK]) >> at % 8 & 1

    def _ones(self, plane: int, at: int) -> int:
        """Ones before a place of a plane."""
        block, inside = divmod(at, 8 * BLOCK)
        count = self.planes[plane]["ones"][block]
        if inside:
            bits = self._block(plane, block)
            count += int(np.bitwise_count(bits[: inside // 8]).sum(dtype=np.int64))
            if inside % 8:
                count += (int(bits[inside // 8]) & (1 << inside % 8) - 1).bit_count()
        return count

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Place of the bit of that value with k such before it."""
        ones = np.array(self.planes[plane]["ones"])
        before = ones if bit else np.arange(len(ones)) * 8 * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(plane, block), bitorder="little")
        return block * 8 * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for k, plane in enumerate(self.planes):
            one = self._bit(k, at)
            ones = self._ones(k, at)
            token |= one << plane["bit"]
            at = plane["zeros"] + ones if one else at - ones
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the ids equal to token of a range stand under the last plane."""
        if token >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            a, b = self._ones(k, start), self._ones(k, end)
            start, end = (plane["zeros"] + a, plane["zeros"] + b) if token >> plane["bit"] & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in a range of places."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def rank(self, token: int, at: int) -> int:
        """How often an id occurs before a place."""
        return self.count(token, 0, at)

    def select(self, token: int, k: int) -> int:
        """Place of the occurrence of an id with k before it."""
        first, end = self._range(token, 0, self.n)
        if not 0 <= k < end - first:
            raise IndexError(k)
        at = first + k
        for p, plane in reversed(list(enumerate(self.planes))):
            at = self._find(p, 1, at - plane["zeros"]) if token >> plane["bit"] & 1 else self._find(p, 0, at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, ascending."""
        first, end = self._range(token, 0, self.n)
        at = np.arange(first, end)
        for p, plane in reversed(list(enumerate(self.planes))):
            if not len(at):
                break
            bit = token >> plane["bit"] & 1
            bits = np.concatenate([np.unpackbits(self._block(p, b), bitorder="little") for b in range(len(plane["ends"]))])[: self.n]
            at = np.flatnonzero(bits == bit)[at - plane["zeros"] * bit]
        return at

    def decode(self) -> np.ndarray:
        """All ids."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p, plane in reversed(list(enumerate(self.planes))):
            bits = b"".join(self.unpack(self.file[a:b]) for a, b in self._places(p))
            ones = np.unpackbits(np.frombuffer(bits, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[~ones] = values[: plane["zeros"]]
            above[ones] = values[plane["zeros"] :] | values.dtype.type(1 << plane["bit"])
            values = above
        return values.astype(np.uint32)

    def _places(self, plane: int) -> Iterator[tuple[int, int]]:
        before = self.planes[plane - 1]["ends"][-1] if plane and self.planes[plane - 1]["ends"] else 0
        for end in self.planes[plane]["ends"]:
            yield self.data + before, self.data + end
            before = end

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id, its ids)."""
        ids, at = self.decode(), 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            yield doc_id, at, ids[at : at + n]
            at += n


# Shards


def _shards(path: str, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])

        def row():
            file = write_file(np.concatenate(held), docs, lengths)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(docs)], "n_tokens": [size], "file": [file]}, schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, buf, bounds in text_slices(batch.column(1), SLICE):
                ids, counts = encode(buf, bounds, path)
                ends = np.cumsum(counts)
                for k in range(first, end):
                    own = ids[ends[k - first] - counts[k - first] : ends[k - first]]
                    if size and size + len(own) + 1 > shard:
                        yield row()
                        seq, docs, lengths, held, size = seq + 1, [], [], [], 0
                    docs.append(doc_ids[k])
                    lengths.append(len(own) + 1)
                    held += [own, np.array([END], np.uint32)]
                    size += len(own) + 1
        if docs:
            yield row()

    return run


class TokenStore:
    """Shards in a folder: ``write`` once, then read from the files alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, docs: DataFrame, path: str = TOKENIZER, shard: int = SHARD) -> TokenStore:
        """Encode (doc_id, text) in ascending doc_id order."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        keyed = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_salt", F.monotonically_increasing_id())
        dealt = keyed.repartitionByRange("doc_id", "_hash", "_salt").sortWithinPartitions("doc_id", "_hash", "_salt").select("doc_id", "text")
        # Files are compressed themselves, and large: a row group holds a few.
        dealt.mapInArrow(_shards(path, shard), SHARDS).write.option("compression", "none").option("parquet.block.size", str(32 << 20)).parquet(self.folder)
        return self

    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARDS).parquet(self.folder)

    def starts(self) -> DataFrame:
        """(part, seq, shard_start): ids before each shard; one row a shard, summed by part and then over parts."""
        sizes = self.shards().select("part", "seq", "n_tokens")
        parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_high", F.shiftright("part", 10))
        highs = parts.groupBy("_high").agg(F.sum("_n").alias("_m"))

        def before(n: str, order: str, *within: str):
            return F.sum(n).over(Window.partitionBy(*within).orderBy(order)) - F.col(n)

        highs = highs.select("_high", before("_m", "_high").alias("_b2"))
        parts = parts.select("part", "_high", before("_n", "part", "_high").alias("_b1")).join(highs, "_high").select("part", (F.col("_b1") + F.col("_b2")).alias("_b"))
        inside = sizes.select("part", "seq", before("n_tokens", "seq", "part").alias("_b0"))
        return inside.join(parts, "part").select("part", "seq", (F.col("_b0") + F.col("_b")).cast("long").alias("shard_start"))

    def _with_starts(self, rows: DataFrame, at: str) -> DataFrame:
        """``rows`` (part, seq, at, ...) with ``at`` counted from the first id of all."""
        starts = stored(self.starts(), "shard-starts")
        rest = [c for c in rows.columns if c not in ("part", "seq", at)]
        return rows.join(broadcast_if_small(starts, 32), ["part", "seq"]).select((F.col(at) + F.col("shard_start")).alias(at), *rest)

    def documents(self) -> DataFrame:
        """(start, doc_id, ids) of every document; ids are little-endian unsigned 32-bit integers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    part, seq = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, start, ids in TokenFile(batch.column(2)[k].as_py()).documents():
                        rows.append((part, seq, start, doc_id, ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held > 1 << 19:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

        def _batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

        found = self.shards().select("part", "seq", "file").mapInArrow(run, "part int, seq int, start long, doc_id long, ids binary")
        return self._with_starts(found, "start")

    def _asked(self, answer, kind: T.StructType) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from answer(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), TokenFile(batch.column(2)[k].as_py()))

        return self.shards().select("part", "seq", "file").mapInArrow(run, kind)

    def occurrences(self, tokens: Sequence[int]) -> DataFrame:
        """(place, token) of every occurrence of some ids, places over all shards."""

        def answer(part: int, seq: int, file: TokenFile) -> Iterator[pa.RecordBatch]:
            for token in tokens:
                at = file.occurrences(token)
                if len(at):
                    same = lambda x, kind: pa.array(np.full(len(at), x), kind)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([same(part, pa.int32()), same(seq, pa.int32()), pa.array(at, pa.int64()), same(token, pa.int64())], ["part", "seq", "place", "token"])

        return self._with_starts(self._asked(answer, "part int, seq int, place long, token long"), "place")

    def counts(self, tokens: Sequence[int]) -> DataFrame:
        """(token, n) over all shards, from the ranks alone; a row a shard and token is shuffled at most."""

        def answer(part: int, seq: int, file: TokenFile) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.int64()), pa.array([file.count(t) for t in tokens], pa.int64())], ["token", "n"])

        return self._asked(answer, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))

    def tokens_at(self, places: DataFrame) -> DataFrame:
        """(place, token) of the different places of a table; a place past the end is left out.

        Places meet the shards that overlap their range of ``2 ** CELL_BITS`` ids; a shard's
        places are no more than its ids, and each opens one block a plane.
        """
        spans = self.starts().join(self.shards().select("part", "seq", "n_tokens"), ["part", "seq"])
        cells = F.sequence(F.shiftright("shard_start", CELL_BITS), F.shiftright(F.col("shard_start") + F.col("n_tokens") - 1, CELL_BITS))
        asked = places.select(F.col("place").cast("long").alias("place")).withColumn("_cell", F.shiftright("place", CELL_BITS))
        inside = (F.col("place") >= F.col("shard_start")) & (F.col("place") < F.col("shard_start") + F.col("n_tokens"))
        found = asked.join(spans.withColumn("_cell", F.explode(cells)), "_cell").where(inside)
        sets = found.groupBy("part", "seq", "shard_start").agg(F.collect_set("place").alias("places"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    file, start = TokenFile(batch.column("file")[k].as_py()), batch.column("shard_start")[k].as_py()
                    at = batch.column("places")[k].values
                    yield pa.RecordBatch.from_arrays([at, pa.array([file.access(x - start) for x in at.to_pylist()], pa.int64())], ["place", "token"])

        files = self.shards().select("part", "seq", "file")
        return sets.join(files, ["part", "seq"]).select("file", "shard_start", "places").mapInArrow(run, "place long, token long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the files."""
    bounded_batches(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    store = TokenStore(spark, new_folder(spark, "token-files")).write(docs)
    return store.documents().select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
