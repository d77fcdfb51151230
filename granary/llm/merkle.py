"""A Merkle manifest of a dataset, and for every row the authentication path to its root.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and
its value. A tree hangs together the leaves of one language, by ascending doc_id; its nodes are the
SHA-256 of two consecutive nodes (the last one of a level may stand alone and is hashed alone). The
roots of the languages, in order, are the leaves of the tree above, whose root names the dataset.

A tree is cut into aligned blocks of ``2 ** BLOCK_BITS`` leaves, so no task holds a language. Block
roots are the leaves of the next level of blocks, until each tree is one block. Within a block the
paths are made by a Merkle traversal: for each height one treehash stack computes the sibling that
is wanted next, and a fixed number of steps a leaf, given to the stack whose lowest node is lowest,
has every sibling ready in time; of nodes it holds a number that grows with the height only. The
path above the block, the same for all its leaves, is joined to it and appended.

Leaves are hashed where the rows lie; of a row its id and digests move, never its text. Positions
are stored with sorted rows, so a lost executor repeats its part with the same outcome.

Defined results for odd input:

* null in any field: ``-``. A null doc_id stands first in its language; a null lang is a tree of
  its own, the first one. Empty texts are ``0:``. Very long texts are hashed whole, by the JVM.
* repeated rows: a leaf each, beside one another. Ties in doc_id: by leaf; rows equal in all five
  fields are interchangeable, so it does not matter which comes first.
* a language of one row: its leaf is its subroot. One language: its subroot is the root. A path
  without siblings has the digest of the empty string. Empty table: no rows.
* further columns, whatever their names, are not part of the manifest and are left out.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.shared import bounded_batches, broadcast_if_small, removed, spread, stored

BLOCK_BITS = 10

#: Steps of a path: no sibling, one to the left, one to the right. A sibling's digest follows.
ALONE, LEFT, RIGHT = 0, 1, 2


# Leaves, as expressions


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def leaves(docs: DataFrame, claimed_n_chars: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, claim): claim is the digest of the row with another ``n_chars``; null where that is null."""
    doc_id, source, lang, n_chars, text = map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))
    lang_name = lang.cast("string")
    claim = F.lit(None).cast("binary") if claimed_n_chars is None else F.when(claimed_n_chars.isNotNull(), digest(doc_id, source, lang_name, claimed_n_chars, text))
    return docs.select(lang_name.alias("tree"), doc_id.cast("long").alias("doc_id"), digest(doc_id, source, lang_name, n_chars, text).alias("leaf"), claim.alias("claim"))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...), a stored table or a part of one, with ``pos`` from 0 within its tree and ``n``, the size of the tree.

    Rows are sorted over all partitions and stored with their place in the partition. What is
    added to it, the rows of the tree in earlier partitions, comes from one count a tree and
    partition. Rows that agree in the whole order are dealt out by where they were read.
    """
    keys = ["tree", *order, "_salt"]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "placed")
    counts = kept.groupBy("tree", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    tree, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_part")
    starts = stored(counts.select("tree", "_part", "_first", (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_before"), F.sum("_rows").over(tree).alias("n")), "starts")
    same = F.col("k.tree").eqNullSafe(F.col("s.tree")) & (F.col("k._part") == F.col("s._part"))
    out = kept.alias("k").join(broadcast_if_small(starts, 96).alias("s"), same).select(
        "k.*", "s.n", (F.col("s._before") + F.col("k._at") - F.col("s._first")).alias("pos")
    ).drop("_at", "_part")
    out.parts = (kept, starts)
    return out


# One block: nodes are hexadecimal digests, or None past the end of the tree


def parent(left: bytes | None, right: bytes | None) -> bytes | None:
    if left is None:
        return None
    return sha256(left + right if right else left).hexdigest().encode()


def height(n: int) -> int:
    return (n - 1).bit_length()


class Treehash:
    """The node over ``2 ** height`` leaves from ``first`` on, computed one step at a time on a stack."""

    def __init__(self, leaf: Sequence[bytes], height: int):
        self.leaf, self.height, self.stack, self.next, self.done = leaf, height, [], 0, True

    def begin(self, first: int) -> None:
        self.stack, self.next, self.done = [], first, first >= len(self.leaf)

    def low(self) -> float:
        """Height of the lowest node on the stack: own height if it is empty, infinite if nothing is left to do."""
        return float("inf") if self.done else self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        """Put two nodes of equal height together, or take one more leaf."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (at, right), (_, left) = stack.pop(), stack.pop()
            stack.append((at + 1, parent(left, right)))
        else:
            stack.append((0, self.leaf[self.next] if self.next < len(self.leaf) else None))
            self.next += 1
        self.done = len(stack) == 1 and stack[0][0] == self.height

    def node(self) -> bytes | None:
        return self.stack[0][1] if self.stack else None


def block_root(leaf: Sequence[bytes], height: int) -> bytes:
    whole = Treehash(leaf, height)
    whole.begin(0)
    while not whole.done:
        whole.step()
    return whole.node()


def traversal(leaf: Sequence[bytes], height: int) -> Iterator[list[bytes | None]]:
    """For each leaf in turn, its siblings from the lowest to the highest; the list is reused.

    Szydlo, "Merkle tree traversal in log space and time" (2004): a leaf gets 2 * height - 1 steps.
    """
    auth, stacks = [], [Treehash(leaf, h) for h in range(height)]
    for h, stack in enumerate(stacks):  # the two first nodes of each height
        for first, into in ((1 << h, auth), (0, None)):
            stack.begin(first)
            while not stack.done:
                stack.step()
            if into is not None:
                into.append(stack.node())
    for at in range(len(leaf)):
        yield auth
        for h, stack in enumerate(stacks):
            if (at + 1) % (1 << h):
                break
            auth[h] = stack.node()
            stack.begin((at + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * height - 1):
            stack = min(stacks, key=Treehash.low)
            if stack.done:
                break
            stack.step()


def steps(at: int, siblings: Sequence[bytes | None]) -> bytes:
    """A path as bytes, for the leaf at place ``at`` of its block."""
    return b"".join(
        bytes([ALONE]) if node is None else bytes([LEFT if at >> h & 1 else RIGHT]) + bytes.fromhex(node.decode()) for h, node in enumerate(siblings)
    )


def siblings_of(path: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(path):
        side = path[at]
        yield side, b"" if side == ALONE else hexlify(path[at + 1 : at + 33])
        at += 1 if side == ALONE else 33


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give, in hexadecimal."""
    node = leaf
    for side, other in siblings_of(path):
        node = sha256(other + node if side == LEFT else node + other).hexdigest().encode()
    return node


def path_digest(path: bytes) -> bytes:
    return sha256(b"".join(other for _, other in siblings_of(path))).hexdigest().encode()


# Levels of blocks


def _block_height(n: int, bits: int) -> int:
    return bits if n > 1 << bits else height(n)


def blocks_of(nodes: DataFrame, payload: Sequence[str], bits: int) -> DataFrame:
    """(tree, n, block, members, root), stored, from (tree, n, pos, node, payload...): at most ``2 ** bits`` members each."""
    member = F.struct("pos", "node", *payload)
    grouped = nodes.groupBy("tree", "n", F.shiftright("pos", bits).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for n, members in zip(batch.column("n").to_pylist(), batch.column("members"), strict=True):
                leaf = [hexlify(x) for x in members.values.field("node").to_pylist()]
                roots.append(bytes.fromhex(block_root(leaf, _block_height(n, bits)).decode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])

    return stored(grouped.mapInArrow(run, T.StructType([*grouped.schema.fields, T.StructField("root", T.BinaryType())])), "blocks")


def levels_of(nodes: DataFrame, payload: Sequence[str], bits: int) -> list[DataFrame]:
    """Stored levels of blocks, the leaves' own first; the last has one block a tree."""
    out = [blocks_of(nodes, payload, bits)]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1 << bits:
        below = out[-1].select("tree", F.col("block").alias("pos"), (F.shiftright(F.col("n") - 1, bits) + 1).alias("n"), F.col("root").alias("node"))
        out.append(blocks_of(below, (), bits))
    return out


#: What is above a block: the path from its root, and the roots that it leads to.
ABOVE = ("path", "subroot", "top")


def _under(level: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what is above them."""
    same = F.col("b.tree").eqNullSafe(F.col("a.tree")) & (F.col("b.block") == F.col("a.pos"))
    return level.alias("b").join(broadcast_if_small(above, F.length("path") + 128).alias("a"), same).select("b.tree", "b.n", "b.block", "b.members", *(f"a.{c}" for c in ABOVE))


def _members(blocks: DataFrame, bits: int, payload: Sequence[str]) -> DataFrame:
    """(tree, pos, node, path, subroot, top, payload...) of every member, its path up to the top."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["members"].dataType.elementType.fields}
    schema = "tree string, pos long, node binary, path binary, subroot binary, top binary" + "".join(f", {c} {kinds[c]}" for c in payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                members, (tree, n, top_path, subroot, top) = batch.column("members")[row].values, (batch.column(c)[row].as_py() for c in ("tree", "n", *ABOVE))
                node = members.field("node")
                leaf = [hexlify(x) for x in node.to_pylist()]
                paths = [steps(at, auth) + top_path for at, auth in enumerate(traversal(leaf, _block_height(n, bits)))]
                columns = [pa.array([tree] * len(leaf), pa.string()), members.field("pos"), node, pa.array(paths, pa.binary())]
                columns += [pa.array([x] * len(leaf), pa.binary()) for x in (subroot, top)]
                yield pa.RecordBatch.from_arrays([*columns, *(members.field(c) for c in payload)], ["tree", "pos", "node", *ABOVE, *payload])

    return blocks.mapInArrow(run, schema)


def proofs(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, pos, doc_id, leaf, claim, path, subroot, top) of ``leaves``; digests are binary.

    ``path`` has a byte for each level, ALONE, LEFT or RIGHT, and after the latter two the
    sibling's 32 bytes; ``folded`` leads a leaf along it to ``top``, the root of the dataset.
    """
    hashed = stored(rows.withColumnRenamed("leaf", "node"), "leaves")
    nodes = placed(hashed, ["doc_id", "node"])
    levels = levels_of(nodes, ("doc_id", "claim"), bits)
    removed(hashed, *nodes.parts)
    roots = levels[-1].select(F.col("tree").alias("lang"), F.col("root").alias("node")).withColumn("tree", F.lit("all"))
    langs = placed(roots, ["lang"])
    upper = levels_of(langs, ("lang",), bits)
    removed(*langs.parts)
    above = upper[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("path"), F.col("root").alias("subroot"), F.col("root").alias("top"))
    above = stored(above, "above")
    done = []
    for level in reversed(upper):
        done += [above, level]
        above = stored(_members(_under(level, above), bits, ("lang",) if level is upper[0] else ()), "above")
    done.append(above)
    above = stored(above.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "top"), "above")
    for level in reversed(levels[1:]):
        done += [above, level]
        above = stored(_members(_under(level, above), bits, ()), "above")
    removed(*done)
    # The leaves' own blocks and the paths above them stay: the result is made from them.
    return _members(_under(levels[0], above), bits, ("doc_id", "claim")).withColumnRenamed("node", "leaf")


def verified(proved: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every claim, else leaf, led along its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, claim, path, top = (batch.column(c).to_pylist() for c in ("leaf", "claim", "path", "top"))
            got = [folded(hexlify(a if b is None else b), p) for a, b, p in zip(leaf, claim, path, strict=True)]
            right = [hexlify(t) == g for t, g in zip(top, got, strict=True)]
            texts = [pa.array([hexlify(x).decode() for x in batch.column(c).to_pylist()], pa.string()) for c in ("leaf", "subroot", "top")]
            digests = [pa.array([x.decode() for x in xs], pa.string()) for xs in ([path_digest(p) for p in path], got)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *texts, *digests, pa.array(right)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            )

    return proved.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 7 divides the id's crc32 the row under test has one character more than it says."""
    bounded_batches(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))
    forged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return verified(proofs(leaves(docs, F.when(forged, F.col("n_chars").cast("decimal(20,0)") + 1))))


SQL = """
WITH RECURSIVE encoded AS (
  SELECT doc_id, lang, n_chars, a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || z AS row_text,
    a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) END || z AS forged_text
  FROM (SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z FROM documents)
), crcs AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, ignored: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc FROM (SELECT DISTINCT doc_id FROM documents)
), leaf AS MATERIALIZED (
  SELECT e.doc_id, lang, sha256(row_text) AS leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(forged_text) ELSE sha256(row_text) END AS claim,
    row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY e.doc_id NULLS FIRST, sha256(row_text)) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM encoded e LEFT JOIN crcs c USING (doc_id)
), tree AS (
  SELECT lang, 0 AS h, pos, n, leaf AS node FROM leaf
  UNION ALL
  SELECT lang, h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, h, pos // 2, n
), subroots AS (
  SELECT lang, h AS top_h, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS h, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY h, pos // 2, n
), whole AS (
  SELECT t.lang, t.h, t.pos, t.node FROM tree t WHERE t.n > 1
  UNION ALL SELECT s.lang, s.top_h + u.h, u.pos, u.node FROM subroots s, upper_tree u WHERE u.n > 1
), walk AS (
  SELECT k, l.lang, 0 AS h, l.pos, claim AS node, '' AS proof, s.top_h, s.pos AS lang_pos FROM leaf l
    JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT k, w.lang, w.h + 1, w.at // 2, sha256(CASE WHEN w.at % 2 = 1 THEN coalesce(o.node, '') || w.node ELSE w.node || coalesce(o.node, '') END),
    proof || coalesce(o.node, ''), top_h, lang_pos
  FROM (SELECT *, CASE WHEN h = top_h THEN lang_pos ELSE pos END AS at FROM walk) w
  JOIN (SELECT DISTINCT lang, h FROM whole) more ON more.lang IS NOT DISTINCT FROM w.lang AND more.h = w.h
  LEFT JOIN whole o ON o.lang IS NOT DISTINCT FROM w.lang AND o.h = w.h AND o.pos = CASE WHEN w.at % 2 = 1 THEN w.at - 1 ELSE w.at + 1 END
), ends AS (SELECT k, arg_max(node, h) AS folded_root, arg_max(proof, h) AS proof FROM walk GROUP BY k)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM leaf l JOIN ends USING (k) JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang,
  (SELECT node FROM upper_tree WHERE n = 1) r
"""
