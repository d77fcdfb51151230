"""The Merkle manifest against the tree by its definition, for several block sizes, and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import merkle
from tests.llm.test_operators import SCHEMA


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return h(*map(enc, (doc_id, source, lang, n_chars, text)))


def up(nodes):
    return [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]


def path_of(nodes, at):
    """Siblings of a node with their sides, and the root, level by level."""
    out = []
    while len(nodes) > 1:
        other = at ^ 1
        out.append((other < at, nodes[other] if other < len(nodes) else None))
        nodes, at = up(nodes), at // 2
    return out, nodes[0]


def fold(node, path):
    for left, other in path:
        node = h(node) if other is None else h(other, node) if left else h(node, other)
    return node


def brute(rows):
    """Rows as the query has them."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    subroots = {x: path_of([leaf_of(r) for r in t], 0)[1] for x, t in trees.items()}
    out = []
    for at, lang in enumerate(langs):
        above, root = path_of([subroots[x] for x in langs], at)
        leaves = [leaf_of(r) for r in trees[lang]]
        for k, r in enumerate(trees[lang]):
            path = path_of(leaves, k)[0] + above
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            got = fold(leaf_of((*r[:4], r[4] + 1)) if bad else leaves[k], path)
            out.append((r[0], leaves[k], subroots[lang], root, h(*(o for _, o in path if o)), got, got == root))
    return sorted(out, key=str)


ODD = [
    (None, "no id", "en", "s", 5), (None, None, None, None, None), (3, "", "en", None, 0), (3, "", "en", None, 0), (3, "other", "en", "s", 5),
    (10, "é😀", "日本", "ü", 2), (11, "z" * 3_000_000, "zz", "s", 2**63 - 1), (-7, "below zero", "en", "-", 10), (13, "a:b-", "", "", None),
]


def rows_of(n):
    return [(k * 3 % 1009, f"text {k}", ("en", "de", None)[k % 7 // 3], f"s{k % 5}", k) for k in range(n)]


@pytest.mark.parametrize("bits", [2, 10])
def test_proofs_are_those_of_the_definition(spark, bits):
    rows = rows_of(75) + ODD
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("leaf", "tree", "pos", "n", "path", "_salt", "node")}).repartition(3)
    forged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proved = merkle.proofs(merkle.leaves(docs, F.when(forged, F.col("n_chars").cast("decimal(20,0)") + 1)), bits)
    got = sorted((tuple(r) for r in merkle.verified(proved).collect()), key=str)
    assert got == brute(rows) and not all(r[-1] for r in got)


def test_small_trees(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(merkle.proofs(merkle.leaves(empty))).count() == 0
    one = [(5, "only", "en", "s", 4)]
    got = merkle.verified(merkle.proofs(merkle.leaves(spark.createDataFrame(one, SCHEMA)))).first()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["proof_sha256"] == h("")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_traversal_keeps_few_nodes_and_finds_every_sibling(n):
    leaf = [h(str(k)).encode() for k in range(n)]
    height = merkle.height(n)
    most = 0
    for at, auth in enumerate(merkle.traversal(leaf, height)):
        want, root = path_of([x.decode() for x in leaf], at)
        assert [None if x is None else x.decode() for x in auth] == [o for _, o in want]
        path = merkle.steps(at, auth)
        assert merkle.folded(leaf[at], path).decode() == root == merkle.block_root(leaf, height).decode()
        most = max(most, len(auth))
    assert most == height


def test_traversal_stacks_stay_logarithmic():
    leaf = [h(str(k)).encode() for k in range(256)]
    seen, made = [], []
    begin = merkle.Treehash.begin
    try:
        merkle.Treehash.begin = lambda self, first: (made.append(self), begin(self, first))[1]
        for _ in merkle.traversal(leaf, 8):
            seen.append(sum(len(s.stack) for s in set(made)))
    finally:
        merkle.Treehash.begin = begin
    assert max(seen) <= 3 * 8
    assert merkle.path_digest(b"") == h("").encode()


def test_a_changed_row_is_found_by_a_kept_manifest(spark):
    rows = rows_of(40)
    proved = merkle.proofs(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), 2)
    later = spark.createDataFrame([(*r[:1], r[1] + "!", *r[2:]) if r[0] == 9 else r for r in rows], SCHEMA)
    now = merkle.leaves(later).select("doc_id", F.col("leaf").alias("claim"))
    checked = merkle.verified(proved.drop("claim").join(now, "doc_id"))
    assert [r["doc_id"] for r in checked.where("not verified").collect()] == [9]
