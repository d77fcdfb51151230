"""Phrases against a plain count over all texts, for several shard and filter sizes; the automaton against all substrings."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import collocations as co
from tests.llm.test_operators import LOW, SCHEMA

PIECES, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def pieces(text):
    return [w for p in PIECES.split((text or "").translate(LOW)) if (w := WORDS.findall(p))]


def counted(rows, most=4):
    out = {}
    for lang, text in rows:
        own = out.setdefault(lang or "und", Counter())
        for w in pieces(text):
            for size in range(1, most + 1):
                own.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    return out


def brute(rows, least, top, percent=80):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = lambda p, q: any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= percent * a and inside(p, q) for q, c in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed, n, vocabulary=30):
    rng = np.random.default_rng(seed)
    names = ["über", "The", "x\x0by"[0], *(f"w{k}" for k in range(vocabulary))]
    marks = [" ", " ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!? "]
    out = []
    for _ in range(n):
        at = np.minimum(rng.geometric(0.12, int(rng.integers(0, 120))) - 1, len(names) - 1)
        out.append("".join(names[k] + marks[rng.integers(len(marks))] for k in at))
    return out


ODD = [(None, "Und lang  und LANG"), ("und", "und lang"), ("en", None), ("en", ""), ("en", " . \t,"), ("日", "日 本 日 本 日 本"), ("en", "same same same same same same")]


def rows_of(seed, n=120):
    return [(("en", "de", None)[k % 3], t) for k, t in enumerate(texts(seed, n))] + ODD


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("size,bits,least,top", [(1 << 20, 28, 5, 2000), (37, 6, 3, 2000), (5, 28, 2, 15)])
def test_phrases_are_those_of_the_plain_count(spark, size, bits, least, top):
    rows = rows_of(size)
    docs = spark.createDataFrame([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("phrase", "n", "a", "k", "left", "right", "words")})
    got = collected(co.collocations(docs, least=least, top=top, size=size, filter_bits=bits))
    assert got == brute(rows, least, top) and got
    assert {r[0] for r in got} >= {"en", "de", "und"}


def test_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, "too few words", "en", "s", 1)], SCHEMA)).count() == 0


def test_counts_that_pass_64_bits_are_exact(spark):
    n = 9_000_000_000_000_000
    one = spark.createDataFrame([("en", "a", n), ("en", "b", n)], co.COUNTS)
    two = spark.createDataFrame([("en", "a b", n - 1)], co.COUNTS)
    row = co.scored([one, two]).first()
    assert row["score"] == 2_000_000 * (n - 1) // (2 * n) and row["a"] == n - 1


def words_of_texts(rows, limit=2 << 20):
    names = sorted({lang or "und" for lang, _ in rows})
    code = np.array([names.index(lang or "und") for lang, _ in rows])
    return list(co.segments(pa.array([t for _, t in rows], pa.string()), code, limit)), names


@pytest.mark.parametrize("limit,size", [(2 << 20, 1 << 20), (64, 7), (3, 1)])
def test_no_occurrence_is_lost_at_the_edges_of_segments_and_shards(limit, size):
    rows = rows_of(5, 20) + [("en", " ".join(texts(6, 30))), ("en", "a" * 500 + " " + "b" * 20 + ". c  .  d " * 30)]
    got: dict = {}
    for words, carried in co.shards(iter(words_of_texts(rows, limit)[0]), size, 3):
        own = co.Automaton(words, carried, 4)
        names = words_of_texts(rows)[1]
        for d in range(1, 5):
            states = np.flatnonzero(own.count[d])
            for p, c, lang in zip(own.phrases(d, states).to_pylist(), own.count[d][states].tolist(), own.words.lang[own.last[d][states]].tolist(), strict=True):
                got.setdefault(names[lang], Counter())[tuple(p.split(" "))] += c
    assert got == {k: v for k, v in counted(rows).items() if v}


def test_links_and_classes_of_the_automaton():
    rows = [("en", t) for t in texts(8, 25, 12)]
    (words,), _ = words_of_texts(rows)
    own = co.Automaton(words, 0, 4)
    f = counted(rows)["en"]
    ends: dict = {}
    at = 0
    for text in (t for _, t in rows):
        for w in pieces(text):
            for k in range(len(w)):
                for size in range(1, min(4, k + 1) + 1):
                    ends.setdefault(tuple(w[k - size + 1 : k + 1]), set()).add(at + k)
            at += len(w)
    name = {d: [tuple(p.split(" ")) for p in own.phrases(d, np.arange(len(own.last[d]))).to_pylist()] for d in range(1, 5)}
    for d in range(1, 5):
        assert len(set(name[d])) == len(name[d]) and {p: int(c) for p, c in zip(name[d], own.count[d], strict=True)} == {p: c for p, c in f.items() if len(p) == d}
        if d > 1:
            assert [name[d - 1][k] for k in own.link(d)] == [p[1:] for p in name[d]]
            assert [name[d - 1][k] for k in own.before(d)] == [p[:-1] for p in name[d]]
        longest = {p for p, keep in zip(name[d], own.longest(d), strict=True) if keep}
        assert longest == {p for p in name[d] if not any(len(q) == d + 1 and q[1:] == p and ends[q] == ends[p] for q in ends)}


def test_filter_keeps_every_phrase(spark):
    rng = np.random.default_rng(4)
    phrases = sorted({f"w{a} é{b}" for a, b in rng.integers(0, 300, (500, 2))})
    found = spark.createDataFrame([("en", p, 1) for p in phrases], co.COUNTS)
    for bits in (28, 8):
        kept = co.filter_of(found, bits)
        split = [p.split(" ") for p in phrases]
        ask = lambda lang, a, b: kept.has(co.phrase_hashes([co.hashes(pa.array([x.encode() for x in y])) for y in (a, b)], co.hashes(pa.array([lang.encode()] * len(a)))))  # noqa: E731, B023
        assert ask("en", [p[0] for p in split], [p[1] for p in split]).all() and len(kept.data) <= max(8, (1 << bits) // 8)
        if bits == 28:
            assert ask("de", [p[0] for p in split], [p[1] for p in split]).mean() < 0.1
