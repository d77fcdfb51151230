"""Phrases of two to four words that occur more often than their parts explain, by language.

The texts of a task are taken in shards of about ``SHARD`` words. Over each shard stands a
generalised suffix automaton of bounded depth, in arrays: a state is a different sequence of words,
reached from the state of all but its last word; its suffix link leads to the state without its
first word; its endpos count says how often it ends anywhere in the shard's pieces. All pieces of
all languages share it, each language from a root of its own.

Phrases are counted length by length, in one pass over the texts each. A shard enumerates its
states of that depth whose two parts, the state before and the suffix link, can be frequent: a
Bloom filter of the frequent phrases one word shorter says so. The filter has a bounded size; a
false positive only costs a row, since counts are exact. The counts of all shards are summed by
phrase, partially in the tasks, and the frequent ones stored. So what is shuffled is one row a
shard and possibly frequent phrase, however often a phrase occurs.

Scores look up the counts of both parts of each cut. A phrase falls to a longer one along suffix
links (a word more on the left) and prefixes (a word more on the right): counts fall with length,
so if any longer phrase subsumes it, one that is a word longer does.

Defined results for odd input:

* null and empty texts have no words. Null lang: ``und``, together with any such language.
* very long texts are cut into segments at word ends and run over shards, with the last words
  carried along; no occurrence is lost or counted twice. A word of any length is one word.
* repeated rows count each. Ties: in the cuts the shortest first part, in the report the smaller
  phrase in byte order. Empty table, or no frequent phrase: no rows.
* further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.hashing import mix, text_slices
from granary.llm.shared import bounded_batches, broadcast_if_small, removed, spread, stored

MOST_WORDS = 4
LEAST = 30
TOP = 2000
SHARD = 1 << 20  # words of an automaton
FILTER_BITS = 28  # a filter has at most 2 ** FILTER_BITS bits, 32 MB
COUNTS = "lang string, phrase string, n long"

#: Classes of bytes: of words, between words, between pieces.
WORD, SPACE, BREAK = 0, 1, 2


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[0x20, 0x09]] = SPACE
    out[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = BREAK
    return out


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# Words of texts


class Words:
    """Words one after the other: their bytes, lengths, language, and whether a piece begins with them."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, lang: np.ndarray, begins: np.ndarray):
        self.data, self.lengths, self.lang, self.begins = data, lengths, lang, begins

    def __len__(self) -> int:
        return len(self.lengths)

    def __getitem__(self, places: slice) -> Words:
        ends = np.concatenate([[0], np.cumsum(self.lengths)])
        a, b, _ = places.indices(len(self))
        return Words(self.data[ends[a] : ends[b]], self.lengths[a:b], self.lang[a:b], self.begins[a:b])

    @staticmethod
    def joined(parts: list[Words]) -> Words:
        return Words(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("data", "lengths", "lang", "begins")))


def words_of(buf: np.ndarray, bounds: np.ndarray, lang: np.ndarray, inside: bool = False) -> Words:
    """Words of the texts between bounds; ``inside``: the first text goes on from an earlier segment's last word."""
    buf, bounds = buf[bounds[0] : bounds[-1]], bounds - bounds[0]
    kind = CLASSES[buf]
    word = kind == WORD
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    text = np.searchsorted(bounds, s, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(kind == BREAK, dtype=np.int64)])
    begins = np.ones(len(s), bool)
    begins[1:] = (text[1:] != text[:-1]) | (breaks[s[1:]] != breaks[e[:-1]])
    if inside and len(s) and text[0] == 0:
        begins[0] = breaks[s[0]] > 0
    return Words(LOWER[buf[word]], e - s, lang[text], begins)


def segments(texts: pa.Array, langs: np.ndarray, limit: int = 2 << 20) -> Iterator[Words]:
    """Words of a batch in parts of about ``limit`` bytes; a longer text is cut behind a space or a break."""
    for first, end, buf, bounds in text_slices(texts, limit):
        if end - first > 1 or bounds[-1] - bounds[0] <= 2 * limit:
            yield words_of(buf, bounds, langs[first:end])
            continue
        at, stop, inside, held = int(bounds[0]), int(bounds[-1]), False, False
        while at < stop:
            upto = min(stop, at + limit)
            while upto < stop:
                back = np.flatnonzero(CLASSES[buf[at:upto]] != WORD)
                if len(back):
                    upto = at + int(back[-1]) + 1
                    break
                upto = min(stop, upto + limit)
            found = words_of(buf, np.array([at, upto]), langs[first:end], inside)
            if held and len(found):
                found.begins[0] = True
            # A break behind the last word, or among segments without any, still ends its piece.
            last = np.flatnonzero(CLASSES[buf[at:upto]] == WORD)
            tail = CLASSES[buf[at + (int(last[-1]) if len(last) else 0) : upto]]
            held = bool((tail == BREAK).any()) or held and not len(found)
            inside, at = True, upto
            yield found


def shards(parts: Iterator[Words], size: int, keep: int) -> Iterator[tuple[Words, int]]:
    """(words, number of words, ``keep`` at most, carried over from the shard before, not to be counted again)."""
    held, n, carried = [], 0, 0
    for part in parts:
        at = 0
        while at < len(part):
            take = part[at : at + size - n + carried]
            held.append(take)
            n, at = n + len(take), at + len(take)
            if n - carried >= size:
                whole = Words.joined(held)
                yield whole, carried
                held = [whole[max(0, len(whole) - keep) :]]
                n = carried = len(held[0])
    if n > carried:
        yield Words.joined(held), carried


# The automaton of a shard


class Automaton:
    """States of depth 1 to ``depth`` over a shard.

    ``at[d]`` is the state of depth d that ends at each place (-1: none), ``last[d]`` a place where
    a state ends, ``count[d]`` its endpos count over the places from ``carried`` on. A state is
    made from its prefix and last word, so equal sequences are one state, whatever their hashes.
    """

    def __init__(self, words: Words, carried: int, depth: int):
        offsets = np.concatenate([[0], np.cumsum(words.lengths)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(words.data))]).dictionary_encode()
        self.words, self.carried = words, carried
        self.texts, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.at, self.last, self.count = {}, {}, {}
        self._add(1, words.lang * len(self.texts) + self.code, np.ones(len(words), bool))
        for d in range(2, depth + 1):
            self.deepen(d, np.ones(len(words), bool))

    def _add(self, d: int, key: np.ndarray, there: np.ndarray) -> None:
        places = np.flatnonzero(there)
        _, first, state = np.unique(key[places], return_index=True, return_inverse=True)
        self.at[d] = np.full(len(key), -1, np.int64)
        self.at[d][places] = state
        self.last[d] = places[first]
        self.count[d] = np.bincount(state[places >= self.carried], minlength=len(first))

    def deepen(self, d: int, wanted: np.ndarray) -> None:
        """States of depth d that end at wanted places, from those of depth d - 1."""
        before = np.concatenate([[-1], self.at[d - 1][:-1]])
        there = wanted & (before >= 0) & (self.at[d - 1] >= 0) & ~self.words.begins
        self._add(d, before * (len(self.last[1]) + 1) + self.at[1], there)

    def link(self, d: int) -> np.ndarray:
        """Of each state of depth d the state of depth d - 1 without its first word."""
        return self.at[d - 1][self.last[d]]

    def before(self, d: int) -> np.ndarray:
        """Of each state of depth d the state of depth d - 1 without its last word."""
        return self.at[d - 1][self.last[d] - 1]

    def longest(self, d: int) -> np.ndarray:
        """Whether a state is the longest of its class: no state a word longer ends at just the same places."""
        out = np.ones(len(self.last[d]), bool)
        if d + 1 in self.last:
            link = self.link(d + 1)
            out[link[self.count[d + 1] == self.count[d][link]]] = False
        return out

    def word_hashes(self) -> np.ndarray:
        """A hash of each different word."""
        if "hash" not in self.__dict__:
            self.hash = hashes(self.texts)
        return self.hash

    def phrases(self, d: int, states: np.ndarray) -> pa.Array:
        """The words of states, joined by spaces."""
        words = self.texts.view(pa.large_string())
        return pc.binary_join_element_wise(*(words.take(pa.array(self.code[self.last[d][states] - k])) for k in reversed(range(d))), pa.scalar(" ", pa.large_string()))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of whole byte strings: sums of scrambled bytes times powers."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    length = np.diff(bounds)
    place = np.arange(len(buf)) - np.repeat(bounds[:-1], length)
    value = mix((buf.astype(np.uint64) + np.uint64(1)) * mix(place.astype(np.uint64) + np.uint64(0x51)))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + length.astype(np.uint64))


def phrase_hashes(parts: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """From the hashes of the first, second ... words of phrases, and of their language."""
    return reduce(lambda whole, word: mix(whole * np.uint64(0x9E3779B97F4A7C15) + word), parts, lang)


# A filter of bounded size


class Filter:
    """Of a set of phrases: says yes to each of them, and seldom to another."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, data

    def has(self, h: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.data, np.uint64)
        out = np.ones(len(h), bool)
        for at in _filter_places(h, self.bits):
            out &= (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _filter_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(h + np.uint64(k)) >> np.uint64(64 - bits) for k in (1, 2)]


def filter_of(found: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """Of stored counts. Tasks hash their phrases; the words of the filter are or-ed by a shuffle, so the driver gets each once."""
    n = found.count()
    bits = min(most_bits, max(10, (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(at, 1 << 16)
                parts = pc.split_pattern(part.column(1).cast(pa.large_binary()), b" ")
                words, ends = hashes(parts.flatten()), np.cumsum(pc.list_value_length(parts).to_numpy())
                size = ends[0] if len(ends) else 0  # all phrases are of one length
                h = phrase_hashes([words[k::size] for k in range(size)], hashes(part.column(0)))
                places = np.concatenate(_filter_places(h, bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["at", "bit"]
                )

    rows = found.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    table[rows["at"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return Filter(bits, table.tobytes())


# Counts


def _counted(depth: int, size: int, shared):
    """Tasks: the states of one depth of every shard that can be frequent, and at depth 1 the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        number: dict[str, int] = {}

        def parts() -> Iterator[Words]:
            for batch in batches:
                langs = batch.column(0).dictionary_encode()
                for name in langs.dictionary.to_pylist():
                    if name not in number:
                        number[name] = len(names)
                        names.append(name)
                code = np.array([number[x] for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()] if len(langs) else np.zeros(0, np.int64)
                yield from segments(batch.column(1), code)

        def rows(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([lang[at : at + (1 << 16)].cast(pa.string()), phrase[at : at + (1 << 16)].cast(pa.string()), pa.array(n[at : at + (1 << 16)], pa.int64())], ["lang", "phrase", "n"])

        for words, carried in shards(parts(), size, depth - 1):
            own = Automaton(words, carried, 1)
            lang_of = pa.array(names)
            for d in range(2, depth + 1):
                ends = own.last[d - 1]
                h = phrase_hashes([own.word_hashes()[own.code[ends - k]] for k in reversed(range(d - 1))], hashes(lang_of)[words.lang[ends]])
                known = np.append(shared.value[d - 2].has(h), False)[own.at[d - 1]]
                own.deepen(d, known & np.concatenate([[False], known[:-1]]))
            counted = np.flatnonzero(own.count[depth])
            yield from rows(lang_of.take(pa.array(words.lang[own.last[depth][counted]])), own.phrases(depth, counted), own.count[depth][counted])
            if depth == 1:
                total = np.bincount(words.lang[carried:], minlength=len(names))
                yield from rows(lang_of, pa.nulls(len(names), pa.string()), total)

    return run


def frequent(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, size: int = SHARD, filter_bits: int = FILTER_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Stored counts (lang, phrase, n) of the phrases of 1, 2, ... words that occur often enough; and (lang, n) of all words."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    found, filters, shared = [], [], None
    for depth in range(1, most_words + 1):
        counts = texts.mapInArrow(_counted(depth, size, shared), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        kept = stored(counts.where((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases-{depth}")
        if depth == 1:
            totals, kept_words = kept.where("phrase is null").select("lang", "n"), kept.where("phrase is not null")
            kept_words.stored_at = kept.stored_at
            kept = kept_words
        found.append(kept)
        if depth < most_words:
            filters.append(filter_of(kept, filter_bits))
            if shared is not None:
                shared.unpersist()
            shared = spark.sparkContext.broadcast(filters)
    if shared is not None:
        shared.unpersist()
    return found, totals


# Scores, subsumption, report


def scored(found: list[DataFrame], numerator: int = 2_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words or more, by its cut of the lowest score.

    Either side of a cut is as frequent as the whole at least, so its count is among the found ones.
    """
    words = F.split("phrase", " ")
    size = F.size(words)
    cuts = reduce(DataFrame.unionByName, found[1:]).select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), words.alias("words"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"),
    )
    parts = broadcast_if_small(reduce(DataFrame.unionByName, found), F.octet_length("phrase") + 48)
    both = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]
    )
    score = F.expr(f"cast(a AS decimal(19,0)) * {numerator} div (cast(l AS decimal(19,0)) + r)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "phrase", "a").agg(least.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def subsumed(found: list[DataFrame], percent: int = 80) -> DataFrame:
    """(lang, phrase) of the phrases that a phrase one word longer, to the left or the right, has nearly all occurrences of."""
    words = F.split("phrase", " ")
    longer = reduce(DataFrame.unionByName, found[2:])
    link, before = F.slice(words, 2, F.size(words)), F.slice(words, 1, F.size(words) - 1)
    most = longer.select("lang", F.explode(F.array(F.array_join(link, " "), F.array_join(before, " "))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("over"))
    both = reduce(DataFrame.unionByName, found[1:-1]).join(most, ["lang", "phrase"])
    return both.where(F.col("over").cast("decimal(19,0)") * 100 >= F.col("n").cast("decimal(19,0)") * percent).select("lang", "phrase")


def collocations(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, percent: int = 80, size: int = SHARD, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of (lang, text), at most ``top``; stored."""
    if most_words < 3:
        raise ValueError("phrases have up to three words at least")
    bounded_batches(docs.sparkSession)
    found, totals = frequent(docs, most_words, least, size, filter_bits)
    left = scored(found).join(subsumed(found, percent), ["lang", "phrase"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(broadcast_if_small(totals, 64), "lang")
    out = stored(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    removed(*found)
    return out


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language over all documents."""
    return collocations(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")))


SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words
), counts AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS n
  FROM starts, (VALUES (1), (2), (3), (4)) AS s(size) WHERE i + size - 1 <= len(w) GROUP BY ALL
), totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), often AS (SELECT * FROM counts WHERE n >= 30
), cuts AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(generate_series(1, size - 1)) AS k FROM often WHERE size > 1
), scores AS (
  SELECT c.lang, c.size, c.phrase, a, k, l.n AS l, r.n AS r, (2000000::HUGEINT * a // (l.n + r.n))::BIGINT AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
), lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, n, array_to_string(w[i : i + len - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, size - len + 1)) AS i FROM (SELECT lang, n, size, w, unnest(generate_series(2, size - 1)) AS len
    FROM (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE size > 2)))
), dropped AS (SELECT DISTINCT o.lang, o.phrase FROM often o JOIN parts p ON p.lang = o.lang AND p.phrase = o.phrase WHERE 100 * p.n >= 80 * o.n
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest ANTI JOIN dropped USING (lang, phrase) JOIN totals USING (lang) QUALIFY rank <= 2000
"""
