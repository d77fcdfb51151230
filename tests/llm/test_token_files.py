"""Token files: ids against the tokenizer, every lookup against the plain array, documents over shards, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import wavelet
from granary.llm.hashing import text_slices
from granary.llm.shared import new_folder
from tests.llm.test_operators import SCHEMA, prose

PLAIN = Tokenizer.from_file(wavelet.TOKENIZER)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def encoded(texts, limit=wavelet.SLICE):
    out = []
    for _, _, buf, bounds in text_slices(pa.array(texts, pa.string()), limit):
        ids, counts = wavelet.encode(buf, bounds, limit=limit)
        ends = np.cumsum(counts)
        out += [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
    return out


TRICKY = [
    "", None, "a", " ", "  two  spaces ", "it's we'll !'s 'tis d'accord", "tab\tnew\n\nline \r\n x", "é à ñ ß  ü x y　z", "abc123def_456--7", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>'s",
    "<|endoftext", "日本語 テキスト", "\x1c\x1d a\x7fb", "😀😀 x😀'll", "x" * 5000, "Ā ā߿ z", "a\u0085b   c",
]


def test_ids_are_those_of_the_tokenizer():
    rng = np.random.default_rng(3)
    texts = [*TRICKY, prose(rng, 3000), "end"]
    assert encoded(texts) == [ids_of(t) for t in texts]
    long = prose(rng, 8000) + " <|endoftext|> it's" + "y" * 3000 + " é fin"
    assert encoded([long], limit=4096) == [ids_of(long)] == encoded([long])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab's 1.<|>endoftxt\n\té  ñ😀"), max_size=40), max_size=5))
def test_ids_of_any_text(texts):
    assert encoded(texts) == [ids_of(t) for t in texts]


@pytest.mark.parametrize("n,most", [(1, 1), (1, 70_000), (7, 3), (40_000, 50_257), (70_000, 5), (33_000, 1 << 20)])
def test_every_lookup_agrees_with_the_array(n, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(3 / most, n), most).astype(np.uint32) if most > 3 else rng.integers(0, most, n).astype(np.uint32)
    file = wavelet.TokenFile(wavelet.write_file(ids, [5, None], [1, n - 1] if n > 1 else [1, 0]))
    assert len(file) == n and file.decode().tolist() == ids.tolist()
    for at in {0, n - 1, *rng.integers(0, n, 60).tolist()}:
        token = int(ids[at])
        assert file.access(at) == token
        k = file.rank(token, at)
        assert k == int((ids[:at] == token).sum()) and file.select(token, k) == at
    for token in {0, int(ids[0]), most, most + 1, 1 << 22}:
        places = np.flatnonzero(ids == token)
        assert file.occurrences(token).tolist() == places.tolist() and file.count(token) == len(places)
        assert file.count(token, n // 3, n // 2) == int((ids[n // 3 : n // 2] == token).sum())
        with pytest.raises(IndexError):
            file.select(token, len(places))
    with pytest.raises(IndexError):
        file.access(n)


def test_a_file_is_smaller_than_its_ids_and_opens_only_what_it_needs():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 400_000), 50_000).astype(np.uint32)
    data = wavelet.write_file(ids, [1], [len(ids)])
    assert len(data) < 1.4 * len(ids)
    file = wavelet.TokenFile(data)
    file.access(200_000)
    assert len(file.seen) <= 2 * len(file.planes)
    with pytest.raises(ValueError):
        wavelet.TokenFile(b"none" + data)


def plain(rows):
    """Rows of the query, in order; of equal ids in any order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*ids_of(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(store):
    got = store.documents().select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc")).collect()
    return sorted((tuple(r) for r in got), key=lambda r: r[1])


@pytest.mark.parametrize("shard", [1, 500, 1 << 20])
def test_documents_come_back_from_the_files(spark, shard):
    rng = np.random.default_rng(9)
    texts = [*TRICKY, *(prose(rng, int(n)) for n in rng.integers(0, 300, 40))]
    rows = [(k * 7 % 101, t, "en", "s", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("ids", "start", "part", "seq", "_hash", "_salt", "file")})
    store = wavelet.TokenStore(spark, new_folder(spark, "files")).write(docs, shard=shard)
    want = plain([(r[0], r[1]) for r in sorted(rows)])
    assert read(store) == want
    files = store.shards().count()
    assert files >= len(rows) if shard == 1 else files >= 1
    flat = np.concatenate([[*ids_of(r[1]), 0] for r in sorted(rows)])
    tokens = [0, int(flat[3]), 50256, 49_999]
    found = {t: sorted(r["place"] for r in store.occurrences(tokens).where(F.col("token") == t).collect()) for t in tokens}
    assert found == {t: np.flatnonzero(flat == t).tolist() for t in tokens}
    assert {r["token"]: r["n"] for r in store.counts(tokens).collect()} == {t: len(found[t]) for t in tokens}
    asked = [0, 5, 5, len(flat) - 1, len(flat), len(flat) // 2]
    got = sorted((r["place"], r["token"]) for r in store.tokens_at(spark.createDataFrame([(x,) for x in asked], "place long")).collect())
    assert got == [(x, int(flat[x])) for x in sorted(set(asked)) if x < len(flat)]


def test_odd_rows_are_all_written(spark):
    rows = [(None, "no id", "en", "s", 1), (None, None, None, None, None), (3, "same", "en", "s", 4), (3, "same", "en", "s", 4), (3, "other text", "en", "s", 1), (-5, "y " * 1_500_000, "en", "s", 1)]
    got = read(wavelet.TokenStore(spark, new_folder(spark, "odd-files")).write(spark.createDataFrame(rows, SCHEMA)))
    assert [r[0] for r in got] == [None, None, -5, 3, 3, 3] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in plain([(r[0], r[1]) for r in rows]))
    assert wavelet.TokenStore(spark, new_folder(spark, "no-files")).write(spark.createDataFrame([], SCHEMA)).documents().count() == 0


def test_query_is_the_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in wavelet.op12_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == plain(rows)
