"""Embedding of texts through a pluggable model, and a deterministic offline model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.config import DEFAULT
from granary.shared import bounded_batches


class Embedder(Protocol):
    """Anything that turns a list of texts into as many vectors, in order; pickled to the tasks."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed feature hashing of words and word pairs into a unit vector; needs no network.

    A feature's hash is the first four bytes of its MD5, which SQL can compute as well.
    """

    def __init__(self, width: int = 256):
        self.width = width

    def __call__(self, texts: list[str]) -> list[list[float]]:
        found, sizes = [], []
        for t in texts:
            words = re.findall(r"\w+", (t or "").lower())
            n = len(found)
            found += map(_digest_of_word, words)
            found += [_digest(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)]
            sizes.append(len(found) - n)
        h = np.frombuffer(b"".join(found), ">u4")[::4].astype(np.int64)
        place = np.repeat(np.arange(len(texts)) * self.width, sizes) + h % self.width
        out = np.bincount(place, np.where(h & 0x80000000, 1.0, -1.0), len(texts) * self.width).reshape(-1, self.width)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    def one(self, text: str) -> list[float]:
        return self([text])[0]


def _digest(feature: str) -> bytes:
    return hashlib.md5(feature.encode()).digest()


#: Words come again and again, pairs of them less so.
_digest_of_word = lru_cache(1 << 16)(_digest)


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "text", batch: int = DEFAULT.embed_batch) -> DataFrame:
    """Add ``embedding``; the model gets at most ``batch`` texts a call and any error fails the task."""
    names = [c for c in rows.columns if c != "embedding"]
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for at in range(0, got.num_rows, batch):
                part = got.slice(at, batch)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                vectors = embedder(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(texts)} texts, {len(vectors)} vectors")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, "embedding"])

    kinds = rows.select(names).schema.add("embedding", T.ArrayType(T.FloatType()))
    return rows.select(names).mapInArrow(run, kinds)
