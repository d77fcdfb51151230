"""The hashing embedder over many texts at once, against its definition feature by feature."""

import hashlib
import re

import numpy as np

from granary.operators import embed


def plain(text, width):
    words = re.findall(r"\w+", (text or "").lower())
    out = np.zeros(width)
    for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
        out[h % width] += 1 if h & 0x80000000 else -1
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


def test_vectors_of_many_texts_are_those_of_each(monkeypatch):
    texts = ["", "   ", None, "one", "a b a b A", "Ünï çödé 日本 語", "x" * 5000, "word " * 300, *(f"n{k} word {k % 7} of {k % 3}" for k in range(50))]
    for width in (1, 64, 100):
        assert embed.HashingEmbedder(width)(texts) == [plain(t, width) for t in texts]
    assert embed.HashingEmbedder(8)([]) == [] and embed.HashingEmbedder(8).one("a b") == plain("a b", 8)
    hashed = []
    monkeypatch.setattr(hashlib, "md5", lambda b, md5=hashlib.md5: hashed.append(b) or md5(b))
    embed.HashingEmbedder(8)(["again seen"] * 100)
    assert hashed.count(b"seen") <= 1  # a word is hashed once a worker
