"""Cells of a bounded cost and an exact mode of the Jaccard join, ids of any size, and WARC files as they come."""

import gzip
import os
import time
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import jaccard_join, secret_scan, toxicity, warc
from granary.llm.shared import new_folder, shared_folder
from tests.llm.test_operators import SCHEMA, brute_components, brute_spans, frame, prose

# the Jaccard join


def family(n, jaccard, seed=1, size=300):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    keep = round(size * (2 * jaccard / (1 + jaccard)) ** 0.5)
    return [np.sort(np.concatenate([rng.choice(base, keep, replace=False), rng.integers(0, 1 << 63, size - keep, dtype=np.uint64)])) for _ in range(n)]


def links(sets):
    n = len(sets)
    return jaccard_join.cell_links(np.arange(n), np.zeros(n, np.int64), sets, pa.array([[]] * n, pa.list_(pa.int64())), 0.75)


def groups(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        a, b = find(root, a), find(root, b)
        root[max(a, b)] = min(a, b)
    return [find(root, k) for k in range(n)]


def find(root, k):
    while root[k] != k:
        k = root[k]
    return k


@pytest.mark.parametrize("jaccard,room", [(0.72, 1 << 23), (0.745, 1 << 23), (0.745, 2000), (0.76, 300)])
def test_postings_lose_no_link(monkeypatch, jaccard, room):
    monkeypatch.setattr(jaccard_join, "POSTINGS", room)
    sets = family(160, jaccard) + family(40, 0.7, 2) + [np.sort(np.random.default_rng(k).integers(0, 1 << 63, 50, dtype=np.uint64)) for k in range(9)]
    want = groups(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if jaccard_join.reaches(sets[a], sets[b], 0.75)])
    assert groups(len(sets), links(sets)) == want and len(sets) >= jaccard_join.FEW
    i, j = np.triu_indices(len(sets), 1)
    kept = jaccard_join.Postings(sets, room).may_link(i, j, 0.75)
    assert all(k for a, b, k in zip(i, j, kept, strict=True) if jaccard_join.reaches(sets[a], sets[b], 0.75))


def test_a_full_cell_of_unlinked_near_copies_is_quick():
    sets = family(2000, 0.667)
    began = time.monotonic()
    assert links(sets) == [] and time.monotonic() - began < 15  # 2 M pairs


def test_sure_routes_of_any_number():
    for routes, threshold in ((48, 0.75), (20, 0.5), (7, 0.9)):
        few = 0.0
        for want in range(routes + 1):
            few += comb(routes, want) * threshold**want * (1 - threshold) ** (routes - want)
            if few > jaccard_join.LOST:
                break
        assert jaccard_join.sure_routes(routes, threshold) == max(want, 1)
    assert 650 < jaccard_join.sure_routes(1100, 0.75) < 750 and jaccard_join.sure_routes(5, 1.0) == 5


@pytest.mark.parametrize("routes", [None, 48])
def test_exact_mode_and_what_is_left_behind(spark, routes):
    rng = np.random.default_rng(12)
    base = [prose(rng, 120) for _ in range(4)]
    texts = []
    for k in range(60):
        words = base[k % 4].split(" ")
        for at in rng.integers(0, len(words), k % 9):
            words[at] = f"z{k}{at}"
        texts.append(" ".join(words))
    texts += ["", None, "a b", texts[0]]
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = jaccard_join.jaccard_components(frame(spark, texts), routes=routes)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(texts)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"digest", "by-class"}


# toxicity


def test_toxicity_learns_from_ids_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 2
        doc_id = int(rng.integers(-(1 << 63), (1 << 63) - 1)) if k > 2 else [(1 << 63) - 1, -(1 << 63), 1 << 62][k]
        rows.append((doc_id, prose(rng, 40, 50) + (" vile scum rot" * 6 if toxic else ""), "en", "s", 1))
        labels.append((doc_id, toxic))
    rows += [(1 << 61, None, "en", "s", None), (5, "x " * 600_000, "en", "s", 1), (None, "vile scum", "en", "s", 1)]
    labels += [(1 << 61, 0), (5, 0), (None, 1), (7, None)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    right = [(got[d] >= toxicity.CUT) == bool(y) for d, y in labels[:400]]
    assert np.mean(right) > 0.95


# WARC


def test_pages_with_odd_tags():
    page = """<HTML data-lang="xx" lang='fr'><title data-x="a > b">T &amp; U</title><p title="a > b">one</p><a data-href="/no" href="/yes">two</a>
    <a href='q"x'>three</a><img alt=">" src=pic.png><script data-x=">" src="s.js">hidden</script><a name=x>four</a><A HREF = "/caps" href="/second">5</A>"""
    assert warc.plain_text(page) == "T & U\none\ntwo\nthree four5"
    found = warc.page_metadata(page, "http://h/d/")
    assert found["title"] == "T & U" and found["lang"] == "fr"
    assert [(x["tag"], x["url"]) for x in found["links"]] == [
        ("a", "http://h/yes"), ("a", 'http://h/d/q"x'), ("img", "http://h/d/pic.png"), ("script", "http://h/d/s.js"), ("a", "http://h/caps")
    ]
    assert warc.attributes(' A=1 b="x y" c disabled=\'\' a=2') == {"a": "1", "b": "x y", "c": "", "disabled": ""}
    began = time.monotonic()
    warc.plain_text('<a "' * 200_000), warc.page_metadata("<a href='" * 200_000, "")
    assert time.monotonic() - began < 20


def chunked(body, sizes):
    out, at = b"", 0
    for n in sizes:
        out += b"%x;ext=1\r\n" % len(body[at : at + n]) + body[at : at + n] + b"\r\n"
        at += n
    return out + b"0\r\nTrailer: x\r\n\r\n"


def test_chunked_bodies_and_headers_of_any_case(spark, tmp_path):
    page = "<p>Hello</p><p>wörld</p>".encode()
    assert warc.dechunked(chunked(page, [3, 9, 100])) == page and warc.dechunked(b"plain text") == b"plain text"
    assert warc.dechunked(b"5\r\nHello\r\n6\r\n wor") == b"Hello wor" and warc.dechunked(b"") == b""
    zipped = gzip.compress(page)
    bodies = [(b"", page), (b"Transfer-Encoding: chunked\r\n", chunked(page, [3, 9, 100])), (b"transfer-encoding: Chunked\r\nContent-Encoding: gzip\r\n", chunked(zipped, [10, 1000]))]
    data = b""
    for k, (more, body) in enumerate(bodies):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + more + b"\r\n" + body
        head = [("warc-type", "Response"), ("WARC-RECORD-ID", f"<urn:uuid:{k}>"), ("warc-target-uri", "http://h/")] if k else [("WARC-Type", "response"), ("WARC-Target-URI", "http://h/")]
        data += warc.serialised(head, block)
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = warc.derivatives(warc.read_responses(spark, str(tmp_path))).where("record_type = 'conversion'").collect()
    assert [bytes(r["block"]).decode() for r in rows] == ["Hello\nwörld"] * 3
    assert {r["payload_digest"] for r in rows} == {warc.digest(b) for _, b in bodies} and {r["target_uri"] for r in rows} == {"http://h/"}
    assert len({r["refers_to"] for r in rows}) == 3 and all(r["refers_to"].startswith("<urn:uuid:") for r in rows)


# secrets


def test_texts_of_very_many_spans(spark):
    rng = np.random.default_rng(6)
    parts = []
    for k in range(16_000):
        parts += [["é ", "😀", "x y "][int(rng.integers(3))], [f"token={k:08d}abc", "token=short", f"AKIA{k:016d}", "f" * 40, f"secret: {'ab12' * 9}"][k % 5], " "]
    texts = ["".join(parts), "".join(parts[:1500]), "nothing", "token=12345678" * 130]
    docs = frame(spark, texts)
    began = time.monotonic()
    got = secret_scan.scan(docs.withColumn("path", F.col("doc_id")), new_folder(spark, "many-spans"), rules=secret_scan.BASE_RULES, path_cols=("path",))
    found = {r["path"]: r for r in got.select("path", secret_scan.spans_string(F.col("spans")).alias("s"), "spans").collect()}
    assert {k: r["s"] for k, r in found.items()} == {k: brute_spans(t) for k, t in enumerate(texts)}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs).collect()}
    assert time.monotonic() - began < 90
    for k, text in enumerate(texts):
        out, at = [], 0
        spans = sorted((s["start"], s["ord"], s["kind"], s["end"]) for s in found[k]["spans"])
        if k != 2:
            for start, _, kind, end in spans:
                out += [] if start < at else [text[at:start], f"[{kind}]"]
                at = max(at, end)
        assert clean[k] == "".join(out) + text[at:]
