"""Texts of small PDF files made here, plain and compressed, and through the folder scan."""

import zlib

import pytest

from granary.functions import pdf
from granary.sources import files

CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00e90021> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"


def stream(body, packed, more=b""):
    data = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n" % (len(data), b"/Filter /FlateDecode" if packed else b"", more) + data + b"\nendstream"


def made(contents, packed=False, in_stream=False):
    """A file of one page for each content, their tree and fonts in an object stream if asked for."""
    n = len(contents)
    kids = b" ".join(b"%d 0 R" % (10 + k) for k in range(n))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % n, 3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /ToUnicode 5 0 R >>"}
    for k in range(n):
        plain[10 + k] = b"<< /Type /Page /Parent 2 0 R /Contents " + (b"[ %d 0 R ]" % (50 + k) if k % 2 else b"%d 0 R" % (50 + k)) + b" >>"
    objects = {5: stream(CMAP, packed), 7: rb"<< /Title (A \(small\) file) /Author <FEFF00E9> >>", **{50 + k: stream(c, packed) for k, c in enumerate(contents)}}
    if in_stream:
        heads, bodies = b"", b""
        for number, body in plain.items():
            heads += b"%d %d " % (number, len(bodies))
            bodies += body + b"\n"
        objects[90] = stream(heads + bodies, packed, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(heads)))
    else:
        objects |= plain
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in sorted(objects.items())) + b"trailer << /Root 1 0 R /Info 7 0 R >>\n%%EOF"


CONTENTS = [
    rb"BT /F1 12 Tf 72 700 Td (Hello \(nested (pair)\) w\366rld) Tj 0 -14 Td [(Ne) -20 (xt) -300 (line\\)] TJ ET BT 1 0 0 1 0 0 Tm <41 42 4> Tj T* (x) ' ET",
    b"q BT /F2 9 Tf 0 0 Td <00010002> Tj <001000110012> Tj ET Q",
    b"0 0 m 100 100 l S",
]
WANT = ["Hello (nested (pair)) wörld\nNext line\\\nAB@\nx", "Hé!abc", ""]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("in_stream", [False, True])
def test_pages(packed, in_stream):
    got = pdf.pages(made(CONTENTS, packed, in_stream))
    assert [t for t, _ in got] == WANT
    assert got[1][1] == {"title": "A (small) file", "author": "é", "page": 1, "total_pages": 3}


def test_files_that_are_odd():
    with pytest.raises(ValueError):
        pdf.pages(b"plain text")
    assert pdf.pages(b"%PDF-1.4\n%%EOF") == []
    cut = made(CONTENTS, True)
    assert isinstance(pdf.pages(cut[: len(cut) // 2]), list)


def test_a_folder_of_pdf_files(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(made(CONTENTS, True))
    (tmp_path / "a.txt").write_text("text")
    got = files.scan_folder(spark, str(tmp_path), pdf.pages).orderBy("ordinal").collect()
    assert [(r["source"], r["text"], r["metadata"].get("page")) for r in got] == [("a.txt", "text", None), *(("b.pdf", t, str(k)) for k, t in enumerate(WANT))]
