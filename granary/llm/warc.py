"""WARC derivatives: metadata and plain-text conversion records for archived responses.

Every response becomes two records that point back to it. The ``metadata`` record lists the
page's title, language and outgoing links; the ``conversion`` record holds its visible text.
Both name the response in WARC-Refers-To, and keep its target URI, date, payload and block
digests, its HTTP status and headers and the other headers of its record, line by line, in
``WARC-Source-*`` headers of their own. Digests of the source are taken over as they stand; only
where it brings none is one computed, over the payload's bytes as archived. Record ids are
derived from the response's id, so a repeated run, or a task run again after a lost executor,
gives the same records. Each record is one gzip member, so written files can be cut at any
record.

Defined results for odd input:

* null or empty payload: both records, with empty text and no links.
* null url: an empty target URI; relative links stay as they are. Line ends and other control
  characters in a header's value are written as percent escapes, so they end no header.
* unclosed tags, comments and scripts run to the end of the page; a ``<`` that begins no tag is
  text. Characters without a name keep their entity. Unknown charsets are read as UTF-8; bytes
  that do not decode, or a damaged encoding, are replaced in the text, never in a digest.
* header names count in any case; a response without an id gets one from its block. A body with
  chunked transfer coding is put together for the text; digests are those of the archived bytes.
* repeated rows and ties: each row gives its two records; equal rows give equal records.
* very long pages are converted whole. Empty table: empty result. Other columns of the input,
  whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.shared import bounded_batches, spread

#: Record ids are UUIDs of version 5 in this name space.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:granary:warc")
DATE = "1970-01-01T00:00:00Z"  # of responses that do not bring one
RECORD = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, "
    "source_block_digest string, block_digest string, content_type string, content_length long, n_links int, block binary, record binary"
)

_INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""  # of a tag: quoted values may hold any character
_HIDDEN = re.compile(rf"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b{_INSIDE}>.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAK = re.compile(rf"<\s*/?\s*(?:p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|section|article|header|footer|nav|title|blockquote|pre)\b{_INSIDE}>", re.I)
_TAG = re.compile(rf"<[A-Za-z/!?]{_INSIDE}>|<[A-Za-z/!?][^>]*(?:>|$)")
_TITLE = re.compile(rf"<title\b{_INSIDE}>(.*?)(?:</title\s*>|$)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_OPENING = re.compile(rf"<(html|a|link|img|script|iframe|area)\b({_INSIDE})>", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """Visible text: block elements end lines, runs of white space are one space, empty lines go."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def page_metadata(page: str, url: str) -> dict:
    """Title, language and links (tag, resolved address), in page order."""
    opening = lambda m: _OPENING.match(m[0])
    seen = _HIDDEN.sub(lambda m: tag[0] if (tag := opening(m)) and tag[1].lower() == "script" and "src" in attributes(tag[2]) else " ", page)
    title, lang, links = _TITLE.search(page), None, []
    for tag, inside in (m.groups() for m in _OPENING.finditer(seen)):
        values = attributes(inside)
        if tag.lower() == "html":
            found = re.match(r"[A-Za-z-]+", values.get("lang", ""))
            lang = lang or (found[0] if found else None)
            continue
        address = values.get("href", values.get("src"))
        if address is None:
            continue
        raw = html.unescape(address).strip()
        try:
            links.append({"tag": tag.lower(), "url": urljoin(url, raw) if url else raw})
        except ValueError:  # an address that is none
            links.append({"tag": tag.lower(), "url": raw})
    return {"title": " ".join(html.unescape(_TAG.sub("", title[1])).split()) if title else None, "lang": lang, "links": links}


def attributes(inside: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; of equal names the first counts, one without a value is empty."""
    out: dict[str, str] = {}
    for name, *values in (m.groups() for m in _ATTRIBUTE.finditer(inside)):
        out.setdefault(name.lower(), next((v for v in values if v is not None), ""))
    return out


def header_value(value: str) -> str:
    """A value on one line: control characters as percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def serialised(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {header_value(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def _unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, or of a plain one, piece by piece."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + step]) for k in range(0, len(data), step))
        return
    member, rest, at = zlib.decompressobj(31), b"", 0
    while rest or at < len(data):
        if not rest:
            rest, at = bytes(view[at : at + step]), at + step
        piece = member.decompress(rest, step)
        if piece:
            yield piece
        rest = member.unused_data if member.eof else member.unconsumed_tail
        if member.eof:
            member = zlib.decompressobj(31)


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers in their order, block) of the records of a WARC file; one record is unpacked at a time."""
    pieces, held = _unpacked(data), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        end = held.find(b"\r\n\r\n")
        while end < 0 and more():
            end = held.find(b"\r\n\r\n")
        if end < 0:
            if held.strip():
                raise ValueError("a WARC record without the end of its headers")
            return
        if held[:2] == b"\r\n":
            continue
        _, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
        size = int(dict((k.lower(), v) for k, v in headers)["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("a WARC record is cut off")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield headers, block


class Named(dict):
    """Headers by name, in any case."""

    def __init__(self, headers: list[tuple[str, str]]):
        super().__init__(reversed([(k.lower(), v) for k, v in headers]))  # of equal names the first counts

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def dechunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding; as it is if it has none after all. A cut-off chunk is kept as far as it goes."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", body[at:end] if end >= 0 else body[at:], re.S)
        if not size:
            return body
        n = int(size[1], 16)
        if end < 0 or not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records with their headers as a dictionary."""
    return ((dict(headers), block) for headers, block in records(data))


def page_text(payload: bytes, head: str) -> str:
    """The payload as text: without its transfer coding and content encoding, in the charset of its headers."""
    said = head.lower()
    if re.search(r"^transfer-encoding:[^\r\n]*\bchunked\b", said, re.M):
        payload = dechunked(payload)
    if re.search(r"^content-encoding:\s*(?:x-)?gzip", said, re.M):
        with contextlib.suppress(OSError, EOFError, zlib.error):
            payload = gzip.decompress(payload)
    elif re.search(r"^content-encoding:\s*deflate", said, re.M):
        with contextlib.suppress(zlib.error):
            payload = zlib.decompress(payload)
    charset = re.search(r"^content-type:[^\r\n]*charset=[\"']?([\w.:-]+)", said, re.M)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, for ``derivatives``; one file a task.

    (page_id, record_id, url, date, headers, html, payload, source_headers): ``payload`` has the
    archived bytes, ``html`` their text, ``source_headers`` the record's own headers. A task
    holds its file as it is stored, and unpacks one record at a time.
    """
    names = ["page_id", "record_id", "url", "date", "headers", "html", "payload", "source_headers"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in records(content.as_py()):
                    of = Named(headers)
                    if (of.get("WARC-Type") or "").lower() != "response":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    head = head.decode("latin-1")
                    rows.append((
                        None, of.get("WARC-Record-ID") or f"<urn:uuid:{uuid.uuid5(SPACE, digest(block))}>", of.get("WARC-Target-URI"), of.get("WARC-Date"), head, page_text(body, head), body,
                        "\r\n".join(f"{k}: {v}" for k, v in headers),
                    ))
                    size += 2 * len(body)
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    kind = "page_id long, record_id string, url string, date string, headers string, html string, payload binary, source_headers string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as responses: an id from url and content, a plain 200 header."""
    said = F.concat_ws("\0", F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit("")))
    h = F.sha1(said)
    part = lambda a, n: F.substring(h, a, n)
    made = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    return pages.select(
        "page_id", made.alias("record_id"), "url", F.lit(DATE).alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("headers"), "html",
    )


#: Headers of the source's record that the derivatives carry under names of their own, or that hold for the source alone.
_OWN = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-length", "content-type", "warc-payload-digest", "warc-block-digest"}


def source_lines(http: str | None, warc: str | None) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """What both derivatives keep of the response's headers, line by line; and the headers of its record by lower-case name."""
    out = []
    status, *lines = (http or "").split("\r\n")
    if status:
        out.append(("WARC-Source-HTTP-Status", status))
    out += [("WARC-Source-HTTP-Header", line) for line in lines if line]
    of = {}
    for line in (warc or "").split("\r\n"):
        name, _, value = line.partition(":")
        of[name.strip().lower()] = value.strip()
        if line and name.strip().lower() not in _OWN:
            out.append(("WARC-Source-Header", line))
    return out, of


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records (see RECORD) for every response (page_id, record_id, url, date, headers, html; and payload, source_headers where there are any).

    A narrow pass, page by page: nothing is shuffled, and a task holds one page's records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 9, pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        table = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )
        for batch in batches:
            rows, size = [], 0
            for page_id, source, url, date, http, page, data, warc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                url, page = url or "", page or ""
                kept, of = source_lines(http, warc)
                found = page_metadata(page, url)
                payload = of.get("warc-payload-digest") or digest(page.encode("utf-8", "surrogatepass") if data is None else data)
                whole = of.get("warc-block-digest")
                fields = found | {"http-headers": http, "payload-digest": payload}
                blocks = (
                    ("metadata", "application/json", json.dumps(fields, ensure_ascii=False).encode("utf-8", "replace")),
                    ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
                )
                for kind, content_type, block in blocks:
                    record_id = f"<urn:uuid:{uuid.uuid5(SPACE, f'{source} {kind}')}>"
                    head = [
                        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", source), ("WARC-Target-URI", url),
                        ("WARC-Date", date or DATE), ("WARC-Source-Payload-Digest", payload), *([("WARC-Source-Block-Digest", whole)] if whole else []),
                        *kept, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type),
                    ]
                    record = serialised(head, block)
                    size += len(record) + len(block)
                    rows.append((
                        page_id, kind, record_id, source, url, date or DATE, payload, whole, digest(block), content_type, len(block),
                        len(found["links"]), block, record,
                    ))
                if size > 4 << 20:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    bounded_batches(responses.sparkSession)
    given = [c if c in responses.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("payload", "binary"), ("source_headers", "string"))]
    columns = ["record_id", "url", "date", "headers", "html"]
    return responses.select(F.col("page_id").cast("long").alias("page_id"), *columns, *given).mapInArrow(run, RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page, the records themselves with what identifies them."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return derivatives(responses_of(pages)).select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest", "content_type",
        "content_length", "n_links", "record",
    )
