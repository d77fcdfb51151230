"""Text of the pages of a PDF file, for ``sources.files``: a small reader for text-based files.

It knows plain and Flate-compressed streams, object streams, the page tree, the operators that show
text, simple encodings and ToUnicode maps. What it does not know, such as encryption, other filters
and scanned images, gives no text. A file without the PDF header is an error, as it is no PDF.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_INFO = ("Title", "Author", "Subject", "Creator", "Producer")
SPACE = -180  # thousandths of an em: a shift in a line of text that stands for a space


def literal(token: bytes) -> bytes:
    """The bytes of a (string) or a <hexadecimal string>."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e[:1] in b"01234567" else b"" if e in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(e, e)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def as_text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


class Reader:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.objects = data, {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                inner, first = self.stream(body), int(self.number(body, b"First") or 0)
                heads = list(map(int, inner[:first].split()))
                ends = [*heads[3::2], len(inner) - first]
                for n, at, end in zip(heads[::2], heads[1::2], ends, strict=False):
                    self.objects.setdefault(n, inner[first + at : first + end])

    @staticmethod
    def number(body: bytes, name: bytes) -> bytes | None:
        found = re.search(rb"/" + name + rb"\s+(\d+)(?!\s+\d+\s+R)", body)
        return found[1] if found else None

    @staticmethod
    def stream(body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        if b"/Filter" not in body[: found.start()]:
            return found[1]
        if b"/FlateDecode" not in body[: found.start()]:
            return b""
        try:
            return zlib.decompressobj().decompress(found[1])
        except zlib.error:
            return b""

    def value(self, body: bytes, name: bytes) -> bytes:
        """What stands behind a name: a dictionary, an array or an object that is referred to."""
        found = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*(?=[\[<(/\d])", body)
        if not found:
            return b""
        rest = body[found.end() :]
        pointed = _REFERENCE.match(rest)
        if pointed:
            return self.objects.get(int(pointed[1]), b"")
        for opening, closing in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(opening):
                depth = 0
                for m in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
                    depth += 1 if m[0] == opening else -1
                    if not depth:
                        return rest[: m.end()]
        return rest

    def pages(self) -> list[bytes]:
        found, seen = [], set()

        def below(number: int, resources: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen or not body:
                return
            seen.add(number)
            resources = self.value(body, b"Resources") or resources
            kids = self.value(body, b"Kids")
            if kids:
                for kid in _REFERENCE.findall(kids):
                    below(int(kid), resources)
            elif re.search(rb"/Type\s*/Page\b", body):
                found.append((body, resources))

        for body in self.objects.values():
            root = re.search(rb"/Type\s*/Catalog\b", body) and re.search(rb"/Pages\s+(\d+)", body)
            if root:
                below(int(root[1]), b"")
        return found or [(b, self.value(b, b"Resources")) for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def maps(self, resources: bytes) -> dict[bytes, dict[int, str]]:
        """Of each font of a page that has one: its ToUnicode map."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            table = self.stream(self.value(self.objects.get(int(number), b""), b"ToUnicode"))
            if table:
                out[name] = codes = {}
                for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
                    for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                        codes[int(code, 16)] = bytes.fromhex(to.decode()).decode("utf-16-be", "replace")
                for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
                    for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                        for k in range(int(low, 16), min(int(high, 16), int(low, 16) + 65535) + 1):
                            codes[k] = chr(int(to, 16) + k - int(low, 16))
        return out

    def text(self, body: bytes, resources: bytes) -> str:
        held = self.value(body, b"Contents")
        numbers = _REFERENCE.findall(held) if held.startswith(b"[") else []
        content = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in numbers) if numbers else self.stream(held)
        maps, codes, stack, out = self.maps(resources), None, [], []

        def shown(token: bytes) -> str:
            raw = literal(token)
            return "".join(codes.get(int.from_bytes(raw[k : k + 2], "big"), "") for k in range(0, len(raw), 2)) if codes else as_text(raw)

        for token in _TOKEN.findall(content):
            if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
                stack.append(token)
                continue
            if token == b"Tf" and len(stack) > 1:
                codes = maps.get(stack[-2][1:])
            elif token in (b"Td", b"TD", b"Tm", b"T*", b"ET"):
                still = token in (b"Td", b"TD") and stack[-1:] and re.fullmatch(rb"[-+]?0*\.?0*", stack[-1])
                out.append(" " if still else "\n")
            elif token in (b"Tj", b"'", b'"') and stack:
                out.append(("" if token == b"Tj" else "\n") + shown(stack[-1]))
            elif token == b"TJ":
                first = len(stack) - 1 - stack[::-1].index(b"[") if b"[" in stack else 0
                for x in stack[first:]:
                    if x[:1] in b"(<":
                        out.append(shown(x))
                    elif re.fullmatch(rb"[-+.\d]+", x) and float(x) < SPACE:
                        out.append(" ")
            stack = []
        lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line)

    def info(self) -> dict[str, str]:
        pointed = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", self.data)
        body = self.objects.get(int(pointed[1]), b"") if pointed else b""
        found = {n: re.search(rb"/" + n.encode() + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", body, re.S) for n in _INFO}
        return {n.lower(): as_text(literal(m[1])) for n, m in found.items() if m}


def pages(content: bytes) -> list[tuple[str, dict]]:
    """(text, metadata) of every page; metadata has its number from 0, the number of pages and what the file says of itself."""
    reader = Reader(content)
    found = reader.pages()
    return [(reader.text(*p), {**reader.info(), "page": k, "total_pages": len(found)}) for k, p in enumerate(found)]
