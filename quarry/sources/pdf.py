"""Text of PDF files: their objects, pages, content streams and ToUnicode maps.

A small reader for what text needs: plain and Flate streams, object streams, page
trees, fonts. Codes go through a font's ToUnicode map (two bytes, else one); without a
map, printable Latin-1 stands for itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

_DELIMITERS = b"()<>[]{}/% \t\r\n\x0c\x00"
_SPACE = b" \t\r\n\x0c\x00"


@dataclass(frozen=True)
class Name:
    value: str


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass(frozen=True)
class Word:
    """An operator or keyword."""

    value: bytes


class Reader:
    """Objects of a byte string, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:
                while self.at < len(self.data) and self.data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next object; None at the end."""
        self._skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        c = d[at : at + 1]
        if c == b"/":
            end = at + 1
            while end < len(d) and d[end] not in _DELIMITERS:
                end += 1
            self.at = end
            return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), d[at + 1 : end]).decode("latin-1"))
        if c == b"(":
            return self._string()
        if d[at : at + 2] == b"<<":
            self.at += 2
            return self._dict()
        if c == b"<":
            end = d.find(b">", at)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9a-fA-F]", b"", d[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while (x := self.next()) is not None and x != Word(b"]"):
                out.append(x)
            return _references(out)
        if c in (b"]", b"{", b"}", b")"):
            self.at += 1
            return Word(c)
        if d[at : at + 2] == b">>":
            self.at += 2
            return Word(b">>")
        end = at
        while end < len(d) and d[end] not in _DELIMITERS:
            end += 1
        self.at = max(end, at + 1)
        token = d[at : self.at]
        try:
            return int(token)
        except ValueError:
            pass
        try:
            return float(token)
        except ValueError:
            return Word(token)

    def _dict(self) -> dict:
        flat = []
        while (x := self.next()) is not None and x != Word(b">>"):
            flat.append(x)
        flat = _references(flat)
        return {k.value: v for k, v in zip(flat[::2], flat[1::2]) if isinstance(k, Name)}

    def _string(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while at < len(d):
            c = d[at]
            if c == 0x5C and at + 1 < len(d):
                at += 1
                e = d[at]
                if 0x30 <= e <= 0x37:
                    digits = re.match(rb"[0-7]{1,3}", d[at : at + 3])[0]
                    out.append(int(digits, 8) & 255)
                    at += len(digits) - 1
                elif e == 0x0D and d[at + 1 : at + 2] == b"\n":
                    at += 1
                elif e not in b"\r\n":
                    out.append(plain.get(e, e))
            else:
                depth += (c == 0x28) - (c == 0x29)
                if not depth:
                    break
                out.append(c)
            at += 1
        self.at = at + 1
        return bytes(out)


def _references(items: list) -> list:
    out: list = []
    for x in items:
        if x == Word(b"R") and len(out) >= 2 and isinstance(out[-1], int) and isinstance(out[-2], int):
            out[-2:] = [Ref(out[-2])]
        else:
            out.append(x)
    return out


class Document:
    """Objects by number; found by scanning, so a damaged table of places does no harm."""

    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[ \t\r\n]+\d{1,5}[ \t\r\n]+obj\b", data):
            reader = Reader(data, m.end())
            number = int(m[1])
            value = reader.next()
            self.objects[number] = value
            if isinstance(value, dict):
                reader._skip()
                if data[reader.at : reader.at + 6] == b"stream":
                    start = reader.at + 6
                    start += 2 if data[start : start + 2] == b"\r\n" else 1
                    size = value.get("Length")
                    stop = start + size if isinstance(size, int) and data[start + size : start + size + 12].strip().startswith(b"endstream") else data.find(b"endstream", start)
                    self.streams[number] = data[start : stop if stop >= 0 else len(data)]
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == Name("ObjStm") and isinstance(value.get("First"), int):
                content = self.stream(number)
                head = Reader(content[: value["First"]])
                pairs = [head.next() for _ in range(2 * int(value.get("N", 0)))]
                for inner, offset in zip(pairs[::2], pairs[1::2]):
                    if isinstance(inner, int) and isinstance(offset, int):
                        self.objects.setdefault(inner, Reader(content, value["First"] + offset).next())

    def get(self, value):
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def stream(self, number: int) -> bytes:
        filters = self.get(self.objects[number].get("Filter")) if isinstance(self.objects.get(number), dict) else None
        data = self.streams.get(number, b"")
        for f in filters if isinstance(filters, list) else [filters]:
            if f == Name("FlateDecode"):
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error:
                    return b""
            elif f is not None:
                return b""
        return data

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """(page, resources), in the order of the tree."""
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == Name("Catalog")), None)
        seen: set[int] = set()

        def walk(node, resources: dict) -> Iterator[tuple[dict, dict]]:
            value = self.get(node)
            if not isinstance(value, dict) or id(value) in seen:
                return
            seen.add(id(value))
            own = self.get(value.get("Resources"))
            resources = own if isinstance(own, dict) else resources
            kids = self.get(value.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    yield from walk(kid, resources)
            else:
                yield value, resources

        if root is not None:
            yield from walk(root.get("Pages"), {})


def unicode_map(cmap: bytes) -> dict[bytes, str]:
    """Codes to text of a ToUnicode map: bfchar pairs, bfrange runs and lists."""
    out: dict[bytes, str] = {}

    def text(b: bytes) -> str:
        return b.decode("utf-16-be", "ignore")

    reader, block, operands = Reader(cmap), None, []
    while (x := reader.next()) is not None:
        if isinstance(x, Word):
            if x.value in (b"beginbfchar", b"beginbfrange"):
                block = x.value[7:]
            elif x.value in (b"endbfchar", b"endbfrange"):
                block = None
            operands = []
            continue
        operands.append(x)
        if block == b"char" and len(operands) == 2:
            if all(isinstance(o, bytes) for o in operands):
                out[operands[0]] = text(operands[1])
            operands = []
        elif block == b"range" and len(operands) == 3:
            low, high, to = operands
            operands = []
            if not (isinstance(low, bytes) and isinstance(high, bytes)):
                continue
            first, last = int.from_bytes(low, "big"), min(int.from_bytes(high, "big"), int.from_bytes(low, "big") + 0xFFFF)
            for code in range(first, last + 1):
                if isinstance(to, list):
                    value = text(to[code - first]) if code - first < len(to) and isinstance(to[code - first], bytes) else None
                else:
                    point = int.from_bytes(to, "big") + code - first if isinstance(to, bytes) else -1
                    value = chr(point) if 0 <= point < 0x110000 and not 0xD800 <= point < 0xE000 else None
                if value is not None:
                    out[code.to_bytes(len(low), "big")] = value
    return out


def decode(codes: bytes, to: dict[bytes, str] | None) -> str:
    """Two-byte codes where the map has them, else one-byte codes; unmapped codes are dropped."""
    if not to:
        return "".join(c for c in codes.decode("latin-1") if c.isprintable())
    out, at = [], 0
    while at < len(codes):
        for size in (2, 1):
            if len(codes[at : at + size]) == size and codes[at : at + size] in to:
                out.append(to[codes[at : at + size]])
                at += size
                break
        else:
            at += 2 if any(len(k) == 2 for k in to) else 1
    return "".join(out)


def page_text(content: bytes, fonts: dict[str, dict[bytes, str]]) -> str:
    """Shown strings; movements of the line are spaces, new lines are line feeds."""
    out, operands, font = [], [], None
    reader = Reader(content)
    shown = lambda x: decode(x, fonts.get(font)) if isinstance(x, bytes) else ""
    while (x := reader.next()) is not None:
        if not isinstance(x, Word):
            operands.append(x)
            continue
        op = x.value
        if op == b"Tf" and operands and isinstance(operands[0], Name):
            font = operands[0].value
        elif op == b"Tj" and operands:
            out.append(shown(operands[-1]))
        elif op == b"TJ" and operands and isinstance(operands[-1], list):
            out += map(shown, operands[-1])
        elif op in (b"'", b'"') and operands:
            out.append("\n" + shown(operands[-1]))
        elif op in (b"Td", b"TD", b"Tm"):
            out.append(" ")
        elif op == b"T*":
            out.append("\n")
        elif op == b"BI":
            end = re.compile(rb"\sEI\b").search(content, reader.at)
            reader.at = end.end() if end else len(content)
        operands = []
    return "".join(out).strip()


def extract_text(data: bytes) -> str:
    """Text of all pages, a line feed between pages; empty for what can't be read."""
    doc = Document(data)
    texts = []
    for page, resources in doc.pages():
        fonts = {}
        listed = doc.get(resources.get("Font")) if isinstance(resources, dict) else None
        for name, ref in (listed or {}).items() if isinstance(listed, dict) else ():
            font = doc.get(ref)
            to = font.get("ToUnicode") if isinstance(font, dict) else None
            if isinstance(to, Ref):
                fonts[name] = unicode_map(doc.stream(to.number))
        contents = page.get("Contents")
        value = doc.get(contents)
        refs = value if isinstance(value, list) else [contents]
        content = b"\n".join(doc.stream(r.number) for r in refs if isinstance(r, Ref))
        if text := page_text(content, fonts):
            texts.append(text)
    return "\n".join(texts).strip()
