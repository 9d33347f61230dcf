"""PDF: pages with an invisible text layer over a picture written, and the resolution of pages read back."""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np


class Word(NamedTuple):
    text: str
    x: float
    y: float  # of its top, from the top of the page
    w: float
    h: float


def _literal(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def write(pages: list[tuple[np.ndarray | None, float, list[Word]]]) -> bytes:
    """A document of (grey picture or none, dots per inch, words in pixels): what is seen is the picture, what is found the text."""
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []

    def put(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: bytes, data: bytes) -> bytes:
        return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)

    for picture, dpi, words in pages:
        h, w = picture.shape if picture is not None else (792 * dpi / 72, 612 * dpi / 72)
        scale, wide, high = 72 / dpi, w * 72 / dpi, h * 72 / dpi
        shown, resources = b"", b"/Font << /F1 3 0 R >>"
        if picture is not None:
            image = put(stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode" % (w, h), zlib.compress(np.ascontiguousarray(picture, np.uint8).tobytes())))
            shown, resources = b"q %.4f 0 0 %.4f 0 0 cm /Im0 Do Q\n" % (wide, high), resources + b" /XObject << /Im0 %d 0 R >>" % image
        text = b"".join(b"BT 3 Tr /F1 %.2f Tf %.2f %.2f Td %s Tj ET\n" % (max(1, t.h * scale), t.x * scale, high - (t.y + t.h) * scale, _literal(t.text)) for t in words if t.text)
        content = put(stream(b"", shown + text))
        kids.append(put(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Resources << %s >> /Contents %d 0 R >>" % (wide, high, resources, content)))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


class Page(NamedTuple):
    width: float  # in points
    height: float
    images: int
    dpi: float | None  # of all pictures, by the area that each covers
    least: float | None
    most: float | None
    text: str


_NUMBER = rb"[-+]?[0-9]*\.?[0-9]+"


class Document:
    """The objects of a file by its cross-reference tables, the later ones first; streams that are not packed or packed by zlib."""

    def __init__(self, data: bytes):
        self.data, self.at = data, {}
        told = re.findall(rb"startxref\s+(\d+)", data)
        if not told:
            raise ValueError("no cross-reference table")
        at, self.root, seen = int(told[-1]), None, set()
        while at is not None and at not in seen:
            seen.add(at)
            at = self._table(at)
        if self.root is None:
            raise ValueError("no catalogue")

    def _table(self, at: int) -> int | None:
        """Reads one table; where the one before it stands."""
        head = re.compile(rb"\s*xref\s+").match(self.data, at)
        if not head:
            raise ValueError("no cross-reference table at the place named")
        at = head.end()
        while m := re.compile(rb"(\d+) (\d+)\s+").match(self.data, at):
            at = m.end()
            for i in range(int(m[2])):
                entry = self.data[at : at + 20]
                if entry[17:18] == b"n":
                    self.at.setdefault(int(m[1]) + i, int(entry[:10]))
                at += 20
        trailer = self.data[at : self.data.index(b">>", at)]
        root, before = re.search(rb"/Root\s+(\d+) 0 R", trailer), re.search(rb"/Prev\s+(\d+)", trailer)
        self.root = self.root or (int(root[1]) if root else None)
        return int(before[1]) if before else None

    def body(self, number: int) -> bytes:
        start = self.data.index(b"obj", self.at[number]) + 3
        return self.data[start : self.data.index(b"endobj", start)]

    def stream(self, number: int) -> bytes:
        body = self.body(number)
        start = re.search(rb"stream\r?\n", body).end()
        n = re.search(rb"/Length\s+(\d+)", body)
        data = body[start : start + int(n[1])]
        return zlib.decompress(data) if b"/FlateDecode" in body[:start] else data

    def pages(self, node: int | None = None, box: bytes | None = None) -> list[tuple[int, bytes | None]]:
        """Page objects in order, each with the box it has from above."""
        node = node if node is not None else int(re.search(rb"/Pages\s+(\d+) 0 R", self.body(self.root))[1])
        body = self.body(node)
        own = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
        box = own[1] if own else box
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        return [p for k in re.findall(rb"(\d+) 0 R", kids[1]) for p in self.pages(int(k), box)] if kids else [(node, box)]

    def page(self, number: int, box: bytes | None) -> Page:
        body = self.body(number)
        x0, y0, x1, y1 = map(float, re.findall(_NUMBER, box)[:4]) if box else (0, 0, 0, 0)
        wide, high = x1 - x0, y1 - y0
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+ 0 R)", body)
        content = b"\n".join(self.stream(int(n)) for n in re.findall(rb"(\d+) 0 R", contents[1])) if contents else b""
        shown = {m[3]: (float(m[1]), float(m[2])) for m in re.finditer(rb"(%s) 0 0 (%s) %s %s cm\s*/(\w+) Do" % (_NUMBER, _NUMBER, _NUMBER, _NUMBER), content)}
        each = []
        named = re.search(rb"/XObject\s*<<(.*?)>>", body, re.DOTALL)
        for m in re.finditer(rb"/(\w+)\s+(\d+) 0 R", named[1]) if named else []:
            image = self.body(int(m[2]))
            pixels = [re.search(rb"/%s\s+(\d+)" % k, image) for k in (b"Width", b"Height")]
            if b"/Image" in image and all(pixels) and wide > 0 and high > 0:
                dw, dh = shown.get(m[1], (wide, high))
                dw, dh = dw if dw > 0 else wide, dh if dh > 0 else high
                each.append((dw * dh, min(int(pixels[0][1]) / (dw / 72), int(pixels[1][1]) / (dh / 72))))
        words = [re.sub(rb"\\([\\()])", rb"\1", t).decode("cp1252", "replace") for t in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*Tj", content)]
        dpi = sum(a for a, _ in each) / sum(a / d for a, d in each) if each else None
        return Page(wide, high, len(each), dpi, min((d for _, d in each), default=None), max((d for _, d in each), default=None), " ".join(words))


def read(data: bytes) -> list[Page]:
    """All pages of a file; ValueError where its tables can't be followed."""
    document = Document(data)
    return [document.page(n, box) for n, box in document.pages()]
