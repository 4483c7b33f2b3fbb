"""Writes documents: used to turn known tables into files and read them back."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np

from .kernels.objects import Name, Ref

FLAVOURS = ("classic", "flate", "ascii85", "asciihex", "runlength", "lzw", "objstm", "broken")


@functools.lru_cache(1024)
def _name(x: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c < 127 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in x.encode())


@functools.lru_cache(4096)
def _float(x: float) -> bytes:
    return f"{x:.4f}".rstrip("0").rstrip(".").encode()


_SPECIAL = re.compile(rb"[\\()\r]")


def dump(x) -> bytes:
    kind = type(x)
    if kind is int:
        return b"%d" % x
    if kind is dict:
        return b"<< " + b" ".join([_name(k) + b" " + (b"%d %d R" % v if type(v) is Ref else dump(v)) for k, v in x.items()]) + b" >>"
    if kind is bytes:
        if not _SPECIAL.search(x):
            return b"(" + x + b")"
        return b"(" + x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    if kind is Ref:
        return b"%d %d R" % x
    if kind is Name:
        return _name(x)
    if kind is float and x:  # zero has two signs, which are one key
        return _float(x)
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, Name):
        return _name(x)
    if isinstance(x, (int, float)):
        return (b"%d" % x) if isinstance(x, int) else f"{x:.4f}".rstrip("0").rstrip(".").encode()
    if isinstance(x, dict):
        return b"<< " + b" ".join([_name(k) + b" " + dump(v) for k, v in x.items()]) + b" >>"
    return b"[ " + b" ".join(list(map(dump, x))) + b" ]"


def run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128)) + b"\x80"


_NINE_BITS = np.arange(8, -1, -1, dtype=np.uint16)
_NINE = [f"{c:09b}" for c in range(258)]


def lzw(data: bytes) -> bytes:
    """9-bit codes only: a clear code before the table could need ten."""
    if len(data) > 400:
        at = np.arange(0, len(data), 200)
        codes = np.append(np.insert(np.frombuffer(data, np.uint8).astype(np.uint16), at, 256), np.uint16(257))
        return np.packbits((codes[:, None] >> _NINE_BITS).astype(np.uint8) & 1).tobytes()
    bits = "".join([_NINE[256] + "".join(map(_NINE.__getitem__, data[k : k + 200])) for k in range(0, len(data) or 1, 200)]) + _NINE[257]
    size = -(-len(bits) // 8)
    return int(bits.ljust(size * 8, "0"), 2).to_bytes(size, "big")


def _flate(d: bytes) -> bytes:
    return zlib.compress(d)


ENCODERS = {
    "flate": (["FlateDecode"], _flate), "ascii85": (["ASCII85Decode", "FlateDecode"], lambda d: base64.a85encode(_flate(d)) + b"~>"), "asciihex": (["ASCIIHexDecode"], lambda d: d.hex().encode() + b">"),
    "runlength": (["RunLengthDecode"], run_length), "lzw": (["LZWDecode"], lzw),
}


class Writer:
    def __init__(self, flavour: str = "classic"):
        self.flavour = flavour
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        self._next = 1
        self.trailer: dict = {}

    def add(self, x, data: bytes | None = None, num: int | None = None) -> Ref:
        if not num:
            num = self._next
            while num in self.objects:
                num += 1
        self._next = max(self._next, num + 1)
        self.objects[num] = (x, data)
        return Ref(num, 0)

    def stream(self, data: bytes, attrs: dict | None = None) -> Ref:
        names, encode = ENCODERS.get(self.flavour, ([], lambda d: d))
        body = encode(data)
        f = {"Filter": [Name(n) for n in names] if len(names) > 1 else Name(names[0])} if names else {}
        return self.add({**(attrs or {}), **f, "Length": len(body)}, body)

    def bytes(self) -> bytes:
        out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        packed = {n for n, (x, d) in self.objects.items() if d is None} if self.flavour == "objstm" else set()
        size = max(self.objects, default=0) + 1
        for n, (x, d) in sorted(self.objects.items()):
            if n not in packed:
                at[n] = len(out)
                out += b"%d 0 obj\n" % n + dump(x) + (b"\nstream\n" + d + b"\nendstream" if d is not None else b"") + b"\nendobj\n"
        if self.flavour == "objstm":
            bodies = {n: dump(self.objects[n][0]) + b"\n" for n in sorted(packed)}
            heads, pos = [], 0
            for n, b in bodies.items():
                heads.append(b"%d %d" % (n, pos))
                pos += len(b)
            head = b" ".join(heads) + b"\n"
            data = _flate(head + b"".join(bodies.values()))
            store, table = size, size + 1
            at[store] = len(out)
            out += b"%d 0 obj\n" % store + dump({"Type": Name("ObjStm"), "N": len(bodies), "First": len(head), "Filter": Name("FlateDecode"), "Length": len(data)}) + b"\nstream\n" + data + b"\nendstream\nendobj\n"
            at[table] = len(out)
            rows = bytearray(b"\0\0\0\0\0\0\0")
            order = {n: k for k, n in enumerate(bodies)}
            for n in range(1, size + 2):
                rows += b"\2" + store.to_bytes(4, "big") + order[n].to_bytes(2, "big") if n in order else b"\1" + at[n].to_bytes(4, "big") + b"\0\0" if n in at else bytes(7)
            data = _flate(bytes(rows))
            attrs = {**self.trailer, "Type": Name("XRef"), "Size": size + 2, "W": [1, 4, 2], "Filter": Name("FlateDecode"), "Length": len(data)}
            out += b"%d 0 obj\n" % table + dump(attrs) + b"\nstream\n" + data + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % at[table]
            return bytes(out)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n" for n in range(1, size))
        out += b"trailer\n" + dump({**self.trailer, "Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % (999999999 if self.flavour == "broken" else start)
        return bytes(out)


def show(text: str) -> bytes:
    b = text.encode("cp1252", "replace")
    return b"(" + b + b") Tj\n" if not _SPECIAL.search(b) else dump(b) + b" Tj\n"


def text_page(lines: Iterable[tuple[str, float, str]], top: float = 770, left: float = 50, leading: float = 14) -> bytes:
    """Content with one line each: (text, size, font key)."""
    out = [b"BT\n"]
    step, at, fonts = b"0 " + dump(-float(leading)) + b" Td\n", dump(float(left)) + b" " + dump(float(top)) + b" Td\n", {}
    for text, size, font in lines:
        if (font, size) not in fonts:
            fonts[font, size] = b"/%s %s Tf\n" % (font.encode(), dump(float(size)))
        out += fonts[font, size], at, show(text)
        at = step
    out.append(b"ET\n")
    return b"".join(out)


def simple_font(name: str) -> dict:
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(name), "Encoding": Name("WinAnsiEncoding")}


def document(pages: list[bytes], flavour: str = "classic", info: dict[str, bytes] | None = None, page_attrs: dict | None = None, fonts: dict[str, dict] | None = None, build: Callable[[Writer], dict] | None = None) -> bytes:
    """A document of these content streams, with F1 (Helvetica) and F2 (its bold) unless fonts are given. `build` adds objects and gives further attributes of pages, resources among them."""
    w = Writer(flavour)
    page_attrs = {**(page_attrs or {}), **(build(w) if build else {})}
    catalog, tree = w.add(None), w.add(None)
    fonts = {k: w.add(v) for k, v in (fonts or {"F1": simple_font("Helvetica"), "F2": simple_font("Helvetica-Bold")}).items()}
    kids = []
    for content in pages:
        c = w.stream(content)
        kids.append(w.add({"Type": Name("Page"), "Parent": tree, "Contents": c, **(page_attrs or {})}))
    w.objects[catalog.num] = ({"Type": Name("Catalog"), "Pages": tree}, None)
    w.objects[tree.num] = ({"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": fonts}}, None)
    w.trailer["Root"] = catalog
    if info:
        w.trailer["Info"] = w.add(info)
    return w.bytes()


LINES_PER_PAGE = 36


def from_text(text: str | None, flavour: str = "classic", first_size: float = 12.0) -> bytes:
    """A document of a text's non-empty lines, 36 a page; the first may be larger."""
    lines = [x for x in (text or "").split("\n") if x]
    rows = [(x, first_size if not k else 12.0, "F1") for k, x in enumerate(lines)]
    return document([text_page(rows[k : k + LINES_PER_PAGE]) for k in range(0, len(rows), LINES_PER_PAGE)] or [b""], flavour)


def table_page(rows: list[list[str]], xs: list[float], top: float = 700, step: float = 20, size: float = 10, ruled: bool = False) -> bytes:
    """A grid of cells at fixed places, with lines round them if ruled."""
    out = bytearray()
    if ruled:
        edges = [*xs, xs[-1] + (xs[-1] - xs[-2] if len(xs) > 1 else 100)]
        x0, x1, y0, y1 = xs[0] - 4, edges[-1] - 4, top - step * len(rows) + step - 6, top + step - 6
        out += b"1 w\n" + b"".join(b"%s %s m %s %s l S\n" % tuple(dump(float(v)) for v in (x0, y1 - step * k, x1, y1 - step * k)) for k in range(len(rows) + 1))
        out += b"".join(b"%s %s m %s %s l S\n" % tuple(dump(float(v)) for v in (x - 4, y0, x - 4, y1)) for x in edges)
    out += b"BT /F1 %s Tf\n" % dump(float(size))
    for k, r in enumerate(rows):
        for x, cell in zip(xs, r, strict=False):
            if cell:
                out += b"1 0 0 1 %s %s Tm " % (dump(float(x)), dump(float(top - step * k))) + show(cell)
    return bytes(out + b"ET\n")
