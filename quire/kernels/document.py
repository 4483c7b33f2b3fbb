"""A document: cross-reference loading with recovery, object access, the page tree, metadata and elements."""

from __future__ import annotations

import re
from typing import NamedTuple

from . import filters, jpeg
from .crypt import Decryptor
from .objects import _GAP, Name, Op, Parser, ParseError, Ref, Stream, indirect, text_string


class DocumentError(ValueError):
    pass


class Entry(NamedTuple):
    """kind: free, file (offset, gen) or stream (container number, index)."""

    kind: str
    a: int
    b: int


class Section(NamedTuple):
    start: int
    end: int
    entries: dict[int, Entry]
    trailer: dict
    kind: str


_VERSION = re.compile(rb"%PDF-(\d{1,3})\.(\d{1,3})")
_HEADER = re.compile(rb"%PDF-[0-9.]*")
_STARTXREF = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)")
_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d{1,15})[\0\t\n\f\r ]+(\d{1,15})[\0\t\n\f\r ]+([nf])(?=[\0\t\n\f\r ])")
#: The head of a subsection.
_SUBSECTION = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]++(\d{1,10})(?=[\0\t\n\f\r ])")
#: An entry of the usual twenty bytes.
_USUAL = re.compile(rb"(\d{10}) (\d{5}) ([nf])(?: \n| \r|\r\n)")
_TRAILER = re.compile(rb"trailer")
MAX_CHASE, MAX_TREE = 32, 64
_entry = tuple.__new__


def version(data: bytes) -> tuple[int, int]:
    m = _VERSION.search(data[:1024])
    return (int(m[1]), int(m[2])) if m else (1, 4)


def header_span(data: bytes) -> tuple[int, int] | None:
    m = _HEADER.search(data[:1024])
    return m.span() if m else None


def startxref(data: bytes) -> tuple[int, int, int] | None:
    """(offset named, first byte, end) of the last startxref in the last KiB, or then in the last 64."""
    for size in (1024, 65536):
        base = max(0, len(data) - size)
        found = list(_STARTXREF.finditer(data, base))
        if found:
            return int(found[-1][1]), found[-1].start(), found[-1].end()
    return None


def eof_span(data: bytes) -> tuple[int, int] | None:
    p = data.rfind(b"%%EOF", max(0, len(data) - 65536))
    return (p, p + 5) if p >= 0 else None


def classic_section(data: bytes, p: int) -> Section:
    parser, start, entries = Parser(data, p + 4, refs=False), p, {}
    while True:
        q = parser.skip()
        if data.startswith(b"trailer", q):
            parser.pos, parser.refs = q + 7, True
            break
        if m := _SUBSECTION.match(data, q):
            first, n, parser.pos = int(m[1]), int(m[2]), m.end()
        else:
            first, n = parser.value(), parser.value()
        if type(first) is not int or type(n) is not int or n < 0:
            raise ParseError("xref subsection")
        at = _GAP.match(data, parser.pos).end()
        usual = _USUAL.findall(data, at, at + 20 * n) if 0 < n <= (len(data) - at) // 20 else ()
        if usual and len(usual) == n:
            parser.pos = at + 20 * n - 1
            found = {k: _entry(Entry, ("file" if c == b"n" else "free", int(a), int(b))) for k, (a, b, c) in enumerate(usual, first)}
            entries = {**entries, **found, **entries} if entries else found
            continue
        for k in range(n):
            if m := _ENTRY.match(data, parser.pos):
                parser.pos = m.end()
                entries.setdefault(first + k, Entry("file" if m[3] == b"n" else "free", int(m[1]), int(m[2])))
                continue
            a, b, c = parser.value(), parser.value(), parser.value()
            if not isinstance(c, Op):
                raise ParseError("xref entry")
            entries.setdefault(first + k, Entry("file", a, b) if c == "n" else Entry("free", a, b))
    trailer = parser.value()
    if not isinstance(trailer, dict):
        raise ParseError("trailer")
    return Section(start, parser.pos, entries, trailer, "table")


def stream_section(data: bytes, p: int) -> Section:
    _, x, start, end = indirect(data, p)
    if not isinstance(x, Stream) or x.attrs.get("Type") != "XRef":
        raise ParseError("no xref stream")
    body = filters.decode(x.attrs, x.data, stop_at_image=False)
    w = [v if isinstance(v, int) and 0 <= v <= 8 else 0 for v in (x.attrs.get("W") or [])][:3]
    if len(w) < 3 or not sum(w):
        raise ParseError("xref stream widths")
    size = x.attrs.get("Size", 0)
    index = x.attrs.get("Index") if isinstance(x.attrs.get("Index"), list) else [0, size if isinstance(size, int) else 0]
    entries, at, step = {}, 0, sum(w)
    for first, n in zip(index[::2], index[1::2], strict=False):
        for k in range(min(n, (len(body) - at) // step)):
            f, q = [], at
            for width in w:
                f.append(int.from_bytes(body[q : q + width], "big"))
                q += width
            at += step
            kind = f[0] if w[0] else 1
            if kind in (0, 1, 2):
                entries.setdefault(first + k, Entry(("free", "file", "stream")[kind], f[1], f[2]))
    return Section(start, end, entries, x.attrs, "stream")


def section_at(data: bytes, offset: int) -> Section:
    p = Parser(data, offset).skip()
    return classic_section(data, p) if data.startswith(b"xref", p) else stream_section(data, p)


def sections(data: bytes) -> list[Section]:
    """Sections from the newest back, a hybrid's stream right after its table; a loop ends the walk."""
    found = startxref(data)
    if not found:
        raise ParseError("no startxref")
    out, seen, todo = [], set(), [found[0]]
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        s = section_at(data, at)
        out.append(s)
        extra, prev = s.trailer.get("XRefStm"), s.trailer.get("Prev")
        if s.kind == "table" and type(extra) is int and extra not in seen:
            seen.add(extra)
            try:
                out.append(section_at(data, extra))
            except (ParseError, ValueError):
                pass
        if type(prev) is int:
            todo.append(prev)
    return out


def recovered(data: bytes) -> Section:
    """A section made by scanning the whole file: the last definition of a number wins; trailers are merged, a later one first, and else the lowest catalog is the root."""
    entries = {int(m[1]): Entry("file", m.start(), int(m[2])) for m in _OBJ.finditer(data)}
    if not entries:
        raise DocumentError("no objects")
    trailer: dict = {}
    for m in _TRAILER.finditer(data):
        try:
            t = Parser(data, m.end()).value()
        except ParseError:
            continue
        if isinstance(t, dict):
            trailer = {**trailer, **t}
    catalogs = []
    for num, e in sorted(entries.items()):
        try:
            x = indirect(data, e.a)[1]
        except ParseError:
            continue
        if isinstance(x, Stream) and x.attrs.get("Type") == "XRef":
            trailer = {**{k: v for k, v in x.attrs.items() if k in ("Root", "Info", "ID", "Encrypt")}, **trailer}
        if isinstance(x, Stream) and x.attrs.get("Type") == "ObjStm":
            for k, n in enumerate(members(x, lambda v: v)[0]):
                entries.setdefault(n, Entry("stream", num, k))
        if isinstance(x, dict) and x.get("Type") == "Catalog":
            catalogs.append(num)
    if "Root" not in trailer and catalogs:
        trailer["Root"] = Ref(catalogs[0], entries[catalogs[0]].b)
    return Section(0, len(data), entries, trailer, "recovered")


def members(x: Stream, resolve) -> tuple[list[int], list[tuple[int, int]], bytes]:
    """Numbers, spans and body of an object stream."""
    body = filters.decode(x.attrs, x.data, resolve, stop_at_image=False)
    n, first = resolve(x.attrs.get("N")), resolve(x.attrs.get("First"))
    if type(n) is not int or type(first) is not int or n < 0:
        return [], [], body
    head = [int(v) for v in re.findall(rb"\d+", body[:first])[: 2 * n]]
    nums, at = head[::2], [first + v for v in head[1::2]]
    return nums[: len(at)], [(a, b) for a, b in zip(at, [*at[1:], len(body)], strict=True)], body


class Page:
    """One leaf of the page tree, with what it inherits."""

    def __init__(self, doc: Document, ref: Ref | None, attrs: dict, inherited: dict):
        self.doc, self.ref, self.attrs = doc, ref, attrs
        get = lambda k: doc.resolve(attrs.get(k, inherited.get(k)))
        resources = get("Resources")
        self.resources = resources if isinstance(resources, dict) else {}
        self.media_box = rect(doc, get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        crop = rect(doc, get("CropBox"))
        self.crop_box = (intersect(crop, self.media_box) if crop else None) or self.media_box
        turn = get("Rotate")
        turn = int(turn) % 360 if isinstance(turn, (int, float)) else 0
        self.rotate = turn if turn % 90 == 0 else 0

    @property
    def size(self) -> tuple[float, float]:
        x0, y0, x1, y1 = self.crop_box
        return (y1 - y0, x1 - x0) if self.rotate % 180 else (x1 - x0, y1 - y0)

    def content(self) -> bytes:
        """The decoded content; parts are joined by a line feed, and one that can't be decoded raises."""
        c = self.doc.resolve(self.attrs.get("Contents"))
        parts = [self.doc.resolve(x) for x in c] if isinstance(c, list) else [c]
        return b"\n".join(self.doc.stream_data(x) for x in parts if isinstance(x, Stream))


_PLAIN_NUMBERS = {int, float}


def rect(doc, x) -> tuple[float, float, float, float] | None:
    v = x if type(x) is list and _PLAIN_NUMBERS.issuperset(map(type, x)) else [doc.resolve(n) for n in x] if isinstance(x, list) else []
    if len(v) < 4 or not all(isinstance(n, (int, float)) for n in v[:4]):
        return None
    a, b, c, d = map(float, v[:4])
    return min(a, c), min(b, d), max(a, c), max(b, d)


def intersect(a, b):
    r = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return r if r[0] < r[2] and r[1] < r[3] else None


class Document:
    def __init__(self, data: bytes, password: str = ""):
        """DocumentError if there are no objects, no catalog, or the password is wrong."""
        self.data, self.version = data, version(data)
        self._cache: dict[int, object] = {}
        self._busy: set[int] = set()
        self._stores: dict[int, tuple] = {}
        self.decryptor = None
        self._load(password)

    def _load(self, password: str) -> None:
        try:
            self.sections = sections(self.data)
            self._merge()
            if not isinstance(self.resolve(self.trailer.get("Root")), dict) and "Encrypt" not in self.trailer:
                raise ParseError("no root")
        except (ParseError, ValueError, KeyError, TypeError):
            self.sections = [recovered(self.data)]
            self._merge()
            self._cache.clear()
            if "Root" not in self.trailer:
                raise DocumentError("no catalog") from None
        if "Encrypt" in self.trailer:
            self._unlock(password)

    def _unlock(self, password: str) -> None:
        enc = self.resolve(self.trailer["Encrypt"])
        enc = {k: self.resolve(v) for k, v in enc.items()} if isinstance(enc, dict) else {}
        ids = self.resolve(self.trailer.get("ID"))
        first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
        try:
            self.decryptor = Decryptor(enc, first if isinstance(first, bytes) else b"", password.encode("utf-8" if enc.get("R", 2) >= 5 else "latin-1", "replace"))
        except (ValueError, TypeError, AttributeError):
            raise DocumentError("encrypted: wrong password") from None
        self._cache.clear()
        self._stores.clear()

    def _merge(self) -> None:
        self.xref: dict[int, Entry] = dict(self.sections[0].entries) if self.sections else {}
        self.trailer: dict = dict(self.sections[0].trailer) if self.sections else {}
        for s in self.sections[1:]:
            for k, e in s.entries.items():
                self.xref.setdefault(k, e)
            for k, v in s.trailer.items():
                self.trailer.setdefault(k, v)

    # objects

    def located(self, num: int) -> tuple[object, tuple[int, int] | None, tuple[int, tuple[int, int]] | None]:
        """(object, span in the file, (container, span in its decoded data)); ParseError if it can't be read."""
        e = self.xref.get(num)
        if e is None or e.kind == "free":
            return None, None, None
        if e.kind == "file":
            ref, x, a, b = indirect(self.data, e.a, self.resolve)
            if ref.num != num:
                raise ParseError("another object is there")
            return self._opened(num, ref, x), (a, b), None
        if e.a not in self._stores:
            store = self.get(e.a)
            self._stores[e.a] = members(store, self.resolve) if isinstance(store, Stream) else ([], [], b"")
        nums, spans, body = self._stores[e.a]
        k = e.b if e.b < len(nums) and nums[e.b] == num else nums.index(num) if num in nums else -1
        if k < 0:
            raise ParseError("not in its object stream")
        parser = Parser(body, spans[k][0])
        x = parser.value()
        return (None if isinstance(x, Op) else x), None, (e.a, (spans[k][0], parser.pos))

    def _opened(self, num: int, ref: Ref, x):
        own = self.trailer.get("Encrypt")
        return self.decryptor.object(x, ref.num, ref.gen) if self.decryptor and not (isinstance(own, Ref) and own.num == num) else x

    def get(self, num: int):
        """An object by number; None where it is missing, unreadable or asked for while it is being read."""
        if num in self._cache:
            return self._cache[num]
        if num in self._busy:
            return None
        self._busy.add(num)
        try:
            x = self.located(num)[0]
        except (ParseError, ValueError, RecursionError):
            x = None
        finally:
            self._busy.discard(num)
        if isinstance(x, Stream):
            x.num = num
        self._cache[num] = x
        return x

    def resolve(self, x):
        if type(x) is not Ref:
            return x
        n = 0
        while isinstance(x, Ref):
            x, n = self.get(x.num), n + 1
            if n > MAX_CHASE:
                raise DocumentError("references form a cycle")
        return x

    def fork(self) -> Document:
        """Shares what doesn't change, the bytes and tables, and has caches of its own."""
        twin = type(self).__new__(type(self))
        twin.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("_pages", "part")})
        twin._cache, twin._busy, twin._stores = {}, set(), {}
        return twin

    def stream_data(self, s: Stream) -> bytes:
        return filters.decode(s.attrs, s.data, self.resolve, stop_at_image=False)

    def image_data(self, s: Stream):
        """(bytes, "samples"), or for a codec that has its own size (pixels h x w x n, "pixels")."""
        name, parms, data = filters.to_image(s.attrs, s.data, self.resolve)
        if name == "DCTDecode":
            return jpeg.decode(data, parms.get("ColorTransform")), "pixels"
        if name is not None:
            raise filters.Unsupported(name)
        return data, "samples"

    # pages

    def declared_pages(self) -> int:
        root = self.resolve(self.trailer.get("Root"))
        pages = self.resolve(root.get("Pages")) if isinstance(root, dict) else None
        n = self.resolve(pages.get("Count")) if isinstance(pages, dict) else None
        return n if type(n) is int and 0 <= n <= len(self.xref) else len(self.pages)

    @property
    def pages(self) -> list[Page]:
        if not hasattr(self, "_pages"):
            out: list[Page] = []
            root = self.resolve(self.trailer.get("Root"))
            top = root.get("Pages") if isinstance(root, dict) else None
            stack, seen = [(top, {}, 0)], set()
            while stack:
                at, up, depth = stack.pop()
                if isinstance(at, Ref):
                    if at.num in seen:
                        continue
                    seen.add(at.num)
                node = self.resolve(at)
                if not isinstance(node, dict) or depth > MAX_TREE:
                    continue
                if isinstance(self.resolve(node.get("Kids")), list):
                    down = {**up, **{k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}}
                    stack += [(kid, down, depth + 1) for kid in reversed(self.resolve(node["Kids"]))]
                elif node.get("Type", "Page") == "Page":
                    out.append(Page(self, at if isinstance(at, Ref) else None, node, up))
            self._pages = out
        return self._pages

    def metadata(self) -> dict[str, str | None]:
        info = self.resolve(self.trailer.get("Info"))
        get = lambda k: self.resolve(info.get(k)) if isinstance(info, dict) else None
        return {k: text_string(v) if isinstance(v := get(k), bytes) else None for k in METADATA}

    # elements

    def elements(self, physical: bool = True, logical: bool = True, content_ops: bool = False, pages: set[int] | None = None):
        """Rows of one table: bytes in file order, then pages with what they use. Each has kind, span, ref, page, container and value or error."""
        if physical:
            yield from sorted(self._physical(), key=lambda r: r["order"])
        if logical:
            yield from self._logical(content_ops, pages)

    def _physical(self):
        row = lambda kind, span, order=None, **k: {"kind": kind, "span": span, "ref": None, "page": None, "in_objstm": None, "value": None, "error": None, "order": (order if order is not None else span[0], -1, 0)} | k
        if h := header_span(self.data):
            yield row("header", h, value=self.data[h[0] : h[1]].decode("latin-1"))
        for num, e in self.xref.items():
            if e.kind == "free":
                continue
            home = self.xref.get(e.a) if e.kind == "stream" else None
            place = (e.a, -1, num) if e.kind == "file" else ((home.a, e.b, num) if home and home.kind == "file" else (1 << 62, e.b, num))
            try:
                x, span, inside = self.located(num)
                if not isinstance(x, Stream):  # the pages that follow needn't read it again
                    self._cache.setdefault(num, x)
                gen = e.b if e.kind == "file" else 0
                yield {"kind": "object", "span": span, "ref": (num, gen), "page": None, "in_objstm": inside, "value": x, "error": None, "order": place}
            except (ParseError, ValueError, RecursionError) as err:
                yield row("object", None, 0, ref=(num, 0), error=str(err)) | {"order": place}
        for s in self.sections:
            if s.kind != "recovered":
                yield row("xref", (s.start, s.end), value=s.trailer if s.kind == "table" else None)
        if s := startxref(self.data):
            yield row("startxref", s[1:], value=s[0])
        if e := eof_span(self.data):
            yield row("eof", e)

    def _logical(self, content_ops: bool, only: set[int] | None):
        row = lambda kind, page, **k: {"kind": kind, "span": None, "ref": None, "page": page, "in_objstm": None, "value": None, "error": None} | k
        for k, p in enumerate(self.pages):
            if only is not None and k not in only:
                continue
            yield row("page", k, ref=p.ref, value=p.attrs)
            for group, kind in (("Font", "font"), ("XObject", "image")):
                named = self.resolve(p.resources.get(group))
                for name in sorted(named) if isinstance(named, dict) else []:
                    r = named[name]
                    x = self.resolve(r)
                    if isinstance(r, Ref) and (kind == "font" or isinstance(x, Stream) and x.attrs.get("Subtype") == "Image"):
                        yield row(kind, k, ref=r, value=x if isinstance(x, dict) else x.attrs if isinstance(x, Stream) else None)
            for r in self.resolve(p.attrs.get("Annots")) or []:
                yield row("annotation", k, ref=r if isinstance(r, Ref) else None, value=self.resolve(r))
            if content_ops:
                from .content import operators

                try:
                    for op, operands, a, b in operators(p.content()):
                        yield row("op", k, span=(a, b), value={"op": Name(op), "operands": operands})
                except (filters.Unsupported, filters.Undecodable) as err:
                    yield row("op", k, error=str(err))


#: The keys of the document information dictionary.
METADATA = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
