"""Content streams: operators, positioned text spans, drawn rulings, and a record of everything that was left out."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from typing import NamedTuple

from . import filters, fonts
from .objects import Name, Op, Parser, ParseError, Ref, Stream

#: Short keys and names of inline images.
INLINE = {
    "BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width", "G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK",
}
_EI = re.compile(rb"(?<=[\0\t\n\f\r ])EI(?=[\0\t\n\f\r ]|$)")
#: The operators of content streams, by family.
OPERATORS = {
    "state": "q Q cm w J j M d ri i gs", "path": "m l c v y h re", "paint": "S s f F f* B B* b b* n", "clip": "W W*", "text object": "BT ET", "text state": "Tc Tw Tz TL Tf Tr Ts", "text position": "Td TD Tm T*",
    "text showing": "Tj TJ ' \"", "type 3": "d0 d1", "color": "CS cs SC SCN sc scn G g RG rg K k", "shading": "sh", "inline image": "BI", "object": "Do", "marked content": "MP DP BMC BDC EMC", "compatibility": "BX EX",
}
KNOWN = {op: family for family, ops in OPERATORS.items() for op in ops.split()}
MAX_FORM_DEPTH, MAX_FORMS = 16, 4096
_tuple = tuple.__new__


class Span(NamedTuple):
    text: str
    x: float
    y: float
    end_x: float
    size: float
    font: str
    bold: bool
    italic: bool


class Ruling(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    width: float


#: The common tokens at one go: a number, a string without escapes, a plain name, a keyword. What doesn't match is left to the parser.
_FAST = re.compile(rb"[\0\t\n\f\r ]*(?:([+-]?(?:\d{1,15}(?:\.\d*)?|\.\d+))(?![^\0\t\n\f\r ()<>\[\]{}/%])|\(([^()\\\r]*)\)|/([!-\x22$-&*-.0-;=?-Z\\^-z|~]+)(?![^\0\t\n\f\r ()<>\[\]{}/%])|([A-Za-z'\"]\*?[A-Za-z0-9*]*)(?![^\0\t\n\f\r ()<>\[\]{}/%]))")
_CONSTANTS = {b"true", b"false", b"null"}
#: A whole operation at one go: a name, up to six numbers, a string without escapes, each or none, and the keyword.
_WHOLE = re.compile(rb"[\0\t\n\f\r ]*+((?:/([!-\x22$-&*-.0-;=?-Z\\^-z|~]++)[\t\n\f\r ]++)?((?:[+-]?(?:\d{1,15}(?:\.\d*)?|\.\d+)[\t\n\f\r ]++){0,6}+)(?:\(([^()\\\r]*+)\)[\0\t\n\f\r ]*+)?)([A-Za-z'\"]\*?[A-Za-z0-9*]*)(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_WHOLE_OPS = {op.encode(): op for op in KNOWN if op != "BI"}
_NUMBERS = {int, float}
#: The same with its string's marks, for streams that consist of such operations.
_EACH = re.compile(rb"([\0\t\n\f\r ]*+(?:/([!-\x22$-&*-.0-;=?-Z\\^-z|~]++)[\t\n\f\r ]++)?((?:[+-]?(?:\d{1,15}(?:\.\d*)?|\.\d+)[\t\n\f\r ]++){0,6}+)(?:(\([^()\\\r]*+\))[\0\t\n\f\r ]*+)?([A-Za-z'\"]\*?[A-Za-z0-9*]*)(?![^\0\t\n\f\r ()<>\[\]{}/%]))")
_name = functools.lru_cache(1024)(lambda raw: Name(raw.decode("ascii")))
MOST_EACH = 1 << 16


def operations(data: bytes):
    """(operator, operands) in order, as `operators` has them; a stream of whole operations alone, unless it is long, is read at one go."""
    found = _EACH.findall(data) if len(data) <= MOST_EACH else []
    # what no operation covers is the white space at the end, or there is something else between them
    if sum([len(x[0]) for x in found]) != len(data.rstrip(b"\0\t\n\f\r ")) or not all([x[4] in _WHOLE_OPS for x in found]):
        for op, v, _, _ in operators(data):
            yield op, v
        return
    for _, name, numbers, text, op in found:
        v = [_name(name)] if name else []
        if numbers:
            v += [float(x) if b"." in x else int(x) for x in numbers.split()] if b"." in numbers else map(int, numbers.split())
        if text:
            v.append(text[1:-1])
        yield _WHOLE_OPS[op], v


def operators(data: bytes):
    """(operator, operands, first byte, end) in order; unknown operators are dropped with their operands, an inline image is one BI."""
    p, operands, start, at, fast, whole = Parser(data, 0, refs=False), [], None, 0, _FAST.match, _WHOLE.match
    while True:
        if start is None and (m := whole(data, at)) and (op := _WHOLE_OPS.get(m[5])):
            name, numbers, text = m.group(2, 3, 4)
            v = [] if name is None else [Name(name.decode("ascii"))]
            if numbers:
                v += [float(x) if b"." in x else int(x) for x in numbers.split()] if b"." in numbers else map(int, numbers.split())
            if text is not None:
                v.append(text)
            at = m.end()
            yield op, v, m.start(1), at
            continue
        m = fast(data, at)
        kind = m.lastindex if m else 0
        if kind and not (kind == 4 and m[4] in _CONSTANTS):
            if start is None:
                start = m.start(kind) - (kind in (2, 3))
            at = m.end()
            raw = m[kind]
            if kind == 1:
                operands.append(float(raw) if b"." in raw else int(raw))
            elif kind == 2:
                operands.append(raw)
            elif kind == 3:
                operands.append(Name(raw.decode("ascii")))
            if kind < 4:
                if len(operands) > 4096:
                    operands = operands[-64:]
                continue
            x = Op(raw.decode("ascii"))
        else:
            p.pos = at
            at = p.skip()
            if at >= len(data):
                return
            start = at if start is None else start
            try:
                x = p.value()
            except ParseError:
                at = max(p.pos, at + 1)
                continue
            at = p.pos
            if not isinstance(x, Op):
                operands.append(x)
                continue
        if x == "BI":
            p.pos, attrs = at, {}
            while True:
                try:
                    k = p.value()
                    if isinstance(k, Op):
                        break
                    v = p.value()
                except ParseError:
                    break
                if isinstance(v, Op):
                    break
                full = INLINE.get(str(k), str(k))
                attrs[full] = Name(INLINE.get(str(v), str(v))) if full == "ColorSpace" and isinstance(v, Name) else v
            body = p.pos + 1
            m = _EI.search(data, body)
            end, at = (m.start() - 1, m.end()) if m else (len(data), len(data))
            yield "BI", [Stream(attrs, data[body : max(body, end)])], start, at
        elif x in KNOWN:
            yield str(x), operands, start, at
        operands, start = [], None


def concat(m, n):
    """The product of two row-vector matrices: m first, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o


def apply(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def invert(m):
    det = m[0] * m[3] - m[1] * m[2]
    if not det or not math.isfinite(det):
        return None
    a, b, c, d = m[3] / det, -m[1] / det, -m[2] / det, m[0] / det
    return a, b, c, d, -(m[4] * a + m[5] * c), -(m[4] * b + m[5] * d)


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: The frame of a text object.
_BARE = {"BT", "ET"}
_FRESH = {"font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "ts": 0.0, "line": 1.0}


def segment_ruling(a, b, width: float) -> Ruling | None:
    """An axis-aligned segment of at least 8 points."""
    (x0, y0), (x1, y1) = a, b
    if max(abs(x1 - x0), abs(y1 - y0)) < 8 or min(abs(x1 - x0), abs(y1 - y0)) > 0.5:
        return None
    return Ruling(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1), width)


def box_ruling(a, b) -> Ruling | None:
    """The centre line of a thin box: at most 3 points thick, at least 8 long."""
    x0, x1, y0, y1 = min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
    w, h = x1 - x0, y1 - y0
    if min(w, h) > 3 or max(w, h) < 8:
        return None
    m = (y0 + y1) / 2 if h <= w else (x0 + x1) / 2
    return Ruling(x0, m, x1, m, h) if h <= w else Ruling(m, y0, m, y1, w)


#: What an error means for a report, the first that fits.
_CAUSES = ((filters.Unsupported, "UnsupportedFilter"), (ParseError, "Parse"), ((RecursionError, OverflowError), "LimitExceeded"), (KeyError, "Missing"))


class Reader:
    """Walks a page's operators. font_cache is shared by the pages of a document."""

    def __init__(self, doc, font_cache: dict):
        self.doc, self.fonts = doc, font_cache
        self.spans: list[Span] = []
        self.rulings: list[Ruling] = []
        self.skips: Counter = Counter()
        self.forms = 0

    def skip(self, kind: str, err: Exception) -> None:
        cause = next((c for kinds, c in _CAUSES if isinstance(err, kinds)), "Unreadable")
        self.skips[kind, cause, str(err)] += 1

    def page(self, page) -> None:
        try:
            data = page.content()
        except (filters.Unsupported, filters.Undecodable) as e:
            self.skip("PageContents", e)
            return
        self.run(data, [page.resources], IDENTITY, 0)

    def _resource(self, scopes: list[dict], group: str, name):
        for s in scopes:
            d = self.doc.resolve(s.get(group))
            if isinstance(d, dict) and d.get(str(name)) is not None and self.doc.resolve(d[str(name)]) is not None:
                return d[str(name)]
        return None

    def run(self, data: bytes, scopes: list[dict], ctm, depth: int) -> None:
        st, stack = dict(_FRESH), []
        tm = tlm = IDENTITY
        path: list = []  # subpaths: lists of points; a box is ("re", a, b)
        curved, at = False, None
        named: dict = {}  # fonts by the names of these scopes
        for op, v in operations(data):
            if op == "Tj":
                if v and isinstance(v[-1], bytes):
                    tm = self.show(v[-1], st, tm, ctm)
                continue
            if not v and op in _BARE:
                if op == "BT":
                    tm = tlm = IDENTITY
                continue
            n = [x for x in v if type(x) in _NUMBERS]
            if op == "Td" and len(n) >= 2:
                a, b, c, d, e, f = tlm
                tm = tlm = a, b, c, d, n[-2] * a + n[-1] * c + e, n[-2] * b + n[-1] * d + f
            elif op == "Tm" and len(n) >= 6:
                tm = tlm = tuple(map(float, n[-6:]))
            elif op == "q":
                stack.append((ctm, dict(st)))
            elif op == "Q":
                if stack:
                    ctm, st = stack.pop()
            elif op == "cm" and len(n) >= 6:
                ctm = concat(n[-6:], ctm)
            elif op == "BT":
                tm = tlm = IDENTITY
            elif op == "Tf" and len(v) >= 2 and n:
                k = v[-2]
                if type(k) is not Name:
                    r = self._resource(scopes, "Font", k)
                    font = fonts.load(self.doc, r, self.fonts) if r is not None else None
                elif k in named:
                    font = named[k]
                else:
                    r = self._resource(scopes, "Font", k)
                    font = named[k] = fonts.load(self.doc, r, self.fonts) if r is not None else None
                st["font"], st["size"] = font, float(n[-1])
            elif op == "TD" and len(n) >= 2:
                st["tl"] = -n[-1]
                a, b, c, d, e, f = tlm
                tm = tlm = a, b, c, d, n[-2] * a + n[-1] * c + e, n[-2] * b + n[-1] * d + f
            elif op == "T*":
                tm = tlm = concat((1, 0, 0, 1, 0, -st["tl"]), tlm)
            elif op in ("Tc", "Tw", "TL", "Ts") and n:
                st[op.lower()] = n[-1]
            elif op == "Tz" and n:
                st["tz"] = n[-1] / 100
            elif op in ("'", '"') and v and isinstance(v[-1], bytes):
                if op == '"' and len(n) >= 2:
                    st["tw"], st["tc"] = n[0], n[1]
                tm = tlm = concat((1, 0, 0, 1, 0, -st["tl"]), tlm)
                tm = self.show(v[-1], st, tm, ctm)
            elif op == "TJ" and v and isinstance(v[-1], list):
                for x in v[-1]:
                    if isinstance(x, bytes):
                        tm = self.show(x, st, tm, ctm)
                    elif isinstance(x, (int, float)):
                        tm = concat((1, 0, 0, 1, -x / 1000 * st["size"] * st["tz"], 0), tm)
            elif op == "w" and n:
                st["line"] = n[-1]
            elif op == "m" and len(n) >= 2:
                at = apply(ctm, *n[-2:])
                path.append([at])
            elif op == "l" and len(n) >= 2 and path:
                at = apply(ctm, *n[-2:])
                if path[-1][0] == "re":
                    path.append([path[-1][1]])
                path[-1].append(at)
            elif op == "h" and path and path[-1][0] != "re":
                path[-1].append(path[-1][0])
            elif op == "re" and len(n) >= 4:
                x, y, w, h = n[-4:]
                path.append(["re", apply(ctm, x, y), apply(ctm, x + w, y + h)])
            elif op in ("c", "v", "y"):
                curved = True
            elif op in KNOWN and KNOWN[op] == "paint":
                if op in ("s", "b", "b*") and path and path[-1][0] != "re":
                    path[-1].append(path[-1][0])
                if not curved and op != "n":
                    self.commit(path, op in ("S", "s", "B", "B*", "b", "b*"), op not in ("S", "s"), st["line"] * math.sqrt(abs(ctm[0] * ctm[3] - ctm[1] * ctm[2])))
                path, curved = [], False
            elif op == "gs" and v:
                r = self.doc.resolve(self._resource(scopes, "ExtGState", v[-1]))
                f = self.doc.resolve(r.get("Font")) if isinstance(r, dict) else None
                if isinstance(f, list) and len(f) == 2 and isinstance(f[1], (int, float)):
                    st["font"], st["size"] = fonts.load(self.doc, f[0], self.fonts), float(f[1])
            elif op == "Do" and v:
                self.form(self.doc.resolve(self._resource(scopes, "XObject", v[-1])), scopes, ctm, depth)

    def form(self, x, scopes, ctm, depth: int) -> None:
        if not isinstance(x, Stream) or x.attrs.get("Subtype") != "Form":
            return
        self.forms += 1
        if depth >= MAX_FORM_DEPTH or self.forms > MAX_FORMS:
            self.skips["Form", "LimitExceeded", "nested forms"] += 1
            return
        try:
            data = self.doc.stream_data(x)
        except (filters.Unsupported, filters.Undecodable) as e:
            self.skip("Form", e)
            return
        m = self.doc.resolve(x.attrs.get("Matrix"))
        m = [self.doc.resolve(v) for v in m] if isinstance(m, list) else []
        own = self.doc.resolve(x.attrs.get("Resources"))
        self.run(data, [own, *scopes] if isinstance(own, dict) else scopes, concat(m, ctm) if len(m) == 6 and all(isinstance(v, (int, float)) for v in m) else ctm, depth + 1)

    def show(self, s: bytes, st: dict, tm, ctm):
        font = st["font"]
        if font is None:
            return tm
        size = st["size"]
        text, w, n, spaces = font.show(s)
        dx = (w * size + n * st["tc"] + spaces * st["tw"]) * st["tz"]
        a, b, c, d, e, f = tm
        if text:
            g, h, i, j, k, o = tm if ctm is IDENTITY else concat(tm, ctm)
            ts, k, o = st["ts"], k + 0.0, o + 0.0
            self.spans.append(_tuple(Span, (text, i * ts + k, j * ts + o, g * dx + i * ts + k, abs(size) * math.hypot(i, j), font.name, font.bold, font.italic)))
        return a, b, c, d, dx * a + e, dx * b + f

    def commit(self, path, stroke: bool, fill: bool, width: float) -> None:
        for sub in path:
            if sub[0] == "re":
                _, a, b = sub
                thin = box_ruling(a, b)
                if fill and not stroke or thin:
                    if thin:
                        self.rulings.append(thin)
                    continue
                sub = [a, (b[0], a[1]), b, (a[0], b[1]), a]
            elif fill and not stroke:
                xs, ys = [p[0] for p in sub], [p[1] for p in sub]
                if len(sub) >= 4 and (r := box_ruling((min(xs), min(ys)), (max(xs), max(ys)))):
                    self.rulings.append(r)
                continue
            for a, b in zip(sub, sub[1:], strict=False):
                if r := segment_ruling(a, b, width):
                    self.rulings.append(r)


def read_page(doc, page, font_cache: dict) -> Reader:
    r = Reader(doc, font_cache)
    try:
        r.page(page)
    except (TypeError, ValueError, KeyError, IndexError, AttributeError, OverflowError, RecursionError) as e:
        r.skip("PageContents", e)
    return r


__all__ = ["INLINE", "KNOWN", "OPERATORS", "Reader", "Ref", "Ruling", "Span", "apply", "concat", "invert", "operators", "read_page"]
