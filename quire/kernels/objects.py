"""PDF objects: a lexer and a recursive parser over bytes.

Values are None, bool, int, float, bytes (strings), Name, list, dict, Ref and Stream; a content keyword is an Op.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Name(str):
    __slots__ = ()

    def __repr__(self):
        return "/" + str(self)


class Op(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    __slots__ = ("attrs", "data", "num")

    def __init__(self, attrs: dict, data: bytes):
        self.attrs, self.data, self.num = attrs, data, None


class ParseError(ValueError):
    pass


class TooDeep(ParseError):
    pass


MAX_DEPTH = 128
_WS = b"\0\t\n\f\r "
_GAP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_REF = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESC = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
_STR = re.compile(rb"[\\()\r]")
_NAME_ESC = re.compile(rb"#([0-9A-Fa-f]{2})")
#: The common entry of a dictionary at one go: a plain name, then a plain name, a reference, a number or a string without escapes. What doesn't match is left to the parser.
_PLAIN_NAME = rb"([!\x22$&'*-.0-;=?-Z\\^-z|~]+)"
_PAIR = re.compile(rb"[\0\t\n\f\r ]*/" + _PLAIN_NAME + rb"[\0\t\n\f\r ]*(?:/" + _PLAIN_NAME + rb"(?=[\0\t\n\f\r ()<>\[\]/])|(?<=[\0\t\n\f\r ])(?:(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?=[\0\t\n\f\r ()<>\[\]/])|([+-]?\d{1,15}(?:\.\d+)?)(?=[\0\t\n\f\r ]*[/>]))|\(([^()\\\r]*)\))")
#: A plain name before a dictionary or array; arrays of numbers, and of references.
_OPENS = re.compile(rb"/" + _PLAIN_NAME + rb"[\0\t\n\f\r ]*(?:<<|(?=\[))")
_NUMBERS = re.compile(rb"\[[\t\n\f\r ]*+((?:[+-]?\d{1,15}(?:\.\d+)?(?:[\t\n\f\r ]++|(?=\])))++)\]")
_REFS = re.compile(rb"\[[\t\n\f\r ]*+((?:\d{1,10}[\t\n\f\r ]++\d{1,5}[\t\n\f\r ]++R(?:[\t\n\f\r ]++|(?=\])))++)\]")
_CONST = {b"true": True, b"false": False, b"null": None}
_END = object()


class Parser:
    """Reads one object at a time from `pos`. refs: `n g R` is a reference (files) or not (content streams)."""

    def __init__(self, data: bytes, pos: int = 0, refs: bool = True):
        self.data, self.pos, self.refs = data, pos, refs

    def skip(self) -> int:
        self.pos = _GAP.match(self.data, self.pos).end()
        return self.pos

    def value(self, depth: int = 0):
        """The next object; Op for a keyword; ParseError at the end of data or for a stray closing mark."""
        if depth > MAX_DEPTH:
            raise TooDeep("nested too deeply")
        d, p = self.data, self.skip()
        if p >= len(d):
            raise ParseError("end of data")
        c = d[p]
        if c == 47:
            m = _REGULAR.match(d, p + 1)
            self.pos = m.end() if m else p + 1
            raw = m[0] if m else b""
            if b"#" in raw:
                raw = _NAME_ESC.sub(lambda x: bytes([int(x[1], 16)]), raw)
            return Name(raw.decode("utf-8", "surrogateescape") if _is_utf8(raw) else raw.decode("latin-1"))
        if c == 40:
            return self._string(p + 1)
        if c == 60:
            if d[p + 1 : p + 2] == b"<":
                self.pos = p + 2
                return self._dict(depth)
            end = d.find(b">", p)
            end = len(d) if end < 0 else end
            self.pos = min(len(d), end + 1)
            try:
                return bytes.fromhex(d[p + 1 : end].decode("ascii"))
            except ValueError:
                pass
            h = re.sub(rb"[^0-9A-Fa-f]", b"", d[p + 1 : end])
            return bytes.fromhex((h + b"0" * (len(h) & 1)).decode())
        if c == 91:
            if depth < MAX_DEPTH:
                if m := _NUMBERS.match(d, p):
                    self.pos = m.end()
                    return [float(x) if b"." in x else int(x) for x in m[1].split()]
                if self.refs and (m := _REFS.match(d, p)):
                    self.pos = m.end()
                    v = m[1].split()
                    return list(map(Ref, map(int, v[::3]), map(int, v[1::3])))
            self.pos, out = p + 1, []
            while True:
                x = self._item(depth, b"]")
                if x is _END:
                    return out
                out.append(x)
        m = _REGULAR.match(d, p)
        if not m:
            self.pos = p + (2 if d[p : p + 2] == b">>" else 1)
            raise ParseError(f"stray {chr(c)}")
        raw = m[0]
        if c <= 57 and (c >= 48 or c in b"+-."):
            if self.refs and 48 <= c and (r := _REF.match(d, p)):
                self.pos = r.end()
                return Ref(int(r[1]), int(r[2]))
            self.pos = m.end()
            return number(raw)
        self.pos = m.end()
        return _CONST[raw] if raw in _CONST else Op(raw.decode("latin-1"))

    def _item(self, depth: int, end: bytes):
        while True:
            p = self.skip()
            if p >= len(self.data):
                return _END
            if self.data.startswith(end, p):
                self.pos = p + len(end)
                return _END
            try:
                x = self.value(depth + 1)
            except TooDeep:
                raise
            except ParseError:
                continue
            if isinstance(x, Op):
                if x in ("endobj", "endstream", "stream"):  # the closing mark is missing
                    self.pos = p
                    return _END
                continue
            return x

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        d, pair = self.data, _PAIR.match if self.refs and depth < MAX_DEPTH else None
        while True:
            while pair and (m := pair(d, self.pos)):
                name, num, gen, n, text = m.group(2, 3, 4, 5, 6)
                if num is not None:
                    v = Ref(int(num), int(gen))
                elif name is not None:
                    v = Name(name.decode("ascii"))
                elif n is not None:
                    v = float(n) if b"." in n else int(n)
                else:
                    v = text
                out[m[1].decode("ascii")] = v
                self.pos = m.end()
            p = _GAP.match(d, self.pos).end()
            if d.startswith(b">>", p):
                self.pos = p + 2
                return out
            if pair and (m := _OPENS.match(d, p)):
                self.pos = m.end()
                out[m[1].decode("ascii")] = self.value(depth + 1) if d[self.pos - 1] != 60 else self._dict(depth + 1)
                continue
            k = self._item(depth, b">>")
            if k is _END:
                return out
            if not isinstance(k, Name):
                continue
            if self.data.startswith(b">>", self.skip()):
                self.pos += 2
                return out
            v = self._item(depth, b">>")
            if v is _END:
                return out
            if v is not None:
                out[str(k)] = v

    def _string(self, p: int) -> bytes:
        d, out, level = self.data, bytearray(), 1
        while True:
            m = _STR.search(d, p)
            if not m:
                out += d[p:]
                self.pos = len(d)
                return bytes(out)
            q = m.start()
            out += d[p:q]
            c, p = d[q], q + 1
            if c == 40:
                level += 1
                out.append(c)
            elif c == 41:
                level -= 1
                if not level:
                    self.pos = p
                    return bytes(out)
                out.append(c)
            elif c == 13:
                out.append(10)
                p += d[p : p + 1] == b"\n"
            else:
                e = d[p] if p < len(d) else 92
                p += 1
                if e in _ESC:
                    out.append(_ESC[e])
                elif 48 <= e <= 55:
                    n = p
                    while n < p + 2 and n < len(d) and 48 <= d[n] <= 55:
                        n += 1
                    out.append(int(d[p - 1 : n], 8) & 255)
                    p = n
                elif e == 13:
                    p += d[p : p + 1] == b"\n"
                elif e != 10:
                    out.append(e)


def _is_utf8(b: bytes) -> bool:
    try:
        b.decode()
        return True
    except UnicodeDecodeError:
        return False


def number(raw: bytes):
    """An int or float; what follows a second sign or point is left out, and junk is 0."""
    if not _NUMBER.match(raw):
        m = re.match(rb"[+-]*(\d*\.?\d*)", raw)
        body = m[1].rstrip(b".") if m else b""
        if not body or body == b".":
            return 0
        raw = (b"-" if raw.startswith(b"-") else b"") + body
    if b"." in raw:
        return float(raw)
    n = int(raw)
    return n if -(1 << 63) <= n < 1 << 63 else float(n)


_HEAD = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ENDSTREAM = re.compile(rb"\r?\n?endstream")
#: A dictionary without others, arrays, strings and comments: it means the same wherever it stands, and many objects have the same few.
_FLAT = re.compile(rb"<<[^<>()\[\]{}%]{0,200}+>>")
_FLATS: dict[bytes, dict | None] = {}
MOST_FLATS = 4096


def _flat(raw: bytes) -> dict | None:
    """What such a dictionary says, a copy for each caller; None if it isn't closed where it seems to be."""
    if raw not in _FLATS:
        if len(_FLATS) >= MOST_FLATS:
            _FLATS.clear()
        p = Parser(raw, 2)
        x = p._dict(0)
        _FLATS[raw] = x if p.pos == len(raw) else None
    x = _FLATS[raw]
    return None if x is None else x.copy()


#: An object that is such a dictionary, or a stream of one, up to its data; and what closes a stream of the length told.
_OBJECT = re.compile(rb"[\0\t\n\f\r ]*+(\d{1,10})[\0\t\n\f\r ]++(\d{1,5})[\0\t\n\f\r ]++obj[\0\t\n\f\r ]*+(<<[^<>()\[\]{}%]{0,200}+>>)[\0\t\n\f\r ]*+(endobj|stream(?:\r\n|\n|\r)?)")
_CLOSED = re.compile(rb"[\0\t\n\f\r ]*+endstream[\0\t\n\f\r ]*+endobj")


def indirect(data: bytes, offset: int, length=None) -> tuple[Ref, object, int, int]:
    """(ref, object, start, end) of `n g obj … endobj` at an offset; a missing endobj is tolerated. length: resolves a stream's /Length."""
    if (m := _OBJECT.match(data, max(0, offset))) and (x := _flat(m[3])) is not None:
        if m[4] == b"endobj":
            return Ref(int(m[1]), int(m[2])), x, m.start(1), m.end()
        s, n = m.end(), x.get("Length")
        if type(n) is int and 0 <= n <= len(data) - s and (end := _CLOSED.match(data, s + n)):
            return Ref(int(m[1]), int(m[2])), Stream(x, data[s : s + n]), m.start(1), end.end()
    p = _GAP.match(data, max(0, offset)).end()
    m = _HEAD.match(data, p)
    if not m:
        raise ParseError("no object here")
    parser = Parser(data, _GAP.match(data, m.end()).end())
    if (flat := _FLAT.match(data, parser.pos)) and (x := _flat(flat[0])) is not None:
        parser.pos = flat.end()
    elif data.startswith(b"<<", parser.pos):
        parser.pos += 2
        try:
            x = parser._dict(0)
        except ParseError:
            x = None
    else:
        try:
            x = parser.value()
        except ParseError:
            x = None
        if isinstance(x, Op):
            x = None
    parser.skip()
    if isinstance(x, dict) and data.startswith(b"stream", parser.pos):
        s = parser.pos + 6
        s += 2 if data[s : s + 2] == b"\r\n" else 1 if data[s : s + 1] in (b"\n", b"\r") else 0
        n = x.get("Length")
        n = length(n) if length and isinstance(n, Ref) else n
        e = s + n if isinstance(n, int) and n >= 0 else -1
        if e < 0 or e > len(data) or not data.startswith(b"endstream", _GAP.match(data, e).end()):
            found = _ENDSTREAM.search(data, s)
            e, parser.pos = (found.start(), found.end()) if found else (len(data), len(data))
        else:
            parser.pos = _GAP.match(data, e).end() + 9
        x = Stream(x, data[s:e])
        parser.skip()
    if data.startswith(b"endobj", parser.pos):
        parser.pos += 6
    return Ref(int(m[1]), int(m[2])), x, p, parser.pos


def text_string(b: bytes | None) -> str | None:
    """A text string: UTF-16BE or UTF-8 by its byte order mark, else Latin-1."""
    if b is None:
        return None
    if b[:2] == b"\xfe\xff":
        return b[2:].decode("utf-16-be", "replace")
    if b[:3] == b"\xef\xbb\xbf":
        return b[3:].decode("utf-8", "replace")
    return b.decode("latin-1")


def pretty(x, indent: int = 0) -> str:
    """An object as indented text; short arrays stay on a line."""
    pad = "  " * indent
    if isinstance(x, Stream):
        return f"{pretty(x.attrs, indent)} stream[{len(x.data)} bytes]"
    if isinstance(x, dict):
        if not x:
            return "<< >>"
        return "<<\n" + "".join(f"{pad}  /{k} {pretty(v, indent + 1)}\n" for k, v in sorted(x.items())) + pad + ">>"
    if isinstance(x, list):
        flat = "[" + " ".join(pretty(v, indent + 1) for v in x) + "]"
        return flat if len(flat) <= 60 and "\n" not in flat else "[\n" + "".join(f"{pad}  {pretty(v, indent + 1)}\n" for v in x) + pad + "]"
    if isinstance(x, Ref):
        return f"{x.num} {x.gen} R"
    if isinstance(x, Name):
        return "/" + x
    if isinstance(x, bytes):
        s = text_string(x)
        return f"({s})" if s.isprintable() else f"<{x.hex()}>"
    return {None: "null", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else f"{x:g}" if isinstance(x, float) else str(x)
