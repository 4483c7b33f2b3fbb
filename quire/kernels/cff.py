"""Outlines of compact fonts (Type 2 charstrings) and of Type 1 fonts. Paths are in thousandths of an em, as those of glyphs.py."""

from __future__ import annotations

import re

from .fonts import STANDARD_NAMES

MAX_STEPS, MAX_DEPTH = 100_000, 12


def _standard_strings() -> list[str]:
    """Names of the first 229 standard strings: the standard encoding in its order, some symbols, and accented letters, capital before small."""
    symbols = "onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior registered minus eth multiply threesuperior copyright"
    accented = (
        "Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex Idieresis Igrave Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex "
        "Udieresis Ugrave Yacute Ydieresis Zcaron"
    ).split()
    return [".notdef", *[n for n in STANDARD_NAMES if n], *symbols.split(), *accented, *[n[0].lower() + n[1:] for n in accented]]


STRINGS = _standard_strings()
_MANY = 391  # standard strings in all; a font's own follow


class _Index:
    """A list of byte strings."""

    def __init__(self, d: bytes, at: int):
        self.items, n = [], int.from_bytes(d[at : at + 2], "big")
        self.end = at + 2
        if n:
            size = d[at + 2]
            if not 1 <= size <= 4 or at + 3 + (n + 1) * size > len(d):
                raise ValueError("index")
            off = [int.from_bytes(d[at + 3 + k * size : at + 3 + (k + 1) * size], "big") for k in range(n + 1)]
            base = at + 2 + (n + 1) * size
            self.items = [d[base + a : base + b] for a, b in zip(off, off[1:], strict=False)]
            self.end = base + off[-1]


def _dict(d: bytes) -> dict[int, list[float]]:
    """Operands by operator; 1200 and more for the two-byte ones."""
    out, stack, k = {}, [], 0
    while k < len(d):
        b = d[k]
        k += 1
        if b <= 21:
            if b == 12 and k < len(d):
                b, k = 1200 + d[k], k + 1
            out[b], stack = stack, []
        elif b == 28:
            stack.append(int.from_bytes(d[k : k + 2], "big", signed=True))
            k += 2
        elif b == 29:
            stack.append(int.from_bytes(d[k : k + 4], "big", signed=True))
            k += 4
        elif b == 30:
            s = ""
            while k < len(d) and "f" not in s:
                s += f"{d[k]:02x}"
                k += 1
            s = s.split("f")[0].replace("a", ".").replace("b", "E").replace("c", "E-").replace("e", "-")
            try:
                stack.append(float(s))
            except ValueError:
                stack.append(0.0)
        elif 32 <= b <= 246:
            stack.append(b - 139)
        elif 247 <= b <= 254 and k < len(d):
            stack.append((b - 247) * 256 + d[k] + 108 if b < 251 else -(b - 251) * 256 - d[k] - 108)
            k += 1
    return out


class CFF:
    """glyph numbers by name, character identifier or code, and their paths."""

    def __init__(self, d: bytes):
        if d[:4] == b"OTTO":
            tables = {d[12 + 16 * k : 16 + 16 * k]: (int.from_bytes(d[20 + 16 * k : 24 + 16 * k], "big"), int.from_bytes(d[24 + 16 * k : 28 + 16 * k], "big")) for k in range(int.from_bytes(d[4:6], "big"))}
            at, n = tables.get(b"CFF ", (0, 0))
            d = d[at : at + n]
        if len(d) < 4 or d[0] != 1:
            raise ValueError("compact font")
        names = _Index(d, d[2])
        tops = _Index(d, names.end)
        strings = _Index(d, tops.end)
        self.globals = _Index(d, strings.end).items
        if not tops.items:
            raise ValueError("compact font")
        top = _dict(tops.items[0])
        number = lambda t, k, z: int(t[k][0]) if t.get(k) else z
        self.glyphs = _Index(d, number(top, 17, len(d))).items
        n = len(self.glyphs)
        self.by_cid = 1230 in top
        m = top.get(1207, [])
        self.unit = m[0] * 1000 if len(m) == 6 and m[0] else 1.0

        def private(t):
            size, at = (int(v) for v in (t.get(18) or [0, 0])[:2]) if len(t.get(18, [])) >= 2 else (0, 0)
            p = _dict(d[at : at + size])
            return _Index(d, at + number(p, 19, 0)).items if 19 in p else []

        self.locals = [private(_dict(x)) for x in _Index(d, number(top, 1236, 0)).items] if 1236 in top else [private(top)]
        self.part = self._parts(d, number(top, 1237, 0), n) if 1237 in top else [0] * n
        sids = self._charset(d, number(top, 15, 0), n)
        text = lambda s: STRINGS[s] if s < len(STRINGS) else strings.items[s - _MANY].decode("latin-1") if _MANY <= s < _MANY + len(strings.items) else f"sid{s}"
        self.cids = {c: g for g, c in reversed(list(enumerate(sids)))} if self.by_cid else {}
        self.names = {} if self.by_cid else {text(s): g for g, s in reversed(list(enumerate(sids)))}
        self.codes = {} if self.by_cid else self._encoding(d, number(top, 16, 0))

    def _parts(self, d: bytes, at: int, n: int) -> list[int]:
        if d[at] == 0:
            return list(d[at + 1 : at + 1 + n])
        out, many = [], int.from_bytes(d[at + 1 : at + 3], "big")
        for k in range(many):
            p = at + 3 + 3 * k
            out += [d[p + 2]] * (int.from_bytes(d[p + 3 : p + 5], "big") - int.from_bytes(d[p : p + 2], "big"))
        return out

    def _charset(self, d: bytes, at: int, n: int) -> list[int]:
        if at <= 2:
            return list(range(n))
        out, kind, p = [0], d[at], at + 1
        while len(out) < n and p + 2 <= len(d):
            first = int.from_bytes(d[p : p + 2], "big")
            if kind == 0:
                out.append(first)
                p += 2
                continue
            wide = kind
            out += range(first, first + 1 + int.from_bytes(d[p + 2 : p + 2 + wide], "big"))
            p += 2 + wide
        return out[:n]

    def _encoding(self, d: bytes, at: int) -> dict[int, int]:
        if at <= 1:
            return {c: self.names[n] for c, n in enumerate(STANDARD_NAMES) if n in self.names}
        out, kind, g = {}, d[at] & 127, 1
        for k in range(d[at + 1]):
            if kind == 0:
                out[d[at + 2 + k]] = g
                g += 1
            else:
                first, left = d[at + 2 + 2 * k], d[at + 3 + 2 * k]
                for c in range(first, first + left + 1):
                    out[c] = g
                    g += 1
        return out

    def glyph(self, code: int, name: str | None) -> int:
        return self.names.get(name) or self.codes.get(code, 0)

    def glyph_of_cid(self, cid: int) -> int:
        return self.cids.get(cid, 0) if self.by_cid else cid

    def path(self, g: int) -> list[tuple]:
        if not 0 <= g < len(self.glyphs):
            return []
        part = self.part[g] if g < len(self.part) else 0
        pen = _Pen(self.unit)
        try:
            _Type2(pen, self.globals, self.locals[part] if part < len(self.locals) else []).run(self.glyphs[g])
        except (IndexError, RecursionError, OverflowError):
            pass
        return pen.closed()


class _Pen:
    def __init__(self, unit: float):
        self.unit, self.x, self.y, self.out = unit, 0.0, 0.0, []

    def move(self, dx: float, dy: float) -> None:
        self.close()
        self.x, self.y = self.x + dx, self.y + dy
        self.out.append(("m", self.x * self.unit, self.y * self.unit))

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.out.append(("l", self.x * self.unit, self.y * self.unit))

    def curve(self, *d: float) -> None:
        p = []
        for dx, dy in zip(d[::2], d[1::2], strict=True):
            self.x, self.y = self.x + dx, self.y + dy
            p += [self.x * self.unit, self.y * self.unit]
        self.out.append(("c", *p))

    def close(self) -> None:
        if self.out and self.out[-1][0] != "h":
            self.out.append(("h",))

    def closed(self) -> list[tuple]:
        self.close()
        return self.out


class _Type2:
    """One glyph's program."""

    def __init__(self, pen: _Pen, globals_: list[bytes], locals_: list[bytes]):
        self.pen, self.subrs, self.stack, self.stems, self.first, self.steps = pen, (locals_, globals_), [], 0, True, 0

    def clear(self, even: bool | None = None, want: int | None = None) -> list[float]:
        """The operands, without the width that the first operator may carry."""
        s, self.stack = self.stack, []
        if self.first:
            self.first = False
            if (even and len(s) % 2) or (want is not None and len(s) > want):
                s = s[1:]
        return s

    def call(self, which: int, depth: int) -> bool:
        subrs = self.subrs[which]
        bias = 107 if len(subrs) < 1240 else 1131 if len(subrs) < 33900 else 32768
        k = int(self.stack.pop()) + bias
        return self.run(subrs[k], depth + 1) if 0 <= k < len(subrs) else False

    def run(self, d: bytes, depth: int = 0) -> bool:
        """True when the glyph has ended."""
        k, pen = 0, self.pen
        if depth > MAX_DEPTH:
            return True
        while k < len(d):
            self.steps += 1
            if self.steps > MAX_STEPS:
                return True
            b = d[k]
            k += 1
            if b >= 32 or b == 28:
                if b == 28:
                    self.stack.append(int.from_bytes(d[k : k + 2], "big", signed=True))
                    k += 2
                elif b < 247:
                    self.stack.append(b - 139)
                elif b < 255:
                    self.stack.append((b - 247) * 256 + d[k] + 108 if b < 251 else -(b - 251) * 256 - d[k] - 108)
                    k += 1
                else:
                    self.stack.append(int.from_bytes(d[k : k + 4], "big", signed=True) / 65536)
                    k += 4
                continue
            if b in (1, 3, 18, 23):
                self.stems += len(self.clear(even=True)) // 2
            elif b in (19, 20):
                self.stems += len(self.clear(even=True)) // 2
                k += (self.stems + 7) // 8
            elif b == 21:
                pen.move(*self.clear(want=2)[-2:])
            elif b in (22, 4):
                v = self.clear(want=1)[-1]
                pen.move(*((v, 0) if b == 22 else (0, v)))
            elif b == 5:
                s = self.clear()
                for a in range(0, len(s) - 1, 2):
                    pen.line(s[a], s[a + 1])
            elif b in (6, 7):
                for n, v in enumerate(self.clear()):
                    pen.line(*((v, 0) if (n % 2 == 0) == (b == 6) else (0, v)))
            elif b in (8, 24, 25):
                s = self.clear()
                a, end = 0, len(s)
                if b == 25:
                    while end - a >= 8:
                        pen.line(s[a], s[a + 1])
                        a += 2
                while end - a >= 6:
                    pen.curve(*s[a : a + 6])
                    a += 6
                if b == 24 and end - a >= 2:
                    pen.line(s[a], s[a + 1])
            elif b in (26, 27):
                s = self.clear()
                side = s.pop(0) if len(s) % 4 else 0
                for a in range(0, len(s) - 3, 4):
                    p, q, r, t = s[a : a + 4]
                    pen.curve(*((side, p, q, r, 0, t) if b == 26 else (p, side, q, r, t, 0)))
                    side = 0
            elif b in (30, 31):
                s, across = self.clear(), b == 31
                for a in range(0, len(s) - 3, 4):
                    p, q, r, t = s[a : a + 4]
                    last = s[a + 4] if len(s) - a == 5 else 0
                    pen.curve(*((p, 0, q, r, last, t) if across else (0, p, q, r, t, last)))
                    across = not across
            elif b in (10, 29):
                if self.call(b == 29, depth):
                    return True
            elif b == 11:
                return False
            elif b == 14:
                self.clear(want=0)
                return True
            elif b == 12:
                b = d[k]
                k += 1
                s = self.stack
                if b == 34:
                    s = self.clear()
                    pen.curve(s[0], 0, s[1], s[2], s[3], 0)
                    pen.curve(s[4], 0, s[5], -s[2], s[6], 0)
                elif b == 35:
                    s = self.clear()
                    pen.curve(*s[:6])
                    pen.curve(*s[6:12])
                elif b == 36:
                    s = self.clear()
                    pen.curve(s[0], s[1], s[2], s[3], s[4], 0)
                    pen.curve(s[5], 0, s[6], s[7], s[8], -(s[1] + s[3] + s[7]))
                elif b == 37:
                    s = self.clear()
                    dx, dy = s[0] + s[2] + s[4] + s[6] + s[8], s[1] + s[3] + s[5] + s[7] + s[9]
                    pen.curve(*s[:6])
                    pen.curve(*s[6:10], *((s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])))
                elif b in (9, 14, 26):
                    v = s.pop()
                    s.append(abs(v) if b == 9 else -v if b == 14 else max(v, 0) ** 0.5)
                elif b in (10, 11, 12, 24):
                    q, p = s.pop(), s.pop()
                    s.append(p + q if b == 10 else p - q if b == 11 else (p / q if q else 0) if b == 12 else p * q)
                elif b == 18:
                    s.pop()
                elif b == 27:
                    s.append(s[-1])
                elif b == 28:
                    s[-1], s[-2] = s[-2], s[-1]
                else:
                    self.stack = []
            else:
                self.stack = []
        return False


def decrypt(d: bytes, key: int, skip: int) -> bytes:
    out = bytearray()
    for c in d:
        out.append(c ^ (key >> 8))
        key = ((c + key) * 52845 + 22719) & 0xFFFF
    return bytes(out[skip:])


class Type1:
    """A Type 1 font program: glyphs by name."""

    def __init__(self, d: bytes):
        if d[:1] == b"\x80":  # in segments
            out, k = b"", 0
            while k + 6 <= len(d) and d[k] == 0x80 and d[k + 1] in (1, 2):
                n = int.from_bytes(d[k + 2 : k + 6], "little")
                out += d[k + 6 : k + 6 + n]
                k += 6 + n
            d = out
        k = d.find(b"eexec")
        if k < 0:
            raise ValueError("Type 1 font")
        head, body = d[:k], d[k + 5 :].lstrip(b" \t\r\n")
        if re.fullmatch(rb"[0-9A-Fa-f\s]{8}", body[:8]):
            digits = re.match(rb"[0-9A-Fa-f\s]*", body)[0]
            digits = re.sub(rb"\s", b"", digits)
            body = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        body = decrypt(body, 55665, 4)
        n = re.search(rb"/lenIV\s+(-?\d+)", body)
        skip = int(n[1]) if n else 4
        plain = lambda x: decrypt(x, 4330, skip) if skip >= 0 else x
        m = re.search(rb"/FontMatrix\s*\[\s*([-+.\deE]+)", head)
        self.unit = (float(m[1]) * 1000 if m else 1.0) or 1.0
        self.subrs: dict[int, bytes] = {}
        self.glyphs: dict[str, bytes] = {}
        begin = body.find(b"/CharStrings")
        for x in re.finditer(rb"dup\s+(\d+)\s+(\d+)\s+(?:RD|-\||\S+)\s", body[: begin if begin >= 0 else None]):
            self.subrs.setdefault(int(x[1]), plain(body[x.end() : x.end() + int(x[2])]))
        at = max(begin, 0)
        while x := re.compile(rb"/([^\s/{}\[\]()<>]+)\s+(\d+)\s+(?:RD|-\||\S+)\s").search(body, at):
            self.glyphs.setdefault(x[1].decode("latin-1"), plain(body[x.end() : x.end() + int(x[2])]))
            at = x.end() + int(x[2])
        if not self.glyphs:
            raise ValueError("Type 1 font")
        self.codes = {int(c): n.decode("latin-1") for c, n in re.findall(rb"dup\s+(\d+)\s*/([^\s/]+)\s+put", head)} or {c: n for c, n in enumerate(STANDARD_NAMES) if n}

    def glyph(self, code: int, name: str | None) -> str | None:
        return name if name in self.glyphs else self.codes.get(code)

    def path(self, name: str | None) -> list[tuple]:
        pen = _Pen(self.unit)
        if name in self.glyphs:
            try:
                self._run(self.glyphs[name], pen, {"stack": [], "ps": [], "flex": None, "steps": 0, "side": 0.0}, 0)
            except (IndexError, TypeError, OverflowError):
                pass
        return pen.closed()

    def _run(self, d: bytes, pen: _Pen, st: dict, depth: int) -> bool:
        s, k = st["stack"], 0
        if depth > MAX_DEPTH:
            return True

        def move(dx, dy):
            if st["flex"] is not None:
                pen.x, pen.y = pen.x + dx, pen.y + dy
                st["flex"].append((pen.x, pen.y))
            else:
                pen.move(dx, dy)

        while k < len(d):
            st["steps"] += 1
            if st["steps"] > MAX_STEPS:
                return True
            b = d[k]
            k += 1
            if b >= 32:
                if b < 247:
                    s.append(b - 139)
                elif b < 255:
                    s.append((b - 247) * 256 + d[k] + 108 if b < 251 else -(b - 251) * 256 - d[k] - 108)
                    k += 1
                else:
                    s.append(int.from_bytes(d[k : k + 4], "big", signed=True))
                    k += 4
                continue
            if b == 12:
                b = 1200 + d[k]
                k += 1
            if b == 13:
                pen.x, st["side"] = s[0], s[0]
            elif b == 1207:
                pen.x, pen.y, st["side"] = s[0], s[1], s[0]
            elif b == 21:
                move(s[-2], s[-1])
            elif b == 22:
                move(s[-1], 0)
            elif b == 4:
                move(0, s[-1])
            elif b == 5:
                pen.line(s[-2], s[-1])
            elif b == 6:
                pen.line(s[-1], 0)
            elif b == 7:
                pen.line(0, s[-1])
            elif b == 8:
                pen.curve(*s[-6:])
            elif b == 30:
                pen.curve(0, s[-4], s[-3], s[-2], s[-1], 0)
            elif b == 31:
                pen.curve(s[-4], 0, s[-3], s[-2], 0, s[-1])
            elif b == 9:
                pen.close()
            elif b == 14:
                return True
            elif b == 11:
                return False
            elif b == 10:
                n = int(s.pop())
                if self._run(self.subrs.get(n, b""), pen, st, depth + 1):
                    return True
                continue
            elif b == 1206:  # an accented letter of two others
                asb, dx, dy, base, accent = s[-5:]
                s.clear()
                side = st["side"]
                for code, x, y in ((base, 0.0, 0.0), (accent, side - asb + dx, dy)):
                    part = STANDARD_NAMES[int(code) & 255]
                    if part in self.glyphs:
                        pen.close()
                        inner = _Pen(pen.unit)
                        self._run(self.glyphs[part], inner, {"stack": [], "ps": [], "flex": None, "steps": st["steps"], "side": 0.0}, depth + 1)
                        pen.out += [(op, *[v + (x if n % 2 == 0 else y) * pen.unit for n, v in enumerate(p)]) for op, *p in inner.closed()]
                return True
            elif b == 1212:
                q, p = s.pop(), s.pop()
                s.append(p / q if q else 0)
                continue
            elif b == 1216:
                which, many = int(s.pop()), int(s.pop())
                args = [s.pop() for _ in range(many)]
                if which == 1:
                    st["flex"] = []
                elif which == 0 and st["flex"] is not None:
                    p, st["flex"] = st["flex"], None
                    if len(p) >= 7:
                        for a in (1, 4):
                            pen.out.append(("c", *[v * pen.unit for q in p[a : a + 3] for v in q]))
                    st["ps"] = [pen.y, pen.x]
                elif which == 3:
                    st["ps"] = [3]
                elif which != 2:
                    st["ps"] = args
                continue
            elif b == 1217:
                s.append(st["ps"].pop() if st["ps"] else 0)
                continue
            elif b == 1233:
                pen.x, pen.y = s[-2], s[-1]
            s.clear()
        return False
