"""JBIG2 images with arithmetic coding: generic and refinement regions, symbol dictionaries and text regions, composed on a page. Huffman coding, halftones and refinement within symbols are refused by name."""

from __future__ import annotations

import numpy as np

from . import fax
from .errors import Undecodable, Unsupported

MAX_PIXELS, MAX_SYMBOLS = 1 << 26, 1 << 16
#: The probability states of the arithmetic coder (estimate, next after the more and the less probable symbol, does the sense change).
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0),
    (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0),
    (0x2401, 23, 20, 0), (0x2201, 24, 21, 0), (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0),
    (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0),
    (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
#: Neighbours (x, y) that make up a pixel's context, from the highest bit; a number stands for an adaptive one. Then the context that tells whether a row repeats.
GENERIC = (
    ([3, (-1, -2), (0, -2), (1, -2), 2, 1, (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), 0, (-4, 0), (-3, 0), (-2, 0), (-1, 0)], 0x9B25), ([(-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), 0, (-3, 0), (-2, 0), (-1, 0)], 0x0795),
    ([(-1, -2), (0, -2), (1, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), 0, (-2, 0), (-1, 0)], 0x00E5), ([(-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), 0, (-4, 0), (-3, 0), (-2, 0), (-1, 0)], 0x0195),
)
#: Neighbours in the refined image and in the one that it refines, and the context of rows that repeat.
REFINED = (
    ([(0, -1), (1, -1), (-1, 0), 0], [1, (0, -1), (1, -1), (-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)], 0x0008), ([(-1, -1), (0, -1), (1, -1), (-1, 0)], [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1), (1, 1)], 0x0008),
)
#: Prefixes of coded integers: bits of the value and what is added to it.
INTEGERS = ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436))


class Coder:
    """The arithmetic decoder; contexts are lists of state << 1 | sense."""

    def __init__(self, data: bytes):
        self.d, self.p, self.ct = data, 0, 0
        self.c = (data[0] if data else 0xFF) << 16
        self.fill()
        self.c = (self.c << 7) & 0xFFFFFFFF
        self.ct -= 7
        self.a = 0x8000

    def fill(self) -> None:
        d, p = self.d, self.p
        if (d[p] if p < len(d) else 0xFF) == 0xFF:
            if (d[p + 1] if p + 1 < len(d) else 0xFF) > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.p += 1
                self.c += d[p + 1] << 9
                self.ct = 7
        else:
            self.p += 1
            self.c += (d[p + 1] if p + 1 < len(d) else 0xFF) << 8
            self.ct = 8

    def bit(self, cx: list[int], i: int) -> int:
        v = cx[i]
        qe, more, less, switch = STATES[v >> 1]
        d = v & 1
        self.a -= qe
        if (self.c >> 16) < qe:
            if self.a < qe:
                cx[i] = more << 1 | d
            else:
                cx[i] = less << 1 | (d ^ switch)
                d ^= 1
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return d
            if self.a < qe:
                cx[i] = less << 1 | (d ^ switch)
                d ^= 1
            else:
                cx[i] = more << 1 | d
        while True:
            if not self.ct:
                self.fill()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return d

    def integer(self, cx: list[int]) -> int | None:
        """A signed number, or None for out of band."""
        at = 1

        def take() -> int:
            nonlocal at
            b = self.bit(cx, at)
            at = at << 1 | b if at < 256 else ((at << 1 | b) & 511) | 256
            return b

        sign, k = take(), 0
        while k < 5 and take():
            k += 1
        bits, add = INTEGERS[k]
        v = 0
        for _ in range(bits):
            v = v << 1 | take()
        v += add
        return v if not sign else -v if v else None

    def number(self, cx: list[int], bits: int) -> int:
        at = 1
        for _ in range(bits):
            at = at << 1 | self.bit(cx, at)
        return at - (1 << bits)


def generic(coder: Coder, w: int, h: int, template: int, adaptive: list[tuple[int, int]], repeats: bool, cx: list[int]) -> list[bytearray]:
    """Rows of pixels; of a row that is told to repeat the one above."""
    near, special = GENERIC[template]
    near = [adaptive[n] if isinstance(n, int) else n for n in near]
    pad = max(8, *(abs(x) for x, _ in near))
    blank = bytearray(w + 2 * pad)
    rows: list[bytearray] = []
    # neighbours by row; those that follow one another are shifted along
    by_row: dict[int, list[tuple[int, int]]] = {}
    for k, (x, y) in enumerate(near):
        by_row.setdefault(y, []).append((x + pad, len(near) - 1 - k))
    same = False
    for y in range(h):
        if repeats and coder.bit(cx, special):
            same = not same
        if same:
            rows.append(bytearray(rows[-1] if rows else blank))
            continue
        row = bytearray(w + 2 * pad)
        rows.append(row)
        parts = [(rows[y + dy] if y + dy >= 0 else blank, x, s) for dy, of in by_row.items() for x, s in of]
        bit = coder.bit
        for x in range(w):
            i = 0
            for of, dx, s in parts:
                if of[x + dx]:
                    i |= 1 << s
            row[x + pad] = bit(cx, i)
    return [r[pad : pad + w] for r in rows]


def refined(coder: Coder, w: int, h: int, template: int, ref: list[bytearray], dx: int, dy: int, adaptive: list[tuple[int, int]], repeats: bool, cx: list[int]) -> list[bytearray]:
    """An image told by its differences from another, moved by (dx, dy)."""
    own, other, special = REFINED[template]
    own = [adaptive[n] if isinstance(n, int) else n for n in own]
    other = [adaptive[n] if isinstance(n, int) else n for n in other]
    rows: list[bytearray] = []
    at = lambda of, x, y: of[y][x] if 0 <= y < len(of) and 0 <= x < len(of[y]) else 0
    same = False
    for y in range(h):
        row = bytearray(w)
        rows.append(row)
        if repeats and coder.bit(cx, special):
            same = not same
        for x in range(w):
            if same:
                around = {at(ref, x - dx + i, y - dy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
                if len(around) == 1:
                    row[x] = around.pop()
                    continue
            i = 0
            for ox, oy in own:
                i = i << 1 | at(rows, x + ox, y + oy)
            for ox, oy in other:
                i = i << 1 | at(ref, x - dx + ox, y - dy + oy)
            row[x] = coder.bit(cx, i)
    return rows


class _Reader:
    def __init__(self, d: bytes, at: int = 0):
        self.d, self.at = d, at

    def int(self, n: int, signed: bool = False) -> int:
        if self.at + n > len(self.d):
            raise Undecodable("JBIG2Decode")
        self.at += n
        return int.from_bytes(self.d[self.at - n : self.at], "big", signed=signed)

    def places(self, n: int) -> list[tuple[int, int]]:
        return [(self.int(1, True), self.int(1, True)) for _ in range(n)]


class _Page:
    def __init__(self, w: int, h: int):
        self.w, self.h, self.px, self.made, self.work = w, h, None, {}, 0

    def budget(self, n: int) -> None:
        """All that is decoded for an image counts."""
        self.work += n
        if self.work > MAX_PIXELS:
            raise Undecodable("JBIG2Decode: too much work")

    def page(self, d: bytes) -> None:
        r = _Reader(d)
        w, h, _, _, flags, _ = (r.int(n) for n in (4, 4, 4, 4, 1, 2))
        h = self.h if h == 0xFFFFFFFF else h
        if w * h > MAX_PIXELS:
            raise Undecodable("JBIG2Decode")
        self.px, self.default = np.full((h, w), flags >> 2 & 1, np.uint8), flags >> 2 & 1

    def put(self, rows: list[bytearray], x: int, y: int, how: int) -> None:
        if self.px is None:
            self.px, self.default = np.zeros((self.h, self.w), np.uint8), 0
        _compose(self.px, np.array(rows, np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 0), np.uint8), x, y, how)

    def region(self, r: _Reader) -> tuple[int, int, int, int, int]:
        w, h, x, y, flags = r.int(4), r.int(4), r.int(4, True), r.int(4, True), r.int(1)
        self.budget(w * h)
        return w, h, x, y, flags & 7

    def generic(self, d: bytes) -> None:
        r = _Reader(d)
        w, h, x, y, how = self.region(r)
        flags = r.int(1)
        if flags & 1:
            packed = fax.decode(d[r.at :], {"K": -1, "Columns": w, "Rows": h, "BlackIs1": True, "EndOfBlock": False})
            rows = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(h, -1), axis=1)[:, :w]
            self.put([bytearray(v.tobytes()) for v in rows], x, y, how)
            return
        template = flags >> 1 & 3
        adaptive = r.places(4 if template == 0 else 1)
        self.put(generic(Coder(d[r.at :]), w, h, template, adaptive, bool(flags & 8), [0] * (1 << len(GENERIC[template][0]))), x, y, how)

    def refinement(self, d: bytes) -> None:
        r = _Reader(d)
        w, h, x, y, how = self.region(r)
        flags = r.int(1)
        adaptive = r.places(2) if not flags & 1 else []
        if self.px is None:
            raise Undecodable("JBIG2Decode")
        under = np.zeros((h, w), np.uint8)
        _compose(under, self.px[max(y, 0) : y + h, max(x, 0) : x + w], max(-x, 0), max(-y, 0), 4)
        self.put(refined(Coder(d[r.at :]), w, h, flags & 1, [bytearray(v.tobytes()) for v in under], 0, 0, adaptive, bool(flags & 2), [0] * (1 << 13)), x, y, how)

    def symbols(self, d: bytes, given: list[list[bytearray]]) -> list[list[bytearray]]:
        r = _Reader(d)
        flags = r.int(2)
        if flags & 1:
            raise Unsupported("JBIG2Decode Huffman")
        if flags & 2:
            raise Unsupported("JBIG2Decode refined symbols")
        template = flags >> 10 & 3
        adaptive = r.places(4 if template == 0 else 1)
        out, new = r.int(4), r.int(4)
        if len(given) + new > MAX_SYMBOLS or out > MAX_SYMBOLS:
            raise Undecodable("JBIG2Decode")
        coder, cx = Coder(d[r.at :]), [0] * (1 << len(GENERIC[template][0]))
        tall, wide, run = ([0] * 512 for _ in range(3))
        made, h = [], 0
        while len(made) < new:
            h += coder.integer(tall) or 0
            w = 0
            if not 0 <= h < 1 << 16:
                raise Undecodable("JBIG2Decode")
            while (dw := coder.integer(wide)) is not None:
                w += dw
                if len(made) >= new or not 0 <= w < 1 << 16:
                    raise Undecodable("JBIG2Decode")
                self.budget(w * h + 1)
                made.append(generic(coder, w, h, template, adaptive, False, cx))
            self.budget(1)
        every, kept, keep, k = given + made, [], False, 0
        while k < len(every):
            n = coder.integer(run)
            if n is None or n < 0 or k + n > len(every):
                raise Undecodable("JBIG2Decode")
            kept += every[k : k + n] if keep else []
            k, keep = k + n, not keep
            self.budget(1)
        return kept

    def text(self, d: bytes, symbols: list[list[bytearray]]) -> None:
        r = _Reader(d)
        w, h, x, y, how = self.region(r)
        flags = r.int(2)
        if flags & 1:
            raise Unsupported("JBIG2Decode Huffman")
        if flags & 2:
            raise Unsupported("JBIG2Decode refined text")
        strips, corner, turned, mode, ground = 1 << (flags >> 2 & 3), flags >> 4 & 3, flags >> 6 & 1, flags >> 7 & 3, flags >> 9 & 1
        shift = flags >> 10 & 31
        shift -= 32 if shift > 15 else 0
        many = r.int(4)
        bits = max(0, (len(symbols) - 1).bit_length())
        coder, ids = Coder(d[r.at :]), [0] * (1 << (bits + 1))
        down, first, along, place = ([0] * 512 for _ in range(4))
        px = np.full((h, w), ground, np.uint8)
        strip, start, done = -(coder.integer(down) or 0) * strips, 0, 0
        while done < many:
            strip += (coder.integer(down) or 0) * strips
            start += coder.integer(first) or 0
            at, new = start, True
            while True:
                if not new:
                    step = coder.integer(along)
                    if step is None:
                        break
                    at += step + shift
                new = False
                t = strip + ((coder.integer(place) or 0) if strips > 1 else 0)
                n = coder.number(ids, bits)
                if n >= len(symbols) or done >= many:
                    raise Undecodable("JBIG2Decode")
                rows = symbols[n]
                sh, sw = len(rows), len(rows[0]) if rows else 0
                self.budget(sh * sw + 1)
                if turned:
                    at += sh - 1 if corner in (0, 2) else 0
                    left, top = (t if corner in (0, 1) else t - sw + 1), (at if corner in (1, 3) else at - sh + 1)
                else:
                    at += sw - 1 if corner in (2, 3) else 0
                    left, top = (at if corner in (0, 1) else at - sw + 1), (t if corner in (1, 3) else t - sh + 1)
                _compose(px, np.array(rows, np.uint8).reshape(sh, sw), left, top, mode)
                at += (sh - 1 if corner in (1, 3) else 0) if turned else (sw - 1 if corner in (0, 1) else 0)
                done += 1
        self.put([bytearray(v.tobytes()) for v in px], x, y, how)


def _compose(px: np.ndarray, part: np.ndarray, x: int, y: int, how: int) -> None:
    """Or, and, exclusive or, equivalence, or the new one."""
    a, b = max(0, -y), max(0, -x)
    part = part[a : max(a, px.shape[0] - y), b : max(b, px.shape[1] - x)]
    if not part.size:
        return
    under = px[y + a : y + a + part.shape[0], x + b : x + b + part.shape[1]]
    under[:] = under | part if how == 0 else under & part if how == 1 else under ^ part if how == 2 else 1 - (under ^ part) if how == 3 else part


def _segments(d: bytes):
    """(number, kind, numbers of those it refers to, data)."""
    r = _Reader(d)
    while r.at + 11 <= len(d):
        number, flags, many = r.int(4), r.int(1), r.int(1)
        n = many >> 5
        if n == 7:
            r.at -= 1
            n = r.int(4) & 0x1FFFFFFF
            r.at += (n + 8) // 8
        if n > 1 << 16:
            raise Undecodable("JBIG2Decode")
        wide = 1 if number <= 256 else 2 if number <= 65536 else 4
        refers = [r.int(wide) for _ in range(n)]
        r.int(4 if flags & 64 else 1)
        size = r.int(4)
        if size == 0xFFFFFFFF:  # until its end mark, which a count of rows follows
            mark = d.find(b"\0\0" if d[r.at + 17 : r.at + 18] and d[r.at + 17] & 1 else b"\xff\xac", r.at + 18)
            size = (mark + 6 if mark >= 0 else len(d)) - r.at
        yield number, flags & 63, refers, d[r.at : r.at + size]
        r.at += size


def decode(data: bytes, shared: bytes, w: int, h: int) -> bytes:
    """Packed rows of an image of this size, 0 black as in the filters' other bilevel images."""
    if not 0 < w * h <= MAX_PIXELS:
        raise Undecodable("JBIG2Decode")
    page = _Page(w, h)
    for part in (shared, data):
        for number, kind, refers, body in _segments(part):
            if kind == 48:
                page.page(body)
            elif kind in (38, 39):
                page.generic(body)
            elif kind in (42, 43):
                page.refinement(body)
            elif kind == 0:
                page.made[number] = page.symbols(body, [s for k in refers for s in page.made.get(k, [])])
            elif kind in (6, 7):
                page.text(body, [s for k in refers for s in page.made.get(k, [])])
            elif kind in (4, 16, 20, 22, 23, 36, 40, 53):
                raise Unsupported(f"JBIG2Decode segment {kind}")
    out = np.zeros((h, w), np.uint8)
    if page.px is not None:
        _compose(out, page.px, 0, 0, 4)
    return np.packbits(1 - out, axis=1).tobytes()
