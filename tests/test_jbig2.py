import random

import numpy as np
import pytest
from test_images import Bits, fax_down, picture

from quire.kernels import filters, jbig2
from quire.kernels.objects import Name, Stream


class Encoder:
    """The arithmetic encoder."""

    def __init__(self):
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray(1)

    def bit(self, cx, i, d):
        v = cx[i]
        qe, more, less, switch = jbig2.STATES[v >> 1]
        self.a -= qe
        if d == v & 1:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            cx[i] = more << 1 | v & 1
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            cx[i] = less << 1 | (v & 1) ^ switch
        while True:
            self.a, self.c, self.ct = self.a << 1, self.c << 1, self.ct - 1
            if not self.ct:
                self.byte()
            if self.a & 0x8000:
                return

    def byte(self):
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c, self.ct = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c, self.ct = self.c & 0x7FFFF, 8

    def end(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self.byte()
        return bytes(self.out[1:]) + (b"\xff\xac" if self.out[-1] != 0xFF else b"\xac")

    def integer(self, cx, v):
        at = 1

        def put(b):
            nonlocal at
            self.bit(cx, at, b)
            at = at << 1 | b if at < 256 else ((at << 1 | b) & 511) | 256

        put(int(v is None or v < 0))
        n = abs(v or 0)
        k = max(k for k, (_, add) in enumerate(jbig2.INTEGERS) if n >= add)
        for _ in range(k):
            put(1)
        if k < 5:
            put(0)
        bits, add = jbig2.INTEGERS[k]
        for s in range(bits - 1, -1, -1):
            put((n - add) >> s & 1)

    def number(self, cx, bits, v):
        at = 1
        for s in range(bits - 1, -1, -1):
            b = v >> s & 1
            self.bit(cx, at, b)
            at = at << 1 | b


def pixel(rows, x, y):
    return int(rows[y][x]) if 0 <= y < len(rows) and 0 <= x < len(rows[0]) else 0


def put_generic(e, rows, template, adaptive, repeats, cx):
    near, special = jbig2.GENERIC[template]
    near = [adaptive[n] if isinstance(n, int) else n for n in near]
    same = False
    for y, row in enumerate(rows):
        if repeats:
            now = list(row) == (list(rows[y - 1]) if y else [0] * len(row))
            e.bit(cx, special, int(now != same))
            same = now
            if same:
                continue
        for x in range(len(row)):
            e.bit(cx, sum(pixel(rows, x + dx, y + dy) << (len(near) - 1 - k) for k, (dx, dy) in enumerate(near)), int(row[x]))


def segment(number, kind, data, refers=()):
    return number.to_bytes(4, "big") + bytes([kind, len(refers) << 5]) + bytes(refers) + b"\1" + len(data).to_bytes(4, "big") + data


def region(w, h, x=0, y=0, how=0):
    return b"".join(v.to_bytes(4, "big", signed=v < 0) for v in (w, h, x, y)) + bytes([how])


def page(w, h, ground=0):
    return segment(0, 48, w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes(8) + bytes([ground << 2]) + bytes(2))


def packed(rows):
    return np.packbits(1 - np.array(rows, np.uint8), axis=1).tobytes()


def bitmaps():
    r = np.random.RandomState(2)
    for w, h, p in ((1, 1, 0.5), (9, 7, 0.5), (40, 30, 0.1), (33, 12, 0.9), (70, 20, 0.0)):
        rows = (r.rand(h, w) < p).astype(int)
        rows[h // 2 :: 3] = rows[h // 2 - 1 if h > 1 else 0]
        yield w, h, rows.tolist()


NOMINAL = {0: [(3, -1), (-3, -1), (2, -2), (-2, -2)], 1: [(3, -1)], 2: [(2, -1)], 3: [(2, -1)]}


@pytest.mark.parametrize("template", [0, 1, 2, 3])
def test_generic(template):
    for w, h, rows in bitmaps():
        for repeats in (False, True):
            for adaptive in (NOMINAL[template], [(-5, -1), *NOMINAL[template][1:]]):
                e = Encoder()
                put_generic(e, rows, template, adaptive, repeats, [0] * (1 << 16))
                body = region(w, h) + bytes([template << 1 | repeats << 3]) + b"".join(bytes([x & 255, y & 255]) for x, y in adaptive) + e.end()
                assert jbig2.decode(page(w, h) + segment(1, 38, body), b"", w, h) == packed(rows), (template, w, repeats)


def test_faxed_region():
    for w, h, rows in bitmaps():
        bits, above = Bits(), [0] * w
        for row in rows:
            fax_down(bits, row, above)
            above = row
        assert jbig2.decode(page(w, h) + segment(1, 38, region(w, h) + b"\1" + bits.bytes()), b"", w, h) == packed(rows)


def symbols(e, shapes, cx):
    """Symbols by rising height, each height a class."""
    tall, wide, run = ([0] * 512 for _ in range(3))
    last = 0
    for h in sorted({len(s) for s in shapes}):
        e.integer(tall, h - last)
        last, w = h, 0
        for s in shapes:
            if len(s) == h:
                e.integer(wide, len(s[0]) - w)
                w = len(s[0])
                put_generic(e, s, 0, NOMINAL[0], False, cx)
        e.integer(wide, None)
    e.integer(run, 0)
    e.integer(run, len(shapes))


def test_text():
    r = random.Random(3)
    shapes = sorted(([[r.randint(0, 1) for _ in range(r.randint(2, 7))] for _ in range(1)] * r.randint(2, 6) for _ in range(5)), key=len)
    shapes = [[list(row) for row in s] for s in shapes]
    for s in shapes:
        s[0] = [1] * len(s[0])
    e = Encoder()
    symbols(e, shapes, [0] * (1 << 16))
    at = b"".join(bytes([x & 255, y & 255]) for x, y in NOMINAL[0])
    shared = segment(1, 0, bytes(2) + at + (5).to_bytes(4, "big") * 2 + e.end())
    for corner in range(4):
        for turned in (0, 1):
            w, h = 80, 60
            want, e = np.zeros((h, w), int), Encoder()
            down, first, along, place = ([0] * 512 for _ in range(4))
            ids = [0] * 16
            e.integer(down, 0)
            strip = start = 0
            lines = [[r.randrange(5) for _ in range(r.randint(1, 4))] for _ in range(3)]
            for line in lines:
                e.integer(down, 4)
                strip += 16
                begin = 8 + r.randint(0, 3)
                e.integer(first, begin - start)
                start = s = begin
                for k, n in enumerate(line):
                    if k:
                        gap = r.randint(1, 4)
                        e.integer(along, gap - 1)  # the shift adds one
                        s += gap
                    off = r.randint(0, 3)
                    e.integer(place, off)
                    e.number(ids, 3, n)
                    sh, sw = len(shapes[n]), len(shapes[n][0])
                    t, size = strip + off, (sh if turned else sw) - 1
                    before = corner in ((0, 2) if turned else (2, 3))
                    s += size if before else 0
                    x, y = (t, s) if turned else (s, t)
                    x -= sw - 1 if corner in (2, 3) else 0
                    y -= sh - 1 if corner in (0, 2) else 0
                    want[y : y + sh, x : x + sw] |= np.array(shapes[n])
                    s += 0 if before else size
                e.integer(along, None)
            flags = 2 << 2 | corner << 4 | turned << 6 | 1 << 10
            body = region(w, h) + flags.to_bytes(2, "big") + sum(map(len, lines)).to_bytes(4, "big") + e.end()
            assert jbig2.decode(page(w, h) + segment(2, 6, body, [1]), shared, w, h) == packed(want), (corner, turned)


@pytest.mark.parametrize("template", [0, 1])
def test_refinement(template):
    r = np.random.RandomState(5)
    ref = (r.rand(20, 25) < 0.4).astype(int)
    ref[4:12, 5:15] = 1
    new = ref ^ (r.rand(20, 25) < 0.1)
    new[4:12, 5:15] = 1
    for repeats in (False, True):
        e, cx = Encoder(), [0] * (1 << 13)
        put_generic(e, ref.tolist(), 0, NOMINAL[0], False, [0] * (1 << 16))
        first = segment(1, 38, region(25, 20) + b"\0" + b"".join(bytes([x & 255, y & 255]) for x, y in NOMINAL[0]) + e.end())
        own, other, special = jbig2.REFINED[template]
        places = [(-1, -1), (-1, -1)]
        own, other = ([places[n] if isinstance(n, int) else n for n in z] for z in (own, other))
        e = Encoder()
        for y in range(20):
            flat = lambda x: len({pixel(ref, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}) == 1
            if repeats:
                same = all(new[y][x] == pixel(ref, x, y) for x in range(25) if flat(x))
                e.bit(cx, special, int(same != (y > 0 and was)))
                was = same
            for x in range(25):
                if repeats and same and flat(x):
                    continue
                i = 0
                for dx, dy in own:
                    i = i << 1 | pixel(new, x + dx, y + dy)
                for dx, dy in other:
                    i = i << 1 | pixel(ref, x + dx, y + dy)
                e.bit(cx, i, int(new[y][x]))
        body = region(25, 20, how=4) + bytes([template | repeats << 1]) + (b"\xff\xff\xff\xff" if not template else b"") + e.end()
        assert jbig2.decode(page(25, 20) + first + segment(2, 42, body), b"", 25, 20) == packed(new)


def test_page_and_refusals():
    e = Encoder()
    put_generic(e, [[1, 0]], 3, NOMINAL[3], False, [0] * (1 << 16))
    body = lambda how: region(2, 1, 1, 1, how) + bytes([6]) + bytes([2, 255]) + e_end
    e_end = e.end()
    for how, want in ((0, [1, 1]), (1, [1, 0]), (2, [0, 1]), (3, [1, 0]), (4, [1, 0])):
        assert jbig2.decode(page(4, 2, 1) + segment(1, 38, body(how)), b"", 4, 2) == packed([[1] * 4, [1, *want, 1]]), how
    assert jbig2.decode(b"", b"", 3, 1) == packed([[0, 0, 0]])
    with pytest.raises(filters.Unsupported):
        jbig2.decode(segment(1, 16, b""), b"", 3, 1)
    with pytest.raises(filters.Unsupported):
        jbig2.decode(segment(1, 0, b"\0\1"), b"", 3, 1)
    for bad in (segment(1, 38, b"x"), segment(1, 38, region(1 << 16, 1 << 16) + b"\0"), page(1 << 16, 1 << 16)):
        with pytest.raises(filters.Undecodable):
            jbig2.decode(bad, b"", 3, 1)
    attrs = {"Filter": Name("JBIG2Decode"), "Subtype": Name("Image"), "Width": 4, "Height": 2, "DecodeParms": {"JBIG2Globals": Stream({}, page(4, 2, 1))}}
    assert filters.decode(attrs, segment(1, 38, body(2))) == packed([[1] * 4, [1, 0, 1, 1]])


def test_drawn():
    e = Encoder()
    put_generic(e, [[1, 0], [0, 1]], 3, NOMINAL[3], False, [0] * (1 << 16))
    data = page(2, 2) + segment(1, 38, region(2, 2) + bytes([6, 2, 255]) + e.end())
    px, warn = picture(lambda w: {"Resources": {"XObject": {"B": w.add({"Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("JBIG2Decode"), "Length": len(data)}, data)}}}, b"q 20 0 0 20 0 0 cm /B Do Q")
    assert not warn and px[5, 5].tolist() == [0] * 3 == px[15, 15].tolist() and px[5, 15].tolist() == [255] * 3 == px[15, 5].tolist()
