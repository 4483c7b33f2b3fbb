import re

import numpy as np
import pytest

from quire import corpus as C
from quire.kernels.cff import CFF, STRINGS, Type1
from quire.kernels.document import Document
from quire.kernels.objects import Name
from quire.kernels.raster import draw


def num(*v):
    return b"".join(bytes([n + 139]) if -107 <= n <= 107 else b"\x1c" + n.to_bytes(2, "big", signed=True) for n in v)


def index(items):
    off, at = [1], 1
    for x in items:
        at += len(x)
        off.append(at)
    return len(items).to_bytes(2, "big") + (b"\2" + b"".join(o.to_bytes(2, "big") for o in off) + b"".join(items) if items else b"")


def compact(glyphs, names, subrs=(), globals_=(), cids=None):
    """A compact font of these programs; names of glyphs from the second on."""
    wide = lambda v: b"\x1d" + v.to_bytes(4, "big")
    own = [n.encode() for n in names if n not in STRINGS]
    sid = lambda n: STRINGS.index(n) if n in STRINGS else 391 + own.index(n.encode())
    charset = b"\0" + b"".join((sid(n) if cids is None else c).to_bytes(2, "big") for n, c in zip(names, cids or names))
    private = num(0) + b"\x14" if not subrs else b""
    private = wide(len(wide(0) + b"\x13")) + b"\x13" if subrs else private

    def top(at):
        t = (num(0, 0, 0) + b"\x0c\x1e" if cids else b"") + wide(at[0]) + b"\x0f" + wide(at[1]) + b"\x11"
        return t + (wide(at[4]) + b"\x0c\x24" + wide(at[5]) + b"\x0c\x25" if cids else wide(len(private)) + wide(at[2]) + b"\x12")

    def build(at):
        head = b"\1\0\4\4" + index([b"F"]) + index([top(at)]) + index(own) + index(list(globals_))
        parts, where = [charset, index(glyphs), private, index(list(subrs)) if subrs else b""], []
        out = head
        for p in parts:
            where.append(len(out))
            out += p
        where.append(len(out))
        out += index([wide(len(private)) + wide(where[2]) + b"\x12"]) if cids else b""
        where.append(len(out))
        out += bytes(1 + len(glyphs)) if cids else b""
        return out, where

    _, where = build([0] * 6)
    return build(where)[0]


BOX = num(100, 100) + b"\x15" + num(300) + b"\x06" + num(400) + b"\x07" + num(-300) + b"\x06\x0e"


def test_names():
    assert len(STRINGS) == 229 and STRINGS[1] == "space" and STRINGS[34] == "A" and STRINGS[149] == "germandbls" and STRINGS[150] == "onesuperior" and STRINGS[171] == "Aacute" and STRINGS[228] == "zcaron"


def test_compact():
    curve = num(500) + num(0, 0) + b"\x15" + num(10, 20, 30, 40) + b"\x1f" + num(5, 10, 20, 30, 40, 7) + b"\x08" + num(1, 2, 3, 4, 5) + b"\x1b\x0e"  # with a width
    called = num(-107) + b"\x0a" + num(-107) + b"\x1d\x0e"
    hinted = num(1, 2, 3, 4) + b"\x12" + num(5, 6) + b"\x13\xa0" + num(9) + b"\x16" + num(3, 4) + b"\x05\x0e"
    f = CFF(compact([b"\x0e", BOX, curve, called, hinted], ["A", "odd.name", "B", "C"], [num(7, 8) + b"\x15\x0b"], [num(5) + b"\x06\x0b"]))
    assert f.path(1) == [("m", 100, 100), ("l", 400, 100), ("l", 400, 500), ("l", 100, 500), ("h",)] and f.path(0) == [] and f.path(99) == []
    assert f.path(2) == [("m", 0, 0), ("c", 10, 0, 30, 30, 30, 70), ("c", 35, 80, 55, 110, 95, 117), ("c", 97, 118, 100, 122, 105, 122), ("h",)]
    assert f.path(3) == [("m", 7, 8), ("l", 12, 8), ("h",)] and f.path(4) == [("m", 9, 0), ("l", 12, 4), ("h",)]
    assert f.glyph(0, "odd.name") == 2 and f.glyph(65, None) == 1 and f.glyph(66, None) == 3 and f.glyph(1, "none") == 0
    flex = [num(0, 0) + b"\x15" + num(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 50) + b"\x0c\x23\x0e", num(0, 0) + b"\x15" + num(1, 2, 3, 4, 5, 6, 7) + b"\x0c\x22\x0e", num(0, 0) + b"\x15" + num(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) + b"\x0c\x25\x0e"]
    g = CFF(compact([b"\x0e", *flex], ["A", "B", "C"]))
    assert g.path(1)[2] == ("c", 16, 20, 25, 30, 36, 42) and g.path(2)[2][-1] == 0 and g.path(3)[2][-2:] == (0, 41)  # down is further than across, so x returns
    cid = CFF(compact([b"\x0e", BOX], ["x"], cids=[300]))
    assert cid.by_cid and cid.glyph_of_cid(300) == 1 and cid.glyph_of_cid(1) == 0 and cid.path(1) == f.path(1)
    for bad in (b"", b"\1\0\4\4", b"\2\0\4\4" * 9, compact([BOX], [])[:40]):
        with pytest.raises((ValueError, IndexError)):
            CFF(bad)


def encrypt(d, key):
    out = bytearray()
    for p in d:
        c = p ^ (key >> 8)
        out.append(c)
        key = ((c + key) * 52845 + 22719) & 0xFFFF
    return bytes(out)


def type1(glyphs, subrs=(), hexed=False, segments=False):
    one = lambda d: encrypt(bytes(4) + d, 4330)
    body = b"dup /Private 9 dict dup begin /lenIV 4 def /Subrs %d array\n" % len(subrs)
    body += b"".join(b"dup %d %d RD %s NP\n" % (k, len(one(s)), one(s)) for k, s in enumerate(subrs)) + b"ND 2 index /CharStrings %d dict dup begin\n" % len(glyphs)
    body += b"".join(b"/%s %d RD %s ND\n" % (n.encode(), len(one(d)), one(d)) for n, d in glyphs.items()) + b"end\n"
    head, tail = b"%!PS-AdobeFont-1.0\n/FontMatrix [0.001 0 0 0.001 0 0] def /Encoding 256 array dup 33 /box put readonly def currentfile eexec\n", encrypt(bytes(4) + body, 55665)
    tail = tail.hex().encode() if hexed else tail
    return b"\x80\1" + len(head).to_bytes(4, "little") + head + b"\x80\2" + len(tail).to_bytes(4, "little") + tail if segments else head + tail


def n1(*v):
    return b"".join(bytes([n + 139]) if -107 <= n <= 107 else b"\xff" + n.to_bytes(4, "big", signed=True) for n in v)


def test_type1():
    box = n1(50, 600) + b"\x0d" + n1(50, 100) + b"\x15" + n1(300) + b"\x06" + n1(400) + b"\x07" + n1(-300) + b"\x06\x09\x0e"
    curves = n1(0, 500) + b"\x0d" + n1(1, 2) + b"\x15" + n1(1, 2, 3, 4) + b"\x1e" + n1(1, 2, 3, 4) + b"\x1f" + n1(0) + b"\x0a\x09\x0e"
    accented = n1(50, 600) + b"\x0d" + n1(10, 200, 300, 65, 193) + b"\x0c\x06"
    flex = n1(0, 500) + b"\x0d" + n1(0) + b"\x16" + n1(0, 1) + b"\x0c\x10" + b"".join(n1(a, b) + b"\x15" + n1(0, 2) + b"\x0c\x10" for a, b in ((5, 5), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6))) + n1(50, 26, 26, 3, 0) + b"\x0c\x10\x0c\x11\x0c\x11\x0c\x21\x09\x0e"
    want = [("m", 100, 100), ("l", 400, 100), ("l", 400, 500), ("l", 100, 500), ("h",)]
    for hexed, segments in ((False, False), (True, False), (False, True)):
        f = Type1(type1({".notdef": b"\x0e", "box": box, "A": box, "grave": box, "curves": curves, "Agrave": accented, "flex": flex}, [n1(7) + b"\x06\x0b"], hexed, segments))
        assert f.path("box") == want and f.path("none") == [] and f.glyph(33, None) == "box" and f.glyph(33, "curves") == "curves"
        assert f.path("curves") == [("m", 1, 2), ("c", 1, 3, 3, 6, 7, 6), ("c", 8, 6, 10, 9, 10, 13), ("l", 17, 13), ("h",)]
        both = f.path("Agrave")
        assert both[:5] == want and both[5] == ("m", 100 + 240, 400) and len(both) == 10
        assert [x for x in f.path("flex") if x[0] == "c"] == [("c", 6, 6, 8, 8, 11, 11), ("c", 15, 15, 20, 20, 26, 26)]
    with pytest.raises(ValueError):
        Type1(b"no font")


@pytest.mark.parametrize("key", ["FontFile3", "FontFile"])
def test_text_is_drawn(key):
    n = n1(0, 1000) + b"\x0d" + n1(0) + b"\x16" + n1(500) + b"\x06" + n1(500) + b"\x07" + n1(-500) + b"\x06\x09\x0e"
    program = compact([b"\x0e", num(0) + b"\x16" + num(500) + b"\x06" + num(500) + b"\x07" + num(-500) + b"\x06\x0e"], ["A"]) if key == "FontFile3" else type1({"A": n})

    def font(w):
        file = w.stream(program)
        return {"Resources": {"Font": {"F9": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("X"), "FirstChar": 65, "Widths": [1000], "Encoding": Name("WinAnsiEncoding"), "FontDescriptor": {key: file}}}}}

    d = Document(C.document([b"BT /F9 20 Tf 0 0 Td (AA) Tj ET"], page_attrs={"MediaBox": [0, 0, 40, 20]}, build=font))
    px, warn = draw(d, d.pages[0])
    ink = (px == 0).all(2)
    want = np.zeros((20, 40), bool)
    want[10:, 0:10] = want[10:, 20:30] = True
    assert (ink == want).all() and not warn
    assert re.sub(r"\s", "", str(d.pages[0].size)) == "(40.0,20.0)"
