import math
import random

import numpy as np
import pytest

from quire import corpus as C
from quire.kernels import colors, fax, filters, jpeg, metrics
from quire.kernels.document import Document
from quire.kernels.objects import Name
from quire.kernels.raster import MOST_WARNINGS, draw, function, report


class Bits:
    def __init__(self):
        self.s = []

    def put(self, code):
        self.s.append(code)

    def bytes(self, fill="0"):
        s = "".join(self.s)
        s += fill * (-len(s) % 8)
        return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8))


def fax_run(bits, n, color):
    table = {v: k for k, v in fax.runs((fax.WHITE, fax.BLACK)[color]).items()}
    while n > 2623:
        bits.put(table[2560])
        n -= 2560
    if n >= 64:
        bits.put(table[n // 64 * 64])
    bits.put(table[n % 64])


def changes(row):
    return [k for k in range(len(row)) if row[k] != (row[k - 1] if k else 0)]


def fax_down(bits, row, above):
    """One line of two-dimensional coding, straight from the rules."""
    w, modes = len(row), {v: k for k, v in fax.MODES.items()}
    at = lambda r, k: r[k] if k >= 0 else 0
    edges = lambda r: [k for k in range(w) if r[k] != at(r, k - 1)]
    a0, color = -1, 0
    while a0 < w:
        a1 = next((k for k in range(max(a0, 0), w) if row[k] != color and k > a0 - (a0 < 0)), w)
        b1 = next((k for k in edges(above) if k > a0 and above[k] != color), w)
        b2 = next((k for k in edges(above) if k > b1), w)
        if b2 < a1:
            bits.put(modes["pass"])
            a0 = b2
        elif abs(a1 - b1) <= 3:
            bits.put(modes[a1 - b1])
            a0, color = a1, 1 - color
        else:
            a2 = next((k for k in range(a1 + 1, w) if row[k] == color), w)
            bits.put(modes["across"])
            fax_run(bits, a1 - max(a0, 0), color)
            fax_run(bits, a2 - a1, 1 - color)
            a0 = a2


def pictures():
    r = random.Random(1)
    for w, h, p in ((1, 1, 0.5), (8, 3, 0.5), (33, 9, 0.3), (200, 30, 0.05), (3000, 4, 0.001), (64, 20, 0.0), (70, 20, 1.0), (130, 25, 0.9)):
        rows = [[0] * w]
        for _ in range(h):
            row = list(rows[-1])
            for k in range(w):
                if r.random() < p:
                    row[k] ^= 1
            rows.append(row)
        yield w, rows[1:]


def packed(w, rows, black):
    return np.packbits(np.array(rows, np.uint8) if black else 1 - np.array(rows, np.uint8), axis=1).tobytes()


def test_fax_codes_are_prefix_free():
    for codes in (fax.WHITE, fax.BLACK):
        table = fax.runs(codes)
        assert len(table) == 104 and sorted(table.values()) == [*range(64), *range(64, 2561, 64)]
        assert not any(a != b and b.startswith(a) for a in table for b in table)


@pytest.mark.parametrize("black", [True, False])
def test_fax(black):
    for w, rows in pictures():
        four, one, two, aligned = Bits(), Bits(), Bits(), Bits()
        above = [0] * w
        for k, row in enumerate(rows):
            fax_down(four, row, above)
            for bits in (one, aligned):
                edge, color = 0, 0
                for x in [*changes(row), w]:
                    fax_run(bits, x - edge, color)
                    edge, color = x, 1 - color
            aligned.put("0" * (-len("".join(aligned.s)) % 8))
            two.put("000000000001" + ("1" if k % 3 == 0 else "0"))
            if k % 3 == 0:
                edge, color = 0, 0
                for x in [*changes(row), w]:
                    fax_run(two, x - edge, color)
                    edge, color = x, 1 - color
            else:
                fax_down(two, row, above)
            above = row
        want, size = packed(w, rows, black), {"Columns": w, "Rows": len(rows), "BlackIs1": black}
        four.put("000000000001" * 2)
        assert fax.decode(four.bytes(), {**size, "K": -1}) == want, w
        assert fax.decode(four.bytes(), {**size, "K": -1, "Rows": 0}) == want, w
        assert fax.decode(one.bytes(), size) == want, w
        assert fax.decode(aligned.bytes(), {**size, "EncodedByteAlign": True}) == want, w
        assert fax.decode(two.bytes(), {**size, "K": 4}) == want, w
    assert filters.decode({"Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": 8}, "Height": 2}, b"") == b"\xff\xff"


def zigzag(block):
    return [block[k // 8][k % 8] for k in jpeg.ZIGZAG]


def jpeg_of(planes, sampling, progressive=False, restart=0, adobe=None):
    """A JPEG file with flat tables: symbols of eight bits."""
    h, w = planes[0].shape
    mh, mv = max(s[0] for s in sampling), max(s[1] for s in sampling)
    seg = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    cos = np.array([[math.sqrt((1 if u else 0.5) / 4) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    symbols = list(range(12)) + [r << 4 | s for r in range(16) for s in range(1, 11)] + [0xF0] + [r << 4 for r in range(1, 15)] + [0]
    symbols = sorted(set(symbols))
    code = {s: f"{k:08b}" for k, s in enumerate(symbols)}
    value = lambda v: (f"{v:0{abs(v).bit_length()}b}" if v > 0 else f"{(1 << abs(v).bit_length()) - 1 + v:0{abs(v).bit_length()}b}") if v else ""
    mx, my = -(-w // (8 * mh)), -(-h // (8 * mv))
    coded = []
    for p, (sh, sv) in zip(planes, sampling):
        small = p[:: mv // sv, :: mh // sh]
        full = np.pad(small, ((0, my * 8 * sv - small.shape[0]), (0, mx * 8 * sh - small.shape[1])), "edge").astype(float) - 128
        coded.append({(y, x): zigzag(np.rint(cos @ full[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] @ cos.T).astype(int).tolist()) for y in range(my * sv) for x in range(mx * sh)})
    out = b"\xff\xd8" + seg(0xDB, bytes([0]) + b"\1" * 64) + (seg(0xEE, b"Adobe" + bytes(6) + bytes([adobe])) if adobe is not None else b"")
    out += seg(0xC2 if progressive else 0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([k + 1, s[0] << 4 | s[1], 0]) for k, s in enumerate(sampling)))
    counts = bytes([0] * 7 + [len(symbols)] + [0] * 8)
    out += seg(0xC4, bytes([0]) + counts + bytes(symbols)) + seg(0xC4, bytes([16]) + counts + bytes(symbols))
    out += seg(0xDD, restart.to_bytes(2, "big")) if restart else b""

    def scan(parts, start, end, high, low, units, emit):
        body = bytes([len(parts)]) + b"".join(bytes([k + 1, 0]) for k in parts) + bytes([start, end, high << 4 | low])
        data, bits, last = b"", Bits(), {}
        for n, unit in enumerate(units):
            if restart and n and n % restart == 0:
                data += bits.bytes("1").replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
                bits, last = Bits(), {}
            for k, at in unit:
                emit(bits, coded[k][at], k, last)
        return seg(0xDA, body) + data + bits.bytes("1").replace(b"\xff", b"\xff\0")

    def put_ac(bits, z, start, end, low):
        run = 0
        cut = lambda v: int(math.copysign(abs(v) >> low, v))
        for v in map(cut, z[start : end + 1]):
            if not v:
                run += 1
                continue
            while run > 15:
                bits.put(code[0xF0])
                run -= 16
            bits.put(code[run << 4 | abs(v).bit_length()] + value(v))
            run = 0
        if run:
            bits.put(code[0])

    def put_dc(low):
        def emit(bits, z, k, last):
            v = z[0] >> low
            d = v - last.get(k, 0)
            last[k] = v
            bits.put(code[abs(d).bit_length()] + value(d))

        return emit

    def put_all(bits, z, k, last):
        put_dc(0)(bits, z, k, last)
        put_ac(bits, z, 1, 63, 0)

    def put_refined(bits, z, start, end, low):
        """Refinement of one block, ended by itself."""
        run, tail = 0, ""
        cut = [abs(v) >> low for v in z]
        new = [k for k in range(start, end + 1) if cut[k] == 1]
        for k in range(start, end + 1):
            if cut[k] > 1:
                tail += str(cut[k] & 1)
            elif cut[k] == 0:
                run += 1
                if run == 16 and any(j > k for j in new):
                    bits.put(code[0xF0] + tail)
                    run, tail = 0, ""
            else:
                bits.put(code[run << 4 | 1] + ("1" if z[k] > 0 else "0") + tail)
                run, tail = 0, ""
        if run or tail:
            bits.put(code[0] + tail)

    mixed = [[(k, (y * s[1] + j, x * s[0] + i)) for k, s in enumerate(sampling) for j in range(s[1]) for i in range(s[0])] for y in range(my) for x in range(mx)]
    alone = lambda k: [[(k, (y, x))] for y in range(-(-(-(-h * sampling[k][1] // mv)) // 8)) for x in range(-(-(-(-w * sampling[k][0] // mh)) // 8))]
    units = mixed if len(planes) > 1 else alone(0)
    every = list(range(len(planes)))
    if not progressive:
        return out + scan(every, 0, 63, 0, 0, units, put_all) + b"\xff\xd9"
    out += scan(every, 0, 0, 0, 1, units, put_dc(1)) + scan(every, 0, 0, 1, 0, units, lambda bits, z, k, last: bits.put(str(z[0] & 1)))
    for k in every:
        out += scan([k], 1, 5, 0, 1, alone(k), lambda bits, z, k, last: put_ac(bits, z, 1, 5, 1)) + scan([k], 6, 63, 0, 1, alone(k), lambda bits, z, k, last: put_ac(bits, z, 6, 63, 1))
        out += scan([k], 1, 63, 1, 0, alone(k), lambda bits, z, k, last: put_refined(bits, z, 1, 63, 0))
    return out + b"\xff\xd9"


def plane(h, w, seed):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 90 * np.sin((x + seed) / 9) * np.cos(y / (7 + seed)) + np.random.RandomState(seed).randint(-9, 9, (h, w)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg(progressive):
    for h, w, restart in ((8, 8, 0), (17, 30, 0), (40, 25, 2)):
        gray = plane(h, w, 1)
        got = jpeg.decode(jpeg_of([gray], [(1, 1)], progressive, restart))
        assert got.shape == (h, w, 1) and np.abs(got[:, :, 0].astype(int) - gray).max() <= 2
        planes = [plane(h, w, k) for k in (1, 2, 3)]
        got = jpeg.decode(jpeg_of(planes, [(1, 1)] * 3, progressive, restart, adobe=0))
        assert all(np.abs(got[:, :, k].astype(int) - planes[k]).max() <= 2 for k in range(3))
    y = plane(33, 47, 2)
    flat = np.full((33, 47), 128, np.uint8)
    got = jpeg.decode(jpeg_of([y, flat, flat], [(2, 2), (1, 1), (1, 1)], progressive))
    assert got.shape == (33, 47, 3) and np.abs(got.astype(int) - y[:, :, None]).max() <= 3
    red = jpeg.decode(jpeg_of([np.full((8, 8), 76, np.uint8), np.full((8, 8), 85, np.uint8), np.full((8, 8), 255, np.uint8)], [(1, 1)] * 3, progressive))
    assert np.abs(red.astype(int) - [254, 0, 0]).max() <= 2
    four = [plane(16, 16, k) for k in range(4)]
    got = jpeg.decode(jpeg_of(four, [(1, 1)] * 4, progressive, adobe=0))
    assert got.shape == (16, 16, 4) and all(np.abs(got[:, :, k].astype(int) - four[k]).max() <= 2 for k in range(4))


def test_damaged_jpeg():
    data = jpeg_of([plane(64, 64, 1)], [(1, 1)])
    got = jpeg.decode(data[: len(data) // 2])
    assert got.shape == (64, 64, 1) and np.abs(got[:8, :8, 0].astype(int) - plane(64, 64, 1)[:8, :8]).max() <= 2
    for bad in (b"", b"\xff\xd8", b"\xff\xd8\xff\xc3\0\x0b\x08\0\x08\0\x08\1\1\x11\0", data[:60]):
        with pytest.raises(filters.Undecodable):
            jpeg.decode(bad)


def picture(build, content, box=(0, 0, 20, 20)):
    d = Document(C.document([content], "flate", page_attrs={"MediaBox": list(box)}, build=build))
    return draw(d, d.pages[0])


def test_images_of_codecs():
    def build(w):
        red = jpeg_of([np.full((8, 8), 76, np.uint8), np.full((8, 8), 85, np.uint8), np.full((8, 8), 255, np.uint8)], [(1, 1)] * 3)
        fax_ = Bits()
        fax_down(fax_, [0, 0, 0, 0, 1, 1, 1, 1], [0] * 8)
        image = {"Subtype": Name("Image"), "BitsPerComponent": 8}
        return {"Resources": {"XObject": {
            "J": w.add({**image, "Width": 8, "Height": 8, "ColorSpace": Name("DeviceRGB"), "Filter": Name("DCTDecode"), "Length": len(red)}, red),
            "F": w.add({**image, "Width": 8, "Height": 1, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": 8}, "Length": 9}, fax_.bytes()),
            "X": w.add({**image, "Width": 8, "Height": 8, "ColorSpace": Name("DeviceRGB"), "Filter": Name("JPXDecode"), "Length": 1}, b"x"),
        }}}

    px, warn = picture(build, b"q 10 0 0 10 0 10 cm /J Do Q q 20 0 0 10 0 0 cm /F Do Q q 5 0 0 5 15 15 cm /X Do Q")
    assert px[5, 5, 0] > 250 and px[5, 5, 1:].max() < 4 and px[15, 5].tolist() == [255] * 3 and px[15, 15].tolist() == [0] * 3
    assert px[2, 17].tolist() == [255] * 3 and list(warn) == ["Image JPXDecode"]


def test_unknown_space_is_told():
    px, warn = picture(lambda w: {"Resources": {"ColorSpace": {"Odd": [Name("Odd"), 1]}}}, b"/Odd cs 0.5 scn 0 0 20 20 re f")
    assert list(warn) == ["ColorSpace Odd"]
    _, warn = picture(lambda w: {"Resources": {"ColorSpace": {"P": [Name("Pattern")]}, "Pattern": {}}}, b"/P cs /None scn 0 0 20 20 re f")
    assert list(warn) == ["Pattern skipped"]


def test_spaces():
    class Doc:
        resolve = staticmethod(lambda x: x)

    load = lambda x: colors.load(Doc, x, function)
    assert load(Name("DeviceCMYK")).one([1, 0, 0, 0]) == (0, 1, 1) and load(Name("G")).one([0.5]) == (0.5,) * 3
    lab = load([Name("Lab"), {"WhitePoint": [0.9642, 1, 0.8249], "Range": [-128, 127, -128, 127]}])
    white, red = lab.one([100, 0, 0]), lab.one([54.3, 80.8, 69.9])
    assert min(white) > 0.99 and red[0] > 0.97 and max(red[1:]) < 0.1
    tint = {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [0.2, 0.4, 0.6], "N": 1}
    spot = load([Name("Separation"), Name("X"), Name("DeviceRGB"), tint])
    assert spot.one([1]) == pytest.approx((0.2, 0.4, 0.6)) and spot.first == [1.0]
    assert math.isnan(load([Name("Separation"), Name("None"), Name("DeviceRGB"), tint]).rgb(np.array([1.0]))[0])
    index = load([Name("Indexed"), Name("DeviceRGB"), 1, b"\0\0\0\xff\0\x33"])
    assert index.one([1]) == (1, 0, 0.2) and index.one([9]) == (1, 0, 0.2) and load([Name("Indexed"), Name("DeviceRGB"), 999, b""]) is None
    assert load([Name("Pattern")]) is None and load(Name("Nothing")) is None and load(None) is None


def test_functions():
    class Doc:
        resolve = staticmethod(lambda x: x)
        stream_data = staticmethod(lambda s: s.data)

    from quire.kernels.objects import Stream

    make = lambda body, **attrs: function(Doc, Stream(attrs, body))
    grid = make(bytes([0, 255, 0, 255]), FunctionType=0, Domain=[0, 1, 0, 1], Range=[0, 1], Size=[2, 2], BitsPerSample=8)
    assert grid([0, 0]) == [0] and grid([1, 0]) == [1] and grid([0.25, 0.7]) == pytest.approx([0.25])
    four = make(bytes([0x0F]), FunctionType=0, Domain=[0, 1], Range=[0, 30], Size=[2], BitsPerSample=4)
    assert four(0.5) == pytest.approx([15])
    calc = lambda text, x, n=1: make(text, FunctionType=4, Domain=[-9, 9] * len(x), Range=[-99, 99] * n)(x)
    assert calc(b"{ dup mul exch 2 mul add }", [3, 4]) == [22] and calc(b"{ 0 gt { 1 } { 2 } ifelse }", [3]) == [1] and calc(b"{ 3 1 roll }", [1, 2, 3], 3) == [3, 1, 2]
    assert calc(b"{ 2 copy sub 2 index }", [5, 3], 4) == [5, 3, 2, 5] and calc(b"{ 60 cos 7 3 idiv 90 sin % note\n }", [1], 4)[1:] == pytest.approx([0.5, 2, 1])
    assert calc(b"{ pop pop pop }", [1]) == [0] and make(b"{ 1 ", FunctionType=4, Domain=[0, 1], Range=[0, 1]) is None


def test_masks_and_patterns():
    def build(w):
        image = {"Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}
        stencil = w.stream(b"\x40", {"Subtype": Name("Image"), "Width": 2, "Height": 1, "ImageMask": True, "BitsPerComponent": 1})
        shade = {"ShadingType": 2, "ColorSpace": Name("DeviceGray"), "Coords": [0, 0, 20, 0], "Function": {"FunctionType": 2, "Domain": [0, 1], "C0": [0], "C1": [1], "N": 1}}
        return {"Resources": {
            "XObject": {"M": w.stream(b"\0\0", {**image, "Mask": stencil})},
            "Pattern": {"S": {"PatternType": 2, "Shading": shade}, "T": w.stream(b"1 0 0 rg 0 0 2 4 re f", {"PatternType": 1, "PaintType": 1, "BBox": [0, 0, 4, 4], "XStep": 4, "YStep": 4, "Resources": {}})},
        }}

    px, warn = picture(build, b"q 20 0 0 5 0 15 cm /M Do Q /Pattern cs /S scn 0 5 20 5 re f /T scn 0 0 20 5 re f")
    assert px[2, 5].tolist() == [0] * 3 and px[2, 15].tolist() == [255] * 3 and not warn
    assert px[12, 1, 0] < 30 and 110 < px[12, 10, 0] < 150 and px[12, 18, 0] > 220
    assert px[17, 1].tolist() == [255, 0, 0] and px[17, 3].tolist() == [255] * 3 and px[17, 5].tolist() == [255, 0, 0]


def test_report():
    from collections import Counter

    assert report(Counter({"a": 1, "b": 2})) == ["a", "b (2)"]
    got = report(Counter({f"w{k:03}": 2 for k in range(MOST_WARNINGS + 3)}))
    assert len(got) == MOST_WARNINGS + 1 and got[-1] == "6 more"


def test_widths():
    assert metrics.face("ABCDEF+Arial,Bold") == "Helvetica-Bold" and metrics.face("TimesNewRomanPS-BoldItalicMT") == "Times-BoldItalic" and metrics.face("Courier-Oblique") == "Courier" and metrics.face("Garamond") is None
    assert metrics.width("Helvetica", "A") == 667 and metrics.width("Helvetica", "Ä") == 667 and metrics.width("Times-Roman", "í") == 278 and metrics.width("Courier", "x") == 600 and metrics.width("Helvetica", "漢") is None


def test_good_pages_stay():
    """A fault in reading one page costs the rows of that page alone."""
    from quire.sources import pdf

    d = Document(C.document([C.text_page([(f"page {k}", 12, "F1")]) for k in range(3)]))
    real = pdf.read_page

    def bad(doc, page, cache):
        if page is d.pages[2]:
            raise ValueError("broken")
        return real(doc, page, cache)

    pdf.read_page = bad
    try:
        assert [r[0] for r in pdf.VIEWS["text"](d)] == [0, 1]
        assert list(pdf.VIEWS["skips"](d)) == [(2, "PageContents", "Unreadable", "ValueError: broken", 1)]
        assert "page 1" in next(pdf.VIEWS["document_text"](d))[0]
    finally:
        pdf.read_page = real
    with pytest.raises(ValueError):
        pdf.page_index(0, 3)
    assert pdf.page_index(3, 3) == 2


def test_pages_are_dealt(spark, tmp_path):
    """Ranges of pages read by ranged reads, one file of many pages beside others, and one that is no document."""
    from pyspark.sql import functions as F

    from quire.sources import pdf

    want = []
    for k, n in enumerate((1, 25, 0, 7)):
        data = C.document([C.text_page([(f"file {k} page {j}", 12, "F1")]) for j in range(n)], C.FLAVOURS[k]) if n else b"nothing"
        (tmp_path / f"{k}.pdf").write_bytes(data)
        want += [(f"{k}.pdf", j, f"file {k} page {j}") for j in range(n)]
    df = spark.createDataFrame([(str(tmp_path / f"{k}.pdf"),) for k in range(4)] + [(str(tmp_path / "missing.pdf"),)], "path string")
    text = pdf.ranged_view(df, "text", per=4).select(F.substring_index("path", "/", -1), "page", F.trim("text"))
    assert sorted(map(tuple, text.collect())) == sorted(want)
    assert text.rdd.getNumPartitions() > 1
    with pytest.raises(ValueError):
        pdf.ranged_view(df, "markdown")
    assert [p.rsplit("/", 1)[1] for p in pdf.listed(f"{tmp_path}/*.pdf")] == ["0.pdf", "1.pdf", "2.pdf", "3.pdf"] == [p.rsplit("/", 1)[1] for p in pdf.listed(f"file://{tmp_path.parent}/**/*.pdf") if tmp_path.name in p]
    assert pdf.listed(f"{tmp_path}/none*") == [] and len(pdf.listed(f"{tmp_path}/1.pdf")) == 1


def test_inherit_tells_cycles(spark):
    from quire.operators.tables import inherit

    rows = [("a", None, 1), ("b", "a", None), *[(f"n{k}", f"n{k - 1}" if k else "b", None) for k in range(200)], ("x", "y", None), ("y", "x", 7)]
    got = {r.node: (r.depth, r.v, r.error) for r in inherit(spark.createDataFrame(rows, "node string, parent string, v int"), ["v"], most=256).collect()}
    assert got["a"] == (0, 1, None) and got["b"] == (1, 1, None) and got["n199"] == (201, 1, None) and got["x"][2] == got["y"][2] == "too deep"
