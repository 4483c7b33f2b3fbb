import hashlib
import random
import zlib

import pytest

from quire import corpus as C
from quire.kernels import content, crypt, filters, fonts, layout
from quire.kernels.document import Document, DocumentError, startxref, version
from quire.kernels.objects import Name, Op, Parser, ParseError, Ref, Stream, number, pretty, text_string


def parse(b, refs=True):
    return Parser(b, refs=refs).value()


def test_objects():
    assert parse(b"[1 -2.5 +3 .5 4. true false null /A#20b (x\\(y\\)\\101\\\n(z)) <48 6 5> 3 0 R << /K [<< >>] /N null >>]") == [1, -2.5, 3, 0.5, 4.0, True, False, None, Name("A b"), b"x(y)A(z)", b"He", Ref(3, 0), {"K": [{}]}]
    assert parse(b"<48656>") == b"He`" and parse(b"% c\n/X") == "X" and parse(b"1 0 R", refs=False) == 1 and isinstance(parse(b"foo"), Op)
    assert parse(b"(a\r\nb\rc\\\r\nd)") == b"a\nb\ncd" and parse(b"(open") == b"open" and parse(b"[1 2") == [1, 2] and parse(b"<< /A 1 ] /B 2 >>") == {"A": 1, "B": 2}
    assert number(b"--5") == -5 and number(b"1.2.3") == 1.2 and number(b"+") == 0 and number(b"9" * 30) == 1e30
    with pytest.raises(ParseError):
        parse(b"  ")
    with pytest.raises(ParseError):
        parse(b"[" * 200)
    assert text_string(b"\xfe\xff\x00a\x20\xac") == "a€" and text_string(b"\xef\xbb\xbf\xc3\xa9") == "é" and text_string(b"\xe9") == "é" and text_string(None) is None
    assert pretty({"A": [1, Name("B")], "C": b"x"}) == "<<\n  /A [1 /B]\n  /C (x)\n>>"


def test_round_trip_of_values():
    r = random.Random(1)

    def value(d=0):
        k = r.randint(0, 8 if d < 3 else 5)
        if k == 6:
            return [value(d + 1) for _ in range(3)]
        if k == 7:
            return {"a": value(d + 1) or 0}
        return (None, True, r.randint(-999, 999), Name("n#/ x"), bytes(r.randrange(256) for _ in range(9)).replace(b"\r", b""), Ref(3, 0), None, None, False)[k]

    for _ in range(300):
        v = value()
        assert parse(C.dump(v)) == v or v is None


def test_filters():
    r = random.Random(2)
    for n in (0, 1, 4, 100, 5000):
        d = bytes(r.choice(b"abcab \0\xff") for _ in range(n))
        for name, (names, enc) in C.ENCODERS.items():
            assert filters.decode({"Filter": [Name(x) for x in names]}, enc(d)) == d, name
    assert filters.flate(zlib.compress(b"hello" * 99)[:-9]).startswith(b"hello") and filters.flate(zlib.compress(b"x")[2:-4]) == b"x" and filters.flate(b"\n" + zlib.compress(b"y")) == b"y"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!" and filters.ascii85(b"z~>") == bytes(4) and filters.ascii_hex(b"4 8x65>ff") == b"He" and filters.run_length(b"\x02abc\xfed\x80zz") == b"abcddd"
    with pytest.raises(filters.Undecodable):
        filters.ascii85(b"s8W-\"~>")
    with pytest.raises(filters.Unsupported):
        filters.decode({"Filter": Name("JBIG2Decode")}, b"")
    assert filters.decode({"Filter": [Name("AHx"), Name("DCT")]}, b"FFD8>") == b"\xff\xd8"


def test_predictors():
    r = random.Random(3)
    for bpp, columns in ((1, 7), (3, 5)):
        rows = [bytes(r.randrange(256) for _ in range(bpp * columns)) for _ in range(10)]
        prev, enc = bytes(bpp * columns), b""
        for k, row in enumerate(rows):
            kind = k % 5
            left = lambda i: row[i - bpp] if i >= bpp else 0  # noqa: E731, B023
            corner = lambda i: prev[i - bpp] if i >= bpp else 0  # noqa: E731, B023

            def paeth(i):
                a, b, c = left(i), prev[i], corner(i)  # noqa: B023
                return min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))

            guess = [lambda i: 0, left, lambda i: prev[i], lambda i: (left(i) + prev[i]) // 2, paeth][kind]  # noqa: B023
            enc += bytes([kind]) + bytes((row[i] - guess(i)) & 255 for i in range(len(row)))
            prev = row
        assert filters.predict(enc, {"Predictor": 15, "Colors": bpp, "Columns": columns}) == b"".join(rows)
    assert filters.predict(bytes([1, 1, 1, 5, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])


def test_crypt_vectors():
    k, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_blocks(k, block, True).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" and crypt.aes_blocks(bytes(range(32)), block, True).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    data = b"sixteen byte blk" * 3
    assert crypt.aes_cbc_decrypt(k, crypt.aes_cbc_encrypt(k, data, bytes(16)), bytes(16), False) == data


def encrypted(user: bytes, owner: bytes, text: str) -> bytes:
    """A document under the handler's third revision, 128-bit RC4."""
    fid, perm = b"0123456789abcdef", 0xFFFFFFFC
    key = hashlib.md5((owner + crypt.PAD)[:32]).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    o = (user + crypt.PAD)[:32]
    for i in range(20):
        o = crypt.rc4(bytes(c ^ i for c in key), o)
    k = hashlib.md5((user + crypt.PAD)[:32] + o + perm.to_bytes(4, "little") + fid).digest()
    for _ in range(50):
        k = hashlib.md5(k).digest()
    u = crypt.rc4(k, hashlib.md5(crypt.PAD + fid).digest())
    for i in range(1, 20):
        u = crypt.rc4(bytes(c ^ i for c in k), u)
    w = C.Writer()
    cat, tree = w.add(None), w.add(None)
    font = w.add(C.simple_font("Helvetica"))
    seal = lambda n, d: crypt.rc4(hashlib.md5(k + n.to_bytes(3, "little") + b"\0\0").digest(), d)
    body = seal(4, C.text_page([(text, 12, "F1")]))
    c = w.add({"Length": len(body)}, body)
    page = w.add({"Type": Name("Page"), "Parent": tree, "Contents": c})
    w.objects[cat.num] = ({"Type": Name("Catalog"), "Pages": tree}, None)
    w.objects[tree.num] = ({"Type": Name("Pages"), "Kids": [page], "Count": 1, "Resources": {"Font": {"F1": font}}}, None)
    enc = w.add({"Filter": Name("Standard"), "V": 2, "R": 3, "Length": 128, "O": o, "U": u + bytes(16), "P": perm - (1 << 32)})
    w.trailer.update({"Root": cat, "Encrypt": enc, "ID": [fid, fid]})
    return w.bytes()


def test_encrypted():
    b = encrypted(b"", b"chief", "secret text")
    for password in ("", "chief"):
        assert text_of(Document(b, password)) == "secret text"
    b = encrypted(b"me", b"chief", "secret text")
    assert text_of(Document(b, "me")) == text_of(Document(b, "chief")) == "secret text"
    with pytest.raises(DocumentError):
        Document(b, "other")


def text_of(d):
    cache = {}
    return "\f".join(layout.text_of(content.read_page(d, p, cache).spans) for p in d.pages)


def lay(stream: bytes) -> str:
    return text_of(Document(C.document([stream])))


@pytest.mark.parametrize("flavour", C.FLAVOURS)
def test_flavours(flavour):
    text = "one (two) \\ three\nüber ß | # é\n" + "\n".join(f"line {k}" for k in range(80))
    d = Document(C.from_text(text, flavour))
    assert text_of(d).replace("\f", "\n") == text and len(d.pages) == 3 == d.declared_pages()
    kinds = [e["kind"] for e in d.elements()]
    assert kinds[0] == "header" and kinds.count("page") == 3 and all(not e["error"] for e in d.elements())


def test_text_layout():
    assert lay(b"BT /F1 12 Tf 72 700 Td (Line one) Tj 0 -20 Td (Line two) Tj ET") == "Line one\nLine two"
    assert lay(b"BT /F1 12 Tf 72 700 Td [(A) -300 (B)] TJ ET") == "A B" and lay(b"BT /F1 12 Tf 72 700 Td [(A) -50 (B)] TJ ET") == "AB"
    assert lay(b"BT /F1 12 Tf 3 Tr 72 700 Td (hidden) Tj ET") == "hidden" and lay(b"BT /F1 12 Tf 14 TL 72 700 Td (a) Tj T* (b) Tj (c) ' ET") == "a\nb\nc"
    assert lay(b"q 1 0 0 1 10 10 cm BT /F1 12 Tf (x) Tj ET Q") == "x" and lay(b"BT /F9 12 Tf (none) Tj ET") == ""


def test_forms():
    w = C.Writer()
    cat, tree, font = w.add(None), w.add(None), w.add(C.simple_font("Helvetica-BoldOblique"))
    form = w.add(None)
    body = b"BT /F1 10 Tf 5 5 Td (in form) Tj ET /X Do"
    w.objects[form.num] = ({"Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 100, 200], "Resources": {"XObject": {"X": form}}, "Length": len(body)}, body)
    page = w.add({"Type": Name("Page"), "Parent": tree, "Contents": w.stream(b"/X Do"), "Resources": {"Font": {"F1": font}, "XObject": {"X": form}}})
    w.objects[cat.num], w.objects[tree.num] = ({"Type": Name("Catalog"), "Pages": tree}, None), ({"Type": Name("Pages"), "Kids": [page], "Count": 1}, None)
    w.trailer["Root"] = cat
    d = Document(w.bytes())
    r = content.read_page(d, d.pages[0], {})
    assert r.spans[0][:3] == ("in form", 105.0, 205.0) and r.spans[0].bold and r.spans[0].italic and r.skips["Form", "LimitExceeded", "nested forms"] == 1 and len(r.spans) == 16


def md(*pages, **k):
    d = Document(C.document(list(pages), **k))
    from quire.sources.pdf import VIEWS

    return next(VIEWS["markdown"](d))[0]


def test_markdown():
    lines = [("Title", 18, "F1"), ("text with | pipe", 12, "F1"), ("# not a heading", 12, "F1")] + [("more words in the body", 12, "F1")] * 3
    assert md(C.text_page(lines)) == "# Title\n\ntext with \\| pipe\n\\# not a heading\n" + "\n".join(["more words in the body"] * 3)
    assert md(C.text_page([("1. one", 12, "F1"), ("2. two", 12, "F1")])) == "1. one\n2. two" and md(C.text_page([("• one", 12, "F1"), ("- two", 12, "F1")])) == "- one\n- two"
    grid = [["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"], ["7", "8", "9"]]
    assert md(C.table_page(grid, [72, 250, 430])).splitlines()[2] == "| 1 | 2 | 3 |"
    assert md(C.table_page([["x", "y"], ["1", "2"]], [72, 250], ruled=True)) == "| x | y |\n| --- | --- |\n| 1 | 2 |"
    run = [C.text_page([("ACME REPORT", 12, "F1")], 770) + C.text_page([(f"page {w} says something", 12, "F1"), (f"and {w} goes on", 12, "F1")], 700) + C.text_page([(str(k), 12, "F1")], 40) for k, w in enumerate(("ab", "cd", "ef"))]
    assert "ACME" not in md(*run) and "page ab" in md(*run) and md(*run).count("goes on") == 3


def test_inline_style():
    line = layout.Line([("plain ", False, False), ("bold", True, False), (" and ", False, False), ("both ", True, True), ("...", True, False)], 0, 0, 1, 1)
    assert layout.emphasis(line) == "plain **bold** and ***both*** ..."


def test_recovery_and_damage():
    good = C.from_text("hello\nworld", "flate")
    assert text_of(Document(good.replace(b"startxref", b"startxxxx"))) == "hello\nworld" and text_of(Document(b"junk\n" + good)) == "hello\nworld"
    assert version(b"x%PDF-1.3") == (1, 3) and version(b"") == (1, 4) and startxref(good)[0] > 0 and startxref(b"") is None
    r = random.Random(5)
    for _ in range(150):
        b = bytearray(good)
        for _ in range(r.randint(1, 20)):
            b[r.randrange(len(b))] = r.randrange(256)
        try:
            d = Document(bytes(b[: r.randint(1, len(b))]))
        except DocumentError:
            continue
        list(d.elements(content_ops=True))
        text_of(d)
    with pytest.raises(DocumentError):
        Document(b"")


def test_hybrid():
    base = C.from_text("shown", "classic")
    at = len(base)
    info = b"9 0 obj\n<< /Title (hid) >>\nendobj\n"
    rows = b"\1" + at.to_bytes(4, "big") + b"\0"
    xs_at = at + len(info)
    xs = b"10 0 obj\n" + C.dump({"Type": Name("XRef"), "Size": 11, "W": [1, 4, 1], "Index": [9, 1], "Length": len(rows)}) + b"\nstream\n" + rows + b"\nendstream\nendobj\n"
    table_at = xs_at + len(xs)
    table = b"xref\n0 0\ntrailer\n" + C.dump({"Size": 11, "Root": Ref(1, 0), "Info": Ref(9, 0), "XRefStm": xs_at, "Prev": startxref(base)[0]}) + b"\nstartxref\n%d\n%%%%EOF\n" % table_at
    d = Document(base + info + xs + table)
    assert d.metadata()["Title"] == "hid" and text_of(d) == "shown" and len(d.sections) == 3


def test_fonts():
    assert fonts.glyph_text("f_i") == "fi" and fonts.glyph_text("uni00E9.alt") == "é" and fonts.glyph_text("u1F600") == "😀" and fonts.glyph_text("Eacute") == "É" and fonts.glyph_text("nothing") is None and fonts.glyph_text(".notdef") is None
    assert fonts.WIN_ANSI[0x80] == "€" and fonts.WIN_ANSI[0x95] == "•" and fonts.MAC_ROMAN[0x8E] == "é" and fonts.STANDARD[0xAE] == "ﬁ" and fonts.STANDARD_NAMES[0xAE] == "fi" and fonts.STANDARD[39] == "’"
    t = fonts.ToUnicode(b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <10> <12> <0041> <20> <21> [<0058> <0059>] endbfrange")
    assert [t(c) for c in (1, 0x10, 0x12, 0x20, 0x21, 5)] == ["fi", "A", "C", "X", "Y", None]


def test_content():
    ops = list(content.operators(b"q 1 0 0 RG bogus 5 w BI /W 2 /H 1 /BPC 8 /CS /G ID \x01EI\x02 EI Q"))
    assert [o[0] for o in ops] == ["q", "RG", "w", "BI", "Q"] and isinstance(ops[3][1][0], Stream) and ops[3][1][0].attrs == {"Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}
    data = b" /F#31 1.5 Tf (a\\)) Tj[(b)-5.]TJ true <</A 1>> /x BDC % c\n T* f*"
    assert [(o[0], o[1], data[o[2] : o[3]]) for o in content.operators(data)] == [
        ("Tf", [Name("F1"), 1.5], b"/F#31 1.5 Tf"), ("Tj", [b"a)"], b"(a\\)) Tj"), ("TJ", [[b"b", -5.0]], b"[(b)-5.]TJ"), ("BDC", [True, {"A": 1}, Name("x")], b"true <</A 1>> /x BDC"), ("T*", [], b"T*"), ("f*", [], b"f*"),
    ]
    m = (2, 1, 0, 3, 5, 7)
    assert content.apply(content.invert(m), *content.apply(m, 4, 9)) == pytest.approx((4, 9)) and content.invert((1, 1, 1, 1, 0, 0)) is None
    d = Document(C.document([b"2 w 10 10 m 10 200 l S 20 20 100 2 re f 0 0 m 5 0 l S 10 10 m 20 40 l S 0 0 m 1 2 3 4 5 60 c 10 10 m 10 90 l S"]))
    r = content.read_page(d, d.pages[0], {})
    assert [tuple(x) for x in r.rulings] == [(10, 10, 10, 200, 2), (20, 21, 120, 21, 2)]


def test_render():
    import struct

    from quire.kernels.raster import render

    page = b"1 0 0 rg 10 10 20 20 re f 0 0 1 RG 4 w 50 5 m 50 35 l S /G gs 0 1 0 rg 60 10 10 10 re f q 0 0 5 40 re W n 0 g 0 0 80 40 re f Q q 10 0 0 10 62 28 cm BI /W 2 /H 2 /BPC 8 /CS /RGB ID " + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]) + b" EI Q"
    d = Document(C.document([page], page_attrs={"MediaBox": [0, 0, 80, 40], "Resources": {"ExtGState": {"G": {"ca": 0.5}}}}))
    w, h, png, warnings = render(d, d.pages[0])
    assert (w, h) == (80, 40) == struct.unpack(">II", png[16:24]) and not warnings
    raw = zlib.decompress(png[png.index(b"IDAT") + 4 :])
    at = lambda x, y: tuple(raw[y * 241 + 1 + 3 * x :][:3])
    assert at(15, 20) == (255, 0, 0) and at(50, 20) == (0, 0, 255) and at(35, 20) == (255, 255, 255) and at(65, 25) == (128, 255, 128) and at(2, 5) == (128, 128, 128) and at(63, 3) == (255, 128, 128)


def test_ranged(tmp_path):
    import http.server
    import threading

    from quire.sources.ranged import CachedBackend, FileBackend, MemBackend, open_ranged

    big = C.document([C.text_page([(f"page {k} " + "filler " * 9, 12, "F1")] * 36) for k in range(900)])
    for flavour in ("classic", "objstm", "flate"):
        b = C.from_text("hello\nworld", flavour)
        (tmp_path / "a.pdf").write_bytes(b)
        for spec in (b, str(tmp_path / "a.pdf"), FileBackend(str(tmp_path / "a.pdf"))):
            assert text_of(open_ranged(spec)) == "hello\nworld"
    d = open_ranged(CachedBackend(MemBackend(big), most=1 << 20))
    assert d.declared_pages() == 900 and d.backend.fetched < 0.2 * len(big) and d.get(1)["Type"] == "Catalog"
    assert text_of(open_ranged(encrypted(b"me", b"chief", "secret text"), "me")) == "secret text"
    with pytest.raises(DocumentError):
        open_ranged(C.from_text("x", "broken"))
    data = C.from_text("over http")

    class Ranges(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):  # noqa: N802
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):  # noqa: N802
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.send_response(206 if self.path == "/good" else 200)
            self.end_headers()
            self.wfile.write(data[a : b + 1])

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert text_of(open_ranged(url + "/good")) == "over http"
    with pytest.raises(DocumentError):
        open_ranged(url + "/whole")
    server.shutdown()


def truetype() -> bytes:
    """A program with a square (A) and a composite of two of them (B)."""
    import struct

    pts = [(0, 0), (0, 1000), (500, 1000), (500, 0)]
    body = lambda vals: b"".join(struct.pack(">h", b - a) for a, b in zip([0, *vals], vals))
    square = struct.pack(">hhhhh", 1, 0, 0, 500, 1000) + struct.pack(">HH", 3, 0) + bytes([1] * 4) + body([x for x, _ in pts]) + body([y for _, y in pts])
    both = struct.pack(">hhhhh", -1, 0, 0, 1000, 1000) + struct.pack(">HHhh", 0x23, 1, 0, 0) + struct.pack(">HHhhh", 0x0B, 1, 600, 0, 8192)
    square += b"\0" * (len(square) % 2)
    glyf = square + both
    loca = struct.pack(">4H", 0, 0, len(square) // 2, len(glyf) // 2)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">2H", 66, 0xFFFF) + b"\0\0" + struct.pack(">2H", 65, 0xFFFF) + struct.pack(">2H", (1 - 65) & 0xFFFF, 1) + struct.pack(">2H", 0, 0)
    head = bytes(18) + struct.pack(">H", 1000) + bytes(34)
    tables = {b"head": head, b"maxp": struct.pack(">IH", 0x10000, 3), b"loca": loca, b"glyf": glyf, b"cmap": cmap}
    out, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for k, t in tables.items():
        out += struct.pack(">4sIII", k, 0, at, len(t))
        at += len(t)
    return out + b"".join(tables.values())


def test_glyphs():
    import struct

    from quire.kernels.glyphs import TrueType
    from quire.kernels.raster import render

    t = TrueType(truetype())
    assert t.glyph(0, "A") == 1 and t.glyph(0, "B") == 2 and [p[0] for p in t.path(1)] == ["m", "l", "l", "l", "l", "h"] and len(t.path(2)) == 12 and t.path(2)[7][1:] == (600.0, 500.0) and t.path(9) == []
    with pytest.raises(ValueError):
        TrueType(b"junk")
    w = C.Writer("flate")
    cat, tree = w.add(None), w.add(None)
    program = w.stream(truetype())
    desc = w.add({"Type": Name("FontDescriptor"), "FontName": Name("Sq"), "Flags": 32, "FontFile2": program})
    font = w.add({"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Sq"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 65, "Widths": [600, 1000], "FontDescriptor": desc})
    proc = w.stream(b"1000 0 0 0 500 500 d1 0 0 500 500 re f")
    own = w.add({"Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "CharProcs": {"sq": proc}, "Encoding": {"Differences": [97, Name("sq")]}, "FirstChar": 97, "Widths": [1000]})
    page = w.add({"Type": Name("Page"), "Parent": tree, "Contents": w.stream(b"BT /F 20 Tf 10 10 Td 1 0 0 rg (A) Tj 0 0 1 rg /G 20 Tf (aa) Tj ET")})
    w.objects[cat.num] = ({"Type": Name("Catalog"), "Pages": tree}, None)
    w.objects[tree.num] = ({"Type": Name("Pages"), "Kids": [page], "Count": 1, "MediaBox": [0, 0, 80, 40], "Resources": {"Font": {"F": font, "G": own}}}, None)
    w.trailer["Root"] = cat
    d = Document(w.bytes())
    _, _, png, warnings = render(d, d.pages[0])
    raw = zlib.decompress(png[png.index(b"IDAT") + 4 :])
    at = lambda x, y: tuple(raw[y * 241 + 1 + 3 * x :][:3])
    assert not warnings and at(15, 20) == (255, 0, 0) and at(21, 20) == (255, 255, 255) and at(25, 25) == (0, 0, 255) and at(45, 25) == (0, 0, 255) and at(35, 25) == (255, 255, 255) and struct.unpack(">I", png[16:20]) == (80,)
