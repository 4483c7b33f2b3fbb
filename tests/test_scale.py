"""What queries do with larger tables: numbers of tasks and of readings, memory, ties."""

import random
import re
import time

import pytest

from quire import corpus as C
from quire.kernels import content, document, filters, fonts, objects
from quire.kernels import layout as L
from quire.kernels.content import Span, operators
from quire.kernels.objects import Parser
from quire.operators import tables as O
from quire.plans import queries as Q
from quire.sources.pdf import value_tree, view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", "bold_titles jq_error_keeps_outputs jq_select tounicode_ranges value_tree_paths lineitem_table_roundtrip two_column_order skip_report doc_markdown_roundtrip doc_metadata damaged_files recovery_last_wins list_items doc_text_roundtrip".split())
def test_documents_are_dealt(spark, name):
    """A table in one row group isn't one task."""
    assert Q.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_dealt_evenly(spark):
    rows = Q.dealt(spark.range(0, 16000, 1, 1)).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(rows) == 16000 and max(rows) < 2 * 16000 / len(rows)


def test_group_lines():
    """First fit as defined, and in time that grows with the spans."""
    rnd = random.Random(3)
    for n in (5, 40, 300):
        spans = [Span("x", rnd.uniform(0, 500), rnd.uniform(0, 400), 600.0, rnd.choice((6.0, 8.0, 24.0)), "F", False, False) for _ in range(n)]
        groups: list[list] = []
        for s in spans:
            g = next((g for g in groups if abs(g[0] - s.y) <= 0.5 * max(g[1], s.size)), None)
            if g:
                g[1], g[2] = max(g[1], s.size), [*g[2], s]
            else:
                groups.append([s.y, s.size, [s]])
        want = [sorted(g[2], key=lambda s: s.x) for g in sorted(groups, key=lambda g: -g[0])]
        assert [x.spans for x in L.group_lines(spans)] == want
    many = [Span("x", 0.0, 20.0 * k, 6.0, 10.0, "F", False, False) for k in range(40000)]
    t = time.perf_counter()
    assert len(L.group_lines(many)) == 40000 and time.perf_counter() - t < 10


@pytest.mark.parametrize("body", [b"/A 1 /B 2 0 R /C (s) /D /N /E -1.5 /A 3", b"/A#20B 1/C/D/E[1 2 0 R]/F<</G 1>>", b"/A null /B true /C 1 2 /D 5", b"/A(x\\)y)/B 00012 % c\n/C 1. /D .5 >> 1", b"/A 1 0 R/B 2 0 RX /C"])
def test_dictionaries_at_one_go(body):
    """Common entries are read as the parser reads them."""
    data = b"<< " + body + b" >> "
    whole, plain = Parser(data), Parser(data)
    pair, objects._PAIR = objects._PAIR, re.compile(rb"(?!)")
    try:
        want = plain.value(), plain.pos
    finally:
        objects._PAIR = pair
    assert (whole.value(), whole.pos) == want


NEVER = re.compile(rb"(?!)")


def columns_of(rows):
    """Columns as defined: unions of overlapping cells of the rows that have most; none if another row's cells would share a column."""
    most = max(map(len, rows))
    out: list[list[float]] = []
    for a, b in sorted(c for r in rows if len(r) == most for c in r):
        if out and a <= out[-1][1] + 6:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    for r in rows:
        at = -1
        for x0, x1 in r:
            hit = [k for k, (a, b) in enumerate(out) if x0 < b + 1 and x1 > a - 1]
            if hit and hit[0] <= at:
                return []
            at = hit[-1] if hit else at
    return [tuple(x) for x in out]


def test_even_rows():
    """Columns as defined over all rows so far, and in time that grows with the rows."""
    rnd = random.Random(5)
    for _ in range(300):
        rows = []
        for _ in range(rnd.randrange(1, 12)):
            xs = sorted(rnd.sample([0, 40, 80, 120, 160], rnd.choice((1, 2, 3, 3, 3, 4))))
            rows.append([(x + rnd.uniform(-4, 4), x + rnd.uniform(5, 45)) for x in xs])
        first, end, columns = rnd.randrange(len(rows)), 0, []
        end = first
        while end < len(rows) and len(rows[end]) >= 2 and len(found := columns_of(rows[first : end + 1])) >= 2:
            end, columns = end + 1, found
        assert L.even_rows(rows, first) == (end, columns)
    spans = [Span("cell", x, -20.0 * k, x + 50, 10.0, "F", False, False) for k in range(6000) for x in (50.0, 200.0, 400.0)]
    t = time.perf_counter()
    (table,) = L.lane_tables(L.group_lines(spans))
    assert len(table.rows) == 6000 and time.perf_counter() - t < 10


def test_objects_are_numbered_once():
    """Adding an object doesn't look at all others."""
    w, t = C.Writer(), time.perf_counter()
    w.add(1, num=3)
    assert [w.add(None).num for _ in range(50000)] == list(range(4, 50004)) and time.perf_counter() - t < 5


@pytest.mark.parametrize("data", [b"BT /F1 10 Tf 1 0 0 1 72 700.5 Tm (a b) Tj\n[(a) -2 (b)] TJ T* (x) ' 1 2 (y) \" ET", b"1 2 3 4 5 6 7 cm q/F 1 Tf +1 -.5 m 2. 3 l S Q(a)Tj true false null 1 w nope 2 w", b"/A#20 gs /N(x)Tj (a\\)b) Tj 1 2", b"BI /W 1 ID x EI 0 0 5 5 re f % note\n /P <</K 1>> BDC EMC 1234567890123456 w"])
def test_operations_at_one_go(data, monkeypatch):
    """Whole operations are read as their tokens are."""
    read = lambda: [(op, [x.attrs if isinstance(x, objects.Stream) else x for x in v], a, b) for op, v, a, b in operators(data)]
    fast = read()
    monkeypatch.setattr(content, "_WHOLE", NEVER)
    assert fast == read() and len(fast) > 1


@pytest.mark.parametrize("body", [b"/A [1 2.5 -3] /B [ 4 0 R 5 0 R ] /C << /D [ ] /E << /F 1 >> >> /G [1 0 R 2] >>", b"/A[/N(x)]/B<</C[<< /D 2 0 R>>]>> /E [1 2 R] /F [ 1. 2 ]>> /X", b"/A [ 1 2 /B << /C 3", b"/A [1 % c\n 2] /B" + b"[" * 200 + b">>"])
def test_arrays_at_one_go(body, monkeypatch):
    def read(refs):
        p = Parser(b"<< " + body, refs=refs)
        try:
            return p.value(), p.pos
        except objects.TooDeep as e:
            return repr(e)

    fast = [read(True), read(False)]
    for name in ("_NUMBERS", "_REFS", "_OPENS"):
        monkeypatch.setattr(objects, name, NEVER)
    assert fast == [read(True), read(False)]


def test_tables_at_one_go(monkeypatch):
    """Usual entries are read as others are, and odd ones still are."""
    b = C.from_text("x\ny")
    at = b.index(b"xref\n0")
    fast = document.classic_section(b, at)
    odd = document.classic_section(b.replace(b" n \n", b" n\n"), at)
    monkeypatch.setattr(document, "_USUAL", NEVER)
    assert fast == document.classic_section(b, at) and fast.entries == odd.entries and len(fast.entries) > 5


def test_maps_at_one_go(monkeypatch):
    data = b"2 beginbfchar <01> <0041>\n<2> < 00 42 > endbfchar 1 beginbfrange <10> <12> [<0043> /a <0045>] <20><22><0061> endbfrange"
    fast = vars(fonts.ToUnicode(data))
    monkeypatch.setattr(fonts, "_HEX", NEVER)
    assert fast == vars(fonts.ToUnicode(data)) and fast["single"] == {1: "A", 32: "B", 16: "C", 17: "a", 18: "E"}


def test_codes_of_every_width():
    """Codes of 9 to 12 bits, and what is cut off."""
    def packed(data):
        table, bits, cur, width = {bytes([k]): k for k in range(256)}, f"{256:09b}", b"", 9
        size = 258
        for c in data:
            if cur + bytes([c]) in table:
                cur += bytes([c])
                continue
            bits += format(table[cur], f"0{width}b")
            if size < 4095:
                table[cur + bytes([c])] = size
                size += 1
                width = 9 if size < 511 + 1 else 10 if size < 1023 + 1 else 11 if size < 2047 + 1 else 12
            else:
                bits += f"{256:0{width}b}"
                table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
            cur = bytes([c])
        bits += format(table[cur], f"0{width}b")
        return bits

    rnd = random.Random(9)
    data = bytes(rnd.choice(b"abcdefgh\xff") for _ in range(60000))
    bits = packed(data)
    out = filters.lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"))
    assert len(out) > 1000 and data.startswith(out[:1000])
    assert filters.lzw(C.lzw(data)) == data and filters.lzw(C.lzw(data)[:300])[:250] == data[:250] and filters.lzw(b"") == b""


def test_tree_looks_at_pages_alone():
    """What a page uses isn't read for the tree, so a fault there doesn't cost it."""
    tree = value_tree(document.Document(C.document([b""], page_attrs={"Annots": 5})))
    assert [p["value"]["Annots"] for p in tree["pages"]] == [5]


def readings(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_selectors_share_a_reading(spark):
    """One writing and one reading of the documents for all selectors."""
    assert readings(Q.QUERIES["selector_spans"](spark, SF)) == 2


def test_ladder_reads_once(spark):
    assert readings(Q.QUERIES["size_ladder"](spark, SF)) == 2


def test_merge_reads_sections_once(spark):
    """Written and read for the sections, written and read for the metadata."""
    assert readings(Q.QUERIES["xref_merge_latest"](spark, SF)) == 4


def test_round_trip_keeps_running_lines(spark):
    """Lines at the edges of pages that repeat are lines of the text all the same."""
    text = "\n".join(["first line"] + ["the same line."] * 200)
    d = Q.written(spark.createDataFrame([(1, text)], "doc_id long, text string"), Q._headed)
    whole, short = (view(d, "markdown", running=r).first().markdown for r in (True, False))
    assert whole.count("the same line.") == 200 and short.count("the same line.") == 190


def test_elements_without_values(spark):
    d = Q._documents(spark, SF)
    all_, bare = (view(d, "elements", **o).where("span is not null").select("doc_id", "seq", "kind", "span").collect() for o in ({}, {"logical": False, "values": False}))
    assert sorted(all_) == sorted(bare) and view(d, "elements", values=False).where("value is not null").count() == 0


def test_equal_intervals_are_peers(spark):
    """A part is what its intervals say: no order of equal ones may be asked of a sort."""
    d = spark.createDataFrame([(1, 0, 5), (1, 20, 30), (1, 20, 30), (1, 33, 34)], "k int, lo long, hi long")
    out = O.packed(d, ["k"], "lo", "hi", 6)
    assert sorted(tuple(r) for r in out.select("lo", "hi", "n").collect()) == [(0, 5, 1), (20, 34, 3)]
    assert "RangeFrame" in out._jdf.queryExecution().analyzed().toString()


def test_roles_in_time():
    """Edges of many pages that repeat are counted once for each height, and by the rule: two points apart at most, on half the pages and three at least."""
    rnd = random.Random(8)
    line = lambda t, y: L.Line([(t, False, False)], 50.0, y, 90.0, 12.0)
    for _ in range(200):
        pages = [[L.Block("paragraph", [line(rnd.choice(("a 1", "A  2", "b", "Page 3")), rnd.choice((700.0, 701.0, 702.5, 705.0))), line("body", 400.0), line("c", rnd.choice((40.0, 43.0)))])] for _ in range(rnd.randrange(1, 9))]
        edges = {role: [(L.normalise(p[0].lines[at].text), p[0].lines[at].y) for p in pages] for role, at in (("header", 0), ("footer", -1))}
        want = {role: [len(pages) >= 3 and (t == "page #" or sum(u == t and abs(y - z) <= 2 for u, z in e) >= max(3, len(pages) // 2)) for t, y in e] for role, e in edges.items()}
        L.tag_roles(pages)
        assert {role: [any(b.role == role for b in p) for p in pages] for role in want} == want
        assert all(sum(len(b.lines) for b in p) == 3 for p in pages)
    pages = [[L.Block("paragraph", [line("same", 770.0), line(f"body {k}", 400.0)])] for k in range(20000)]
    t = time.perf_counter()
    L.tag_roles(pages)
    assert all(p[0].role == "header" for p in pages) and time.perf_counter() - t < 5


@pytest.mark.parametrize("data", [b"BT /F1 12 Tf 50 770.5 Td (a) Tj 0 -14 Td () Tj ET\n ", b"BT (a) Tj (b\\)c) Tj ET", b"1 2 nope 3 w", b"BI /W 1 ID x EI 0 0 5 5 re f", b"q [(a) 1] TJ Q", b"q\nQ", b"(a) Tj % x", b"", b" \n", b"(a", b"1 2 m true w"])
def test_streams_at_one_go(data):
    assert list(content.operations(data)) == [(op, v) for op, v, _, _ in operators(data)] or b"BI" in data
    assert [op for op, _ in content.operations(data)] == [op for op, _, _, _ in operators(data)]


@pytest.mark.parametrize("data", [b"5 0 obj\n<< /A 1 /B 2 0 R/C /D >>\nendobj", b"5 0 obj<</Length 3>>stream\r\nabc\nendstream endobj x", b"5 0 obj << /Length 9 >> stream\nabc\nendstream\nendobj", b"5 0 obj << /A 1 endobj 6 0 obj /B >> endobj", b"% c\n5 0 obj % c\n<< /A 1 >> endobj", b"5 0 obj << /Length 3 >> stream\nabc endstream 7", b"5 0 obj << /A << /B 1 >> >> endobj", b"5 0 obj << /A 1 >>"])
def test_objects_at_one_go(data, monkeypatch):
    def read():
        ref, x, a, b = objects.indirect(data, 0)
        return ref, (x.attrs, x.data) if isinstance(x, objects.Stream) else x, a, b

    fast = [read(), read()]
    if isinstance(x := objects.indirect(data, 0)[1], dict):
        x["own"] = 1  # a copy: the next reader has none of it
    assert fast == [read(), read()]
    monkeypatch.setattr(objects, "_OBJECT", NEVER)
    assert fast == [read(), read()]


def test_documents_go_at_once(monkeypatch):
    """A document that was read leaves nothing for the collector."""
    import gc
    import weakref

    from quire.sources import pdf

    kept, data = [], C.from_text("a\nb")
    monkeypatch.setattr(pdf, "Document", lambda *a: kept.append(weakref.ref(d := document.Document(*a))) or d)
    gc.disable()
    try:
        assert [r[2] for r in pdf._open(pdf.VIEWS["lines"], lambda: pdf.Document(data), len(data), "lines", {})] == ["a", "b"] and kept[0]() is None
    finally:
        gc.enable()


def test_columns_asked_for(spark):
    """A query that needs a few columns of a view has no others made."""
    d = Q._documents(spark, SF)
    whole, some = view(d, "spans"), view(d, "spans", columns=("text", "size"))
    assert some.columns == ["doc_id", "text", "size"]
    assert sorted(some.collect()) == sorted(whole.select(*some.columns).collect())
    for name, made in (("size_histogram", "text"), ("line_view", "seq")):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert f"{made}#" in plan and "end_x" not in plan


def test_filters_at_one_go(monkeypatch):
    """Plain stretches of codes, whole groups and whole pairs are decoded together, and as they are one by one."""
    rnd = random.Random(4)
    whole = C.lzw(bytes(rnd.randrange(256) for _ in range(9000)))
    odd = [bytes(rnd.choice(whole) for _ in range(rnd.randrange(40))) for _ in range(300)]
    cut = [whole[:k] for k in (0, 1, 2, 225, 226, 227, 5000)] + [whole[:300] + b"\xff\xff" + whole[302:], whole[:450] + b"\x80\x00" + whole[452:]]
    nine = "".join(f"{c:09b}" for c in [256, *range(253), 256, *range(3), 257])  # the longest stretch of nine bits, then a clear code
    data = [whole, *odd, *cut, int(nine.ljust(-(-len(nine) // 8) * 8, "0"), 2).to_bytes(-(-len(nine) // 8), "big")]
    fast = [[filters.lzw(x, early) for early in (0, 1)] for x in data]
    assert fast[-1][1] == bytes([*range(253), *range(3)])
    monkeypatch.setattr(filters, "_plain_codes", lambda whole, at, end, most: (b"", at, False))
    assert fast == [[filters.lzw(x, early) for early in (0, 1)] for x in data]

    def tried(x):
        try:
            return filters.ascii85(x)
        except filters.Undecodable:
            return None

    texts = [b"87cURD]i,\"Ebo80~>", b"87cUR D]i,\"E\nbo7&~>" * 2, b"!!!!!z87cURD]i,\"Ebo80", b"s8W-!" * 6, b"s8W-\"" * 6, b"uuuuu" * 6, b"!" * 26, b"!" * 27, b"!" * 30 + b"\x7f", b"!!!!! ~ >" * 4]
    fast = [tried(x) for x in texts]
    monkeypatch.setattr(filters, "_QUINTETS", NEVER)
    assert fast == [tried(x) for x in texts] and fast[3] == b"\xff" * 24 and fast[4] is None
    assert [filters.ascii_hex(x) for x in (b"0aFF>", b"0a f\nf>00", b"0a7", b"0g1>", b"", b"\xff12>")] == [b"\x0a\xff", b"\x0a\xff", b"\x0a\x70", b"\x01", b"", b"\x12"]


def test_long_codes_are_few_steps(monkeypatch):
    """A stream of plain stretches takes a step for thousands of codes, not one for each."""
    steps, plain = [], filters._plain_codes
    monkeypatch.setattr(filters, "_plain_codes", lambda *a: steps.append(1) or plain(*a))
    data = bytes(range(256)) * 400
    assert filters.lzw(C.lzw(data)) == data and len(steps) < 60


def test_strings_by_their_map():
    """A string's text and advance are those of its codes one by one."""
    f = fonts.Font(document.Document(C.document([b""])), C.simple_font("Helvetica"))
    f.show(b"")
    for s in (b"", b"a b", bytes(range(256)), bytes(range(32, 256)) * 9):
        assert f.show(s) == ("".join(f._texts[c] for c in s), sum(f.widths[c] for c in s) * f.scale, len(s), s.count(b" "))
