import pytest

from quire import corpus as C
from quire.api import COMPRESSION, Document, render_options
from quire.kernels.glyphs import platforms
from quire.sources.pdf import VIEWS


def some():
    return Document(data=C.document([C.text_page([(f"page {k}", 20 if not k else 12, "F1")] + [("body", 12, "F1")] * 4) for k in range(3)], "objstm"))


def test_render_options():
    assert render_options() == {"scale": 1.0, "level": 6, "glyphs": True} and render_options(2, "none", "fast") == {"scale": 2.0, "level": 1, "glyphs": False}
    for bad in ({"scale": 0}, {"scale": "x"}, {"fonts": "all"}, {"compression": "most"}, {"scale": 1000}):
        with pytest.raises(ValueError):
            render_options(**bad)


def test_rendering():
    d = some()
    png, warnings = d[0].render_reporting(0.2)
    assert png.startswith(b"\x89PNG") and warnings == ["Glyph NoGlyph (5)"] and d[0].render_reporting(0.2, fonts="none")[1] == []
    sizes = {c: len(d[1].render(0.2, compression=c)) for c in COMPRESSION}
    assert sizes["none"] > sizes["fast"] >= sizes["best"]
    assert [len(x) > 8 for x in d.render_pages([2, 0], 0.2)] == [True, True]
    with pytest.raises(ValueError):
        d.render_pages([0], compression="odd")


def test_fork_and_outputs():
    d = some()
    twin = d.fork()
    assert twin.extract_text() == d.extract_text() and twin._doc.data is d._doc.data and twin._doc.xref is d._doc.xref and twin._doc._cache is not d._doc._cache
    assert d.write("text") == d.extract_text() and d.write("markdown") == d.extract_markdown()
    with pytest.raises(KeyError):
        d.write("odd")


def test_layout_options():
    d = some()._doc
    (text,) = next(VIEWS["layout"](d, pretty=True))
    assert text.startswith('{\n  "pages"') and '"kind": "heading"' in text
    (two,) = next(VIEWS["layout"](d, pages=[2]))
    assert '"page":2' in two and '"page":1' not in two
    for bad in ({"ranking": "odd"}, {"pages": [0]}, {"pages": [4]}):
        with pytest.raises(ValueError):
            list(VIEWS["layout"](d, **bad))


def test_platforms():
    table = (0).to_bytes(2, "big") + (2).to_bytes(2, "big") + b"".join(p.to_bytes(2, "big") + (1).to_bytes(2, "big") + (99).to_bytes(4, "big") for p in (1, 3))
    font = b"\0\1\0\0" + (1).to_bytes(2, "big") + bytes(6) + b"cmap" + bytes(4) + (28).to_bytes(4, "big") + len(table).to_bytes(4, "big") + table
    assert platforms(font) == {1, 3} and platforms(font[:30]) == set() and platforms(b"") == set()
