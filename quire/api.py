"""A document as an object, beside the views for tables of them."""

from __future__ import annotations

from collections.abc import Iterator

from .kernels import layout
from .kernels.content import read_page
from .kernels.document import Document as _Document
from .kernels.objects import Stream, pretty
from .sources.pdf import VIEWS, to_json, value_tree


#: Compression of rendered pages, as levels; and which fonts draw text: embedded ones, or none.
COMPRESSION, FONTS = {"none": 0, "fast": 1, "default": 6, "best": 9}, ("embedded", "none")


def render_options(scale: float = 1.0, fonts: str = "embedded", compression: str = "default") -> dict:
    """Checked options of rendering; ValueError names what isn't known."""
    if not isinstance(scale, (int, float)) or not 0 < scale <= 64:
        raise ValueError(f"scale must be above 0 and 64 at most, not {scale!r}")
    if fonts not in FONTS:
        raise ValueError(f"fonts must be one of {', '.join(FONTS)}, not {fonts!r}")
    if compression not in COMPRESSION:
        raise ValueError(f"compression must be one of {', '.join(COMPRESSION)}, not {compression!r}")
    return {"scale": float(scale), "level": COMPRESSION[compression], "glyphs": fonts == "embedded"}


class Page:
    def __init__(self, doc: Document, number: int):
        self.doc, self.number, self._page = doc, number, doc._doc.pages[number]

    @property
    def size(self) -> tuple[float, float]:
        return self._page.size

    @property
    def rotation(self) -> int:
        return self._page.rotate

    def read(self):
        """Spans, rulings and skips."""
        return read_page(self.doc._doc, self._page, self.doc._fonts)

    def extract_text(self) -> str:
        return layout.text_of(self.read().spans)

    def extract_markdown(self) -> str:
        """Sizes are ranked on this page alone."""
        r = self.read()
        return layout.markdown([layout.page_blocks(r.spans, r.rulings)])

    def render(self, scale: float = 1.0, fonts: str = "embedded", compression: str = "default") -> bytes:
        return self.render_reporting(scale, fonts, compression)[0]

    def render_reporting(self, scale: float = 1.0, fonts: str = "embedded", compression: str = "default") -> tuple[bytes, list[str]]:
        """The PNG, and what was left out."""
        from .kernels.raster import render

        return render(self.doc._doc, self._page, **render_options(scale, fonts, compression))[2:]


class Document:
    """Of a path or of bytes: exactly one of them."""

    def __init__(self, path: str | None = None, data: bytes | None = None, password: str = ""):
        if (path is None) == (data is None):
            raise ValueError("exactly one of path and data is needed")
        if path is not None:
            with open(path, "rb") as f:
                data = f.read()
        self._doc, self._fonts = _Document(data, password), {}

    @property
    def page_count(self) -> int:
        return len(self._doc.pages)

    def __len__(self) -> int:
        return self.page_count

    def __getitem__(self, k: int) -> Page:
        n = self.page_count
        if not -n <= k < n:
            raise IndexError("page out of range")
        return Page(self, k % n)

    @property
    def version(self) -> str:
        return "{}.{}".format(*self._doc.version)

    @property
    def metadata(self) -> dict[str, str | None]:
        return self._doc.metadata()

    def extract_text(self) -> str:
        return "\f".join(self[k].extract_text() for k in range(len(self)))

    def extract_markdown(self) -> str:
        """Sizes are ranked over the whole document."""
        return next(VIEWS["markdown"](self._doc))[0]

    def elements(self, *, physical: bool = True, logical: bool = True, pages: list[int] | None = None, content_ops: bool = False) -> Iterator[dict]:
        return self._doc.elements(physical, logical, content_ops, None if pages is None else set(pages))

    def get_object(self, num: int):
        return to_json(self._doc.get(num))

    def show_object(self, num: int) -> str:
        """Indented text, and the decoded length of a stream."""
        x = self._doc.get(num)
        out = pretty(x)
        if isinstance(x, Stream):
            try:
                out += f" decoded[{len(self._doc.stream_data(x))} bytes]"
            except ValueError as e:
                out += f" ({e})"
        return out

    def tree(self, data: str = "omit") -> dict:
        return value_tree(self._doc, data)

    def render_pages(self, pages: list[int] | None = None, scale: float = 1.0, fonts: str = "embedded", compression: str = "default") -> list[bytes]:
        render_options(scale, fonts, compression)
        return [self[k].render(scale, fonts, compression) for k in (range(len(self)) if pages is None else pages)]

    def fork(self) -> Document:
        """Another reader of the same bytes and cross-references, with caches of its own."""
        twin = Document.__new__(Document)
        twin._doc, twin._fonts = self._doc.fork(), {}
        return twin

    def write(self, output: str) -> str:
        """All pages through one of layout.OUTPUTS, by name."""
        return layout.OUTPUTS[output]([self[k].read() for k in range(len(self))])
