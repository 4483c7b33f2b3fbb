"""Files to tables. A file is a row (content BINARY); each view is a narrow map over the rows, so no view shuffles, and only what a view needs is read from a document.

A file that can't be opened gives a row with an error (view `documents`) and none elsewhere. A fault on a page costs the rows of that page alone, and view `skips` has a row of kind "PageContents" for it;
a fault that ends a view of the whole document is told in `documents.error`. Lack of memory fails the task.
"""

from __future__ import annotations

import base64
import fnmatch
import json
import math
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..kernels import layout as L
from ..kernels.content import Ruling, Span, operators, read_page
from ..kernels.document import METADATA, Document, DocumentError
from ..kernels.objects import Name, Ref, Stream, text_string
from .ranged import open_ranged

SCHEMAS = {
    "documents": "version string, encrypted boolean, pages long, declared_pages long, size long, error string",
    "metadata": ", ".join(f"{k} string" for k in METADATA),
    "pages": "page int, ref struct<num: long, gen: int>, media_box struct<x0: double, y0: double, x1: double, y1: double>, crop_box struct<x0: double, y0: double, x1: double, y1: double>, rotate int, width double, height double, resources string",
    "elements": "seq long, kind string, span struct<start: long, `end`: long>, ref struct<num: long, gen: int>, page int, in_objstm struct<num: long, start: long, `end`: long>, value string, error string",
    "xref_entries": "section int, num long, kind string, a long, b long",
    "content_ops": "page int, seq int, op string, operands array<string>, start long, `end` long",
    "spans": "page int, seq int, text string, x double, y double, end_x double, size double, font string, bold boolean, italic boolean",
    "rulings": "page int, seq int, x0 double, y0 double, x1 double, y1 double, width double",
    "skips": "page int, kind string, cause string, detail string, count long",
    "lines": "page int, seq int, text string, x double, y double, end_x double, size double",
    "blocks": "page int, block_no int, kind string, level int, role string, text string, x0 double, y0 double, x1 double, y1 double",
    "text": "page int, text string",
    "document_text": "text string",
    "markdown": "markdown string",
    "page_markdown": "page int, markdown string",
    "layout": "layout string",
    "tree": "tree string",
    "png": "page int, width int, height int, png binary, warnings string",
    "pixels": "page int, x int, y int, r int, g int, b int",
}


def to_json(x, data: str = "omit", doc: Document | None = None):
    """A value as JSON-ready Python: names and text as strings, references as {"_r": [num, gen]}, other bytes as {"_bytes": base64}, a stream as its dictionary and what is asked of its data."""
    kind = type(x)
    if kind is Name:
        return str(x)
    if kind is int:
        return x
    if kind is Ref:
        return {"_r": [x.num, x.gen]}
    if kind is bytes:
        try:
            return text_string(x) if x[:2] == b"\xfe\xff" or x[:3] == b"\xef\xbb\xbf" else x.decode()
        except UnicodeDecodeError:
            return {"_bytes": base64.b64encode(x).decode()}
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, list):
        return [to_json(v, data, doc) for v in x]
    if isinstance(x, dict):
        return {k: to_json(v, data, doc) for k, v in sorted(x.items())}
    if isinstance(x, Stream):
        out = {"_stream": to_json(x.attrs, data, doc), "_length": len(x.data)}
        if data == "raw":
            out["_data"] = to_json(x.data)
        elif data == "decode" and doc:
            try:
                out["_data"] = to_json(doc.stream_data(x))
            except ValueError as e:
                out["_error"] = str(e)
        return out
    return str(x) if isinstance(x, Name) else x


_dumps = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


def value_tree(doc: Document, data: str = "omit") -> dict:
    """One JSON document of a file: header, objects by number, pages, sections, trailer and startxref."""
    out: dict = {"header": None, "objects": {}, "pages": [], "xref": [], "trailer": to_json(doc.trailer), "startxref": None}
    for e in doc.elements(logical=False):
        span = list(e["span"]) if e["span"] else None
        if e["kind"] == "object" and not e["error"]:
            out["objects"]["{} {}".format(*e["ref"])] = {"value": to_json(e["value"], data, doc), "_span": span}
        elif e["kind"] == "xref":
            out["xref"].append({"_span": span})
        elif e["kind"] in ("header", "startxref"):
            out[e["kind"]] = e["value"]
    out["pages"] = [{"ref": list(p.ref) if p.ref else None, "value": to_json(p.attrs)} for p in doc.pages]
    return out


def _read(doc: Document) -> Iterator[tuple[int, list[Span], list[Ruling], dict]]:
    """What is read of each page; nothing of one with a fault."""
    cache: dict = {}
    for k, p in enumerate(doc.pages):
        try:
            r = read_page(doc, p, cache)
        except FAULTS:
            yield k, [], [], {}
            continue
        yield k, r.spans, r.rulings, r.skips


def _blocks(doc: Document, running: bool = False) -> list[list[L.Block]]:
    """Blocks of each page. Running lines get their roles, unless they are to stay among the others."""
    read = list(_read(doc))
    sizes = L.Sizes(s for _, spans, _, _ in read for s in spans)
    pages = [L.page_blocks(spans, rulings, sizes) for _, spans, rulings, _ in read]
    if not running:
        L.tag_roles(pages)
    return pages


#: What reading a damaged file may raise.
FAULTS = (DocumentError, RecursionError, ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError)


#: Views with rows of single pages; these can be read a range of pages at a time.
PAGE_VIEWS = ("pages", "content_ops", "spans", "rulings", "skips", "lines", "text", "page_markdown", "png", "pixels")


def _pages(d: Document) -> Iterator[tuple[int, object]]:
    """The pages asked for: all, or those of the document's part."""
    first, end = getattr(d, "part", (0, None))
    for k, p in enumerate(d.pages[first:end]):
        yield first + k, p


def _each(d: Document, rows: Callable, faults: list | None = None) -> Iterator[tuple]:
    """The rows of each page by itself: a page with a fault has none, and the fault is noted."""
    for k, p in _pages(d):
        try:
            out = list(rows(k, p))
        except FAULTS as e:
            if faults is not None:
                faults.append((k, e))
            continue
        yield from out


def _fault(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def _v_documents(d):
    yield "{}.{}".format(*d.version), d.decryptor is not None, len(d.pages), d.declared_pages(), len(d.data), None


def _v_metadata(d):
    m = d.metadata()
    yield tuple(m[k] for k in METADATA)


def _v_pages(d):
    box = lambda b: dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))

    def rows(k, p):
        yield k, ({"num": p.ref.num, "gen": p.ref.gen} if p.ref else None), box(p.media_box), box(p.crop_box), p.rotate, *p.size, _dumps(to_json(p.resources))

    return _each(d, rows)


def _v_elements(d, content_ops=False, logical=True, values=True):
    """Elements in order; without the logical ones no page is looked for, and without values none is turned to JSON."""
    for k, e in enumerate(d.elements(logical=logical, content_ops=content_ops)):
        span = {"start": e["span"][0], "end": max(e["span"])} if e["span"] else None
        inside = {"num": e["in_objstm"][0], "start": e["in_objstm"][1][0], "end": e["in_objstm"][1][1]} if e["in_objstm"] else None
        yield k, e["kind"], span, ({"num": e["ref"][0], "gen": e["ref"][1]} if e["ref"] else None), e["page"], inside, (None if e["value"] is None or not values else _dumps(to_json(e["value"]))), e["error"]


def _v_xref(d):
    for k, s in enumerate(d.sections):
        for n, e in s.entries.items():
            yield k, n, *e


def _v_ops(d):
    return _each(d, lambda k, p: ((k, n, op, [_dumps(to_json(x)) for x in v], a, b) for n, (op, v, a, b) in enumerate(operators(p.content()))))


def _reading(d: Document, rows: Callable, faults: list | None = None) -> Iterator[tuple]:
    """Rows from what is read of each page."""
    cache: dict = {}
    return _each(d, lambda k, p: rows(k, read_page(d, p, cache)), faults)


def _v_spans(d):
    return _reading(d, lambda k, r: ((k, n, *s) for n, s in enumerate(r.spans)))


def _v_rulings(d):
    return _reading(d, lambda k, r: ((k, n, *x) for n, x in enumerate(r.rulings)))


def _v_skips(d):
    faults: list = []
    yield from _reading(d, lambda k, r: [(k, kind, cause, detail, n) for (kind, cause, detail), n in sorted(r.skips.items())], faults)
    for k, e in faults:
        yield k, "PageContents", "Unreadable", _fault(e), 1


def _v_lines(d):
    return _reading(d, lambda k, r: ((k, n, x.text, x.x, x.y, x.end_x, x.size) for n, x in enumerate(y for seg in L.segments(r.spans) for y in L.group_lines(seg))))


def _v_blocks(d):
    for k, page in enumerate(_blocks(d)):
        for n, b in enumerate(page):
            yield k, n, b.kind, b.level, b.role, L.block_markdown(b), *b.bbox


def _v_text(d):
    return _reading(d, lambda k, r: [(k, L.text_of(r.spans))])


def _v_document_text(d):
    yield ("\f".join(L.text_of(spans) for _, spans, _, _ in _read(d)),)


def _v_markdown(d, running=False):
    """The document as Markdown, without its running headers and footers or with all its lines."""
    yield (L.markdown(_blocks(d, running)),)


def _v_page_markdown(d):
    return _reading(d, lambda k, r: [(k, L.markdown([L.page_blocks(r.spans, r.rulings)]))])


def _v_layout(d, ranking="document", pages=None, pretty=False):
    """Blocks of pages as JSON; sizes are ranked over the document, or over each page."""
    if ranking not in ("document", "page"):
        raise ValueError("ranking is document or page")
    only = None if pages is None else {page_index(p, len(d.pages)) for p in pages}
    if ranking == "document":
        found = list(enumerate(_blocks(d)))
    else:
        found = [(k, L.page_blocks(spans, rulings)) for k, spans, rulings, _ in _read(d)]
    block = lambda b: {"kind": b.kind, "level": b.level, "role": b.role, "text": L.block_markdown(b), "bbox": list(b.bbox)}
    out = {"pages": [{"page": k + 1, "blocks": [block(b) for b in bs]} for k, bs in found if only is None or k in only]}
    yield (json.dumps(out, ensure_ascii=False, indent=2) if pretty else _dumps(out),)


def page_index(page: int, count: int) -> int:
    """The index of a page counted from 1."""
    if not 1 <= page <= count:
        raise ValueError(f"page {page} is out of range 1 to {count}")
    return page - 1


def _v_tree(d):
    yield (_dumps(value_tree(d)),)


def _v_png(d, scale=1.0, compression=6):
    from ..kernels.raster import render

    def rows(k, p):
        w, h, png, warnings = render(d, p, scale, compression)
        yield k, w, h, png, "; ".join(warnings)

    return _each(d, rows)


def _v_pixels(d, scale=1.0):
    from ..kernels.raster import draw

    def rows(k, p):
        rgb = draw(d, p, scale)[0].tolist()
        return ((k, x, y, *c) for y, line in enumerate(rgb) for x, c in enumerate(line))

    return _each(d, rows)


VIEWS: dict[str, Callable] = {
    "documents": _v_documents, "metadata": _v_metadata, "pages": _v_pages, "elements": _v_elements, "xref_entries": _v_xref, "content_ops": _v_ops, "spans": _v_spans, "rulings": _v_rulings, "skips": _v_skips, "lines": _v_lines,
    "blocks": _v_blocks, "text": _v_text, "document_text": _v_document_text, "markdown": _v_markdown, "page_markdown": _v_page_markdown, "layout": _v_layout, "tree": _v_tree, "png": _v_png, "pixels": _v_pixels,
}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files at a path or glob."""
    return spark.read.format("binaryFile").load(path)


def view(df: DataFrame, name: str, *keys: str, content: str = "content", password: str = "", rows: int = 64, columns: tuple[str, ...] | None = None, **options) -> DataFrame:
    """A view of the documents in a binary column, beside the key columns; columns: those of the view's own that are made, if not all. Options: content_ops, logical and values (elements), running (markdown), scale and compression (png), scale (pixels), ranking, pages and pretty (layout)."""
    keys = keys or tuple(c for c in df.columns if c != content)
    return _mapped(df, keys, [content], name, lambda data: _open(VIEWS[name], lambda: Document(data or b"", password), len(data or b""), name, options), rows, columns=columns)


def ranged_view(df: DataFrame, name: str, *keys: str, path: str = "path", per: int = 32, password: str = "", **options) -> DataFrame:
    """A view of single pages of files that tasks open themselves, by ranged reads of a path or http(s) address: no file is moved or held whole, and the pages of a large file are dealt over tasks, `per` at a time.

    A file that can't be opened has no rows here; view `documents` of its bytes tells why.
    """
    if name not in PAGE_VIEWS:
        raise ValueError(f"{name} isn't a view of single pages")
    keys = keys or tuple(df.columns)
    own = StructType([StructField("n_pages", IntegerType())])
    counted = _mapped(df.withColumn("__path", F.col(path)), (*keys, "__path"), ["__path"], "", lambda p: _counted(p, password), 64, own)
    # a number is given, as rows this narrow would be coalesced into one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = counted.where("n_pages > 0").select(*keys, "__path", F.explode(F.expr(f"sequence(0, n_pages - 1, {per})")).alias("__first")).repartition(tasks, "__path", "__first")

    def read(p, first):
        def opened():
            d = open_ranged(p, password)
            d.part = (first, first + per)
            return d

        yield from _open(VIEWS[name], opened, 0, name, options)

    return _mapped(parts, keys, ["__path", "__first"], name, read, 1)


def _counted(path: str, password: str) -> Iterator[tuple]:
    try:
        yield (len(open_ranged(path, password).pages),)
    except (*FAULTS, OSError):
        return


def _mapped(df: DataFrame, keys: tuple[str, ...], given: list[str], name: str, read: Callable, rows: int, own: StructType | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The key columns beside what is read of the given ones, so many rows at a time."""
    inner = df.select(*[F.col(c) for c in keys], *[F.col(c).alias(f"__given{k}") for k, c in enumerate(given)])
    own = own or StructType.fromDDL(SCHEMAS[name])
    made = [k for k, c in enumerate(own.names) if columns is None or c in columns]
    own = StructType([own[k] for k in made])
    schema = StructType([*inner.schema.fields[: len(keys)], *own.fields])
    arrow, n = to_arrow_schema(own), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                where, found = [], []
                for i in range(b.num_rows):
                    found.extend(read(*[b.column(n + k)[i].as_py() for k in range(len(given))]))
                    where.extend([i] * (len(found) - len(where)))
                cols = [[row[k] for row in found] for k in made]
                head = [b.column(k).take(pa.array(where, pa.int64())) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True))], names=schema.names)

    return inner.mapInArrow(run, schema)


def _open(f: Callable, document: Callable, size: int, name: str, options: dict) -> Iterator[tuple]:
    """The rows of a view, as they come: what a fault cuts off doesn't take back the rows before it."""
    d = None
    try:
        d = document()
        yield from f(d, **options)
    except FAULTS as e:
        if name == "documents":
            yield None, None, None, None, size, _fault(e)
    finally:
        if d is not None:  # pages know their document: without them it goes at once, and no collector has to find it
            d.__dict__.pop("_pages", None)


class PdfDataSource(DataSource):
    """spark.read.format("quire-pdf").option("view", "text").load(glob): one partition for each few files; a filter on path is pushed down to the list of files."""

    @classmethod
    def name(cls):
        return "quire-pdf"

    def schema(self):
        return "path string, " + SCHEMAS[self.options.get("view", "text")]

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.only = options, None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            else:
                yield f

    def partitions(self):
        found = [p for p in listed(self.options["path"]) if self.only in (None, p)]
        return [InputPartition(found[k : k + 16]) for k in range(0, len(found), 16)] or [InputPartition([])]

    def read(self, partition):
        name, password = self.options.get("view", "text"), self.options.get("password", "")
        for p in partition.value:
            fs, at = _file_system(p)
            with fs.open_input_file(at) as f:
                data = f.read()
            for row in _open(VIEWS[name], lambda data=data: Document(data, password), len(data), name, {}):
                yield (p, *row)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def listed(pattern: str) -> list[str]:
    """The files of a path or glob, on any file system that addresses name (file, hdfs, object stores), in order."""
    fs, at = _file_system(pattern)
    head = pattern[: len(pattern) - len(at)] if "://" in pattern and pattern.endswith(at) else ""
    parts = at.split("/")
    fixed = next((k for k, x in enumerate(parts) if any(c in x for c in "*?[")), len(parts))
    if fixed == len(parts):
        return [head + at] if fs.get_file_info(at).type == pafs.FileType.File else []
    base, rest = "/".join(parts[:fixed]) or "/", parts[fixed:]
    found = fs.get_file_info(pafs.FileSelector(base, recursive=len(rest) > 1, allow_not_found=True))
    return sorted(head + x.path for x in found if x.type == pafs.FileType.File and _matches(x.path[len(base.rstrip("/")) + 1 :].split("/"), rest))


def _matches(path: list[str], pattern: list[str]) -> bool:
    """Do the parts of a path fit the parts of a glob? ** is any number of them."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        return any(_matches(path[k:], pattern[1:]) for k in range(len(path) + 1))
    return bool(path) and fnmatch.fnmatchcase(path[0], pattern[0]) and _matches(path[1:], pattern[1:])


def register(spark: SparkSession) -> None:
    """Makes the format known; its reader takes filters, which Spark allows only under this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfDataSource)
