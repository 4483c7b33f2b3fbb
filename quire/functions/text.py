"""Text and byte functions as column expressions: no Python runs for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import fonts

_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normalise_line(c: Column) -> Column:
    """Digits as one #, white space as one blank, trimmed, lower case: what running headers are compared by."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\d+", "#"), _WHITE + "+", " ")))


def is_page_number(c: Column) -> Column:
    return normalise_line(c).rlike(r"^(#|page #|(page )?# (of|/) #|[-–—] ?# ?[-–—])$")


def list_marker(c: Column) -> Column:
    """The bullet or number that begins a list item, or null."""
    m = F.regexp_extract(c, r"^\s*([•◦▪–\-*]|\d{1,3}(?=[.)]))[.)]?\s+", 1)
    return F.when(m != "", m)


def md_escape(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def hash_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\s*)#", r"$1\\#")


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def half_points(c: Column) -> Column:
    return F.floor(c * 2 + 0.5)


def ascii_hex_decode(c: Column) -> Column:
    """Hexadecimal text to bytes: what follows > is left out, other characters are skipped, a last single digit gets a zero."""
    h = F.regexp_replace(F.split_part(c, F.lit(">"), F.lit(1)), "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(h) % 2 == 1, F.concat(h, F.lit("0"))).otherwise(h))


def text_string(b: Column) -> Column:
    """Bytes of a text string: UTF-16BE or UTF-8 by their mark, else Latin-1."""
    return (
        F.when(F.substring(b, 1, 2) == F.lit(b"\xfe\xff"), F.decode(F.substring(b, 3, 1 << 30), "UTF-16BE"))
        .when(F.substring(b, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.decode(F.substring(b, 4, 1 << 30), "UTF-8"))
        .otherwise(F.decode(b, "ISO-8859-1"))
    )


def header_version(b: Column) -> Column:
    """x.y of the header in the first KiB; 1.4 without one."""
    head = F.decode(F.substring(b, 1, 1024), "ISO-8859-1")
    m = F.regexp_extract(head, r"%PDF-(\d{1,3}\.\d{1,3})", 1)
    return F.when(m == "", "1.4").otherwise(m)


def startxref(b: Column) -> Column:
    """The offset that the last startxref of the last 64 KiB names, or null."""
    tail = F.decode(F.substring(b, F.greatest(F.lit(1), F.octet_length(b) - 65535), F.lit(65536)), "ISO-8859-1")
    m = F.regexp_extract(tail, r"(?s).*startxref[\x00\t\n\f\r ]+(\d+)", 1)
    return F.when(m != "", m.cast("long"))


def image_codec(name: Column) -> Column:
    return name.isin("DCTDecode", "DCT", "JPXDecode")


def decode_bytes(codes: Column, encoding: str) -> Column:
    """An array of codes to text by one of the named encodings; a code without a character is U+FFFD."""
    table = F.create_map(*[F.lit(x) for c, t in enumerate(fonts.ENCODINGS[encoding]) if t for x in (c, t)])
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.element_at(table, c), F.lit("�"))), "")


def glyph_char(name: Column) -> Column:
    """The character of a glyph name: a table of names, uniXXXX, uXXXX to uXXXXXX and single letters; null for others."""
    table = F.create_map(*[F.lit(x) for kv in fonts.GLYPHS.items() for x in kv])
    code = F.conv(F.regexp_extract(name, r"^u(?:ni)?([0-9A-F]{4,6})$", 1), 16, 10).cast("int")
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.element_at(table, name), F.when(name.rlike(r"^[A-Za-z]$"), name), F.when(name.rlike(r"^(uni[0-9A-F]{4}|u[0-9A-F]{4,6})$") & ~code.between(0xD800, 0xDFFF) & (code < 0x110000), wide))


def hexdump(b: Column, width: int = 16) -> Column:
    """An array of lines: offset, hex in groups of eight, and printable ASCII."""
    n = F.octet_length(b)
    rows = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / width)).cast("int"))
    cell = lambda k: F.substring(b, k * width + 1, F.lit(width))

    def line(k):
        h = F.lower(F.hex(cell(k)))
        pairs = F.regexp_replace(h, "(..)", "$1 ")
        spaced = F.regexp_replace(pairs, "^((?:.. ){8})(?=.)", "$1 ")
        text = F.regexp_replace(F.decode(cell(k), "ISO-8859-1"), r"[^\x20-\x7E]", ".")
        return F.concat(F.lpad(F.lower(F.hex(k * width)), 8, "0"), F.lit("  "), F.rpad(spaced, width * 3 + 1, " "), F.lit(" |"), text, F.lit("|"))

    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(rows, line))


def result_bytes(result: Column, content: Column) -> Column:
    """The bytes of the spans in a query's JSON result: an object with _span [start, end], or an array of such; null for other results."""
    kind = "struct<_span: array<bigint>>"
    one, many = F.from_json(result, kind), F.from_json(result, f"array<{kind}>")
    spans = F.when(result.rlike(r"^\s*\["), F.transform(many, lambda x: x["_span"])).when(result.rlike(r"^\s*\{"), F.array(one["_span"]))
    good = (F.size(spans) > 0) & F.forall(spans, lambda s: F.coalesce((F.size(s) == 2) & (s[0] >= 0) & (s[1] >= s[0]), F.lit(False)))
    return F.when(good, F.transform(spans, lambda s: F.substring(content, (s[0] + 1).cast("int"), (s[1] - s[0]).cast("int"))))
