"""Fonts as far as text needs them: encodings, ToUnicode maps, widths and style."""

from __future__ import annotations

import codecs
import functools
import re
import unicodedata

import numpy as np

from . import metrics
from .glyphs import platforms
from .objects import Name, Op, Parser, ParseError, Ref, Stream

#: Glyph names that don't follow from a character's Unicode name.
_NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",",
    "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<",
    "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®",
    "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»",
    "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "AE": "Æ", "ae": "æ", "Oslash": "Ø", "oslash": "ø", "OE": "Œ", "oe": "œ", "Thorn": "Þ", "thorn": "þ", "Eth": "Ð", "eth": "ð", "germandbls": "ß", "multiply": "×",
    "divide": "÷", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—",
    "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹",
    "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "nbspace": "\xa0", "softhyphen": "\xad", "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "infinity": "∞",
    "integral": "∫", "approxequal": "≈", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "lozenge": "◊", "Delta": "∆", "Omega": "Ω", "pi": "π", "apple": "\uf8ff", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ",
}
_ACCENTS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "OGONEK": "ogonek", "MACRON": "macron", "BREVE": "breve", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut"}


def _glyphs() -> dict[str, str]:
    out = dict(_NAMED)
    for code in range(0xC0, 0x180):
        m = re.match(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH (.+)$", unicodedata.name(chr(code), ""))
        if m and m[3] in _ACCENTS:
            out.setdefault((m[2] if m[1] == "CAPITAL" else m[2].lower()) + _ACCENTS[m[3]], chr(code))
    for k in range(24):
        lower = chr(0x3B1 + k + (k > 16))
        name = unicodedata.name(lower).split()[-1].capitalize().replace("Lamda", "Lambda")
        out.setdefault(name.lower(), lower)
        out.setdefault(name, lower.upper())
    return out


GLYPHS = _glyphs()


def glyph_char(name: str) -> str | None:
    """One glyph name: uniXXXX and uXXXX to uXXXXXX, single letters, and the names above."""
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name)
    if not m:
        return None
    codes = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
    return "".join(map(chr, codes)) if all(c < 0xD800 or 0xE000 <= c < 0x110000 for c in codes) else None


def glyph_text(name: str) -> str | None:
    """A glyph name without its suffix, its parts joined by underscores; all parts or nothing."""
    parts = [glyph_char(p) for p in name.split(".")[0].split("_")] if name and not name.startswith(".") else [None]
    return None if None in parts else "".join(parts)


def _codec(name: str) -> list[str | None]:
    out = [bytes([c]).decode(name, "replace") for c in range(256)]
    return [None if c < 32 or x == "�" or unicodedata.category(x) == "Cc" else x for c, x in enumerate(out)]


WIN_ANSI = _codec("cp1252")
for _c in (127, 129, 141, 143, 144, 157):
    WIN_ANSI[_c] = "•"
MAC_ROMAN = _codec("mac_roman")
MAC_ROMAN[219] = "¤"
_HIGH = {  # fixed values: codes of the standard encoding from 161 that hold a glyph, by first code of each run
    161: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl", 177: "endash dagger daggerdbl periodcentered", 182: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand",
    191: "questiondown", 193: "grave acute circumflex tilde macron breve dotaccent dieresis", 202: "ring cedilla", 205: "hungarumlaut ogonek caron emdash", 225: "AE", 227: "ordfeminine", 232: "Lslash Oslash OE ordmasculine", 241: "ae", 245: "dotlessi", 248: "lslash oslash oe germandbls",
}
STANDARD: list[str | None] = [chr(c) if 32 <= c < 127 else None for c in range(256)]
STANDARD[39], STANDARD[96] = "’", "‘"
STANDARD_NAMES: list[str | None] = [None] * 256
_BACK = {v: k for k, v in reversed(GLYPHS.items())}
for _a, _names in _HIGH.items():
    for _k, _n in enumerate(_names.split()):
        STANDARD[_a + _k], STANDARD_NAMES[_a + _k] = GLYPHS[_n], _n
for _c in range(32, 127):
    STANDARD_NAMES[_c] = _BACK.get(STANDARD[_c], STANDARD[_c])


def glyph_name(ch: str) -> str:
    """The usual glyph name of a character."""
    return _BACK.get(ch, ch if len(ch) == 1 and ch.isascii() and ch.isalpha() else f"uni{ord(ch[0]):04X}")


ENCODINGS = {"WinAnsiEncoding": WIN_ANSI, "MacRomanEncoding": MAC_ROMAN, "StandardEncoding": STANDARD}
PICTURES = ("symbol", "zapfdingbats", "wingdings", "webdings", "dingbats", "marlett")


#: The common string of a map at one go: whole bytes in hexadecimal.
_HEX = re.compile(rb"[\0\t\n\f\r ]*+<((?:[0-9A-Fa-f]{2})*+)>")


class ToUnicode:
    def __init__(self, data: bytes):
        self.single: dict[int, str] = {}
        self.ranges: list[tuple[int, int, str]] = []
        self.width = 0
        parser, stack = Parser(data, refs=False), []
        while True:
            while m := _HEX.match(data, parser.pos):
                stack.append(bytes.fromhex(m[1].decode()))
                parser.pos = m.end()
            try:
                x = parser.value()
            except ParseError:
                if parser.skip() >= len(data):
                    break
                continue
            if not isinstance(x, Op):
                stack.append(x)
                continue
            if x == "endcodespacerange" and stack and isinstance(stack[0], bytes):
                self.width = max(len(v) for v in stack if isinstance(v, bytes))
            elif x == "endbfchar":
                for a, b in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(a, bytes) and (t := self._text(b)) is not None:
                        self.single[int.from_bytes(a, "big")] = t
            elif x == "endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    if isinstance(c, list):
                        self.single.update({lo + k: t for k, v in enumerate(c[: hi - lo + 1]) if (t := self._text(v)) is not None})
                    elif (t := self._text(c)) is not None and lo <= hi:
                        self.ranges.append((lo, hi, t))
            stack = []

    @staticmethod
    def _text(x) -> str | None:
        if isinstance(x, Name):
            return glyph_text(x)
        t = x.decode("utf-16-be", "replace") if isinstance(x, bytes) and x else None
        return None if t is None or "�" in t else t

    def __call__(self, code: int) -> str | None:
        if code in self.single:
            return self.single[code]
        for lo, hi, t in self.ranges:
            if lo <= code <= hi:
                last = ord(t[-1]) + code - lo
                return t[:-1] + chr(last) if last < 0x110000 and not 0xD800 <= last < 0xE000 else None
        return None


#: Widths by class, where a file has none and its font is no standard one: thousandths of an em.
_NARROW, _WIDE = set("ijl.,:;'|!ftI[]()/\\` "), set("mwMWOQG@%")


def fallback_width(ch: str, mono: bool) -> float:
    return 600.0 if mono else 278.0 if ch in _NARROW else 833.0 if ch in _WIDE else 667.0 if ch.isupper() else 556.0


@functools.lru_cache(64)
def _usual(face: str | None, mono: bool, table: tuple) -> tuple[float, ...]:
    """Widths by code of a font that has none."""
    return tuple((metrics.width(face, ch) if face else None) or fallback_width(ch, mono) for ch in (c or " " for c in table))


class Font:
    def __init__(self, doc, attrs: dict):
        r = doc.resolve
        get = lambda d, k: r(d.get(k)) if isinstance(d, dict) else None
        self.kind = str(get(attrs, "Subtype") or "")
        self.name = str(get(attrs, "BaseFont") or get(attrs, "Name") or "")
        self.two_bytes = self.kind == "Type0"
        kids = get(attrs, "DescendantFonts")
        inner = r(kids[0]) if self.two_bytes and isinstance(kids, list) and kids else attrs
        inner = inner if isinstance(inner, dict) else {}
        desc = get(inner, "FontDescriptor")
        tu = get(attrs, "ToUnicode")
        self.to_unicode = None
        if isinstance(tu, Stream):
            try:
                self.to_unicode = ToUnicode(doc.stream_data(tu))
            except ValueError:
                pass
        self.flags = f if isinstance(f := get(desc, "Flags"), int) else 0
        self._style(get(desc, "FontWeight"))
        family = re.sub(r"^[A-Z]{6}\+", "", self.name).split("-")[0].split(",")[0].lower().replace(" ", "")
        self.pictures = any(family.startswith(p) for p in PICTURES)
        self.scale, self._texts = 0.001, None
        if self.kind == "Type3":
            m = get(attrs, "FontMatrix")
            self.scale = float(r(m[0])) if isinstance(m, list) and m and isinstance(r(m[0]), (int, float)) else 0.001
        if self.two_bytes:
            self._cid_widths(inner, r)
        else:
            self._simple(doc, attrs, desc, get, r)

    def _style(self, weight) -> None:
        low = self.name.lower()
        self.bold = isinstance(weight, (int, float)) and weight >= 600 or bool(self.flags & 1 << 18) or any(s in low for s in ("bold", "black", "heavy"))
        self.italic = bool(self.flags & 1 << 6) or any(s in low for s in ("italic", "oblique"))

    @staticmethod
    def _for_windows(doc, file: Stream) -> bool:
        """Does the embedded program have a character map for Windows?"""
        try:
            return 3 in platforms(doc.stream_data(file))
        except ValueError:
            return False

    def _simple(self, doc, attrs: dict, desc, get, r) -> None:
        enc = get(attrs, "Encoding")
        base = str(enc) if isinstance(enc, str) else str(get(enc, "BaseEncoding") or "")
        self.table: list[str | None] = list(ENCODINGS[base]) if base in ENCODINGS else [None] * 256 if self.pictures else list(STANDARD)
        file = get(desc, "FontFile2") if base not in ENCODINGS and not self.pictures and isinstance(desc, dict) else None
        if isinstance(file, Stream) and self._for_windows(doc, file):
            self.table = [s or w for s, w in zip(STANDARD, WIN_ANSI, strict=True)]
        code = 0
        for x in (get(enc, "Differences") or []) if isinstance(enc, dict) else []:
            x = r(x)
            if isinstance(x, int) and not isinstance(x, bool):
                code = x
            elif isinstance(x, Name):
                if 0 <= code < 256:
                    self.table[code] = glyph_text(x)
                code += 1
        first, widths = get(attrs, "FirstChar"), get(attrs, "Widths")
        missing = get(desc, "MissingWidth")
        mono = "courier" in self.name.lower() or "mono" in self.name.lower()
        given = isinstance(widths, list)
        if isinstance(missing, (int, float)) or given:
            self.widths = [float(missing) if isinstance(missing, (int, float)) else 500.0] * 256
        else:
            self.widths = list(_usual(metrics.face(self.name), mono, tuple(self.table)))
        for k, w in enumerate(widths if given else []):
            c, w = (first if isinstance(first, int) else 0) + k, r(w)
            if 0 <= c < 256 and isinstance(w, (int, float)):
                self.widths[c] = float(w)

    def _cid_widths(self, inner: dict, r) -> None:
        dw = r(inner.get("DW"))
        self.default, self.cid = float(dw) if isinstance(dw, (int, float)) else 1000.0, {}
        self.cid_ranges: list[tuple[int, int, float]] = []
        w, k = [r(x) for x in r(inner.get("W")) or []], 0
        while k + 1 < len(w):
            if isinstance(w[k + 1], list):
                self.cid.update({w[k] + n: float(v) for n, x in enumerate(w[k + 1]) if isinstance(v := r(x), (int, float))})
                k += 2
            elif k + 2 < len(w) and isinstance(w[k + 2], (int, float)):
                self.cid_ranges.append((w[k], w[k + 1], float(w[k + 2])))
                k += 3
            else:
                break

    def show(self, s: bytes) -> tuple[str, float, int, int]:
        """(text, advance in text space, codes, single-byte spaces) of a string."""
        if self.two_bytes:
            codes = [s[k] << 8 | s[k + 1] for k in range(0, len(s) - 1, 2)]
            tu = self.to_unicode or (lambda c: None)
            return "".join("�" if (t := tu(c)) is None else t for c in codes), sum(map(self._cid_width, codes)) * 0.001, len(codes), 0
        if self._texts is None:
            tu = self.to_unicode or (lambda c: None)
            found = [(tu(c), self.table[c]) for c in range(256)]
            self._texts = [t if t is not None else "�" if u is None else u for t, u in found]
            # one character for each code is what a codec maps
            self._map = "".join(self._texts) if all(len(t) == 1 and t != "\ufffe" for t in self._texts) else None
            # whole numbers add up to the same in any order
            self._whole = np.array(self.widths) if all(w.is_integer() and abs(w) < 1 << 24 for w in self.widths) else None
        text = s.decode("latin-1").translate(self._texts) if self._map is None else codecs.charmap_decode(s, "strict", self._map)[0]
        n = len(s)
        width = sum(map(self.widths.__getitem__, s)) if n < 100 or self._whole is None else float(self._whole[np.frombuffer(s, np.uint8)].sum())
        return text, width * self.scale, n, s.count(b" ")

    def _cid_width(self, c: int) -> float:
        w = self.cid.get(c)
        return next((x for lo, hi, x in self.cid_ranges if lo <= c <= hi), self.default) if w is None else w


#: Fonts without references, by what they say; the same few stand in most documents.
_PLAIN: dict[str, Font] = {}


def load(doc, ref_or_dict, cache: dict) -> Font | None:
    key = ref_or_dict.num if isinstance(ref_or_dict, Ref) else id(ref_or_dict)
    if key not in cache:
        d = doc.resolve(ref_or_dict)
        plain = repr(sorted(d.items())) if isinstance(d, dict) and len(d) < 8 and all(isinstance(v, (Name, int)) for v in d.values()) else None
        if plain in _PLAIN:
            cache[key] = _PLAIN[plain]
            return cache[key]
        try:
            cache[key] = Font(doc, d) if isinstance(d, dict) else None
        except (TypeError, ValueError, KeyError, AttributeError, IndexError):
            cache[key] = None
        if plain is not None and len(_PLAIN) < 256:
            _PLAIN[plain] = cache[key]
    return cache[key]
