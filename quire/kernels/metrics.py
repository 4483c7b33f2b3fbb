"""Advance widths of the standard fonts, in thousandths of an em, where a file has none."""

from __future__ import annotations

import re
import unicodedata

#: Characters 32 to 126, from the published font metrics; 39 and 96 are straight marks.
_ASCII = {
    "Helvetica": (
        "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 "
        "611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
    ),
    "Helvetica-Bold": (
        "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 "
        "611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
    ),
    "Times-Roman": (
        "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 "
        "611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
    ),
    "Times-Bold": (
        "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 "
        "667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"
    ),
    "Times-Italic": (
        "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 "
        "556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541"
    ),
    "Times-BoldItalic": (
        "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 "
        "611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570"
    ),
}
#: Other characters, and their widths in the same faces.
_OTHERS = "‘’“”–—•…ßÆæØø†‡ﬁﬂ°©®™£¥¢€§¶«»‹›¡¿·‚„‰ŒœŁłı"
_OTHER_WIDTHS = {
    "Helvetica": "222 222 333 333 556 1000 350 1000 611 1000 889 778 611 556 556 500 500 400 737 737 1000 556 556 556 556 556 537 556 556 333 333 333 611 278 222 333 1000 1000 944 556 222 278",
    "Helvetica-Bold": "278 278 500 500 556 1000 350 1000 611 1000 889 778 611 556 556 611 611 400 737 737 1000 556 556 556 556 556 556 556 556 333 333 333 611 278 278 500 1000 1000 944 611 278 278",
    "Times-Roman": "333 333 444 444 500 1000 350 1000 500 889 667 722 500 500 500 556 556 400 760 760 980 500 500 500 500 500 453 500 500 333 333 333 444 250 333 444 1000 889 722 611 278 278",
    "Times-Bold": "333 333 500 500 500 1000 350 1000 556 1000 722 778 500 500 500 556 556 400 747 747 1000 500 500 500 500 500 540 500 500 333 333 333 500 250 333 500 1000 1000 722 667 278 278",
    "Times-Italic": "333 333 556 556 500 889 350 889 500 889 667 722 500 500 500 500 500 400 760 760 980 500 500 500 500 500 523 500 500 333 333 389 500 250 333 556 1000 944 667 556 278 278",
    "Times-BoldItalic": "333 333 500 500 500 1000 350 1000 500 944 722 722 500 500 500 556 556 400 747 747 1000 500 500 500 500 500 500 500 500 333 333 389 500 250 333 500 1000 944 722 611 278 278",
}
FACES = {
    f: dict(zip([chr(c) for c in range(32, 127)] + list(_OTHERS), map(float, f"{_ASCII[f]} {_OTHER_WIDTHS[f]}".split()), strict=True)) for f in _ASCII
}
#: Families that stand for the standard ones.
_FAMILIES = {"helvetica": "Helvetica", "arial": "Helvetica", "arialmt": "Helvetica", "times": "Times", "timesnewroman": "Times", "timesnewromanps": "Times", "timesnewromanpsmt": "Times", "courier": "Courier", "couriernew": "Courier", "couriernewps": "Courier", "couriernewpsmt": "Courier"}


def face(name: str) -> str | None:
    """The standard face that a font's name means, or None."""
    name = re.sub(r"^[A-Z]{6}\+", "", name)
    family = _FAMILIES.get(re.split(r"[-,]", name)[0].lower().replace(" ", ""))
    bold, italic = "bold" in name.lower(), any(s in name.lower() for s in ("italic", "oblique"))
    if family == "Helvetica":
        return "Helvetica-Bold" if bold else "Helvetica"
    if family == "Times":
        return "Times-" + (("BoldItalic" if italic else "Bold") if bold else "Italic" if italic else "Roman")
    return family


def width(face_name: str, ch: str) -> float | None:
    """A character's width; accented letters are as wide as their letter."""
    if face_name == "Courier":
        return 600.0
    table = FACES[face_name]
    if ch == "\xa0":
        ch = " "
    if ch in table or len(ch) != 1:
        return table.get(ch)
    plain = unicodedata.normalize("NFD", ch)[0]
    return table.get("ı" if plain == "i" else plain)
