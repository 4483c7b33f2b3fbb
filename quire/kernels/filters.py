"""Stream decoding: the filter chain, its parameters and predictors. Codecs of continuous-tone images stay encoded."""

from __future__ import annotations

import binascii
import re
import zlib

import numpy as np

from . import fax, jbig2
from .errors import Undecodable, Unsupported

MAX_STAGES, MAX_BYTES = 32, 256 << 20
IMAGE_CODECS = {"DCTDecode", "DCT", "JPXDecode"}
_SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}


def flate(data: bytes) -> bytes:
    """zlib; raw deflate where the header is broken; as much as can be read of damaged data."""
    for skip in (0, 1, 2):
        if skip and data[:skip].strip(b"\r\n"):
            break
        for bits in (15, -15):
            d, out = zlib.decompressobj(bits), []
            src = data[skip:] if bits > 0 else (data[skip + 2 :] if data[skip : skip + 1] == b"\x78" else data[skip:])
            try:
                out.append(d.decompress(src, MAX_BYTES))
                return out[0]
            except zlib.error:
                got = _piecewise(src, bits)
                if got:
                    return got
    if data.strip():
        raise Undecodable("FlateDecode")
    return b""


def _piecewise(data: bytes, bits: int) -> bytes:
    d, out = zlib.decompressobj(bits), bytearray()
    try:
        for k in range(0, len(data), 64):
            out += d.decompress(data[k : k + 64])
            if len(out) > MAX_BYTES:
                break
    except zlib.error:
        pass
    return bytes(out)


_WEIGHTS = 1 << np.arange(11, -1, -1)
_SINGLE = [bytes([k]) for k in range(256)] + [b"", b""]


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes are cut out as many at a time as have one width for certain."""
    out, table, prev = [], _SINGLE[:], None
    at, end, width, size, edge, total = 0, 8 * len(data), 9, 258, 512 - early, 0
    whole = np.frombuffer(data, np.uint8)
    while at + width <= end:
        if prev is None and size == 258:
            before = at
            plain, at, over = _plain_codes(whole, at, end, 255 - early)
            if plain:
                out.append(plain)
                total += len(plain)
                if total > MAX_BYTES:
                    raise Undecodable("too large")
            if over:
                return b"".join(out)
            if at > before:
                continue
        n = min((end - at) // width, max(1, edge - size + (prev is None)) if width < 12 else 1024)
        bits = np.unpackbits(whole[at >> 3 : (at + n * width + 7) >> 3])[at & 7 :][: n * width]
        for code in bits.reshape(n, width).dot(_WEIGHTS[12 - width :]).tolist():
            at += width
            if code < size:
                if code == 256:
                    table, prev = _SINGLE[:], None
                    width, size, edge = 9, 258, 512 - early
                    break
                if code == 257:
                    return b"".join(out)
                cur = table[code]
            elif prev is not None and code == size:
                cur = prev + prev[:1]
            else:
                return b"".join(out)
            out.append(cur)
            total += len(cur)
            if total > MAX_BYTES:
                raise Undecodable("too large")
            if prev is not None and size < 4096:
                table.append(prev + cur[:1])
                size += 1
            prev = cur
        if size >= edge and width < 12:
            width, edge = width + 1, 2 * (edge + early) - early
    return b"".join(out)


def _plain_codes(whole: np.ndarray, at: int, end: int, most: int) -> tuple[bytes, int, bool]:
    """Stretches of single bytes from an empty table on, each up to a code that clears it again, are read without a table: (bytes, where the next code is, is this the end of data). A stretch has `most` codes, its mark among them, while all are nine bits."""
    n = min((end - at) // 9, 4096)
    bits = np.unpackbits(whole[at >> 3 : (at + n * 9 + 7) >> 3])[at & 7 :][: n * 9]
    codes = bits.reshape(n, 9).dot(_WEIGHTS[3:])
    marks = np.flatnonzero(codes >= 256)
    done, over = 0, False
    for k, c in zip(marks.tolist(), codes[marks].tolist(), strict=True):
        if c > 257 or k - done >= most:
            break
        done = k + 1
        if c == 257:
            over = True
            break
    codes = codes[:done]
    return codes[codes < 256].astype(np.uint8).tobytes(), at + 9 * done, over


_QUINTETS = re.compile(rb"[!-u]*+")
_WHITE = bytes.maketrans(b"", b""), b"\0\t\n\f\r "
_POWERS = 85 ** np.arange(4, -1, -1)


def ascii85(data: bytes) -> bytes:
    data = data.split(b"~>")[0].translate(*_WHITE)
    if len(data) > 20 and _QUINTETS.fullmatch(data):
        whole = len(data) // 5 * 5
        v = (np.frombuffer(data, np.uint8, whole).astype(np.int64) - 33).reshape(-1, 5).dot(_POWERS)
        if int(v.max()) >> 32:
            raise Undecodable("ASCII85Decode")
        return v.astype(">u4").tobytes() + _ascii85(data[whole:])
    return _ascii85(data)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _base85(group)
                group = []
        elif c not in b"\0\t\n\f\r ":
            raise Undecodable("ASCII85Decode")
    if len(group) == 1:
        raise Undecodable("ASCII85Decode")
    if group:
        n = len(group) - 1
        out += _base85(group + [84] * (5 - len(group)))[:n]
    return bytes(out)


def _base85(g: list[int]) -> bytes:
    v = 0
    for x in g:
        v = v * 85 + x
    if v >> 32:
        raise Undecodable("ASCII85Decode")
    return v.to_bytes(4, "big")


def ascii_hex(data: bytes) -> bytes:
    data = data.split(b">")[0]
    try:
        return binascii.unhexlify(data)
    except ValueError:
        pass
    h = re.sub(rb"[^0-9A-Fa-f]", b"", data)
    return bytes.fromhex((h + b"0" * (len(h) & 1)).decode())


def run_length(data: bytes) -> bytes:
    out, p, end = bytearray(), 0, len(data)
    while p < end:
        n = data[p]
        if n == 128:
            break
        if n < 128:
            out += data[p + 1 : p + n + 2]
            p += n + 2
        else:
            out += data[p + 1 : p + 2] * (257 - n)
            p += 2
    return bytes(out)


def predict(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if not isinstance(kind, int) or kind < 2:
        return data
    whole = lambda k, d: v if isinstance(v := parms.get(k, d), int) and v > 0 else d
    colors, bits, columns = whole("Colors", 1), whole("BitsPerComponent", 8), whole("Columns", 1)
    bpp, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if row > MAX_BYTES:
        raise Undecodable("predictor")
    if kind == 2:
        if bits != 8:
            raise Unsupported("TIFF predictor of other than 8 bits")
        n = len(data) // row * row
        a = np.frombuffer(data[:n], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(a, axis=1, dtype=np.uint8).tobytes() + data[n:]
    out, prev = bytearray(), bytes(row)
    for p in range(0, len(data), row + 1):
        prev = unfilter(data[p], data[p + 1 : p + 1 + row], prev, bpp)
        out += prev
        prev = prev.ljust(row, b"\0")
    return bytes(out)


def unfilter(kind: int, row: bytes, prev: bytes, bpp: int) -> bytes:
    if kind == 0 or not row:
        return row
    a, b = np.frombuffer(row, np.uint8), np.frombuffer(prev[: len(row)], np.uint8)
    if kind == 2:
        return (a + b).tobytes()
    if kind == 1:
        pad = -len(a) % bpp
        return np.cumsum(np.append(a, np.zeros(pad, np.uint8)).reshape(-1, bpp), axis=0, dtype=np.uint8).tobytes()[: len(row)]
    out = bytearray(row)
    for i in range(len(out)):
        left, up, corner = out[i - bpp] if i >= bpp else 0, prev[i], prev[i - bpp] if i >= bpp else 0
        if kind == 3:
            add = (left + up) // 2
        elif kind == 4:
            p = left + up - corner
            da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
            add = left if da <= db and da <= dc else up if db <= dc else corner
        else:
            raise Undecodable("PNG row")
        out[i] = (out[i] + add) & 255
    return bytes(out)


def chain(attrs: dict, resolve=lambda x: x) -> list[tuple[str, dict]]:
    """Names of the filters and the parameters of each: a single dictionary belongs to the first."""
    f = resolve(attrs.get("Filter", attrs.get("F")))
    if f is None:
        return []
    p = resolve(attrs.get("DecodeParms", attrs.get("DP")))
    if p is None and isinstance(f, str):
        return [(_SHORT.get(str(f), str(f)), {})]
    names = [resolve(x) for x in (f if isinstance(f, list) else [f])]
    names = [_SHORT.get(str(x), str(x)) for x in names if isinstance(x, str)]
    parms = [resolve(x) for x in p] if isinstance(p, list) else [p]
    at = lambda k: {a: resolve(b) for a, b in parms[k].items()} if k < len(parms) and isinstance(parms[k], dict) else {}
    return [(n, at(k)) for k, n in enumerate(names)]


def to_image(attrs: dict, data: bytes, resolve=lambda x: x) -> tuple[str | None, dict, bytes]:
    """What is left when an image codec ends the chain, with its name and parameters; else no name and the decoded bytes."""
    stages = chain(attrs, resolve)
    left = next(((n, p) for n, p in stages if n in IMAGE_CODECS), (None, {}))
    return _SHORT.get(left[0], left[0]), left[1], decode(attrs, data, resolve)


def decode(attrs: dict, data: bytes, resolve=lambda x: x, stop_at_image: bool = True) -> bytes:
    """The decoded bytes; an image codec ends the chain (its data stays) or, if not allowed, is Unsupported."""
    stages = chain(attrs, resolve)
    if len(stages) > MAX_STAGES:
        raise Undecodable("too many filters")
    for name, parms in stages:
        if name in IMAGE_CODECS:
            if stop_at_image:
                return data
            raise Unsupported(name)
        if name == "FlateDecode":
            data = predict(flate(data), parms)
        elif name == "LZWDecode":
            early = parms.get("EarlyChange", 1)
            data = predict(lzw(data, early if early in (0, 1) else 1), parms)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name == "CCITTFaxDecode":
            data = fax.decode(data, {"Rows": resolve(attrs.get("Height", attrs.get("H"))), **parms})
        elif name == "JBIG2Decode":
            size = [resolve(attrs.get(k)) for k in ("Width", "Height")]
            if not all(type(v) is int for v in size) or attrs.get("Subtype") != "Image":
                raise Unsupported(name)
            shared = parms.get("JBIG2Globals")
            data = jbig2.decode(data, decode(shared.attrs, shared.data, resolve) if hasattr(shared, "attrs") else b"", *size)
        elif name != "Crypt":
            raise Unsupported(name)
        if len(data) > MAX_BYTES:
            raise Undecodable("too large")
    return data
