"""JPEG images with Huffman coding, sequential and progressive, to samples of eight bits."""

from __future__ import annotations

import math

import numpy as np

from .errors import Undecodable

MAX_SAMPLES = 256 << 20
#: The order in which a block's coefficients are stored.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
_COS = np.array([[math.sqrt((1 if u else 0.5) / 4) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the symbol that they begin with and its length, as length << 8 | symbol; 0 where none does."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            if k >= len(symbols) or code >= 1 << n:
                raise Undecodable("DCTDecode")
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


class _Part:
    """A component: its sampling, tables and coefficients."""

    def __init__(self, key: int, h: int, v: int, table: int):
        self.key, self.h, self.v, self.table = key, h, v, table
        self.dc = self.ac = None
        self.last = 0


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def symbol(self, table: list[int]) -> int:
        k = self.at >> 3
        x = table[(int.from_bytes(self.data[k : k + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF]
        self.at += x >> 8
        if not x or self.at > self.end + 16:
            raise EOFError
        return x & 255

    def bits(self, n: int) -> int:
        if not n:
            return 0
        k = self.at >> 3
        v = (int.from_bytes(self.data[k : k + 4], "big") >> (32 - n - (self.at & 7))) & ((1 << n) - 1)
        self.at += n
        return v

    def value(self, n: int) -> int:
        v = self.bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def decode(data: bytes, transform: int | None = None) -> np.ndarray:
    """Height x width x components, as stored but for the colour transform that the file, or else the parameter, tells. A damaged scan leaves the rest as far as it was read."""
    at, quant, dc, ac, parts, restart, adobe, size, progressive = 2, {}, {}, {}, [], 0, None, None, False
    if data[:2] != b"\xff\xd8":
        raise Undecodable("DCTDecode")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind in (0xFF, 0, 1) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while len(body) >= 65:
                wide = body[0] >> 4
                many = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + many].ljust(many, b"\1"), ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + many :]
        elif kind == 0xC4:
            while len(body) >= 17:
                many = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _codes(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            if len(body) < 6 or body[0] != 8:
                raise Undecodable("DCTDecode")
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [_Part(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if not h or not w or not parts or w * h * len(parts) > MAX_SAMPLES or any(not 1 <= x <= 4 for p in parts for x in (p.h, p.v)):
                raise Undecodable("DCTDecode")
            size = h, w, max(p.h for p in parts), max(p.v for p in parts)
            for p in parts:
                p.across, p.down = -(-w // (8 * size[2])) * p.h, -(-h // (8 * size[3])) * p.v
                p.wide, p.high = -(-(-(-w * p.h // size[2])) // 8), -(-(-(-h * p.v // size[3])) // 8)
                p.blocks = [[0] * 64 for _ in range(p.across * p.down)]
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise Undecodable("DCTDecode")
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif kind == 0xDA and size and body:
            scan = []
            for k in range(1, 1 + 2 * body[0], 2):
                p = next((p for p in parts if p.key == body[k]), None)
                if p is None:
                    raise Undecodable("DCTDecode")
                p.dc, p.ac = dc.get(body[k + 1] >> 4), ac.get(body[k + 1] & 15)
                scan.append(p)
            first, last, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = len(data) if end < 0 else end
            try:
                _scan(data[at:end], scan, size, restart, (first, last, approx >> 4, approx & 15) if progressive else None)
            except (EOFError, IndexError, TypeError):
                pass
            at = end
    if size is None:
        raise Undecodable("DCTDecode")
    return _pixels(parts, size, quant, adobe if adobe is not None else transform)


def _scan(data: bytes, scan: list[_Part], size: tuple, restart: int, spectrum: tuple | None) -> None:
    pieces, a, k = [], 0, 0
    while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data):
        if data[k + 1] != 0:
            pieces.append(data[a:k])
            a = k + 2
        k += 2
    pieces = [x.replace(b"\xff\x00", b"\xff") for x in [*pieces, data[a:]]]
    if len(scan) == 1:
        p = scan[0]
        units = [[(p, y * p.across + x)] for y in range(p.high) for x in range(p.wide)]
    else:
        mx, my = scan[0].across // scan[0].h, scan[0].down // scan[0].v
        units = [[(p, (y * p.v + j) * p.across + x * p.h + i) for p in scan for j in range(p.v) for i in range(p.h)] for y in range(my) for x in range(mx)]
    step = restart or len(units)
    for piece, start in zip(pieces, range(0, len(units), step), strict=False):
        bits, left = _Bits(piece), [0]
        for p in scan:
            p.last = 0
        try:
            for unit in units[start : start + step]:
                for p, at in unit:
                    if spectrum is None:
                        _block(bits, p, p.blocks[at])
                    elif spectrum[0] == 0:
                        _first(bits, p, p.blocks[at], spectrum)
                    elif spectrum[2] == 0:
                        _further(bits, p, p.blocks[at], spectrum, left)
                    else:
                        _refined(bits, p, p.blocks[at], spectrum, left)
        except EOFError:
            if not restart:
                raise


def _block(bits: _Bits, p: _Part, b: list[int]) -> None:
    p.last += bits.value(bits.symbol(p.dc))
    b[0] = p.last
    k, table = 1, p.ac
    while k < 64:
        s = bits.symbol(table)
        if not s & 15:
            if s != 0xF0:
                return
            k += 16
            continue
        k += s >> 4
        b[ZIGZAG[k]] = bits.value(s & 15)
        k += 1


def _first(bits: _Bits, p: _Part, b: list[int], spectrum: tuple) -> None:
    if spectrum[2]:
        b[0] |= bits.bits(1) << spectrum[3]
    else:
        p.last += bits.value(bits.symbol(p.dc))
        b[0] = p.last << spectrum[3]


def _further(bits: _Bits, p: _Part, b: list[int], spectrum: tuple, left: list[int]) -> None:
    if left[0]:
        left[0] -= 1
        return
    k = spectrum[0]
    while k <= spectrum[1]:
        s = bits.symbol(p.ac)
        r = s >> 4
        if s & 15:
            k += r
            b[ZIGZAG[k]] = bits.value(s & 15) << spectrum[3]
            k += 1
        elif r == 15:
            k += 16
        else:
            left[0] = (1 << r) + bits.bits(r) - 1
            return


def _refined(bits: _Bits, p: _Part, b: list[int], spectrum: tuple, left: list[int]) -> None:
    k, last, one = spectrum[0], spectrum[1], 1 << spectrum[3]

    def refine(z: int) -> None:
        if bits.bits(1) and not abs(b[z]) & one:
            b[z] += one if b[z] > 0 else -one

    if not left[0]:
        while k <= last:
            s = bits.symbol(p.ac)
            r, new = s >> 4, 0
            if s & 15:
                new = one if bits.bits(1) else -one
            elif r < 15:
                left[0] = (1 << r) + bits.bits(r)
                break
            while k <= last:
                z = ZIGZAG[k]
                if b[z]:
                    refine(z)
                elif r:
                    r -= 1
                else:
                    b[z] = new
                    k += 1
                    break
                k += 1
    if left[0]:
        for z in ZIGZAG[k : last + 1]:
            if b[z]:
                refine(z)
        left[0] -= 1


def _pixels(parts: list[_Part], size: tuple, quant: dict, transform: int | None) -> np.ndarray:
    h, w, mh, mv = size
    planes = []
    for p in parts:
        order = np.empty(64, np.int64)
        order[list(ZIGZAG)] = quant.get(p.table, np.ones(64, np.int64))
        x = (np.array(p.blocks, float) * order).reshape(-1, 8, 8)
        x = _COS.T @ x @ _COS + 128
        plane = x.reshape(p.down, p.across, 8, 8).swapaxes(1, 2).reshape(p.down * 8, p.across * 8)
        p.blocks = []
        rows, columns = np.arange(h) * p.v // mv, np.arange(w) * p.h // mh
        planes.append(plane[rows][:, columns])
    v = np.stack(planes, 2)
    n = len(parts)
    if (n == 3 and transform != 0) or (n == 4 and transform in (1, 2)):
        y, cb, cr = v[..., 0], v[..., 1] - 128, v[..., 2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        v = rgb if n == 3 else np.concatenate([255 - rgb, v[..., 3:]], 2)
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)
