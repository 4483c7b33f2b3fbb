"""Group 3 and Group 4 facsimile coding, one and two-dimensional."""

from __future__ import annotations

import numpy as np

MAX_ROWS = 1 << 16

#: The run codes of ITU-T T.4, runs 0 to 63, then 64, 128 and so on to 1728.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 "
    "00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 "
    "01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 "
    "010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 "
    "00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 "
    "000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 "
    "000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 "
    "0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
#: Codes of both colours for runs of 1792, 1856 and so on to 2560.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: The two-dimensional modes; numbers are vertical ones.
MODES = {"0001": "pass", "001": "across", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
_WIDE = 13


def runs(codes: list[str]) -> dict[str, int]:
    return {c: k if k < 64 else (k - 63) * 64 for k, c in enumerate(codes)} | {c: 1792 + 64 * k for k, c in enumerate(LONG)}


def _table(codes: dict) -> list:
    """What the next 13 bits begin with: (length, value)."""
    out: list = [None] * (1 << _WIDE)
    for c, v in codes.items():
        a = int(c, 2) << (_WIDE - len(c))
        out[a : a + (1 << (_WIDE - len(c)))] = [(len(c), v)] * (1 << (_WIDE - len(c)))
    return out


_RUNS, _MODE = (_table(runs(WHITE)), _table(runs(BLACK))), _table(MODES)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int = _WIDE) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 4].ljust(4, b"\0"), "big") >> (32 - n - (self.at & 7))) & ((1 << n) - 1)

    def take(self, table: list):
        got = table[self.peek()]
        if got is None or self.at >= self.end:
            raise EOFError
        self.at += got[0]
        return got[1]

    def run(self, color: int) -> int:
        total = 0
        while (n := self.take(_RUNS[color])) >= 64:
            total += n
        return total + n


def decode(data: bytes, parms: dict) -> bytes:
    """Packed rows, a 0 bit black unless BlackIs1; what can't be read is white, as many rows as are asked for."""
    number = lambda k, z: v if isinstance(v := parms.get(k), int) and not isinstance(v, bool) else z
    k, columns, rows = number("K", 0), max(1, number("Columns", 1728)), min(MAX_ROWS, max(0, number("Rows", 0) or 0))
    align, ends = parms.get("EncodedByteAlign") is True, parms.get("EndOfBlock") is not False
    bits, lines, ref = _Bits(data), [], []
    while bits.at < bits.end and not (rows and len(lines) >= rows) and len(lines) < MAX_ROWS:
        if align and bits.at & 7:
            bits.at += 8 - (bits.at & 7)
        marks = _marks(bits, k)
        if marks > 1 and ends:
            break
        flat = k == 0
        if k > 0 and marks:
            flat = bits.peek(1) == 1
            bits.at += 1
        try:
            ref = _across(bits, columns) if flat else _down(bits, columns, ref)
        except EOFError:
            if k < 0 or not _resync(bits):
                break
            continue
        lines.append(ref)
    out = np.zeros((rows or len(lines), columns), np.uint8)
    for y, changes in enumerate(lines):
        edge = changes + [columns] * (len(changes) & 1)
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            out[y, a:b] = 1
    return np.packbits(out if parms.get("BlackIs1") is True else 1 - out, axis=1).tobytes()


def _marks(bits: _Bits, k: int) -> int:
    """Ends of lines before the next line: 11 zeros or more and a one, in two-dimensional Group 3 with a tag behind all but the last."""
    n = 0
    while bits.at < bits.end:
        at = bits.at
        if bits.peek(11):
            return n
        while bits.at < bits.end and not bits.peek(1):
            bits.at += 1
        if bits.at >= bits.end:
            return n + 1
        bits.at += 1
        n += 1
        if k > 0:
            if bits.peek(13) >> 1 == 1:  # another end follows the tag
                bits.at += 1
        if k < 0 and n == 1 and bits.at - at > 12:
            bits.at = at
            return 0
    return n


def _resync(bits: _Bits) -> bool:
    while bits.at < bits.end:
        if not bits.peek(11):
            return True
        bits.at += 1
    return False


def _across(bits: _Bits, columns: int) -> list[int]:
    """Where the colour changes in a line of runs."""
    out, at, color = [], 0, 0
    while at < columns:
        at = min(columns, at + bits.run(color))
        if at < columns:
            out.append(at)
        color ^= 1
    return _merged(out)


def _merged(changes: list[int]) -> list[int]:
    """Without empty runs between two of one colour; a leading run of no white stays, as a change at 0."""
    out: list[int] = []
    for x in changes:
        if out and out[-1] == x:
            out.pop()
        else:
            out.append(x)
    return out


def _down(bits: _Bits, columns: int, ref: list[int]) -> list[int]:
    """A line told by its differences from the one above."""
    out: list[int] = []
    a, color, first, k = 0, 0, True, 0
    while a < columns:
        k = max(0, k - 2)
        while k < len(ref) and (ref[k] < a or (ref[k] == a and not first) or (k & 1) != color):
            k += 1
        b1 = ref[k] if k < len(ref) else columns
        mode = bits.take(_MODE)
        if mode == "pass":
            a = ref[k + 1] if k + 1 < len(ref) else columns
        elif mode == "across":
            n, m = bits.run(color), bits.run(color ^ 1)
            for x in (a + n, a + n + m):
                out.append(min(x, columns))
            a = min(columns, a + n + m)
        else:
            a = min(columns, max(a, b1 + mode))
            out.append(a)
            color ^= 1
        first = False
    return [x for x in _merged(out) if x < columns]
