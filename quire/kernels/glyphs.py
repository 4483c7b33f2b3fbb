"""Glyph outlines of embedded TrueType programs: cmap, loca, glyf and hmtx; quadratic curves become cubic path operators in thousandths of an em."""

from __future__ import annotations

import struct


class TrueType:
    def __init__(self, data: bytes):
        """ValueError if a needed table is missing or broken."""
        self.data = data
        try:
            n = struct.unpack_from(">H", data, 4)[0]
            self.tables = {}
            for k in range(n):
                tag, _, off, size = struct.unpack_from(">4sIII", data, 12 + 16 * k)
                self.tables[tag] = (off, size)
            self.units = struct.unpack_from(">H", data, self.tables[b"head"][0] + 18)[0] or 1000
            long = struct.unpack_from(">h", data, self.tables[b"head"][0] + 50)[0]
            self.count = struct.unpack_from(">H", data, self.tables[b"maxp"][0] + 4)[0]
            at = self.tables[b"loca"][0]
            self.loca = struct.unpack_from(f">{self.count + 1}{'I' if long else 'H'}", data, at)
            self.loca = self.loca if long else tuple(2 * x for x in self.loca)
            self.glyf = self.tables[b"glyf"][0]
        except (struct.error, KeyError) as e:
            raise ValueError(f"TrueType: {e}") from None
        self.maps = self._cmaps()

    def _cmaps(self) -> dict[tuple[int, int], dict[int, int]]:
        out: dict = {}
        if b"cmap" not in self.tables:
            return out
        base = self.tables[b"cmap"][0]
        try:
            for k in range(struct.unpack_from(">H", self.data, base + 2)[0]):
                platform, enc, off = struct.unpack_from(">HHI", self.data, base + 4 + 8 * k)
                out[platform, enc] = self._cmap(base + off)
        except struct.error:
            pass
        return out

    def _cmap(self, p: int) -> dict[int, int]:
        d, kind = self.data, struct.unpack_from(">H", self.data, p)[0]
        if kind == 0:
            return {c: d[p + 6 + c] for c in range(256) if d[p + 6 + c]}
        if kind == 6:
            first, n = struct.unpack_from(">HH", d, p + 6)
            return {first + k: g for k, g in enumerate(struct.unpack_from(f">{n}H", d, p + 10)) if g}
        if kind == 12:
            out = {}
            for k in range(min(struct.unpack_from(">I", d, p + 12)[0], 65536)):
                a, b, g = struct.unpack_from(">III", d, p + 16 + 12 * k)
                out.update({c: g + c - a for c in range(a, min(b, a + 65535) + 1)})
            return out
        out = {}
        if kind == 4:
            n = struct.unpack_from(">H", d, p + 6)[0] // 2
            ends, starts = struct.unpack_from(f">{n}H", d, p + 14), struct.unpack_from(f">{n}H", d, p + 16 + 2 * n)
            deltas, offs = struct.unpack_from(f">{n}H", d, p + 16 + 4 * n), struct.unpack_from(f">{n}H", d, p + 16 + 6 * n)
            for k in range(n):
                for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                    at = p + 16 + 6 * n + 2 * k + offs[k] + 2 * (c - starts[k])
                    g = (c + deltas[k]) & 0xFFFF if not offs[k] else struct.unpack_from(">H", d, at)[0] if at + 2 <= len(d) else 0
                    g = (g + deltas[k]) & 0xFFFF if offs[k] and g else g
                    if g:
                        out[c] = g
        return out

    def glyph(self, code: int, text: str | None) -> int:
        """The glyph of a character: by its Unicode value, by its code in the symbol map, or by the old one-byte map."""
        for key in ((3, 10), (3, 1), (0, 4), (0, 3)):
            if text and len(text) == 1 and (g := self.maps.get(key, {}).get(ord(text))):
                return g
        sym = self.maps.get((3, 0), {})
        return sym.get(code) or sym.get(0xF000 + code) or self.maps.get((1, 0), {}).get(code, 0)

    def path(self, g: int, depth: int = 0) -> list[tuple]:
        """Path operators of a glyph; nothing for an empty or broken one."""
        if not 0 <= g < self.count or depth > 6:
            return []
        at, end = self.glyf + self.loca[g], self.glyf + self.loca[g + 1]
        if end <= at:
            return []
        try:
            n = struct.unpack_from(">h", self.data, at)[0]
            return self._simple(at + 10, n) if n >= 0 else self._composite(at + 10, depth)
        except (struct.error, IndexError):
            return []

    def _simple(self, p: int, n: int) -> list[tuple]:
        d = self.data
        if not n:
            return []
        ends = struct.unpack_from(f">{n}H", d, p)
        p += 2 * n
        p += 2 + struct.unpack_from(">H", d, p)[0]
        total, flags = ends[-1] + 1, []
        while len(flags) < total:
            f = d[p]
            p += 1
            flags.append(f)
            if f & 8:
                flags += [f] * d[p]
                p += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, out = 0, []
            for f in flags[:total]:
                if f & short:
                    v += d[p] if f & same else -d[p]
                    p += 1
                elif not f & same:
                    v += struct.unpack_from(">h", d, p)[0]
                    p += 2
                out.append(v * 1000 / self.units)
            axes.append(out)
        path, a = [], 0
        for e in ends:
            path += _contour([(x, y, bool(f & 1)) for x, y, f in zip(axes[0][a : e + 1], axes[1][a : e + 1], flags[a : e + 1], strict=True)])
            a = e + 1
        return path

    def _composite(self, p: int, depth: int) -> list[tuple]:
        out, more = [], True
        while more:
            flags, g = struct.unpack_from(">HH", self.data, p)
            p += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", self.data, p)
            p += 4 if flags & 1 else 2
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            v = [x / 16384 for x in struct.unpack_from(f">{n}h", self.data, p)]
            p += 2 * n
            if n:
                a, b, c, d = (v[0], 0.0, 0.0, v[-1]) if n < 4 else v
            e, f = (dx * 1000 / self.units, dy * 1000 / self.units) if flags & 2 else (0.0, 0.0)
            for op, *pts in self.path(g, depth + 1):
                out.append((op, *[z for k in range(0, len(pts), 2) for z in (a * pts[k] + c * pts[k + 1] + e, b * pts[k] + d * pts[k + 1] + f)]))
            more = bool(flags & 32)
        return out


def _contour(pts: list[tuple[float, float, bool]]) -> list[tuple]:
    """A closed contour of on- and off-curve points; between two of the latter lies one of the former."""
    if len(pts) < 2:
        return []
    full = []
    for k, (x, y, on) in enumerate(pts):
        px, py, pon = pts[k - 1]
        if not on and not pon:
            full.append(((px + x) / 2, (py + y) / 2, True))
        full.append((x, y, on))
    k = next(i for i, p in enumerate(full) if p[2])
    full = full[k:] + full[:k]
    at, ctrl = full[0][:2], None
    out: list[tuple] = [("m", *at)]
    for x, y, on in [*full[1:], full[0]]:
        if not on:
            ctrl = (x, y)
        elif ctrl:
            (qx, qy), (ax, ay) = ctrl, at
            out.append(("c", ax + 2 / 3 * (qx - ax), ay + 2 / 3 * (qy - ay), x + 2 / 3 * (qx - x), y + 2 / 3 * (qy - y), x, y))
            at, ctrl = (x, y), None
        else:
            out.append(("l", x, y))
            at = (x, y)
    return [*out, ("h",)]


def platforms(data: bytes) -> set[int]:
    """The platforms that a program's character maps are made for; none if it can't be read."""
    try:
        for k in range(struct.unpack_from(">H", data, 4)[0]):
            tag, _, off, _ = struct.unpack_from(">4sIII", data, 12 + 16 * k)
            if tag == b"cmap":
                return {struct.unpack_from(">H", data, off + 4 + 8 * n)[0] for n in range(struct.unpack_from(">H", data, off + 2)[0])}
    except struct.error:
        pass
    return set()
