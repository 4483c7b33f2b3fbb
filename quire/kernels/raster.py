"""Rendering: filled and stroked paths, clips, constant alpha, soft masks, separable blend modes, shadings, patterns, images and appearances of annotations, to RGB and PNG.

Glyphs come from embedded TrueType, compact and Type 1 programs and Type 3 procedures. Text in fonts that aren't embedded and some image codecs are left out, each reported in the warnings.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np

from . import colors, filters, fonts
from .cff import CFF, Type1
from .content import apply, concat, invert, operators
from .glyphs import TrueType
from .objects import Name, Ref, Stream

SUB = 4  # lines sampled within a pixel row
MAX_PIXELS = 64 << 20


def png(rgb: np.ndarray, level: int = 6) -> bytes:
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def base_matrix(page, scale: float):
    """Crop box to device, y down, turned as the page is."""
    x0, y0, x1, y1 = page.crop_box
    w, h = x1 - x0, y1 - y0
    m = {0: (1, 0, 0, -1, -x0, y1), 90: (0, 1, 1, 0, -y0, -x0), 180: (-1, 0, 0, 1, x1, -y0), 270: (0, -1, -1, 0, y1, x1)}[page.rotate]
    del w, h
    return tuple(v * scale for v in m)


def flatten(path, m) -> list[np.ndarray]:
    """Subpaths as device polylines; curves in up to 32 steps."""
    out, cur = [], []
    for op, *p in path:
        pts = [apply(m, *p[k : k + 2]) for k in range(0, len(p), 2)]
        if op == "m":
            if len(cur) > 1:
                out.append(np.array(cur))
            cur = [pts[0]]
        elif op == "l" and cur:
            cur.append(pts[0])
        elif op == "c" and cur:
            a, (b, c, d) = cur[-1], pts
            n = max(2, min(32, int(math.hypot(d[0] - a[0], d[1] - a[1]) + math.hypot(b[0] - a[0], b[1] - a[1])) // 4 + 4))
            for k in range(1, n + 1):
                t = k / n
                u = 1 - t
                cur.append(tuple(u**3 * a[i] + 3 * u * u * t * b[i] + 3 * u * t * t * c[i] + t**3 * d[i] for i in (0, 1)))
        elif op == "h" and cur:
            cur.append(cur[0])
    if len(cur) > 1:
        out.append(np.array(cur))
    return out


def coverage(lines: list[np.ndarray], w: int, h: int, even_odd: bool = False) -> np.ndarray:
    """How much of each pixel the closed polygons cover, by scan lines with exact ends in x."""
    mask = np.zeros((h, w), np.float32)
    edges = [np.concatenate([p, np.roll(p, -1, 0)], 1) for p in lines]
    if not edges:
        return mask
    e = np.concatenate(edges)
    e = e[e[:, 1] != e[:, 3]]
    if not len(e):
        return mask
    sign = np.where(e[:, 1] < e[:, 3], 1, -1)
    lo, hi = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for y in range(max(0, math.floor(lo.min())), min(h, math.ceil(hi.max()))):
        for k in range(SUB):
            at = y + (k + 0.5) / SUB
            on = (lo <= at) & (at < hi)
            if not on.any():
                continue
            q = e[on]
            xs = q[:, 0] + (at - q[:, 1]) / (q[:, 3] - q[:, 1]) * (q[:, 2] - q[:, 0])
            order = np.argsort(xs, kind="stable")
            xs, wind = xs[order], np.cumsum(sign[on][order])
            inside = (np.arange(1, len(xs) + 1) & 1).astype(bool) if even_odd else wind != 0
            for a, b in zip(xs[:-1][inside[:-1]], xs[1:][inside[:-1]], strict=True):
                _run(mask[y], max(0.0, a), min(float(w), b))
    return np.minimum(mask / SUB, 1)


def _run(row: np.ndarray, a: float, b: float) -> None:
    if b <= a:
        return
    i, j = int(a), int(b)
    if i == j:
        row[i] += b - a
        return
    row[i] += i + 1 - a
    row[i + 1 : j] += 1
    if j < len(row):
        row[j] += b - j


def outline(lines: list[np.ndarray], width: float, cap: int, join: int) -> list[np.ndarray]:
    """Polygons that together cover a stroke: one for each segment and each round or square end."""
    out, r = [], max(width, 1.0) / 2
    circle = np.array([(r * math.cos(t), r * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 16, endpoint=False)])
    for p in lines:
        closed = len(p) > 2 and np.allclose(p[0], p[-1])
        for k, (a, b) in enumerate(zip(p, p[1:], strict=False)):
            d = b - a
            n = math.hypot(*d)
            if not n:
                continue
            d = d / n
            side = np.array([-d[1], d[0]]) * r
            s = a - d * r if cap == 2 and k == 0 and not closed else a
            t = b + d * r if cap == 2 and k == len(p) - 2 and not closed else b
            out.append(np.array([s + side, t + side, t - side, s - side]))
        if width > 1.5:
            out += [circle + v for v in (p if cap == 1 else p[1:-1] if not closed else p)]
    del join
    return out


def dashed(lines: list[np.ndarray], dash: list[float], phase: float) -> list[np.ndarray]:
    if not dash or sum(dash) <= 0 or any(d < 0 for d in dash):
        return lines
    dash = dash * (1 + len(dash) % 2)
    out = []
    for p in lines:
        k, left, on = 0, dash[0], True
        skip = phase % sum(dash)
        while skip >= left:
            skip -= left
            k, on = (k + 1) % len(dash), not on
            left = dash[k]
        left -= skip
        cur = [p[0]] if on else []
        for a, b in zip(p, p[1:], strict=False):
            n = math.hypot(*(b - a))
            at = 0.0
            while n - at > left:
                at += left
                q = a + (b - a) * (at / n)
                if on:
                    out.append(np.array([*cur, q]))
                k, on = (k + 1) % len(dash), not on
                left, cur = max(dash[k], 1e-3), [q] if on is False else []
                cur = [q] if on else []
            left -= n - at
            if on:
                cur.append(b)
        if on and len(cur) > 1:
            out.append(np.array(cur))
    return out


def to_rgb(v: list[float]) -> tuple[float, float, float]:
    """A colour of a device space, by the number of its components."""
    space = colors.of_count(len(v))
    return space.one([float(x) for x in v]) if space else (0.0, 0.0, 0.0)


#: The separable blend modes.
BLEND = {
    "Multiply": lambda b, s: b * s, "Screen": lambda b, s: b + s - b * s, "Darken": np.minimum, "Lighten": np.maximum, "Difference": lambda b, s: abs(b - s), "Exclusion": lambda b, s: b + s - 2 * b * s,
    "Overlay": lambda b, s: np.where(b <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s)), "HardLight": lambda b, s: np.where(s <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s)),
    "ColorDodge": lambda b, s: np.where(b == 0, 0, np.minimum(1, b / np.maximum(1 - s, 1e-6))), "ColorBurn": lambda b, s: np.where(b == 1, 1, 1 - np.minimum(1, (1 - b) / np.maximum(s, 1e-6))),
    "SoftLight": lambda b, s: np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b)) - b)),
}


def function(doc, f):
    """A sampled, exponential, stitching or calculator function, or None. One of a single input takes a number, one of more takes a list."""
    f = doc.resolve(f)
    d = f.attrs if isinstance(f, Stream) else f
    if not isinstance(d, dict):
        return None
    get = lambda k, z=None: [doc.resolve(x) for x in v] if isinstance(v := doc.resolve(d.get(k)), list) else (z if v is None else v)
    kind, domain = get("FunctionType"), get("Domain", [0, 1])
    lo, hi = (domain + [0, 1])[:2]
    clip = lambda x: min(max(x, lo), hi)
    if kind == 2:
        a, b, n = get("C0", [0.0]), get("C1", [1.0]), get("N", 1)
        return lambda x: [p + clip(x) ** n * (q - p) for p, q in zip(a, b, strict=False)]
    if kind == 3:
        parts, bounds, enc = [function(doc, g) for g in get("Functions", [])], get("Bounds", []), get("Encode", [])
        if not parts or None in parts:
            return None

        def stitched(x):
            x = clip(x)
            k = sum(x >= b for b in bounds[: len(parts) - 1])
            edge = [lo, *bounds, hi]
            e0, e1 = (enc[2 * k : 2 * k + 2] + [0, 1])[:2] if len(enc) >= 2 * k + 2 else (0, 1)
            return parts[k](e0 + (x - edge[k]) / ((edge[k + 1] - edge[k]) or 1) * (e1 - e0))

        return stitched
    if kind == 0 and isinstance(f, Stream):
        return _sampled(doc.stream_data(f), get("Size", [0]), get("BitsPerSample", 8), domain, get("Range", [0, 1]), get("Encode"), get("Decode"))
    if kind == 4 and isinstance(f, Stream):
        program, rng = _program(doc.stream_data(f)), get("Range", [])
        return None if program is None else lambda x: _calculated(program, x if isinstance(x, list) else [x], domain, rng)
    return None


def _sampled(data: bytes, size: list, bits: int, domain: list, rng: list, enc: list | None, dec: list | None):
    """Interpolation between the samples of a grid of one or more inputs."""
    n, many = len(rng) // 2, int(np.prod(size)) if size and all(isinstance(x, int) and x > 0 for x in size) else 0
    if not n or not 0 < many * n <= 1 << 22 or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or len(domain) < 2 * len(size) or len(data) * 8 < many * n * bits:
        return None
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=many * n * bits).reshape(-1, bits) @ (1 << np.arange(bits, dtype=np.uint64)[::-1])
    t = flat.reshape(*size[::-1], n) / (2**bits - 1)
    dec, enc = dec or rng, enc or [v for s in size for v in (0, s - 1)]
    low, high = np.array(dec[0::2][:n], float), np.array(dec[1::2][:n], float)

    def at(x):
        x = x if isinstance(x, list) else [x]
        v = t
        for k in range(len(size) - 1, -1, -1):  # the last input varies slowest
            lo, hi = domain[2 * k], domain[2 * k + 1]
            p = enc[2 * k] + (min(max(x[k], lo), hi) - lo) / ((hi - lo) or 1) * (enc[2 * k + 1] - enc[2 * k])
            p = min(max(p, 0), size[k] - 1)
            a = min(int(p), max(0, size[k] - 2))
            v = v[a] + (v[min(a + 1, size[k] - 1)] - v[a]) * (p - a)
        return np.clip(low + v * (high - low), rng[0::2][:n], rng[1::2][:n]).tolist()

    return at


_WORD = re.compile(rb"[{}]|[^\s{}%]+")


def _program(data: bytes) -> list | None:
    """A calculator's program as nested lists."""
    out: list = []
    stack = [out]
    for w in _WORD.findall(re.sub(rb"%[^\r\n]*", b"", data)):
        if w == b"{":
            stack.append([])
            stack[-2].append(stack[-1])
        elif w == b"}":
            if len(stack) < 2:
                return None
            stack.pop()
        else:
            try:
                stack[-1].append(float(w) if b"." in w or b"e" in w.lower() and w[:1].isdigit() else int(w))
            except ValueError:
                stack[-1].append(w.decode("latin-1"))
    return out[0] if len(stack) == 1 and len(out) == 1 and isinstance(out[0], list) else None


_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0, "idiv": lambda a, b: int(a / b) if b else 0, "mod": lambda a, b: math.fmod(a, b) if b else 0,
    "exp": lambda a, b: a**b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "bitshift": lambda a, b: a << b if b >= 0 else a >> -b,
}
_ONE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "sqrt": lambda a: math.sqrt(max(a, 0)), "sin": lambda a: math.sin(math.radians(a)),
    "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "cvi": int, "cvr": float, "not": lambda a: not a if isinstance(a, bool) else ~a,
}


def _calculated(program: list, x: list, domain: list, rng: list) -> list:
    s = [min(max(v, lo), hi) for v, lo, hi in zip(x, domain[0::2], domain[1::2], strict=False)]

    def run(body: list) -> None:
        for k, w in enumerate(body):
            if isinstance(w, list):
                continue
            if not isinstance(w, str):
                s.append(w)
            elif w in _TWO:
                b, a = s.pop(), s.pop()
                s.append(_TWO[w](a, b))
            elif w in _ONE:
                s.append(_ONE[w](s.pop()))
            elif w in ("true", "false"):
                s.append(w == "true")
            elif w == "pop":
                s.pop()
            elif w == "dup":
                s.append(s[-1])
            elif w == "exch":
                s[-1], s[-2] = s[-2], s[-1]
            elif w == "copy" and (n := int(s.pop())) > 0:
                s.extend(s[-n:])
            elif w == "index":
                s.append(s[-1 - int(s.pop())])
            elif w == "roll":
                j, n = int(s.pop()), int(s.pop())
                if n > 0:
                    top, j = s[-n:], j % n
                    s[-n:] = top[n - j :] + top[: n - j]
            elif w == "if":
                if s.pop():
                    run(body[k - 1])
            elif w == "ifelse":
                run(body[k - 2] if s.pop() else body[k - 1])

    try:
        run(program)
    except (IndexError, TypeError, OverflowError, ValueError):
        s = []
    n = len(rng) // 2
    s = [0.0] * (n - len(s)) + [float(v) for v in s[-n:]]
    return [min(max(v, lo), hi) for v, lo, hi in zip(s, rng[0::2], rng[1::2], strict=False)]


class Canvas:
    glyphs = True

    def __init__(self, doc, page, scale: float):
        w, h = (max(1, math.ceil(v * scale - 1e-6)) for v in page.size)
        if w * h > MAX_PIXELS:
            raise ValueError("too many pixels")
        self.doc, self.w, self.h = doc, w, h
        self.px = np.ones((h, w, 3), np.float32)
        self.warn: Counter = Counter()
        self.fonts: dict = {}
        self.faces: dict = {}

    def face(self, ref):
        """(font, TrueType program, character procedures by code, its matrix, its resources) of a font."""
        r = self.doc.resolve
        key = ref.num if isinstance(ref, Ref) else id(ref)
        if key in self.faces:
            return self.faces[key]
        font, attrs = fonts.load(self.doc, ref, self.fonts), r(ref)
        program = procs = None
        matrix, own = (0.001, 0, 0, 0.001, 0, 0), None
        if font is not None and font.kind == "Type3":
            table, enc = r(attrs.get("CharProcs")), r(attrs.get("Encoding"))
            names, code = {}, 0
            for x in (r(enc.get("Differences")) or []) if isinstance(enc, dict) else []:
                x = r(x)
                if isinstance(x, Name):
                    names[code] = str(x)
                    code += 1
                elif isinstance(x, int):
                    code = x
            procs = {c: r(table[n]) for c, n in names.items() if isinstance(table, dict) and n in table}
            m = [r(v) for v in r(attrs.get("FontMatrix")) or []]
            matrix, own = tuple(m) if len(m) == 6 else matrix, r(attrs.get("Resources"))
        elif font is not None:
            kids = r(attrs.get("DescendantFonts"))
            inner = r(kids[0]) if isinstance(kids, list) and kids else attrs
            desc = r(inner.get("FontDescriptor")) if isinstance(inner, dict) else None
            for key_, kind in (("FontFile2", TrueType), ("FontFile3", _compact), ("FontFile", Type1)):
                file = r(desc.get(key_)) if isinstance(desc, dict) else None
                if isinstance(file, Stream):
                    try:
                        program = kind(self.doc.stream_data(file))
                    except (ValueError, IndexError, KeyError):
                        self.warn["Glyph font program"] += 1
            names = _names(r(attrs.get("Encoding")), r)
            if isinstance(program, (CFF, Type1)) and not font.two_bytes:
                program.by_code = [program.glyph(c, names.get(c)) for c in range(256)]
        self.faces[key] = font, program, procs, matrix, own
        return self.faces[key]

    def show(self, s: bytes, st: dict, tm, ctm, scopes, depth: int):
        """Paints a string and moves the text matrix."""
        if not self.glyphs:
            return tm
        if st["face"] is None or st["face"][0] is None:
            self.warn["Glyph NoGlyph"] += 1
            return tm
        font, program, procs, matrix, own = st["face"]
        step = 2 if font.two_bytes else 1
        seen, blank = False, True
        for k in range(0, len(s) - step + 1, step):
            raw = s[k : k + step]
            text, w, _, space = font.show(raw)
            code = int.from_bytes(raw, "big")
            at = concat((st["size"] * st["tz"], 0, 0, st["size"], 0, st["ts"]), concat(tm, ctm))
            if program is not None and st["mode"] in (0, 2, 4, 6) and st["fill"] is not None:
                path = program.path(_glyph(program, font, code, text))
                if path:
                    self.paint(coverage(flatten(path, concat((0.001, 0, 0, 0.001, 0, 0), at)), self.w, self.h), st["fill"], st, st["ca"])
                    seen = True
            elif procs and isinstance(procs.get(code), Stream) and depth < 8:
                try:
                    self.run(self.doc.stream_data(procs[code]), [own, *scopes] if isinstance(own, dict) else scopes, concat(matrix, at), dict(st), depth + 1)
                    seen = True
                except ValueError as e:
                    self.warn[f"Glyph {e}"] += 1
            blank = blank and not text.strip()
            tm = concat((1, 0, 0, 1, (w * st["size"] + st["tc"] + (st["tw"] if space else 0.0)) * st["tz"], 0), tm)
        if not seen and not blank and st["mode"] != 3:
            self.warn["Glyph NoGlyph"] += 1
        return tm

    def paint(self, mask: np.ndarray, color, st: dict, alpha: float) -> None:
        m = mask * alpha if st["clip"] is None else mask * st["clip"] * alpha
        if st.get("soft") is not None:
            m = m * st["soft"]
        if isinstance(color, np.ndarray) and color.shape[-1] == 4:
            m, color = m * color[:, :, 3], color[:, :, :3]
        ys, xs = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
        if not len(ys):
            return
        box = np.s_[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
        src = color[box] if isinstance(color, np.ndarray) else np.array(color, np.float32)
        back, a = self.px[box], m[box][:, :, None]
        blend = BLEND.get(st["blend"])
        self.px[box] = back + a * ((blend(back, np.broadcast_to(src, back.shape)) if blend else src) - back)

    def layer(self, draw) -> tuple[np.ndarray, np.ndarray]:
        """(colours, alpha) of what is drawn on nothing: drawn on white and on black, both are known."""
        held, on = self.px, []
        for ground in (np.ones, np.zeros):
            self.px = ground(held.shape, np.float32)
            draw()
            on.append(self.px)
        self.px = held
        alpha = np.clip(1 - (on[0] - on[1]).mean(2), 0, 1)
        return np.clip(on[1] / np.maximum(alpha, 1e-6)[:, :, None], 0, 1), alpha

    def pattern(self, p, n: list[float], st: dict, key: str, scopes: list[dict], base, depth: int):
        """The paint of a pattern: colours and alpha for each pixel; n colours an uncoloured one."""
        r, d = self.doc.resolve, p.attrs if isinstance(p, Stream) else p
        kind = r(d.get("PatternType")) if isinstance(d, dict) else None
        m = [r(v) for v in r(d.get("Matrix")) or []] if isinstance(d, dict) else []
        at = concat(tuple(m), base) if len(m) == 6 else base
        plain = _fresh()
        if kind == 2:
            rgb, alpha = self.layer(lambda: self.shade(r(d.get("Shading")), at, plain))
            return np.concatenate([rgb, alpha[:, :, None]], 2).astype(np.float32)
        box, xs, ys = ([r(v) for v in r(d.get("BBox")) or []], r(d.get("XStep")), r(d.get("YStep"))) if kind == 1 and isinstance(p, Stream) else ([], 0, 0)
        back = invert(at)
        if len(box) != 4 or not xs or not ys or back is None or depth > 4:
            self.warn["Pattern skipped"] += 1
            return None
        xs, ys = abs(float(xs)), abs(float(ys))
        w, h = (max(1, min(2048, math.ceil(step * math.hypot(*v)))) for step, v in ((xs, at[:2]), (ys, at[2:4])))
        cell = Canvas.__new__(Canvas)
        cell.doc, cell.w, cell.h, cell.warn, cell.fonts, cell.faces, cell.px = self.doc, w, h, self.warn, self.fonts, self.faces, np.ones((h, w, 3), np.float32)
        if r(d.get("PaintType")) == 2 and n:
            space = st.get(f"{key} space")
            plain["fill"] = plain["stroke"] = space.one(n) if space is not None else to_rgb(n)
        own = r(d.get("Resources"))
        x0, y0, x1, y1 = (float(v) for v in box)
        body = self.doc.stream_data(p)

        def draw():
            # what reaches over the cell's edge is seen in the next one
            for i in range(-min(4, math.ceil(x1 / xs)) + 1, min(4, math.ceil(-x0 / xs)) + 1) if x1 - x0 > xs or x0 < 0 or x1 > xs else (0,):
                for j in range(-min(4, math.ceil(y1 / ys)) + 1, min(4, math.ceil(-y0 / ys)) + 1) if y1 - y0 > ys or y0 < 0 or y1 > ys else (0,):
                    m = (w / xs, 0, 0, h / ys, i * w, j * h)
                    state = dict(plain)
                    state["clip"] = coverage(flatten([("m", x0, y0), ("l", x1, y0), ("l", x1, y1), ("l", x0, y1), ("h",)], m), w, h)
                    cell.run(body, [own, *scopes] if isinstance(own, dict) else scopes, m, state, depth + 1)

        rgb, alpha = cell.layer(draw)
        x, y = np.meshgrid(np.arange(self.w) + 0.5, np.arange(self.h) + 0.5)
        u, v = back[0] * x + back[2] * y + back[4], back[1] * x + back[3] * y + back[5]
        i, j = ((np.mod(q, step) / step * k).astype(int).clip(0, k - 1) for q, step, k in ((u, xs, w), (v, ys, h)))
        return np.concatenate([rgb, alpha[:, :, None]], 2).astype(np.float32)[j, i]

    def soft_mask(self, g: dict, ctm, scopes: list[dict], depth: int) -> np.ndarray | None:
        """The mask of a group's luminosity or alpha."""
        r = self.doc.resolve
        form = r(g.get("G"))
        if not isinstance(form, Stream) or depth > 8:
            self.warn["SoftMask skipped"] += 1
            return None
        draw = lambda: self.form(form, ctm, _fresh(), scopes, depth)
        if str(r(g.get("S"))) == "Alpha":
            return self.layer(draw)[1]
        group = r(form.attrs.get("Group"))
        space = self.space(group.get("CS")) if isinstance(group, dict) else None
        ground = [float(r(v)) for v in r(g.get("BC")) or []]
        held, self.px = self.px, np.zeros_like(self.px)
        self.px[:] = space.one(ground) if ground and space is not None else to_rgb(ground) if ground else 0.0
        draw()
        seen, self.px = self.px, held
        mask = seen @ np.array([0.3, 0.59, 0.11], np.float32)
        if (f := function(self.doc, g["TR"]) if isinstance(r(g.get("TR")), (dict, Stream)) else None) is not None:
            mask = np.interp(mask, np.arange(256) / 255, [f(k / 255)[0] for k in range(256)])
        return np.clip(mask, 0, 1).astype(np.float32)

    def form(self, x: Stream, ctm, st: dict, scopes: list[dict], depth: int) -> None:
        r = self.doc.resolve
        try:
            body = self.doc.stream_data(x)
        except ValueError as e:
            self.warn[f"Form {e}"] += 1
            return
        m, own, box = r(x.attrs.get("Matrix")), r(x.attrs.get("Resources")), r(x.attrs.get("BBox"))
        ctm = concat(tuple(r(v) for v in m), ctm) if isinstance(m, list) and len(m) == 6 else ctm
        st = dict(st)
        if isinstance(box, list) and len(box) == 4:
            x0, y0, x1, y1 = (float(r(v)) for v in box)
            clip = coverage(flatten([("m", x0, y0), ("l", x1, y0), ("l", x1, y1), ("l", x0, y1), ("h",)], ctm), self.w, self.h)
            st["clip"] = clip if st["clip"] is None else clip * st["clip"]
        self.run(body, [own, *scopes] if isinstance(own, dict) else scopes, ctm, st, depth + 1)

    def annotations(self, page, base) -> None:
        """Normal appearances, each fitted to its rectangle; hidden ones and those not for viewing are left out."""
        r = self.doc.resolve
        for a in r(page.attrs.get("Annots")) or []:
            a = r(a)
            if not isinstance(a, dict) or (r(a.get("F")) or 0) & 0b100010 or not isinstance(ap := r(a.get("AP")), dict):
                continue
            look = r(ap.get("N"))
            if isinstance(look, dict):
                look = r(look.get(str(r(a.get("AS")))))
            rect = [r(v) for v in r(a.get("Rect")) or []]
            if not isinstance(look, Stream) or len(rect) != 4:
                continue
            box, m = [float(r(v)) for v in r(look.attrs.get("BBox")) or []], r(look.attrs.get("Matrix"))
            m = tuple(r(v) for v in m) if isinstance(m, list) and len(m) == 6 else (1, 0, 0, 1, 0, 0)
            if len(box) != 4:
                continue
            corners = [apply(m, x, y) for x in box[::2] for y in box[1::2]]
            (x0, x1), (y0, y1) = ((min(c), max(c)) for c in zip(*corners, strict=True))
            fit = lambda lo, hi, a, b: ((max(a, b) - min(a, b)) / (hi - lo) if hi > lo else 1.0)
            sx, sy = fit(x0, x1, rect[0], rect[2]), fit(y0, y1, rect[1], rect[3])
            to = (sx, 0, 0, sy, min(rect[0], rect[2]) - x0 * sx, min(rect[1], rect[3]) - y0 * sy)
            self.form(look, concat(to, base), _fresh(), [page.resources], 0)

    def run(self, data: bytes, scopes: list[dict], ctm, st: dict, depth: int = 0) -> None:
        stack, path, start, pending, base = [], [], None, None, ctm
        tm = tlm = (1, 0, 0, 1, 0, 0)
        r = self.doc.resolve

        def resource(group, name):
            for s in scopes:
                d = r(s.get(group))
                if isinstance(d, dict) and str(name) in d:
                    return r(d[str(name)])
            return None

        def raw_resource(group, name):
            return next((d[name] for s in scopes if isinstance(d := r(s.get(group)), dict) and name in d), None)

        for op, v, _, _ in operators(data):
            n = [float(x) for x in v if isinstance(x, (int, float)) and not isinstance(x, bool)]
            if op == "q":
                stack.append((ctm, dict(st)))
            elif op == "Q" and stack:
                ctm, st = stack.pop()
            elif op == "cm" and len(n) >= 6:
                ctm = concat(n[-6:], ctm)
            elif op in ("m", "l") and len(n) >= 2:
                path.append((op, *n[-2:]))
                start = n[-2:] if op == "m" else start
            elif op == "c" and len(n) >= 6:
                path.append(("c", *n[-6:]))
            elif op in ("v", "y") and len(n) >= 4 and path:
                last = path[-1][-2:] if len(path[-1]) > 2 else start
                path.append(("c", *last, *n[-4:]) if op == "v" else ("c", *n[-4:], *n[-2:]))
            elif op == "h":
                path.append(("h",))
            elif op == "re" and len(n) >= 4:
                x, y, w, h = n[-4:]
                path += [("m", x, y), ("l", x + w, y), ("l", x + w, y + h), ("l", x, y + h), ("h",)]
            elif op in ("W", "W*"):
                pending = op
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if op in ("s", "b", "b*"):
                    path.append(("h",))
                lines = flatten(path, ctm)
                if op in ("f", "F", "f*", "B", "B*", "b", "b*") and st["fill"] is not None:
                    self.paint(coverage(lines, self.w, self.h, "*" in op), st["fill"], st, st["ca"])
                if op in ("S", "s", "B", "B*", "b", "b*") and st["stroke"] is not None:
                    f = math.sqrt(abs(ctm[0] * ctm[3] - ctm[1] * ctm[2]))
                    drawn = outline(dashed(lines, [x * f for x in st["dash"]], st["phase"] * f), st["w"] * f, st["cap"], st["join"])
                    drawn = [p if _area(p) > 0 else p[::-1] for p in drawn]
                    self.paint(coverage(drawn, self.w, self.h), st["stroke"], st, st["CA"])
                if pending:
                    m = coverage(lines, self.w, self.h, pending == "W*")
                    st["clip"] = m if st["clip"] is None else m * st["clip"]
                path, pending = [], None
            elif op in ("w", "J", "j") and n:
                st[{"w": "w", "J": "cap", "j": "join"}[op]] = n[-1]
            elif op == "d" and v and isinstance(v[0], list):
                st["dash"], st["phase"] = [float(x) for x in v[0] if isinstance(x, (int, float))], n[-1] if n else 0.0
            elif op in ("g", "rg", "k", "G", "RG", "K") and n:
                key = "fill" if op[0].islower() else "stroke"
                st[key], st[f"{key} space"] = to_rgb(n), None
            elif op in ("cs", "CS") and v:
                key = "fill" if op == "cs" else "stroke"
                space = self.space(v[-1], lambda name: raw_resource("ColorSpace", name))
                st[f"{key} space"] = space
                st[key] = _painted(space.one(space.first)) if space else (0.0, 0.0, 0.0)
                if space is None and not self.is_pattern(v[-1], lambda name: raw_resource("ColorSpace", name)):
                    self.warn[f"ColorSpace {_shown(v[-1])}"] += 1
            elif op in ("sc", "scn", "SC", "SCN"):
                key = "fill" if op[0] == "s" else "stroke"
                if v and isinstance(v[-1], Name):
                    st[key] = self.pattern(resource("Pattern", v[-1]), n, st, key, scopes, base, depth)
                elif n and st.get(f"{key} space") is not None:
                    st[key] = _painted(st[f"{key} space"].one(n))
                elif n:
                    st[key] = to_rgb(n)
            elif op == "gs" and v and isinstance(g := resource("ExtGState", v[-1]), dict):
                for k, f in (("ca", "ca"), ("CA", "CA"), ("LW", "w")):
                    if isinstance(x := r(g.get(k)), (int, float)):
                        st[f] = float(x)
                bm = r(g.get("BM"))
                bm = r(bm[0]) if isinstance(bm, list) and bm else bm
                if bm is not None:
                    st["blend"] = str(bm)
                    if str(bm) in ("Hue", "Saturation", "Color", "Luminosity"):
                        self.warn[f"BlendMode {bm}"] += 1
                if isinstance(soft := r(g.get("SMask")), dict):
                    st["soft"] = self.soft_mask(soft, ctm, scopes, depth)
                elif soft is not None:
                    st["soft"] = None
            elif op == "sh" and v:
                self.shade(resource("Shading", v[-1]), ctm, st, lambda name: raw_resource("ColorSpace", name))
            elif op == "Do" and v:
                x = resource("XObject", v[-1])
                if isinstance(x, Stream) and x.attrs.get("Subtype") == "Form" and depth < 16:
                    self.form(x, ctm, st, scopes, depth)
                elif isinstance(x, Stream):
                    self.image(x, ctm, st, lambda name: raw_resource("ColorSpace", name))
            elif op == "BI":
                self.image(v[0], ctm, st, lambda name: raw_resource("ColorSpace", name))
            elif op == "BT":
                tm = tlm = (1, 0, 0, 1, 0, 0)
            elif op == "Tf" and len(v) >= 2 and n:
                ref = next((d[str(v[-2])] for q in scopes if isinstance(d := r(q.get("Font")), dict) and str(v[-2]) in d), None)
                st["face"], st["size"] = (self.face(ref) if ref is not None else None), n[-1]
            elif op in ("Td", "TD") and len(n) >= 2:
                st["tl"] = -n[-1] if op == "TD" else st["tl"]
                tm = tlm = concat((1, 0, 0, 1, n[-2], n[-1]), tlm)
            elif op == "Tm" and len(n) >= 6:
                tm = tlm = tuple(n[-6:])
            elif op in ("Tc", "Tw", "TL", "Ts", "Tr", "Tz") and n:
                key = {"Tr": "mode"}.get(op, op.lower())
                st[key] = n[-1] / 100 if op == "Tz" else n[-1]
            elif op in ("T*", "Tj", "'", '"', "TJ"):
                if op == '"' and len(n) >= 2:
                    st["tw"], st["tc"] = n[0], n[1]
                if op in ("T*", "'", '"'):
                    tm = tlm = concat((1, 0, 0, 1, 0, -st["tl"]), tlm)
                for x in (v[-1] if op == "TJ" and v and isinstance(v[-1], list) else v[-1:] if op != "T*" else []):
                    if isinstance(x, bytes):
                        tm = self.show(x, st, tm, ctm, scopes, depth)
                    elif isinstance(x, (int, float)):
                        tm = concat((1, 0, 0, 1, -x / 1000 * st["size"] * st["tz"], 0), tm)

    def grid(self, ctm):
        inv = invert(ctm)
        if inv is None:
            return None
        x, y = np.meshgrid(np.arange(self.w) + 0.5, np.arange(self.h) + 0.5)
        return inv[0] * x + inv[2] * y + inv[4], inv[1] * x + inv[3] * y + inv[5]

    def space(self, x, resources=None) -> colors.Space | None:
        return colors.load(self.doc, x, function, resources)

    def is_pattern(self, x, resources) -> bool:
        x = self.doc.resolve(x)
        if isinstance(x, str) and str(x) != "Pattern":
            x = self.doc.resolve(resources(str(x)))
        return str(self.doc.resolve(x[0]) if isinstance(x, list) and x else x) == "Pattern"

    def samples(self, x: Stream, resources=None, mask: bool = False):
        """(values in the space's ranges h x w x n, space, raw samples, bits) of an image, or None with a warning."""
        r, a = self.doc.resolve, x.attrs
        get = lambda k, short=None: r(a.get(k, a.get(short)))
        w, h, bits = get("Width", "W"), get("Height", "H"), get("BitsPerComponent", "BPC")
        stencil = get("ImageMask", "IM") is True
        try:
            body, kind = self.doc.image_data(x)
        except (filters.Unsupported, filters.Undecodable) as e:
            self.warn[f"Image {e}"] += 1
            return None
        named = get("ColorSpace", "CS")
        space = colors.GRAY if stencil else self.space(named, resources) if named is not None else None
        if kind == "pixels":  # a codec that has its own size and depth
            h, w, n = body.shape
            bits, raw = 8, body
            space = space if space is not None and space.n == n else colors.of_count(n)
        else:
            bits = 1 if stencil else bits if bits is not None else 8
            if space is None and named is None and mask:
                space = colors.GRAY
            if space is None or bits not in (1, 2, 4, 8, 16) or type(w) is not int or type(h) is not int or not 0 < w * h <= MAX_PIXELS:
                self.warn["Image Unsupported"] += 1
                return None
            n = space.n
            row = (w * n * bits + 7) // 8
            if len(body) < row * h:
                self.warn["Image Truncated"] += 1
                body = body.ljust(row * h, b"\0")
            raw = np.frombuffer(body, np.uint8)[: row * h].reshape(h, row)
            if bits == 16:
                raw = raw[:, : w * n * 2].reshape(h, -1, 2).astype(int) @ (256, 1)
            elif bits < 8:
                raw = (np.unpackbits(raw, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1]))[:, : w * n]
            raw = raw[:, : w * n].reshape(h, w, n)
        dec = [r(v) for v in get("Decode", "D") or []]
        top = (1 << bits) - 1
        spans = dec if len(dec) >= 2 * n and all(isinstance(v, (int, float)) for v in dec) else [0.0, float(top)] if space.spans == [0.0, -1.0] else space.spans
        lo, hi = np.array(spans[0 : 2 * n : 2], float), np.array(spans[1 : 2 * n : 2], float)
        return lo + raw * ((hi - lo) / top), space, raw, bits

    def image(self, x: Stream, ctm, st: dict, resources=None) -> None:
        r, a = self.doc.resolve, x.attrs
        got, uv = self.samples(x, resources), self.grid(ctm)
        if got is None or uv is None:
            return
        v, space, raw, _ = got
        u, t = uv
        inside = (u >= 0) & (u < 1) & (t >= 0) & (t < 1)
        at = lambda z: z[np.clip(((1 - t) * z.shape[0]).astype(int), 0, z.shape[0] - 1), np.clip((u * z.shape[1]).astype(int), 0, z.shape[1] - 1)]
        if r(a.get("ImageMask", a.get("IM"))) is True:
            if st["fill"] is not None:
                self.paint(inside * (at(v)[:, :, 0] < 0.5).astype(np.float32), st["fill"], st, st["ca"])
            return
        alpha = inside.astype(np.float32)
        soft, mask = r(a.get("SMask")), r(a.get("Mask"))
        if isinstance(soft, Stream):
            if (m := self.samples(soft, resources, True)) is not None:
                alpha = alpha * np.clip(at(m[0])[:, :, 0], 0, 1)
        elif isinstance(mask, Stream):
            if (m := self.samples(mask, resources, True)) is not None:
                alpha = alpha * (at(m[0])[:, :, 0] < 0.5)
        elif isinstance(mask, list) and len(mask) >= 2 * raw.shape[2]:
            lo, hi = np.array([r(z) for z in mask[0::2]][: raw.shape[2]]), np.array([r(z) for z in mask[1::2]][: raw.shape[2]])
            alpha = alpha * ~at(((raw >= lo) & (raw <= hi)).all(2))
        self.paint(alpha.astype(np.float32), np.clip(np.nan_to_num(space.rgb(at(v))), 0, 1).astype(np.float32), st, st["ca"])

    def shade(self, x, ctm, st: dict, resources=None, mask=None) -> None:
        d = x.attrs if isinstance(x, Stream) else x
        r = self.doc.resolve
        kind = r(d.get("ShadingType")) if isinstance(d, dict) else None
        f = d.get("Function") if isinstance(d, dict) else None
        parts = [function(self.doc, g) for g in r(f)] if isinstance(r(f), list) else [function(self.doc, f)]
        c = [float(r(q)) for q in r(d.get("Coords")) or []] if kind in (2, 3) else []
        uv = self.grid(ctm)
        if len(c) != {2: 4, 3: 6}.get(kind) or None in parts or uv is None:
            self.warn["Shading Unsupported"] += 1
            return
        (lo, hi), ext = r(d.get("Domain")) or (0.0, 1.0), r(d.get("Extend")) or (False, False)
        u, v = uv
        if kind == 2:
            dx, dy = c[2] - c[0], c[3] - c[1]
            t = ((u - c[0]) * dx + (v - c[1]) * dy) / ((dx * dx + dy * dy) or 1)
            ok = np.ones(t.shape, bool)
        else:
            x0, y0, r0, x1, y1, r1 = c
            dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
            a = dx * dx + dy * dy - dr * dr or 1e-9
            b = (u - x0) * dx + (v - y0) * dy + r0 * dr
            q = b * b - a * ((u - x0) ** 2 + (v - y0) ** 2 - r0 * r0)
            ok = q >= 0
            t = (b + np.sqrt(np.maximum(q, 0))) / a
            ok &= r0 + np.clip(t, 0 if not ext[0] else -1e9, 1 if not ext[1] else 1e9) * dr >= 0
        ok &= (t >= 0) | bool(ext[0])
        ok &= (t <= 1) | bool(ext[1])
        space = self.space(d.get("ColorSpace"), resources)
        values = [[y for g in parts for y in g(lo + k / 255 * (hi - lo))] for k in range(256)]
        if space is None or any(len(z) < space.n for z in values):
            self.warn["Shading Unsupported"] += 1
            return
        lut = np.clip(space.rgb(np.array([z[: space.n] for z in values], float)), 0, 1).astype(np.float32)
        self.paint(ok.astype(np.float32) if mask is None else ok * mask, lut[(np.clip(t, 0, 1) * 255).astype(int)], st, st["ca"])


def _painted(rgb: tuple[float, float, float]) -> tuple[float, float, float] | None:
    """No paint for a colorant that marks nothing."""
    return None if math.isnan(rgb[0]) else rgb


def _shown(x) -> str:
    return str(x[0]) if isinstance(x, list) and x else str(x)


def _compact(d: bytes):
    """The program of a FontFile3, which may wrap either kind of outline."""
    return TrueType(d) if d[:4] in (b"\0\1\0\0", b"true") else CFF(d)


def _names(enc, r) -> dict[int, str]:
    """Glyph names by code, as far as the font's encoding tells them."""
    base = str(enc) if isinstance(enc, str) else str(r(enc.get("BaseEncoding")) or "") if isinstance(enc, dict) else ""
    out = {c: fonts.glyph_name(t) for c, t in enumerate(fonts.ENCODINGS.get(base, [])) if t}
    code = 0
    for x in (r(enc.get("Differences")) or []) if isinstance(enc, dict) else []:
        x = r(x)
        if isinstance(x, Name):
            out[code] = str(x)
            code += 1
        elif isinstance(x, int):
            code = x
    return out


def _glyph(program, font, code: int, text: str):
    if isinstance(program, TrueType):
        return code if font.two_bytes else program.glyph(code, text)
    if font.two_bytes:
        return program.glyph_of_cid(code) if isinstance(program, CFF) else None
    return program.by_code[code & 255]


def _area(p: np.ndarray) -> float:
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())


def _fresh() -> dict:
    """The graphics state that a page begins with."""
    return {
        "fill": (0.0,) * 3, "stroke": (0.0,) * 3, "w": 1.0, "cap": 0, "join": 0, "dash": [], "phase": 0.0, "ca": 1.0, "CA": 1.0, "blend": "Normal", "clip": None, "soft": None, "face": None, "size": 0.0, "tc": 0.0,
        "tw": 0.0, "tz": 1.0, "tl": 0.0, "ts": 0.0, "mode": 0,
    }


#: Distinct warnings of a page that are listed; others are counted.
MOST_WARNINGS = 64


def report(warn: Counter) -> list[str]:
    """Equal warnings once, with their number; what goes beyond the most is counted in a last line."""
    shown = [f"{k} ({n})" if n > 1 else k for k, n in sorted(warn.items())]
    return shown if len(shown) <= MOST_WARNINGS else [*shown[:MOST_WARNINGS], f"{sum(n for _, n in sorted(warn.items())[MOST_WARNINGS:])} more"]


def draw(doc, page, scale: float = 1.0, glyphs: bool = True) -> tuple[np.ndarray, Counter]:
    """Pixels (height x width x 3 bytes) of a page, and warnings; without glyphs, text leaves no mark and no warning."""
    canvas = Canvas(doc, page, scale)
    canvas.glyphs = glyphs
    ctm = base_matrix(page, scale)
    try:
        canvas.run(page.content(), [page.resources], ctm, _fresh())
    except (filters.Unsupported, filters.Undecodable) as e:
        canvas.warn[f"PageContents {e}"] += 1
    canvas.annotations(page, ctm)
    return np.clip(np.rint(canvas.px * 255), 0, 255).astype(np.uint8), canvas.warn


def render(doc, page, scale: float = 1.0, level: int = 6, glyphs: bool = True) -> tuple[int, int, bytes, list[str]]:
    """(width, height, PNG, warnings) of a page."""
    rgb, warn = draw(doc, page, scale, glyphs)
    return rgb.shape[1], rgb.shape[0], png(rgb, level), report(warn)
