"""Colour spaces: components to RGB between 0 and 1, one colour or arrays of them. Profiles are read as the device space of as many components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .objects import Stream

#: The device spaces, their short names in inline images, and those read as them.
DEVICE = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}


class Space:
    """n components; `rgb` takes arrays whose last axis holds them. `spans` are the ranges that image samples are stretched over."""

    def __init__(self, n: int, rgb: Callable[[np.ndarray], np.ndarray], first: list[float] | None = None, spans: list[float] | None = None):
        self.n, self.rgb, self.first, self.spans = n, rgb, first or [0.0] * n, spans or [0.0, 1.0] * n

    def one(self, v: list[float]) -> tuple[float, float, float]:
        v = (list(v) + self.first)[: self.n] if len(v) < self.n else v[: self.n]
        return tuple(np.clip(self.rgb(np.array(v, float)), 0, 1).tolist())


def _cmyk(v: np.ndarray) -> np.ndarray:
    return 1 - np.minimum(1, v[..., :3] + v[..., 3:4])


GRAY = Space(1, lambda v: np.repeat(np.clip(v, 0, 1), 3, -1))
RGB = Space(3, lambda v: np.clip(v, 0, 1))
CMYK = Space(4, lambda v: _cmyk(np.clip(v, 0, 1)), [0.0, 0.0, 0.0, 1.0])
_BY_COUNT = {1: GRAY, 3: RGB, 4: CMYK}


def of_count(n: int) -> Space | None:
    return _BY_COUNT.get(n)


def _lab(white: list[float], ranges: list[float]) -> Space:
    def rgb(v: np.ndarray) -> np.ndarray:
        m = (v[..., 0] + 16) / 116
        g = lambda x: np.where(x >= 6 / 29, x**3, 108 / 841 * (x - 4 / 29))
        x, y, z = (w * g(t) for w, t in zip(white, (m + v[..., 1] / 500, m, m - v[..., 2] / 200), strict=True))
        linear = np.stack([3.1339 * x - 1.6169 * y - 0.4906 * z, -0.9785 * x + 1.9160 * y + 0.0333 * z, 0.0720 * x - 0.2290 * y + 1.4057 * z], -1).clip(0, 1)
        return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)

    return Space(3, rgb, spans=[0.0, 100.0, *ranges])


def load(doc, x, function: Callable, resources: Callable | None = None, depth: int = 0) -> Space | None:
    """The space that an object names or describes; None for patterns and what isn't known. `function` reads a tint function, `resources` looks names up."""
    r = doc.resolve
    x = r(x)
    if depth > 8 or x is None:
        return None
    if isinstance(x, str):
        if str(x) in DEVICE:
            return _BY_COUNT[DEVICE[str(x)]]
        found = resources(str(x)) if resources else None
        return load(doc, found, function, None, depth + 1) if found is not None else None
    if not isinstance(x, list) or not x:
        return None
    kind, rest = str(r(x[0])), x[1:]
    inner = lambda y: load(doc, y, function, resources, depth + 1)
    if kind in DEVICE:
        return _BY_COUNT[DEVICE[kind]]
    if kind == "ICCBased" and rest:
        s = r(rest[0])
        d = s.attrs if isinstance(s, Stream) else {}
        n = r(d.get("N"))
        return _BY_COUNT.get(n) or (inner(d["Alternate"]) if "Alternate" in d else None)
    if kind == "Lab" and rest and isinstance(d := r(rest[0]), dict):
        numbers = lambda k, z: v if isinstance(v := [r(y) for y in r(d.get(k)) or []], list) and len(v) == len(z) else z
        return _lab(numbers("WhitePoint", [0.9505, 1.0, 1.089]), numbers("Range", [-100.0, 100.0, -100.0, 100.0]))
    if kind in ("Indexed", "I") and len(rest) >= 3:
        base, top, table = inner(rest[0]), r(rest[1]), r(rest[2])
        if isinstance(table, Stream):
            try:
                table = doc.stream_data(table)
            except ValueError:
                return None
        if base is None or not isinstance(table, bytes) or not isinstance(top, int) or not 0 <= top <= 255:
            return None
        t = np.frombuffer(table.ljust((top + 1) * base.n, b"\0")[: (top + 1) * base.n], np.uint8).reshape(-1, base.n) / 255
        lo, hi = np.array(base.spans[0::2]), np.array(base.spans[1::2])
        colors = base.rgb(lo + t * (hi - lo))
        return Space(1, lambda v: colors[np.clip(np.rint(v[..., 0]), 0, top).astype(int)], spans=[0.0, -1.0])
    if kind in ("Separation", "DeviceN") and len(rest) >= 3:
        names = r(rest[0])
        names = [str(r(n)) for n in names] if isinstance(names, list) else [str(names)]
        base, tint = inner(rest[1]), function(doc, rest[2])
        if all(n == "None" for n in names):
            return Space(len(names), lambda v: np.full((*v.shape[:-1], 3), np.nan), [1.0] * len(names))
        if base is None or tint is None:
            return None

        def rgb(v: np.ndarray) -> np.ndarray:
            flat = v.reshape(-1, v.shape[-1])
            known, back = np.unique(flat, axis=0, return_inverse=True)
            out = base.rgb(np.array([(tint(float(k[0])) if len(names) == 1 else tint(k.tolist())) for k in known], float))
            return out[back.ravel()].reshape(*v.shape[:-1], 3)

        return Space(len(names), rgb, [1.0] * len(names))
    return None
