"""Matrices (structs a to f, row vectors) and boxes (x0, y0, x1, y1) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M, _B = "abcdef", ("x0", "y0", "x1", "y1")


def matrix(*v) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(k) for k, x in zip(_M, v, strict=True)])


def concat(m: Column, n: Column) -> Column:
    """m first, then n."""
    g, h = (lambda k: m[k]), (lambda k: n[k])
    return matrix(
        g("a") * h("a") + g("b") * h("c"), g("a") * h("b") + g("b") * h("d"), g("c") * h("a") + g("d") * h("c"), g("c") * h("b") + g("d") * h("d"),
        g("e") * h("a") + g("f") * h("c") + h("e"), g("e") * h("b") + g("f") * h("d") + h("f"),
    )


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def invert(m: Column) -> Column:
    """Null where it is singular."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    a, b, c, d = (F.try_divide(v, det) for v in (m["d"], -m["b"], -m["c"], m["a"]))
    return F.when(det != 0, matrix(a, b, c, d, -(m["e"] * a + m["f"] * c), -(m["e"] * b + m["f"] * d)))


def box(*v: Column) -> Column:
    return F.struct(*[x.cast("double").alias(k) for k, x in zip(_B, v, strict=True)])


def intersect(p: Column, q: Column) -> Column:
    x0, y0, x1, y1 = F.greatest(p["x0"], q["x0"]), F.greatest(p["y0"], q["y0"]), F.least(p["x1"], q["x1"]), F.least(p["y1"], q["y1"])
    return F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1))


def union(p: Column, q: Column) -> Column:
    return box(F.least(p["x0"], q["x0"]), F.least(p["y0"], q["y0"]), F.greatest(p["x1"], q["x1"]), F.greatest(p["y1"], q["y1"]))


def transform(m: Column, b: Column) -> Column:
    """The box round the four moved corners."""
    pts = [apply(m, b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    return box(F.least(*[p[0] for p in pts]), F.least(*[p[1] for p in pts]), F.greatest(*[p[0] for p in pts]), F.greatest(*[p[1] for p in pts]))


def rotation(turn: Column) -> Column:
    """Degrees modulo 360; 0 for what is no multiple of 90."""
    r = F.pmod(turn, F.lit(360))
    return F.when(r % 90 == 0, r).otherwise(0).cast("int")
