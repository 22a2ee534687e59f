"""Scalar expressions: soft predicates, circular values, curves and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hue band centres in degrees and tone knots.
HUE_CENTRES = (0, 30, 60, 120, 180, 240, 270, 300)
TONE_KNOTS = (0.0, 0.10, 0.25, 0.50, 0.66, 0.82, 0.92, 1.0)
#: Luma weights.
LUMA = (0.299, 0.587, 0.114)


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def circular_diff(a: Column, b: Column) -> Column:
    """Difference of two angles in degrees, wrapped to (-180, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def trapezoid(x: Column, lo_outer: float, lo: float, hi: float, hi_outer: float) -> Column:
    """Weight 1 on [lo, hi], falling linearly to 0 at the outer ends; a side without width is a step."""
    up = F.when(x < lo, 0.0 if lo <= lo_outer else F.greatest((x - lo_outer) / (lo - lo_outer), F.lit(0.0)))
    down = F.when(x > hi, 0.0 if hi_outer <= hi else F.greatest((hi_outer - x) / (hi_outer - hi), F.lit(0.0)))
    return F.when(x.isNull(), None).otherwise(F.coalesce(up, down, F.lit(1.0)))


def mask_fold(parts: list[tuple[str, Column]]) -> Column:
    """Fold components into one weight, from 0: add 1-(1-w)(1-c), subtract w(1-c), intersect w c."""
    rules = {"add": lambda w, c: 1 - (1 - w) * (1 - c), "subtract": lambda w, c: w * (1 - c), "intersect": lambda w, c: w * c}
    return reduce(lambda w, p: rules[p[0]](w, p[1]), parts, F.lit(0.0))


def hue_band(hue: Column) -> Column:
    """Index of the nearest centre at or below the hue (0 to 7), hue taken modulo 360."""
    h = F.pmod(hue, F.lit(360.0))
    return reduce(lambda acc, ic: F.when(h >= ic[1], ic[0]).otherwise(acc), enumerate(HUE_CENTRES), F.lit(0))


def piecewise(x: Column, xs: tuple[float, ...], ys: tuple[float, ...]) -> Column:
    """Linear interpolation through knots, flat beyond the ends."""
    out = F.lit(float(ys[-1]))
    for x0, x1, y0, y1 in reversed(list(zip(xs, xs[1:], ys, ys[1:]))):
        out = F.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x.isNull(), None).when(x <= xs[0], float(ys[0])).otherwise(out)
