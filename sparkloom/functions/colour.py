"""Colour expressions: transfer curve, CIE Lab, hue, saturation, soft hue bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.curves import HUE_CENTRES

#: sRGB to XYZ under D65, the white point, and the bounds of the Lab curve.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LAB_BOUND, LAB_SLOPE = 216 / 24389, 24389 / 27


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def cie_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L*, a*, b* of display sRGB values in 0 .. 1."""
    linear = [srgb_to_linear(v) for v in (r, g, b)]
    curve = lambda t: F.when(t > LAB_BOUND, F.cbrt(t)).otherwise((LAB_SLOPE * t + 16) / 116)
    x, y, z = (curve(sum(m * v for m, v in zip(row, linear)) / w) for row, w in zip(TO_XYZ, WHITE))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of two Lab colours (1976)."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, 0 to 360; 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    c = top - low
    h = F.when(top == r, F.pmod((g - b) / c, F.lit(6.0))).when(top == g, (b - r) / c + 2).otherwise((r - g) / c + 4)
    return F.when(c == 0, 0.0).otherwise(60 * h)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Standard deviation of the three channels."""
    m = (r + g + b) / 3
    return F.sqrt(((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3)


def well_exposed(v: Column, sigma: float = 0.2) -> Column:
    """exp(-(v - 0.5)**2 / (2 sigma**2))."""
    return F.exp(-(v - 0.5) * (v - 0.5) / (2 * sigma * sigma))


def band_shares(degrees: Column) -> Column:
    """Array of (band, share): a hue belongs to the centres on both sides of it, by nearness; shares add up to 1."""
    h = F.pmod(degrees, F.lit(360.0))
    ends = (*HUE_CENTRES, 360)
    out = F.lit(None).cast("array<struct<band:int,share:double>>")
    for i in range(len(HUE_CENTRES)):
        part = (h - ends[i]) / (ends[i + 1] - ends[i])
        pair = F.array(F.struct(F.lit(i).alias("band"), (1 - part).alias("share")), F.struct(F.lit((i + 1) % len(HUE_CENTRES)).alias("band"), part.alias("share")))
        out = F.when((h >= ends[i]) & (h < ends[i + 1]), pair).otherwise(out)
    return out


def to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness; greys have hue and saturation 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = 1 - F.abs(top + low - 1)
    return hue(r, g, b), F.when((top > low) & (span > 0), (top - low) / span).otherwise(0.0), (top + low) / 2


def from_hsl(h: Column, s: Column, l: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Red, green and blue of `to_hsl`."""
    a = s * F.least(l, 1 - l)

    def channel(n: int) -> Column:
        k = F.pmod(n + h / 30, F.lit(12.0))
        return l - a * F.greatest(F.least(k - 3, 9 - k, F.lit(1.0)), F.lit(-1.0))

    return channel(0), channel(8), channel(4)


def more_colour(r: Column, g: Column, b: Column, amount: Column | float) -> tuple[Column, Column, Column]:
    """Channels moved away from (or, below 0, towards) the luma by 1 + amount, and clamped to 0 .. 1; -1 gives greys."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    move = lambda v: F.least(F.greatest(y + (v - y) * (1 + amount), F.lit(0.0)), F.lit(1.0))
    return move(r), move(g), move(b)
