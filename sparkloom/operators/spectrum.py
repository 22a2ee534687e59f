"""Discrete Fourier transforms of long series and of rasters, and the shift of two rasters by phase correlation.

A series of n = columns * rows points is transformed in two passes of short
transforms with a twiddle between them, so no task holds a whole series: about
sqrt(n) points are transformed at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def butterflies(z: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Unscaled transform along the last axis: halves are transformed and joined while lengths are even, the rest by definition."""
    n = z.shape[-1]
    turn = 2j * np.pi * (1 if inverse else -1)
    if n % 2 or n <= 2:
        at = np.arange(n)
        return z @ np.exp(turn * (np.outer(at, at) % n) / max(1, n))
    even, odd = butterflies(z[..., ::2], inverse), butterflies(z[..., 1::2], inverse)
    odd = odd * np.exp(turn * np.arange(n // 2) / n)
    return np.concatenate([even + odd, even - odd], axis=-1)


def _factors(n: int) -> tuple[int, int]:
    """The two factors of n nearest its root."""
    small = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    return small, n // small


def _lines(df: DataFrame, line: list[str], at: str, re: str, im: str, n: int, inverse: bool) -> DataFrame:
    """The transform of each line of at most ``n`` points, by place ``at`` (missing points are zero)."""
    schema = df.select(*line, at, re, im).schema

    def run(key: tuple, t: pa.Table) -> pa.Table:
        z = np.zeros(n, dtype=complex)
        np.add.at(z, t[at].to_numpy(), t[re].to_numpy() + 1j * t[im].to_numpy())
        z = butterflies(z, inverse)
        columns = [pa.array([k.as_py()] * n, k.type) for k in key]
        return pa.Table.from_arrays([*columns, pa.array(np.arange(n)), pa.array(z.real.copy()), pa.array(z.imag.copy())], names=[*line, at, re, im])

    return df.select(*line, at, re, im).groupBy(*line).applyInArrow(run, schema)


def fourier(df: DataFrame, n: int, keys: list[str], at: str = "at", re: str = "re", im: str = "im", inverse: bool = False) -> DataFrame:
    """(keys, at, re, im): the transform of each series over 0 .. n - 1; the inverse is scaled by 1 / n.

    Missing places and null values are zero, repeated places add up, places
    outside are left out; a key without places has no row.
    """
    rows = df.where((F.col(at) >= 0) & (F.col(at) < n)).select(*keys, F.col(at).cast("long").alias("__at"), F.coalesce(F.col(re).cast("double"), F.lit(0.0)).alias("re"), F.coalesce(F.col(im).cast("double"), F.lit(0.0)).alias("im"))
    a, b = _factors(n)  # place = a_at * b + b_at, frequency = a_k + a * b_k
    rows = rows.select(*keys, (F.col("__at") % b).alias("b_at"), F.floor(F.col("__at") / b).cast("long").alias("a_at"), "re", "im")
    rows = _lines(rows, [*keys, "b_at"], "a_at", "re", "im", a, inverse)
    angle = (F.lit(1 if inverse else -1) * 2 * math.pi / n) * (F.col("a_at") * F.col("b_at"))
    turned = rows.select(*keys, F.col("a_at").alias("a_k"), "b_at", (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im"))
    rows = _lines(turned, [*keys, "a_k"], "b_at", "re", "im", b, inverse)
    scale = F.lit(1 / n if inverse else 1.0)
    return rows.select(*keys, (F.col("a_k") + a * F.col("b_at")).alias(at), (F.col("re") * scale).alias(re), (F.col("im") * scale).alias(im))


def fourier_2d(cells: DataFrame, h: int, w: int, keys: list[str], re: str = "re", im: str = "im", inverse: bool = False) -> DataFrame:
    """(keys, y, x, re, im): rows, then columns."""
    rows = fourier(cells, w, [*keys, "y"], "x", re, im, inverse)
    return fourier(rows, h, [*keys, "x"], "y", re, im, inverse).select(*keys, "y", "x", re, im)


def phase_correlation(pairs: DataFrame, h: int, w: int, keys: list[str], a: Column, b: Column) -> DataFrame:
    """(keys, peak, dy, dx): where the phase correlation of two rasters is highest, and its height.

    ``a`` at (y + dy, x + dx) is ``b`` at (y, x), round the edges; the peak is 1
    for a pure shift and falls as the rasters differ. Of equal peaks the first
    by rows is taken. Both rasters are transformed at once, as the real and the
    imaginary part of one: their spectra are told apart by symmetry.
    """
    z = fourier_2d(pairs.select(*keys, "y", "x", a.cast("double").alias("re"), b.cast("double").alias("im")), h, w, keys)
    there = z.select(*keys, F.pmod(-F.col("y"), F.lit(h)).alias("y"), F.pmod(-F.col("x"), F.lit(w)).alias("x"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = z.join(there, [*keys, "y", "x"])
    spectra = both.select(*keys, "y", "x", *(F.expr(f"({e}) / 2").alias(n) for n, e in (("ar", "re + re2"), ("ai", "im - im2"), ("br", "im + im2"), ("bi", "re2 - re"))))
    cross = spectra.select(*keys, "y", "x", F.expr("ar * br + ai * bi").alias("re"), F.expr("ai * br - ar * bi").alias("im"))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) + 1e-9
    found = fourier_2d(cross.select(*keys, "y", "x", (F.col("re") / size).alias("re"), (F.col("im") / size).alias("im")), h, w, keys, inverse=True)
    best = found.groupBy(*keys).agg(F.max_by(F.struct("re", "y", "x"), F.struct("re", -F.col("y"), -F.col("x"))).alias("m"))
    wrap = lambda v, n: F.when(v < n / 2, v).otherwise(v - n).cast("long")
    return best.select(*keys, F.col("m.re").alias("peak"), wrap(F.col("m.y"), h).alias("dy"), wrap(F.col("m.x"), w).alias("dx"))
