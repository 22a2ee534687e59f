"""Rasters as tables of cells (keys, y, x, value): blurs, edges, guided filters, shifts, splats, regions.

Rows and columns are window keys, so a raster is spread over its rows, and
many rasters over their keys. A frame reaches cells by coordinate: cells that
are missing are left out, not taken as zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.graph import connected_components


def _along(keys: list[str], line: str, order: str, lo: int, hi: int):
    return W.partitionBy(*keys, line).orderBy(order).rangeBetween(lo, hi)


def neighbour(keys: list[str], line: str, order: str, value: str, at: int) -> Column:
    """The value ``at`` cells further along a line, null if there is no such cell. (Cells are unique.)"""
    return F.max(value).over(_along(keys, line, order, at, at))


def gauss_taps(sigma: float, radius: int) -> list[float]:
    """Weights exp(-d*d / (2 sigma*sigma)) for d = -radius .. radius, before they are normalised."""
    return [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]


def convolve(cells: DataFrame, taps: list[float], keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Separable filter along rows, then columns; taps are renormalised over the cells that are there."""
    keys, radius = keys or [], len(taps) // 2
    for line, order in (("y", "x"), ("x", "y")):
        near = [(t, neighbour(keys, line, order, value, i - radius)) for i, t in enumerate(taps)]
        total = sum((F.coalesce(t * n, F.lit(0.0)) for t, n in near), F.lit(0.0))
        heard = sum((F.when(n.isNotNull(), t).otherwise(0.0) for t, n in near), F.lit(0.0))
        cells = cells.select(*keys, "y", "x", (total / F.when(heard > 0, heard)).alias(value))
    return cells


def sharpen(cells: DataFrame, sigma: float, radius: int, amount: float, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """value + amount * (value - its Gaussian blur); also the blur and the difference."""
    keys = keys or []
    soft = convolve(cells.select(*keys, "y", "x", value), gauss_taps(sigma, radius), keys, value).withColumnRenamed(value, "soft")
    high = F.col(value) - F.col("soft")
    return cells.join(soft, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col(value) + amount * high).alias("sharp"), "soft", high.alias("high"))


def detail(cells: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Size of the four-neighbour Laplacian and of the central-difference gradient; a missing neighbour is the cell itself."""
    keys = keys or []
    at = {n: F.coalesce(neighbour(keys, *axis, value, d), F.col(value)) for n, axis, d in (("l", ("y", "x"), -1), ("r", ("y", "x"), 1), ("u", ("x", "y"), -1), ("d", ("x", "y"), 1))}
    rows = cells.select(*keys, "y", "x", value, at["l"].alias("l"), at["r"].alias("r")).select("*", at["u"].alias("u"), at["d"].alias("d"))
    return rows.select(*keys, "y", "x", F.abs(F.expr(f"l + r + u + d - 4 * {value}")).alias("laplacian"), F.sqrt(F.expr("(r-l)*(r-l) + (d-u)*(d-u)")).alias("gradient"))


def _box(cells: DataFrame, keys: list[str], names: list[str], radius: int) -> DataFrame:
    """Means of several values over the square around each cell, in two windows."""
    across, down = _along(keys, "y", "x", -radius, radius), _along(keys, "x", "y", -radius, radius)
    rest = [c for c in cells.columns if c not in names]
    s = cells.select(*rest, *(F.sum(n).over(across).alias(n) for n in names), F.count("*").over(across).alias("__n"))
    n = F.sum("__n").over(down)
    return s.select(*rest, *((F.sum(c).over(down) / n).alias(c) for c in names))


def guided_filter(cells: DataFrame, radius: int, epsilon: float, keys: list[str] | None = None, guide: str = "guide", mask: str = "mask") -> DataFrame:
    """The mask as a local linear function of the guide: edges of the guide stay, the rest is smoothed.

    a = cov(guide, mask) / (var(guide) + epsilon) and b over squares of
    ``radius``, whose means give a guide + b. Cells need both values.
    """
    keys = keys or []
    i, p = F.col(guide).cast("double"), F.col(mask).cast("double")
    rows = cells.where(i.isNotNull() & p.isNotNull()).select(*keys, "y", "x", i.alias("g"), i.alias("i"), p.alias("p"), (i * i).alias("ii"), (i * p).alias("ip"))
    m = _box(rows, keys, ["i", "p", "ii", "ip"], radius)
    a = (F.col("ip") - F.col("i") * F.col("p")) / (F.col("ii") - F.col("i") * F.col("i") + epsilon)
    lines = m.select(*keys, "y", "x", "g", a.alias("a"), (F.col("p") - a * F.col("i")).alias("b"))
    return _box(lines, keys, ["a", "b"], radius).select(*keys, "y", "x", F.expr("a * g + b").alias("refined"))


def pyramid(cells: DataFrame, levels: int, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """(keys, level, y, x, value): means over 2x2 blocks, again and again; level 0 is the raster itself.

    Sums and counts are carried from level to level, so blocks that are cut
    by the edge keep the mean of their cells.
    """
    keys = keys or []
    level = cells.where(F.col(value).isNotNull()).select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("s"), F.lit(1).cast("long").alias("n"))
    every = [F.struct(F.lit(k).alias("level"), F.shiftright("y", k).alias("y"), F.shiftright("x", k).alias("x")) for k in range(levels + 1)]
    spread = level.select(*keys, F.explode(F.array(*every)).alias("at"), "s", "n")
    sums = spread.groupBy(*keys, "at.level", "at.y", "at.x").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select(*keys, "level", "y", "x", (F.col("s") / F.col("n")).alias(value))


def shift_correlations(a: DataFrame, b: DataFrame, reach: int, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """(keys, dy, dx, n, r): Pearson correlation of a at (y - dy, x - dx) with b at (y, x), for all shifts of up to ``reach``.

    Each cell of b meets (2 reach + 1)**2 cells of a, by equi-join; r is null
    where a side does not vary.
    """
    keys = keys or []
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    moved = a.select(*keys, "y", "x", F.col(value).cast("double").alias("p"), F.explode(steps).alias("dy")).select("*", F.explode(steps).alias("dx"))
    moved = moved.select(*keys, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "p", "dy", "dx")
    pairs = moved.join(b.select(*keys, "y", "x", F.col(value).cast("double").alias("q")), [*keys, "y", "x"])
    flat = (F.stddev_pop("p") > 0) & (F.stddev_pop("q") > 0)
    return pairs.groupBy(*keys, "dy", "dx").agg(F.count("*").alias("n"), F.when(flat, F.covar_pop("p", "q") / (F.stddev_pop("p") * F.stddev_pop("q"))).alias("r"))


def splat(points: DataFrame, y: Column, x: Column, value: Column, weight: Column, keys: list[str] | None = None) -> DataFrame:
    """Spread weighted points over the four vertices around them, bilinearly: (keys, y, x, mass, mean).

    Vertices that get no weight are left out. Partial sums are made before the shuffle.
    """
    keys = keys or []
    rows = points.select(*keys, y.cast("double").alias("fy"), x.cast("double").alias("fx"), value.cast("double").alias("v"), weight.cast("double").alias("w")).where("w > 0 AND fy IS NOT NULL AND fx IS NOT NULL AND v IS NOT NULL")
    corner = lambda j, i: F.struct(
        (F.floor("fy") + j).alias("y"), (F.floor("fx") + i).alias("x"), (F.expr(f"{'' if j else '1 - '}(fy - floor(fy))") * F.expr(f"{'' if i else '1 - '}(fx - floor(fx))") * F.col("w")).alias("w")
    )
    spread = rows.select(*keys, "v", F.explode(F.array(*(corner(j, i) for j in (0, 1) for i in (0, 1)))).alias("c")).where("c.w > 0")
    return spread.groupBy(*keys, "c.y", "c.x").agg(F.sum("c.w").alias("mass"), (F.sum(F.expr("c.w * v")) / F.sum("c.w")).alias("mean"))


def sample_bilinear(points: DataFrame, cells: DataFrame, id_col: str, y: Column, x: Column, value: str = "value") -> DataFrame:
    """(id, value): the raster read between its cells; cells that are missing are left out of the mean.

    Points meet the cells at their four corners by equi-join.
    """
    p = points.select(F.col(id_col), y.cast("double").alias("fy"), x.cast("double").alias("fx"))
    corners = F.array(*(F.struct((F.floor("fy") + j).alias("y"), (F.floor("fx") + i).alias("x")) for j in (0, 1) for i in (0, 1)))
    near = p.select(id_col, "fy", "fx", F.explode(corners).alias("c")).select(id_col, F.expr("(1 - abs(c.y - fy)) * (1 - abs(c.x - fx))").alias("w"), "c.y", "c.x").where("w > 0")
    met = near.join(cells.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("v")), ["y", "x"])
    return met.groupBy(id_col).agg((F.sum(F.expr("w * v")) / F.sum("w")).alias(value))


def regions(cells: DataFrame, label: Column) -> DataFrame:
    """(y, x, label, region): connected parts of cells that touch along an edge and have one label; null labels are no cells.

    ``region`` is the smallest y * 2**32 + x of the part; y and x are whole
    numbers from 0 to 2**31 - 1.
    """
    rows = cells.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), label.alias("label")).where("label IS NOT NULL")
    rows = rows.withColumn("id", F.shiftleft("y", 32) + F.col("x"))
    edges = None
    for line, order in (("y", "x"), ("x", "y")):
        w = W.partitionBy(line).orderBy(order).rangeBetween(1, 1)
        touch = rows.select("id", "label", F.max(F.struct("id", "label")).over(w).alias("next"))
        touch = touch.select(F.col("id").alias("a"), F.when(F.col("next.label") == F.col("label"), F.col("next.id")).otherwise(F.col("id")).alias("b"))
        edges = touch if edges is None else edges.union(touch)
    found = connected_components(edges, "a", "b")
    return rows.join(found, rows["id"] == found["node"]).select("y", "x", rows["label"], found["label"].alias("region"))
