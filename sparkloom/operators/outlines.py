"""Outlines and tiles: polygon filling, quadtree summaries, brush coverage, lens distortion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def polygon_spans(edges: DataFrame, id_col: str, width: int, height: int) -> DataFrame:
    """(id, y, x_from, x_to): runs of cells whose centres lie inside a polygon by the even-odd rule.

    ``edges`` holds the sides of closed polygons as (id, x0, y0, x1, y1); a
    polygon may have several rings. A side meets the rows whose centre is in
    [lower y, upper y), crossings are paired in order, and a run takes the
    centres in [left, right). Runs are cut to the raster. Sides with a null
    are left out. The work is one row per side and raster row that it meets.
    """
    e = edges.select(F.col(id_col), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))).dropna()
    first, last = F.expr("greatest(ceil(least(y0, y1) - 0.5D), 0)"), F.least(F.expr("ceil(greatest(y0, y1) - 0.5D) - 1"), F.lit(height - 1))
    met = e.withColumn("f", first).withColumn("l", last).where("f <= l").select("*", F.explode(F.sequence("f", "l")).alias("y"))
    cross = met.select(id_col, "y", F.expr("x0 + (y + 0.5D - y0) * (x1 - x0) / (y1 - y0)").alias("x"))
    w = W.partitionBy(id_col, "y").orderBy("x")
    runs = cross.select(id_col, "y", F.col("x").alias("a"), F.lead("x").over(w).alias("b"), F.row_number().over(w).alias("r")).where("r % 2 = 1 AND b IS NOT NULL")
    cut = runs.select(id_col, F.col("y").cast("int").alias("y"), F.expr("greatest(ceil(a - 0.5D), 0)").cast("int").alias("x_from"), F.least(F.expr("ceil(b - 0.5D) - 1"), F.lit(width - 1)).cast("int").alias("x_to"))
    return cut.where("x_from <= x_to")


def quadtree(points: DataFrame, x: Column, y: Column, value: Column, depths: int, least: int) -> DataFrame:
    """(depth, tx, ty, n, mean): tiles of the unit square at depths 1 to ``depths`` with ``least`` values or more.

    Points are summed once in the deepest tiles, with a map-side combine, and
    only these bounded sums are rolled up. Points outside the square, and nulls, are left out.
    """
    side = 1 << depths
    p = points.select(F.floor(x * side).alias("tx"), F.floor(y * side).alias("ty"), value.cast("double").alias("v")).where(f"v IS NOT NULL AND tx BETWEEN 0 AND {side - 1} AND ty BETWEEN 0 AND {side - 1}")
    deep = p.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    up = deep.select(F.explode(F.sequence(F.lit(1), F.lit(depths))).alias("depth"), "tx", "ty", "n", "s")
    shrink = lambda c: F.expr(f"shiftright({c}, {depths} - depth)").cast("long").alias(c)
    tiles = up.select("depth", shrink("tx"), shrink("ty"), "n", "s").groupBy("depth", "tx", "ty").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return tiles.where(F.col("n") >= least).select("depth", "tx", "ty", "n", (F.col("s") / F.col("n")).alias("mean"))


def screen_coverage(dabs: DataFrame, keys: list[str], alpha: Column) -> DataFrame:
    """Coverage 1 - product(1 - alpha) of each cell, with alpha clamped to 0..1; a dab of 1 covers fully, null none."""
    a = F.least(F.greatest(F.coalesce(alpha.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    open_ = F.sum(F.when(a < 1, F.log1p(-a)))
    return dabs.groupBy(*keys).agg(F.when(F.max(a) >= 1, 1.0).otherwise(1 - F.exp(open_)).alias("coverage"))


def distort(r: Column, a: float, b: float) -> Column:
    """Radial polynomial r (1 + a r^2 + b r^4)."""
    return r * (1 + a * r * r + b * r * r * r * r)


def undistorted(points: DataFrame, r: str, a: float, b: float, steps: int = 6) -> DataFrame:
    """``points`` with ``undistorted``, the radius that `distort` maps to ``r``: Newton steps, each a column of its own.

    For small coefficients, as lenses have them; where the slope vanishes the result is null.
    """
    out = points.withColumn("undistorted", F.col(r).cast("double"))
    u = F.col("undistorted")
    for _ in range(steps):
        slope = 1 + 3 * a * u * u + 5 * b * u * u * u * u
        out = out.withColumn("undistorted", u - F.try_divide(distort(u, a, b) - F.col(r), slope))
    return out
