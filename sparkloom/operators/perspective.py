"""Vanishing points of rasters: edges vote as lines of two families, whose second moments are summed by one aggregation a pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import raster
from sparkloom.staging import materialize, size_checked

#: Least gradient of an edge, tangent of the cone about an axis, the residual at which a line counts half, how clearly a point must stand out, and lines at least.
LEAST_GRADIENT, CONE_TANGENT, REJECT_SCALE, SEPARATION, LEAST_LINES = 0.05, 0.4663076581549986, 0.02, 8.0, 2000
_MOMENTS = ("aa", "ab", "ac", "bb", "bc", "cc")


def lines(cells: DataFrame, h: int, w: int, keys: list[str], value: str = "value", stride: int = 2) -> DataFrame:
    """(keys, y, x, family, a, b, c, size, c2, s2): the line a u + b v + c = 0 through each edge cell, in coordinates -0.5 .. 0.5.

    Cells on odd coordinates, counted by ``stride`` from 1, with four
    neighbours and a gradient of at least `LEAST_GRADIENT` per unit vote; the
    family is V for edges within the cone about the vertical, H about the
    horizontal. (c2, s2) is twice the edge's angle on the circle.
    """
    near = {n: raster.neighbour(keys, *axis, value, d) for n, axis, d in (("l", ("y", "x"), -1), ("r", ("y", "x"), 1), ("u", ("x", "y"), -1), ("d", ("x", "y"), 1))}
    rows = cells.select(*keys, "y", "x", *(c.alias(n) for n, c in near.items())).where(f"(y - 1) % {stride} = 0 AND (x - 1) % {stride} = 0 AND l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL")
    dw, dh = max(w - 1, 1), max(h - 1, 1)
    rows = rows.select(*keys, "y", "x", ((F.col("r") - F.col("l")) * 0.5 * dw).alias("a"), ((F.col("d") - F.col("u")) * 0.5 * dh).alias("b"), (F.col("x") / dw - 0.5).alias("p"), (F.col("y") / dh - 0.5).alias("q"))
    rows = rows.withColumn("size", F.sqrt(F.expr("a * a + b * b"))).where(F.col("size") >= LEAST_GRADIENT)
    family = F.when(F.abs("b") <= F.abs("a") * CONE_TANGENT, "V").when(F.abs("a") <= F.abs("b") * CONE_TANGENT, "H")
    rows = rows.select(*keys, "y", "x", family.alias("family"), "a", "b", F.expr("-(a * p + b * q)").alias("c"), "size").where("family IS NOT NULL")
    return rows.select("*", F.expr("(b * b - a * a) / (size * size)").alias("c2"), F.expr("-2 * a * b / (size * size)").alias("s2"))


def moments(votes: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """(keys, family, n, aa .. cc, c2, s2): sums of a family's lines, combined on the map side."""
    sums = [F.sum(weight * F.col(m[0]) * F.col(m[1])).alias(m) for m in _MOMENTS]
    return votes.groupBy(*keys, "family").agg(F.count("*").alias("n"), *sums, F.sum(weight * F.col("c2")).alias("c2"), F.sum(weight * F.col("s2")).alias("s2"))


def _points(sums: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, family, n, angle, pa, pb, pc): the direction nearest all lines as a homogeneous point, null where it does not stand out."""
    wanted = [*keys, "family", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _MOMENTS], dtype=float).T
            full = m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(full) if len(full) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            n, c2, s2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n", "c2", "s2"))
            clear = (n >= least) & (values[:, 1] >= SEPARATION * np.abs(values[:, 0])) & (values[:, 2] > 0)
            point = vectors[:, :, 0] * np.where(vectors[:, 2:, 0] < 0, -1, 1)
            out = [batch.column(batch.schema.get_field_index(c)) for c in wanted]
            out += [pa.array(0.5 * np.arctan2(s2, c2)), *(pa.array(np.where(clear, point[:, i], np.nan), from_pandas=True) for i in range(3))]
            yield pa.RecordBatch.from_arrays(out, names=[*wanted, "angle", "pa", "pb", "pc"])

    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInArrow(run, f"{kinds + ', ' if keys else ''}family string, n long, angle double, pa double, pb double, pc double")


def vanishing_points(cells: DataFrame, h: int, w: int, keys: list[str], value: str = "value", stride: int = 2, least: int = LEAST_LINES) -> DataFrame:
    """(keys, family, n, angle, pa, pb, pc): for each raster and family the point in which its lines meet, pa : pb : pc with pc of 0 at infinity, and the mean angle of its edges.

    A first pass weighs lines by their gradient; the second one damps those
    that miss the first answer. The point is null for fewer than ``least`` lines
    and where the lines do not agree on one.
    """
    votes = materialize(lines(cells, h, w, keys, value, stride), "lines")
    first = materialize(_points(moments(votes, keys, F.col("size")), keys, least).select(*keys, "family", "pa", "pb", "pc"), "points")
    miss = F.expr("a * pa + b * pb + c * pc") / REJECT_SCALE
    weight = F.col("size") / F.coalesce(1 + miss * miss, F.lit(1.0))
    return _points(moments(votes.join(size_checked(first, 64), [*keys, "family"]), keys, weight), keys, least)
