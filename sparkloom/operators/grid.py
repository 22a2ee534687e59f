"""Neighbourhood operators on a table of cells (y, x, value), as sliding windows per row and column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def box_mean(cells: DataFrame, y: str, x: str, value: str, radius: int) -> DataFrame:
    """Mean over the square around each present cell, by sums along rows and then columns."""
    along = W.partitionBy(y).orderBy(x).rangeBetween(-radius, radius)
    down = W.partitionBy(x).orderBy(y).rangeBetween(-radius, radius)
    s = cells.select(y, x, F.sum(value).over(along).alias("s"), F.count(value).over(along).alias("n"))
    return s.select(y, x, (F.sum("s").over(down) / F.sum("n").over(down)).alias("mean"))


def dilate(cells: DataFrame, y: str, x: str, value: str, radius: int) -> DataFrame:
    """Maximum over the square around each cell; exact where every row holds the same columns."""
    along = W.partitionBy(y).orderBy(x).rangeBetween(-radius, radius)
    down = W.partitionBy(x).orderBy(y).rangeBetween(-radius, radius)
    return cells.select(y, x, F.max(value).over(along).alias("m")).select(y, x, F.max("m").over(down).alias("dilated"))


def block_means(cells: DataFrame, y: str, x: str, value: str, side: int) -> DataFrame:
    """Mean per block of side x side cells; one aggregation."""
    block = lambda c: F.floor(F.col(c) / side).cast("long")
    return cells.groupBy(block(y).alias("by"), block(x).alias("bx")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def spread(cells: DataFrame, keys: list[str], value: str, radius: int, least: bool) -> DataFrame:
    """(keys, y, x, spread): the least (or largest) value in the square around each cell, over the cells that are there.

    Exact for grids with gaps: a cell first reaches the columns around it, also
    where its own row has no cell (combined before the shuffle), then columns
    are scanned. The work grows with the radius, not with its square. Null
    values are gaps that get a result; it is null where nothing is near.
    """
    pick = F.min if least else F.max
    here = cells.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).alias("v"))
    wide = here.where("v IS NOT NULL").select(*keys, "y", F.explode(F.sequence(F.col("x") - radius, F.col("x") + radius)).alias("x"), "v", F.lit(False).alias("own"))
    rows = wide.unionByName(here.select(*keys, "y", "x", F.lit(None).cast(here.schema["v"].dataType).alias("v"), F.lit(True).alias("own")))
    rows = rows.groupBy(*keys, "y", "x").agg(pick("v").alias("v"), F.max("own").alias("own"))
    down = W.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    return rows.select(*keys, "y", "x", "own", pick("v").over(down).alias("spread")).where("own").drop("own")


def morph(mask: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    """(keys, y, x, spread): the mask grown by ``radius`` cells, or shrunk for a negative one; squares are cut at the edges."""
    return spread(mask, keys, value, abs(radius), radius < 0)
