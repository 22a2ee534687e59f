"""Image pyramids as tables of cells: reduce and expand, Laplacian bands, weighted blends, and the fill of unknown cells.

A raster is a full grid (keys, y, x, value) from (0, 0); its height and width
travel along, for odd edges are cut. All rasters of the keys have one size.
Levels are written tables, so a blend reads each level once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import raster
from sparkloom.staging import materialize

#: A level of a pyramid: its cells, height and width.
Level = tuple[DataFrame, int, int]
#: Levels are not reduced further when a side is shorter.
LEAST_SIDE = 8


def reduce(level: Level, keys: list[str], value: str = "value") -> Level:
    """Half the size: a Gaussian of one cell, then means of 2x2 cells; an odd last row or column is left out."""
    cells, h, w = level
    nh, nw = max(h // 2, 1), max(w // 2, 1)
    soft = raster.convolve(cells.select(*keys, "y", "x", value), raster.gauss_taps(1.0, 3), keys, value)
    y, x = F.floor(F.col("y") / 2).cast("long"), F.floor(F.col("x") / 2).cast("long")
    out = soft.where((y < nh) & (x < nw)).groupBy(*keys, y.alias("y"), x.alias("x")).agg(F.avg(value).alias(value))
    return materialize(out, "level"), nh, nw


def read_between(coarse: Level, fine: DataFrame, keys: list[str], at: Callable[[Column], Column], value: str = "value", name: str = "up") -> DataFrame:
    """``fine`` with ``name``: the coarse level read bilinearly at ``at`` of each coordinate, clamped to its edges."""
    cells, h, w = coarse

    def ends(c: str, n: int) -> Column:
        p = F.least(F.greatest(at(F.col(c)), F.lit(0.0)), F.lit(float(n - 1)))
        low = F.floor(p).cast("long")
        return F.array(F.struct(low.alias("p"), (1 - (p - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("p"), (p - low).alias("w")))

    spread = fine.select(*keys, "y", "x", F.explode(ends("y", h)).alias("cy"), ends("x", w).alias("cxs")).select(*keys, "y", "x", "cy", F.explode("cxs").alias("cx")).where("cy.w * cx.w > 0")
    spread = spread.select(*keys, F.col("y").alias("fy"), F.col("x").alias("fx"), F.col("cy.p").alias("y"), F.col("cx.p").alias("x"), F.expr("cy.w * cx.w").alias("w"))
    up = spread.join(cells.select(*keys, "y", "x", F.col(value).alias("__v")), [*keys, "y", "x"]).groupBy(*keys, F.col("fy").alias("y"), F.col("fx").alias("x")).agg(F.sum(F.expr("w * __v")).alias(name))
    return fine.join(up, [*keys, "y", "x"], "left")


def _half(c: Column) -> Column:
    """A cell of a reduced level lies between two cells of the level below: its centre is at 2x + 0.5."""
    return (c - 0.5) * 0.5


def gaussian(cells: DataFrame, h: int, w: int, levels: int, keys: list[str], value: str = "value") -> list[Level]:
    """The raster and up to ``levels - 1`` reduced ones, none from a level with a side under `LEAST_SIDE`."""
    out = [(materialize(cells.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias(value)), "level"), h, w)]
    while len(out) < levels and min(out[-1][1:]) >= LEAST_SIDE:
        out.append(reduce(out[-1], keys, value))
    return out


def laplacian(pyramid: list[Level], keys: list[str], value: str = "value") -> list[Level]:
    """Each level less the next one expanded to it; the coarsest as it is."""
    out = []
    for level, above in zip(pyramid, pyramid[1:]):
        up = read_between(above, level[0], keys, _half, value)
        out.append((materialize(up.select(*keys, "y", "x", (F.col(value) - F.col("up")).alias(value)), "band"), *level[1:]))
    return [*out, pyramid[-1]]


def collapse(bands: list[Level], keys: list[str], value: str = "value") -> DataFrame:
    """The raster whose bands these are: the exact inverse of `laplacian`."""
    whole = bands[-1]
    for band in bands[-2::-1]:
        up = read_between(whole, band[0], keys, _half, value)
        whole = (materialize(up.select(*keys, "y", "x", (F.col(value) + F.col("up")).alias(value)), "band"), *band[1:])
    return whole[0]


def blend(frames: DataFrame, h: int, w: int, levels: int, frame: str = "frame", value: str = "value", weight: str = "weight", keys: list[str] | None = None) -> DataFrame:
    """(keys, y, x, value): frames mixed band by band, each band by weights as soft as the band.

    ``frames`` has a row for every cell of every frame. Weights are normalised
    per cell; negative and null ones are zero, and where all are zero the frame
    of the smallest number counts alone.
    """
    keys = keys or []
    rows = frames.select(*keys, frame, "y", "x", F.col(value).cast("double").alias("value"), F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = rows.groupBy(*keys, "y", "x").agg(F.sum("weight").alias("__sum"), F.min(frame).alias("__first"))
    share = F.when(F.col("__sum") > 1e-12, F.col("weight") / F.col("__sum")).otherwise((F.col(frame) == F.col("__first")).cast("double"))
    rows = materialize(rows.join(total, [*keys, "y", "x"]).select(*keys, frame, "y", "x", "value", share.alias("weight")), "frames")
    each = [*keys, frame]
    soft = gaussian(rows, h, w, levels, each, "weight")
    sharp = laplacian(gaussian(rows, h, w, len(soft), each), each)
    mixed = []
    for (band, bh, bw), (share_of, *_) in zip(sharp, soft):
        out = band.join(share_of, [*each, "y", "x"]).groupBy(*keys, "y", "x").agg(F.sum(F.expr("value * weight")).alias("value"))
        mixed.append((materialize(out, "mixed"), bh, bw))
    return collapse(mixed, keys)


def fill(cells: DataFrame, h: int, w: int, values: list[str], known: str = "known", keys: list[str] | None = None) -> DataFrame:
    """Unknown cells of a full grid from known ones: weighted means on ever coarser grids, then back down.

    ``known`` is the confidence of a cell, from 0 to 1 (null: 0); null values
    have none. A cell keeps its values in proportion to it and takes the rest
    from the coarser level, read bilinearly. Without any known cell all are
    null. The grids shrink to one cell in about log2 of the longer side rounds.
    """
    keys = keys or []
    has = [F.col(v).isNotNull() for v in values]
    sure = F.least(F.greatest(F.coalesce(F.col(known).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    sure = F.when(has[0] if len(has) == 1 else F.expr(" AND ".join(f"`{v}` IS NOT NULL" for v in values)), sure).otherwise(0.0)
    level = cells.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *(F.when(sure > 0, F.col(v).cast("double")).alias(v) for v in values), sure.alias("known"))
    levels: list[Level] = [(materialize(level, "grid"), h, w)]
    while h > 1 or w > 1:
        h, w = -(-h // 2), -(-w // 2)
        y, x = (F.floor(F.col(c) / 2).cast("long").alias(c) for c in ("y", "x"))
        sums = levels[-1][0].groupBy(*keys, y, x).agg(*(F.sum(F.col(v) * F.col("known")).alias(v) for v in values), F.sum("known").alias("known"))
        out = sums.select(*keys, "y", "x", *(F.when(F.col("known") > 0, F.col(v) / F.col("known")).alias(v) for v in values), F.least("known", F.lit(1.0)).alias("known"))
        levels.append((materialize(out, "grid"), h, w))
    whole = levels[-1]
    for grid, gh, gw in levels[-2::-1]:
        out = grid
        for v in values:
            out = read_between((whole[0].where(F.col(v).isNotNull()), *whole[1:]), out, keys, lambda c: (c + 0.5) / 2 - 0.5, v, f"{v}__up")
        mix = (F.when(F.col("known") >= 1, F.col(v)).otherwise(F.coalesce(F.col("known") * F.col(v), F.lit(0.0)) + (1 - F.col("known")) * F.col(f"{v}__up")).alias(v) for v in values)
        whole = (materialize(out.select(*keys, "y", "x", *mix, "known"), "grid"), gh, gw)
    return whole[0].select(*keys, "y", "x", *values)


def structural_similarity(pairs: DataFrame, keys: list[str], a: str, b: str, sigma: float = 1.5, radius: int = 5) -> DataFrame:
    """(keys, ssim): mean over all cells of the structural similarity of two rasters with values in 0 .. 1.

    First and second moments of both are taken together under a Gaussian, in
    two windows; at the edges it is renormalised over the cells that are there.
    """
    taps = raster.gauss_taps(sigma, radius)
    names = ["a", "b", "aa", "bb", "ab"]
    p, q = F.col(a).cast("double"), F.col(b).cast("double")
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, "y", "x", p.alias("a"), q.alias("b"), (p * p).alias("aa"), (q * q).alias("bb"), (p * q).alias("ab"))
    for line, order in (("y", "x"), ("x", "y")):
        near = {n: [raster.neighbour(keys, line, order, n, i - radius) for i in range(len(taps))] for n in names}
        heard = sum((F.when(c.isNotNull(), t).otherwise(0.0) for t, c in zip(taps, near["a"])), F.lit(0.0))
        rows = rows.select(*keys, "y", "x", *((sum((F.coalesce(t * c, F.lit(0.0)) for t, c in zip(taps, near[n])), F.lit(0.0)) / heard).alias(n) for n in names))
    s = F.expr(f"((2*a*b + {0.01**2}) * (2*(ab - a*b) + {0.03**2})) / ((a*a + b*b + {0.01**2}) * ((aa - a*a) + (bb - b*b) + {0.03**2}))")
    return rows.groupBy(*keys).agg(F.avg(s).alias("ssim"))
