"""Affine registration of pairs of rasters: robust Gauss-Newton steps, from coarse levels to fine ones.

Pairs are keys of one table, so many are aligned at once. The normal equations
of a step are sums, made by one aggregation over the cells of all pairs; only
the parameters (seven numbers a pair) go from step to step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import bands, ranks, raster
from sparkloom.staging import BROADCAST_BYTES, materialize, scratch

#: Steps at each level; a level with a side under this many cells finds a shift only; fewer cells in view end a search.
STEPS, LINEAR_SIDE, LEAST_CELLS = 8, 64, 64
#: The scale of residuals is this many times their median size, and at least the second number.
SPREADS, LEAST_SCALE = 3.0, 1e-4
#: x' = x + a (x - cx) + b (y - cy) + c, y' = y + d (x - cx) + e (y - cy) + f, and an offset g between the rasters' levels.
NAMES = "abcdefg"
#: Of a pair's parameters and sums, at most.
PAIR_BYTES = 1024


def patches(cells: DataFrame, h: int, w: int, keys: list[str], value: str = "value") -> DataFrame:
    """Every cell with the values and central differences at its four corners (y, x) .. (y + 1, x + 1), so that one equi-join reads them bilinearly."""
    near = {n: F.coalesce(raster.neighbour(keys, *axis, value, d), F.col(value)) for n, axis, d in (("l", ("y", "x"), -1), ("r", ("y", "x"), 1), ("u", ("x", "y"), -1), ("d", ("x", "y"), 1))}
    rows = cells.select(*keys, "y", "x", F.col(value).alias("v"), near["l"].alias("l"), near["r"].alias("r")).join(cells.select(*keys, "y", "x", near["u"].alias("u"), near["d"].alias("d")), [*keys, "y", "x"])
    rows = rows.select(*keys, "y", "x", F.struct("v", ((F.col("r") - F.col("l")) / 2).alias("gx"), ((F.col("d") - F.col("u")) / 2).alias("gy")).alias("p00"))
    right = rows.select("*", raster.neighbour(keys, "y", "x", "p00", 1).alias("p01"))
    return right.select("*", *(raster.neighbour(keys, "x", "y", n, 1).alias(m) for n, m in (("p00", "p10"), ("p01", "p11")))).select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), "p00", "p01", "p10", "p11")


def _by_pair(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    """Joined with a row for each pair, which is broadcast where the pairs are few (they were counted)."""
    return rows.join(F.broadcast(table) if small else table, keys, how)


def _warped(fixed: DataFrame, moving: DataFrame, state: DataFrame, h: int, w: int, keys: list[str], small: bool) -> DataFrame:
    """Cells of ``fixed`` with the moving raster's value and gradient where the parameters send them; those outside are left out."""
    cy, cx = (h - 1) / 2, (w - 1) / 2
    at = _by_pair(fixed, state, keys, small)
    at = at.withColumn("xc", F.col("x") - cx).withColumn("yc", F.col("y") - cy)
    at = at.withColumn("tx", F.expr("x + a * xc + b * yc + c")).withColumn("ty", F.expr("y + d * xc + e * yc + f")).where(f"tx >= 0 AND ty >= 0 AND tx <= {w - 1} AND ty <= {h - 1}")
    at = at.withColumn("px", F.floor("tx").cast("long")).withColumn("py", F.floor("ty").cast("long")).withColumn("fx", F.expr("tx - px")).withColumn("fy", F.expr("ty - py"))
    met = at.join(moving, [*keys, "py", "px"])
    # corners beyond the last row and column weigh nothing
    lerp = lambda n: F.expr(f"p00.{n} * (1 - fx) * (1 - fy) + coalesce(p01.{n}, 0) * fx * (1 - fy) + coalesce(p10.{n}, 0) * (1 - fx) * fy + coalesce(p11.{n}, 0) * fx * fy")
    rest = [n for n in ("scale",) if n in state.columns]
    return met.select(*keys, *rest, "xc", "yc", "value", "g", lerp("v").alias("iv"), lerp("gx").alias("gx"), lerp("gy").alias("gy"))


def normal_sums(fixed: DataFrame, moving: DataFrame, state: DataFrame, h: int, w: int, keys: list[str], linear: bool, small: bool) -> DataFrame:
    """(keys, n, cost, m0_0 .., r0 ..): the normal equations of a step, by one aggregation.

    Residuals weigh by the square of s*s / (s*s + e*e) for their scale s, so that
    parts that differ between the rasters do not pull; s = 0 weighs all alike.
    """
    j = ["gx * xc", "gx * yc", "gx", "gy * xc", "gy * yc", "gy", "1"] if linear else ["gx", "gy", "1"]
    rows = _warped(fixed, moving, state, h, w, keys, small).withColumnRenamed("scale", "s")
    rows = rows.withColumn("e", F.expr("value - iv - g")).withColumn("u", F.expr("CASE WHEN s > 0 THEN s * s / (s * s + e * e) ELSE 1 END"))
    terms = [F.count("*").alias("n"), F.sum(F.expr("e * e * u")).alias("cost")]
    terms += [F.sum(F.expr(f"u * u * ({p}) * ({q})")).alias(f"m{i}_{k}") for i, p in enumerate(j) for k, q in enumerate(j) if k >= i]
    terms += [F.sum(F.expr(f"u * u * ({p}) * e")).alias(f"r{i}") for i, p in enumerate(j)]
    return rows.groupBy(*keys).agg(*terms)


def _step(state: DataFrame, sums: DataFrame, keys: list[str], linear: bool, small: bool) -> DataFrame:
    """The parameters after a step: the best measured so far stays beside those tried; a pair that gets worse is done."""
    joined = _by_pair(state, sums, keys, small, "left")
    free = list(range(7)) if linear else [2, 5, 6]
    wanted = state.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = len(free)
                if not r["done"] and r["n"] and r["n"] >= LEAST_CELLS and 2 * r["n"] >= (r["first_n"] or 0) and r["cost"] / r["n"] < r["best_cost"]:
                    r |= {"best": [r[c] for c in NAMES], "best_cost": r["cost"] / r["n"], "first_n": r["first_n"] or r["n"]}
                    m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
                    d = np.linalg.lstsq(m, np.array([r[f"r{i}"] for i in range(k)], dtype=float), rcond=1e-12)[0]
                    for i, v in zip(free, d):
                        r[NAMES[i]] += float(v)
                    r["done"] = not np.isfinite(d).all() or bool(np.abs(d).max() < 1e-7)
                else:
                    r["done"] = True
                out.append({c: r[c] for c in wanted})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(c) for c in wanted]))

    return joined.mapInArrow(run, state.schema)


def align(fixed: DataFrame, moving: DataFrame, h: int, w: int, keys: list[str], value: str = "value", levels: int = 5, steps: int = STEPS) -> DataFrame:
    """(keys, a .. g, cost): for each pair the affine move from cells of ``fixed`` to places of ``moving`` (see `NAMES`), and the mean robust cost.

    Both are full grids of one size. The search starts from no move at the
    coarsest level; levels with a short side find shifts alone. Every step is
    measured, and the best measured parameters are carried on. Pairs in one
    table only are left out; rasters without texture stay where they are.
    """
    pyramids = [bands.gaussian(t, h, w, levels, keys, value) for t in (fixed, moving)]
    start = fixed.select(*keys).distinct().join(moving.select(*keys).distinct(), keys)
    state = start.select(*keys, *(F.lit(0.0).alias(n) for n in NAMES))
    found = materialize(state.select("*", F.lit(0.0).alias("cost")), "affine")
    small = found.count() * PAIR_BYTES <= BROADCAST_BYTES
    for (t, lh, lw), (i, *_) in reversed(list(zip(*pyramids))):
        with scratch(fixed.sparkSession) as keep:
            t, linear = t.withColumnRenamed(value, "value"), min(lh, lw) >= LINEAR_SIDE
            patch = materialize(patches(i, lh, lw, keys, value), "patches")
            # shifts double from level to level, by the ratio of the sizes for odd ones
            last = found if lh == pyramids[0][-1][1] else found.withColumn("c", F.col("c") * 2).withColumn("f", F.col("f") * 2)
            here = materialize(last.select(*keys, *NAMES), "affine")
            e = _warped(t, patch, here, lh, lw, keys, small).select(F.struct(*keys).alias("k"), F.expr("value - iv").alias("e"))
            off = ranks.medians(e, "k", "e").select(F.col("k.*"), F.col("median").alias("g"))
            here = materialize(_by_pair(here.drop("g"), off, keys, small).select(*keys, *NAMES), "affine")
            e = _warped(t, patch, here, lh, lw, keys, small).select(F.struct(*keys).alias("k"), F.expr("abs(value - iv - g)").alias("e"))
            scale = ranks.medians(e, "k", "e").select(F.col("k.*"), F.greatest(SPREADS * F.col("median"), F.lit(LEAST_SCALE)).alias("scale"))
            state = _by_pair(here, scale, keys, small)
            state = state.select(*keys, *NAMES, "scale", F.array(*NAMES).alias("best"), F.lit(float("inf")).alias("best_cost"), F.lit(0).cast("long").alias("first_n"), F.lit(False).alias("done"))
            state = materialize(state, "affine")
            for _ in range(steps + 1):  # the last one measures what the step before it found
                sums = normal_sums(t, patch, state, lh, lw, keys, linear, small)
                state = materialize(_step(state, sums, keys, linear, small), "affine")
                if state.where("NOT done").isEmpty():
                    break
            best = state.select(*keys, *(F.col("best")[i].alias(n) for i, n in enumerate(NAMES)), F.col("best_cost").alias("cost"))
            found = keep(materialize(best, "affine"))
    return found
