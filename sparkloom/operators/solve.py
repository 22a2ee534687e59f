"""Solvers over tables: conjugate gradients on sparse systems with bounds, and projections of curves onto bounds.

A sparse matrix is a table (i, j, a); a step multiplies it with a vector by one
join and one aggregation. Vectors are written tables, two numbers a step reach
the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import lookup
from sparkloom.staging import BROADCAST_BYTES, materialize, scratch

#: A solve ends when the residual's size is this share of the right-hand side's; rounds of the active set.
TOLERANCE, ACTIVE_ROUNDS = 1e-10, 30
#: Of an entry of a vector, about.
VECTOR_BYTES = 24


def product(matrix: DataFrame, vector: DataFrame, value: str, small: bool = False) -> DataFrame:
    """(i, ax): the matrix times a column of ``vector`` (i, value), which is broadcast if its size was found ``small``."""
    v = vector.select(F.col("i").alias("j"), F.col(value).alias("__x"))
    met = matrix.join(F.broadcast(v), "j") if small else lookup(matrix, v, "j", row_bytes=VECTOR_BYTES)
    return met.groupBy("i").agg(F.sum(F.col("a") * F.col("__x")).alias("ax"))


def _dot(state: DataFrame, *pairs: str) -> list[float]:
    return [float(x or 0.0) for x in state.agg(*(F.sum(F.expr(p)).alias(f"d{n}") for n, p in enumerate(pairs))).collect()[0]]


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, start: DataFrame | None = None, free: Column | None = None, steps: int = 200, tolerance: float = TOLERANCE) -> DataFrame:
    """(i, x, residual): the solution of a symmetric positive definite system, with its diagonal as preconditioner.

    ``matrix`` has (i, j, a), repeated entries add up; ``rhs`` has (i, b) with
    one row for each unknown. ``start`` (i, x, and what ``free`` reads) is where
    the search begins, zero without it. Unknowns that are not ``free`` keep
    their value. Null entries are zero; unknowns without an entry on the
    diagonal are divided by 1.
    """
    spark = matrix.sparkSession
    with scratch(spark) as keep:
        m = materialize(matrix.where("a IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL").groupBy("i", "j").agg(F.sum(F.col("a").cast("double")).alias("a")), "matrix")
        diagonal = m.where("i = j AND a > 0").select("i", F.col("a").alias("d"))
        begin = rhs.select("i", F.coalesce(F.col("b").cast("double"), F.lit(0.0)).alias("b"))
        begin = begin.join(start, "i", "left") if start is not None else begin.withColumn("x", F.lit(0.0))
        begin = begin.join(diagonal, "i", "left").select("i", "b", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), F.coalesce("d", F.lit(1.0)).alias("d"), (F.lit(True) if free is None else F.coalesce(free, F.lit(True))).alias("free"))
        begin = materialize(begin, "cg")
        small = begin.count() * VECTOR_BYTES <= BROADCAST_BYTES
        residual = F.when(F.col("free"), F.col("b") - F.coalesce("ax", F.lit(0.0))).otherwise(0.0)
        state = begin.join(product(m, begin, "x", small), "i", "left").select("i", "x", "d", "free", residual.alias("r"))
        state = materialize(state.withColumn("p", F.col("r") / F.col("d")), "cg")
        rz, rr = _dot(state, "r * r / d", "r * r")
        (size,) = _dot(begin, "b * b")
        for _ in range(steps):
            if not rr > tolerance**2 * max(size, 1e-300):
                break
            moved = state.join(product(m, state, "p", small), "i", "left").withColumn("ap", F.when(F.col("free"), F.coalesce("ax", F.lit(0.0))).otherwise(0.0)).drop("ax")
            moved = materialize(moved, "cg")
            (bent,) = _dot(moved, "p * ap")
            if not bent > 0:
                break
            far = F.lit(rz / bent)
            state = materialize(moved.select("i", (F.col("x") + far * F.col("p")).alias("x"), "d", "free", (F.col("r") - far * F.col("ap")).alias("r"), "p"), "cg")
            rz_next, rr = _dot(state, "r * r / d", "r * r")
            state = state.withColumn("p", F.col("r") / F.col("d") + F.lit(rz_next / rz) * F.col("p"))
            rz = rz_next
        return keep(materialize(state.select("i", "x", F.col("r").alias("residual")), "solution"))


def bounded_solve(matrix: DataFrame, rhs: DataFrame, low: Column, high: Column, rounds: int = ACTIVE_ROUNDS) -> DataFrame:
    """(i, x, held): the least of x'Ax / 2 - b'x with every unknown between ``low`` and ``high`` (columns of ``rhs``; null: none).

    Each round solves for the free unknowns from where the last one ended,
    holds those that left their bounds at them, and frees those that the
    gradient pulls back inside; it ends when the set stays the same.
    """
    spark = matrix.sparkSession
    with scratch(spark) as keep:
        sides = materialize(rhs.select("i", "b", low.cast("double").alias("low"), high.cast("double").alias("high")), "bounds")
        state = materialize(sides.select("i", F.lit(0.0).alias("x"), F.lit(0).alias("held")), "active")
        for _ in range(rounds):
            x = conjugate_gradients(matrix, sides, state, F.col("held") == 0)
            x = x.select("i", "x").join(sides, "i").join(state.select("i", F.col("held").alias("was")), "i")
            inside = F.greatest(F.least(F.col("x"), F.coalesce("high", "x")), F.coalesce("low", "x"))
            x = x.select("i", "b", "was", inside.alias("y"), F.when(F.col("x") <= F.col("low"), -1).when(F.col("x") >= F.col("high"), 1).otherwise(0).alias("at"))
            x = materialize(x.withColumnRenamed("y", "x"), "active")
            pull = F.col("b") - F.coalesce("ax", F.lit(0.0))
            held = F.when((F.col("at") < 0) & (pull <= 0), -1).when((F.col("at") > 0) & (pull >= 0), 1).otherwise(0)
            step = materialize(x.join(product(matrix, x, "x"), "i", "left").select("i", "x", "was", held.alias("held")), "active")
            state = step.select("i", "x", "held")
            if step.where("held <> was").isEmpty():
                break
        return keep(materialize(state.select("i", "x", (F.col("held") != 0).alias("held")), "solution"))


# -------------------------------------------------------------- projections


def reachable(x: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each knot narrowed to the values from which both neighbours' bounds can be reached, slopes between ``least`` and ``most``."""
    low, high = low.copy(), high.copy()
    for order, sign in ((range(1, len(x)), 1), (range(len(x) - 2, -1, -1), -1)):
        for i in order:
            j = i - sign
            gap, cap = abs(x[i] - x[j]), most[max(i, j)]
            up, down = (cap * gap, least * gap) if sign > 0 else (-least * gap, -cap * gap)
            low[i], high[i] = max(low[i], low[j] + down), min(high[i], high[j] + up)
    return low, high


def project(x: np.ndarray, target: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, most: np.ndarray, sweeps: int = 20_000, settled: float = 1e-13) -> np.ndarray:
    """The curve nearest ``target`` in the metric of ``weight`` with knots within bounds and slopes from ``least`` to ``most``.

    Alternating projections onto the bounds, and onto the slopes of every other
    segment, each remembering what it corrected last; then one pass that holds
    every knot in what can be reached, so the result is feasible even where the
    sweeps have not settled. NaN where no such curve exists.
    """
    n = len(x)
    lo, hi = reachable(x, low, high, least, most)
    if (lo > hi + 1e-12).any():
        return np.full(n, np.nan)
    y, kept = target.astype(float).copy(), [np.zeros(n) for _ in range(3)]
    gap, inverse = np.diff(x), 1 / weight
    for _ in range(sweeps):
        before = y.copy()
        z = y + kept[0]
        y = np.clip(z, low, high)
        kept[0] = z - y
        moved = np.abs(z - y - kept[0]).max(initial=0)
        for odd in (0, 1):  # segments without a common knot are projected at once
            a = np.arange(odd, n - 1, 2)
            z = y + kept[1 + odd]
            rise = z[a + 1] - z[a]
            excess = rise - np.clip(rise, least * gap[a], most[a + 1] * gap[a])
            share = inverse[a] / (inverse[a] + inverse[a + 1])
            y = z.copy()
            y[a] += excess * share
            y[a + 1] -= excess * (1 - share)
            last, kept[1 + odd] = kept[1 + odd], z - y
            moved = max(moved, np.abs(last - kept[1 + odd]).max(initial=0))
        if max(moved, np.abs(y - before).max(initial=0)) < settled:
            break
    for i in range(n):
        down, up = (y[i - 1] + least * gap[i - 1], y[i - 1] + most[i] * gap[i - 1]) if i else (-np.inf, np.inf)
        y[i] = np.minimum(np.maximum(y[i], max(lo[i], down)), min(hi[i], up))
    return y


def project_curves(rows: DataFrame, key: str, x: str, y: Column, weight: Column, low: Column, high: Column, least: float, most: float) -> DataFrame:
    """(key, x, target, mass, value): for each key the nearest curve through its bounds and slopes, `project` of the weighted means at each x.

    Rows are first brought to one knot for each key and x, so a task holds the
    distinct x of one key; ``x`` is meant to be a bin. The bounds of a knot are
    the narrowest of its rows. Rows with nulls or weights of zero or less are
    left out.
    """
    names = {"y": y, "w": weight, "lo": low, "hi": high}
    cols = (c.cast("double").alias(f"__{n}") for n, c in names.items())
    good = rows.select(key, F.col(x).cast("double").alias(x), *cols).where(f"__w > 0 AND __y IS NOT NULL AND `{x}` IS NOT NULL AND `{key}` IS NOT NULL")
    knots = good.groupBy(key, x).agg((F.sum(F.expr("__w * __y")) / F.sum("__w")).alias("target"), F.sum("__w").alias("mass"), F.coalesce(F.max("__lo"), F.lit(float("-inf"))).alias("low"), F.coalesce(F.min("__hi"), F.lit(float("inf"))).alias("high"))
    kind = good.schema[key].dataType.simpleString()

    def run(group: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(x)
        xs, target, mass, lo, hi = (t[c].to_numpy() for c in (x, "target", "mass", "low", "high"))
        value = project(xs, target, mass, lo, hi, least, np.full(len(xs), most))
        return t.select([key, x, "target", "mass"]).append_column("value", pa.array(value, pa.float64(), from_pandas=True))

    return knots.groupBy(key).applyInArrow(run, f"`{key}` {kind}, `{x}` double, target double, mass double, value double")
