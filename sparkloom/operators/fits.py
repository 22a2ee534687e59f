"""Weighted fits: slopes with their errors, planes, quantile maps, merged exposures, robust curves, least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import ranks, stats
from sparkloom.staging import materialize

#: Fixed value: reach of the biweight in standard deviations.
BIWEIGHT = 4.685


def slope_with_error(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column, step: float = 1 / 255, least: int = 32) -> DataFrame:
    """Weighted least-squares slope of y on x per key, and its standard error, in one aggregation.

    The error adds the regression's own, at the effective number of rows
    (three at least), to that of both ends of x, known to one ``step``. Rows
    with a null or a weight of zero or less are left out. Both results are null
    under ``least`` rows, or where x spreads less than half a step.
    """
    rows = df.select(*keys, x.cast("double").alias("__x"), y.cast("double").alias("__y"), w.cast("double").alias("__w")).where("__w > 0 AND __x IS NOT NULL AND __y IS NOT NULL")
    sums = {"sw": "__w", "sww": "__w*__w", "sx": "__w*__x", "sy": "__w*__y", "sxx": "__w*__x*__x", "sxy": "__w*__x*__y", "syy": "__w*__y*__y"}
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(n) for n, e in sums.items()))
    s = s.select(*keys, "n", F.greatest(F.expr("sw*sw/sww"), F.lit(3.0)).alias("eff"), *(F.expr(f"{a}{b}/sw - s{a[1]}/sw*s{b}/sw").alias(f"v{a[1]}{b}") for a, b in (("sx", "x"), ("sx", "y"), ("sy", "y"))))
    gain = F.col("vxy") / F.col("vxx")
    regression = F.greatest(F.col("vyy") - gain * F.col("vxy"), F.lit(0.0)) / (F.col("vxx") * (F.col("eff") - 2))
    ends = 2 * step * step / 12 / (12 * F.col("vxx"))
    heard = (F.col("n") >= least) & (F.col("vxx") >= (step / 2) ** 2)
    return s.select(*keys, "n", F.when(heard, gain).alias("slope"), F.when(heard, F.sqrt(regression + ends)).alias("error"))


def plane(df: DataFrame, keys: list[str], x: Column, y: Column, value: Column, w: Column) -> DataFrame:
    """Weighted least-squares plane value = a + slope_x x + slope_y y per key: one aggregation, then Cramer's rule.

    Nulls and weights of zero or less are left out; all three are null where
    the rows lie on one line.
    """
    cols = (c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (value, "v"), (w, "g")))
    rows = df.select(*keys, *cols).where("g > 0 AND x IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")
    terms = {"s": "g", "sx": "g*x", "sy": "g*y", "sxx": "g*x*x", "sxy": "g*x*y", "syy": "g*y*y", "sv": "g*v", "sxv": "g*x*v", "syv": "g*y*v"}
    s = rows.groupBy(*keys).agg(*(F.sum(F.expr(e)).alias(n) for n, e in terms.items()))
    # about the weighted means the system has two unknowns
    d = {n: F.expr(f"{n} - s{n[1]}*s{n[2]}/s") for n in ("sxx", "sxy", "syy", "sxv", "syv")}
    det = d["sxx"] * d["syy"] - d["sxy"] * d["sxy"]
    ok = det > 1e-12 * d["sxx"] * d["syy"]
    bx = F.when(ok, (d["sxv"] * d["syy"] - d["syv"] * d["sxy"]) / det)
    by = F.when(ok, (d["syv"] * d["sxx"] - d["sxv"] * d["sxy"]) / det)
    return s.select(*keys, ((F.col("sv") - bx * F.col("sx") - by * F.col("sy")) / F.col("s")).alias("a"), bx.alias("slope_x"), by.alias("slope_y"))


def mid_quantiles(df: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """(key, value, q): cumulative weight below a value plus half of its own, as a share; one row per distinct value."""
    return ranks.mid_shares(df, key, value, weight.cast("double")).select(key, value, "q")


def quantile_map(source: DataFrame, target: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """(key, value, mapped): each distinct source value at its quantile of the target, linear between target values.

    Beyond the target's ends its first or last value; null for keys without a
    target. Ranges of a key are mapped apart, the borders are carried over.
    """
    s = mid_quantiles(source, key, value, weight).select(key, "q", F.col(value).cast("double").alias("v"), F.lit(1).alias("side"))
    t = mid_quantiles(target, key, value, weight).select(key, "q", F.col(value).cast("double").alias("v"), F.lit(0).alias("side"))
    at = F.when(F.col("side") == 0, F.struct("q", "v"))
    both = ranks.between(s.unionByName(t).withColumn("at", at), [key], ["q", "side"], "at")
    lo, hi = F.col("lo"), F.col("hi")
    part = (F.col("q") - lo["q"]) / (hi["q"] - lo["q"])
    mapped = F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["q"] == F.col("q")), lo["v"]).otherwise(lo["v"] + part * (hi["v"] - lo["v"]))
    return both.where("side = 1").select(key, F.col("v").alias(value), mapped.alias("mapped"))


def weighted_cdf(df: DataFrame, value: Column, weight: Column, bins: int, top: float) -> DataFrame:
    """(bin, cdf): share of the weight in bins 0 .. bin, for every bin; values are clamped to the ends."""
    b = F.least(F.greatest(F.floor((bins - 1) * value / top), F.lit(0)), F.lit(bins - 1)).cast("int")
    mass = df.where(value.isNotNull() & (weight > 0)).groupBy(b.alias("bin")).agg(F.sum(weight.cast("double")).alias("w"))
    full = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(mass), "bin", "left")
    # at most ``bins`` rows are left: the window without a key is bounded
    upto = F.sum(F.coalesce("w", F.lit(0.0))).over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    every = F.sum("w").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return full.select("bin", (upto / every).alias("cdf"))


def cdf_at(cdf: DataFrame, points: DataFrame, x: Column, bins: int, top: float) -> DataFrame:
    """``points`` with ``share``: `weighted_cdf` between its bins, linearly; values are clamped to 0 .. ``top``, null stays null.

    The cdf (a row for each of ``bins`` bins) is broadcast.
    """
    pos = F.least(F.greatest(x / top, F.lit(0.0)), F.lit(1.0)) * (bins - 1)
    rows = points.withColumn("__pos", pos.cast("double")).withColumn("__bin", F.floor("__pos").cast("int"))
    after = F.coalesce(F.lead("cdf").over(W.orderBy("bin")), F.col("cdf"))
    line = cdf.select(F.col("bin").alias("__bin"), F.col("cdf").alias("__lo"), after.alias("__hi"))
    part = F.col("__pos") - F.col("__bin")
    return rows.join(F.broadcast(line), "__bin", "left").select(*points.columns, (F.col("__lo") * (1 - part) + F.col("__hi") * part).alias("share"))


def merge_exposures(df: DataFrame, keys: list[str], value: Column, ev: Column) -> DataFrame:
    """Radiance per key from readings in 0 .. 1 taken at ``ev`` stops more light, and the number of readings heard.

    A reading weighs 1 - (2v - 1)**12 times its light, so both ends of the
    range say nothing; radiance is null where no reading is heard.
    """
    light = F.pow(F.lit(2.0), ev)
    w = F.greatest(1 - F.pow(2 * value - 1, F.lit(12)), F.lit(0.0)) * light
    return df.groupBy(*keys).agg((F.sum(w * value / light) / F.sum(F.when(w > 0, w))).alias("radiance"), F.count(F.when(w > 0, 1)).alias("heard"))


def correlation(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted Pearson correlation per key; null where a side does not vary."""
    out = df.select(*keys, x.alias("__x"), y.alias("__y"), w.alias("__w")).where("__w > 0 AND __x IS NOT NULL AND __y IS NOT NULL")
    line = stats.weighted_line(out, keys, "__x", "__y", "__w")
    return line.select(*keys, (F.sqrt("r2") * F.signum("slope")).alias("r"))


def robust_curve(df: DataFrame, x: Column, y: Column, w: Column, bins: int = 64, rounds: int = 3) -> DataFrame:
    """(bin, value, mass): y as a function of x in 0 .. 1, deaf to outliers, never falling.

    Bins start at their weighted median. Each round reweights the rows with
    the biweight of their distance from it, in units of 1.4826 times the bin's
    median absolute deviation, and takes means. Bins that fall are then pooled
    with their neighbours, by mass. The table of bins (at most ``bins`` rows)
    is written each round; no rows reach the driver but these.
    """
    at = F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = df.select(at.alias("bin"), y.cast("double").alias("y"), w.cast("double").alias("w")).where("w > 0 AND bin IS NOT NULL AND y IS NOT NULL")
    centre = stats.weighted_quantiles(rows, "bin", "y", "w", [0.5]).select("bin", F.col("q50").alias("value"))
    centre = materialize(centre, "curve")
    spread = rows.join(F.broadcast(centre), "bin").select("bin", F.abs(F.col("y") - F.col("value")).alias("d"), "w")
    spread = materialize(stats.weighted_quantiles(spread, "bin", "d", "w", [0.5]).select("bin", (BIWEIGHT * 1.4826 * F.col("q50")).alias("reach")), "curve-reach")
    for _ in range(rounds):
        u = F.when(F.col("reach") > 0, (F.col("y") - F.col("value")) / F.col("reach")).otherwise(F.when(F.col("y") == F.col("value"), 0.0).otherwise(1.0))
        g = F.col("w") * F.pow(1 - F.least(u * u, F.lit(1.0)), F.lit(2))
        step = rows.join(F.broadcast(centre.select("bin", "value")), "bin").join(F.broadcast(spread), "bin").select("bin", "y", g.alias("g"))
        centre = materialize(step.groupBy("bin").agg(F.sum(F.expr("g * y")).alias("s"), F.sum("g").alias("mass")).where("mass > 0").selectExpr("bin", "s / mass AS value", "mass"), "curve")
    found = sorted((r.bin, r.value, r.mass) for r in centre.collect())
    values = pool_falls([v for _, v, _ in found], [m for *_, m in found])
    return df.sparkSession.createDataFrame([(b, float(v), float(m)) for (b, _, m), v in zip(found, values)], "bin int, value double, mass double")


def pool_falls(values: list[float], mass: list[float]) -> list[float]:
    """The nearest sequence that never falls, in the metric of ``mass``: neighbours that fall share their mean."""
    blocks: list[list[float]] = []
    for v, m in zip(values, mass):
        blocks.append([v * m, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [total / m for total, m, n in blocks for _ in range(int(n))]


def least_squares(df: DataFrame, features: dict[str, Column], target: Column, weight: Column, ridge: float = 0.0) -> DataFrame:
    """(feature, coefficient) of a weighted linear model without an intercept, by one aggregation.

    The sums of products (a square in the number of features, not of rows)
    are solved on the driver; ``ridge`` is added to their diagonal. Rows with
    a null are left out. Directions that no row has get no coefficient weight.
    """
    names = list(features)
    rows = df.select(*(c.cast("double").alias(f"f{i}") for i, c in enumerate(features.values())), target.cast("double").alias("t"), weight.cast("double").alias("g")).dropna().where("g > 0")
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(*(F.sum(F.expr(f"g*f{i}*f{j}")).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(F.expr(f"g*f{i}*t")).alias(f"b{i}") for i in range(k))).collect()[0]
    a, b = np.zeros((k, k)), np.array([sums[f"b{i}"] or 0.0 for i in range(k)])
    for i, j in pairs:
        a[i, j] = a[j, i] = sums[f"a{i}_{j}"] or 0.0
    found = np.linalg.lstsq(a + ridge * np.eye(k), b, rcond=None)[0]
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, found)], "feature string, coefficient double")
