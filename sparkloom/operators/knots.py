"""Curves through knots that keep monotone runs monotone, and runs of one sign along bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import ranks


def monotone_slopes(knots: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, y, slope): slopes of the cubic Hermite curve that never leaves the range of neighbouring knots.

    Inside, the weighted harmonic mean of both chords, or zero where they
    differ in sign; at the ends the three-point formula, held to the sign of
    the end's chord and to three times it where the next chord turns. Repeated
    x have their largest y; two knots give a straight line, one knot a slope of zero.
    """
    p = knots.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, x).agg(F.max(y).cast("double").alias(y))
    w = W.partitionBy(key).orderBy(x)
    p = p.withColumn("h", F.lead(x).over(w) - F.col(x)).withColumn("d", (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x)))
    for name, at in (("h1", -1), ("d1", -1), ("h2", -2), ("d2", -2), ("hn", 1), ("dn", 1)):
        p = p.withColumn(name, F.lead(name[0], at).over(w) if at > 0 else F.lag(name[0], -at).over(w))
    inner = F.expr("CASE WHEN d1 * d <= 0 THEN 0D ELSE 3 * (h + h1) / ((2 * h + h1) / d1 + (h + 2 * h1) / d) END")

    def end(h: str, d: str, hh: str, dd: str):
        three = f"((2 * {h} + {hh}) * {d} - {h} * {dd}) / ({h} + {hh})"
        return F.expr(f"CASE WHEN {dd} IS NULL THEN {d} WHEN sign({three}) <> sign({d}) THEN 0D WHEN sign({d}) <> sign({dd}) AND abs({three}) > 3 * abs({d}) THEN 3 * {d} ELSE {three} END")

    slope = F.when(F.col("d").isNull() & F.col("d1").isNull(), 0.0).when(F.col("d1").isNull(), end("h", "d", "hn", "dn")).when(F.col("d").isNull(), end("h1", "d1", "h2", "d2")).otherwise(inner)
    return p.select(key, x, y, slope.alias("slope"))


def hermite_at(sloped: DataFrame, probes: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, value) at each distinct probe, of the curve of `monotone_slopes`; beyond the ends the end's value.

    Keys without knots have null. One union, put in order in ranges.
    """
    at = F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"), F.col("slope").alias("m"))
    k = sloped.select(key, F.col(x).cast("double").alias(x), F.lit(0).alias("__probe"), at.alias("__k"))
    q = probes.select(key, F.col(x).cast("double").alias(x)).distinct().select(key, x, F.lit(1).alias("__probe"), F.lit(None).cast(k.schema["__k"].dataType).alias("__k"))
    both = ranks.between(k.unionByName(q), [key], [x, "__probe"], "__k")
    cut = both.where("__probe = 1").withColumn("h", F.expr("hi.x - lo.x")).withColumn("t", (F.col(x) - F.col("lo.x")) / F.col("h"))
    curve = F.expr("(1 + 2 * t) * (1 - t) * (1 - t) * lo.y + t * (1 - t) * (1 - t) * h * lo.m + t * t * (3 - 2 * t) * hi.y + t * t * (t - 1) * h * hi.m")
    value = F.when(F.col("lo").isNull(), F.col("hi.y")).when(F.col("hi").isNull(), F.col("lo.y")).otherwise(curve)
    return cut.select(key, x, value.alias("value"))


def signed_runs(bins: DataFrame, key: str, bin_: str, residual: str, weight: str) -> DataFrame:
    """(key, first, last, mean, share, score): runs of adjoining bins whose residuals have one sign.

    ``mean`` is weighted, ``share`` the run's part of the key's weight and
    ``score`` their product without sign. Zero and null residuals, and weights
    of zero or less, end a run.
    """
    b = bins.where((F.col(weight) > 0) & (F.col(residual) != 0)).select(key, bin_, residual, weight, F.signum(residual).alias("s"))
    b = b.withColumn("g", F.col(bin_) - F.row_number().over(W.partitionBy(key, "s").orderBy(bin_))).withColumn("t", F.sum(weight).over(W.partitionBy(key)))
    runs = b.groupBy(key, "s", "g").agg(F.min(bin_).alias("first"), F.max(bin_).alias("last"), F.sum(F.col(weight) * F.col(residual)).alias("wr"), F.sum(weight).alias("w"), F.first("t").alias("t"))
    return runs.select(key, "first", "last", F.expr("wr / w").alias("mean"), F.expr("w / t").alias("share"), F.expr("abs(wr / w) * (w / t)").alias("score"))
