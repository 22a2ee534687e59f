"""Measures over binned distributions, consensus values, and frames merged cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import ranks, stats


def binned_quantiles(df: DataFrame, key: str, value: Column, low: float, high: float, bins: int, parts: int) -> DataFrame:
    """(key, step, quantile) for steps 0 .. parts: the inverse CDF at step / parts, linear within bins of equal width.

    Values are clamped to [low, high]; null values and keys are left out. Only
    ``bins`` rows a key leave the first aggregation, however hot a key is.
    """
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((value - low) / width), F.lit(0)), F.lit(bins - 1))
    h = df.where(F.col(key).isNotNull() & value.isNotNull()).groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))
    w = W.partitionBy(key)
    h = h.select(key, "bin", "n", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)).alias("c"), F.sum("n").over(w).alias("t"))
    # the steps whose count lies in this bin: above what came before, up to what is reached here
    first = F.when(F.col("c") == F.col("n"), 0).otherwise(F.floor((F.col("c") - F.col("n")) * parts / F.col("t")) + 1)
    last = F.floor(F.col("c") * parts / F.col("t"))
    s = h.withColumn("f", first.cast("long")).withColumn("l", last.cast("long")).where("f <= l").select("*", F.explode(F.sequence("f", "l")).alias("step"))
    within = (F.col("step") * F.col("t") / parts - (F.col("c") - F.col("n"))) / F.col("n")
    return s.select(key, F.col("step").cast("int").alias("step"), (low + width * (F.col("bin") + within)).alias("quantile"))


def quantile_gap(df: DataFrame, key: str, side: Column, value: Column, low: float, high: float, bins: int = 1024, parts: int = 20) -> DataFrame:
    """(key, gap): mean distance of the inverse CDFs of both sides of a key; keys with one side only have none."""
    both = df.select(F.struct(F.col(key).alias("k"), side.alias("s")).alias("ks"), value.alias("v"))
    q = binned_quantiles(both, "ks", F.col("v"), low, high, bins, parts).select("ks.k", "ks.s", "step", "quantile").where("k IS NOT NULL AND s IS NOT NULL")
    pair = q.groupBy("k", "step").agg(F.max(F.when(F.col("s"), F.col("quantile"))).alias("a"), F.max(F.when(~F.col("s"), F.col("quantile"))).alias("b"))
    return pair.where("a IS NOT NULL AND b IS NOT NULL").groupBy(F.col("k").alias(key)).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap"))


def mass_bands(df: DataFrame, key: str, value: str, weight: str, bands: int) -> DataFrame:
    """(key, band, low, high, mass): bands of about equal weight by rising value; equal values share a band.

    A value belongs to the band in which the middle of its weight falls.
    """
    steps = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(weight).alias("w"))
    r = ranks.running(steps, [key], [value], {"w": "w"})
    banded = r.select(key, value, "w", F.floor(bands * (F.col("w_below") + F.col("w") / 2) / F.col("w_all")).cast("int").alias("band"))
    return banded.groupBy(key, "band").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("w").alias("mass"))


def largest_reversal(bins: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, reversal): how far a value falls below the largest before it, at most; 0 for rising sequences."""
    top = F.max(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return bins.where(F.col(value).isNotNull()).select(key, (top - F.col(value)).alias("d")).groupBy(key).agg(F.max("d").alias("reversal"))


def consensus(df: DataFrame, key: str, value: str, weight: str, limit: float) -> DataFrame:
    """(key, consensus, opposed): the weighted median, or 0 where values of the other sign hold ``limit`` of the weight or more."""
    median = stats.weighted_quantiles(df, key, value, weight, [0.5])
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).join(median, key)
    against = F.when(F.signum(value) * F.signum("q50") < 0, F.col(weight)).otherwise(0.0)
    s = rows.groupBy(key).agg(F.max("q50").alias("q"), (F.sum(against) / F.sum(weight)).alias("opposed"))
    return s.select(key, F.when(F.col("opposed") >= limit, 0.0).otherwise(F.col("q").cast("double")).alias("consensus"), "opposed")


def biweight_mean(df: DataFrame, key: str, value: str, reach: float = 4.685, floor: float = 1e-9) -> DataFrame:
    """(key, mean, n): mean with weights (1 - u*u)**2 for u = distance from the median in ``reach`` scaled MADs, 0 beyond."""
    u = (F.col(value) - F.col("med")) / (reach * F.greatest(1.4826 * F.col("mad"), F.lit(floor)))
    w = F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
    return ranks.deviations(df, key, value).groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.count(value).alias("n"))


def fused(frames: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """(keys, value): weighted mean over the frames of each cell; the plain mean where no frame has weight."""
    w = F.when(weight > 0, weight).otherwise(0.0)
    s = frames.where(value.isNotNull()).groupBy(*keys).agg(F.sum(w).alias("__w"), F.sum(w * value).alias("__s"), F.avg(value).alias("__m"))
    return s.select(*keys, F.when(F.col("__w") > 0, F.col("__s") / F.col("__w")).otherwise(F.col("__m")).alias("value"))


def sharpest(frames: DataFrame, keys: list[str], frame: str, value: str, detail: Column) -> DataFrame:
    """(keys, frame, value): each cell from the frame with the most detail there; ties go to the smaller frame."""
    best = F.max_by(F.struct(frame, value), F.struct(F.coalesce(detail, F.lit(float("-inf"))), -F.col(frame)))
    return frames.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("m")).select(*keys, f"m.{frame}", f"m.{value}")


def peak_noise_ratio(pairs: DataFrame, keys: list[str], a: Column, b: Column, peak: float = 1.0) -> DataFrame:
    """(keys, psnr): 10 log10(peak**2 / mean square difference), the latter at least 1e-12."""
    return pairs.groupBy(*keys).agg((10 * F.log10(peak * peak / F.greatest(F.avg((a - b) * (a - b)), F.lit(1e-12)))).alias("psnr"))
