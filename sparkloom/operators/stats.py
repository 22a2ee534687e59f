"""Histograms, quantiles, weighted fits, and robust means and outliers as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import ranks

def histogram(df: DataFrame, value: Column, bins: int, top: float, keys: list[str] | None = None) -> DataFrame:
    """Counts per bin ``floor((bins-1) * value / top)``, clamped to the ends; empty bins included when there are no keys."""
    b = F.least(F.greatest(F.floor((bins - 1) * value / top), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(*(keys or []), b.alias("bin")).agg(F.count("*").alias("n"))
    if keys:
        return counts
    full = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return full.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def clip_shares(df: DataFrame, value: Column, low: float, high: float) -> DataFrame:
    """Per cent of rows at or below ``low`` and at or above ``high``."""
    share = lambda c: 100.0 * F.sum(F.when(c, 1).otherwise(0)) / F.count(value)
    return df.agg(share(value <= low).alias("low_pct"), share(value >= high).alias("high_pct"), F.count(value).alias("n"))


def binned_quantile(hist: DataFrame, q: float) -> DataFrame:
    """The first bin at which the cumulative count reaches the share ``q``; ``hist`` has one bounded row per bin."""
    w = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    total = hist.agg(F.sum("n").alias("total"))
    return hist.withColumn("cum", F.sum("n").over(w)).join(F.broadcast(total)).where(F.col("cum") >= q * F.col("total")).agg(F.min("bin").alias("bin"))


def weighted_quantiles(df: DataFrame, key: str, value: str, weight: str, qs: list[float]) -> DataFrame:
    """Per key the least value at which the cumulative weight reaches each share.

    Equal values are one step; weights of zero or less, and nulls, are left out.
    """
    return ranks.step_quantiles(df, key, value, F.col(weight), qs)


def weighted_line(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares y = a + b x per key in one pass: slope, intercept, r2, effective number of rows; null where the weights sum to zero."""
    d = [F.col(c).cast("double") for c in (x, y, w)]
    X, Y, G = d
    s = df.groupBy(*keys).agg(
        F.nullif(F.sum(G), F.lit(0.0)).alias("sw"), F.sum(G * X).alias("sx"), F.sum(G * Y).alias("sy"), F.sum(G * X * X).alias("sxx"), F.sum(G * X * Y).alias("sxy"), F.sum(G * Y * Y).alias("syy"), F.nullif(F.sum(G * G), F.lit(0.0)).alias("sww")
    )
    vx, vy, c = (F.expr(e) for e in ("sxx - sx*sx/sw", "syy - sy*sy/sw", "sxy - sx*sy/sw"))
    slope = F.when(vx > 0, c / vx)
    return s.select(*keys, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"), F.when((vx > 0) & (vy > 0), c * c / (vx * vy)).alias("r2"), F.expr("sw*sw/sww").alias("n_eff"))


def mid_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, mid): share of rows below a value plus half of those at it; one row per distinct value."""
    return ranks.mid_shares(df, key, value, F.lit(1)).select(key, value, F.col("w").cast("long").alias("n"), F.col("q").alias("mid"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """The element at position n div 2 (from 0) of the sorted values of each key."""
    return ranks.medians(df, key, value).select(key, F.col("upper").alias("upper_median"), "n")


def robust_mean(df: DataFrame, key: str, value: str, floor: float = 1e-5) -> DataFrame:
    """Mean per key with weights exp(-((x - median) / max(3 MAD, floor))**2): far values fade out."""
    z = (F.col(value) - F.col("med")) / F.greatest(3 * F.col("mad"), F.lit(floor))
    w = F.exp(-z * z)
    return ranks.deviations(df, key, value).groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("robust_mean"), F.count(value).alias("n"))


def outliers(df: DataFrame, key: str, value: str, sigmas: float = 20.0) -> DataFrame:
    """Rows farther than ``sigmas`` times 1.4826 MAD from their key's median."""
    return ranks.deviations(df, key, value).where(F.abs(F.col(value) - F.col("med")) > sigmas * 1.4826 * F.col("mad"))


def z_scores(df: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """Adds z: standard score within the key; the raw value where a key has fewer than ``least`` rows or no spread."""
    s = df.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count(value).alias("__n"))
    ok = (F.col("__n") >= least) & (F.col("__s") > 0)
    return df.join(s, key).withColumn("z", F.when(ok, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(F.col(value))).drop("__m", "__s", "__n")


def paired_errors(df: DataFrame, keys: list[str], got: Column, want: Column, scale: float, low_n: int = 20) -> DataFrame:
    """Mean absolute error, signed bias, gap in per cent of ``scale``, rows without a result, and a mark for few rows."""
    d = got - want
    return df.groupBy(*keys).agg(
        F.count(d).alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("bias"),
        (100 * F.avg(F.abs(d)) / scale).alias("gap_pct"),
        F.sum(F.when(got.isNull() & want.isNotNull(), 1).otherwise(0)).cast("long").alias("omitted"),
        (F.count(d) < low_n).alias("low_n"),
    )


def two_sided_bins(df: DataFrame, bin_: Column, side: Column, floor: float = 0.015) -> DataFrame:
    """Share of each bin on both sides of a split; a bin counts with the smaller share, if that reaches ``floor``; a side without rows has shares of zero."""
    c = df.groupBy(bin_.alias("bin")).agg(F.sum(F.when(side, 1).otherwise(0)).alias("a"), F.sum(F.when(side, 0).otherwise(1)).alias("b"))
    t = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = c.join(F.broadcast(t)).select("bin", F.coalesce(F.try_divide("a", "ta"), F.lit(0.0)).alias("share_a"), F.coalesce(F.try_divide("b", "tb"), F.lit(0.0)).alias("share_b"))
    both = F.least("share_a", "share_b")
    return share.select("bin", "share_a", "share_b", F.when(both >= floor, both).otherwise(0.0).alias("weight"))
