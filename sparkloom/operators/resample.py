"""Bootstrap intervals and accumulators that merge."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cumulative Poisson probabilities of mean 1 (0, 1, 2, ...), in units of `PRIME`; later counts have no weight at this resolution.
PRIME = 2_147_483_647
REPLICATES = 200


def poisson_steps() -> list[int]:
    """Thresholds on 0 .. PRIME - 1: a draw counts as many times as it reaches thresholds."""
    p, total, out = np.exp(-1.0), 0.0, []
    for k in range(1, 13):
        total += p
        out.append(int(round(total * PRIME)))
        p /= k
    return [t for t in out if t < PRIME]


def draws(ids: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """Uniform whole numbers below `PRIME` that depend on a row's id and the replicate alone."""
    u = (ids % PRIME * 48271 + replicate * 69621 + 12345) % PRIME
    for a, b in ((16807, 7), (39373, 11)):
        u = (u * u + a) % PRIME
        u = (u * 48271 + replicate * a + b) % PRIME
    return u


def bootstrap(df: DataFrame, key: str, id_col: str, value: Column, weight: Column | None = None, replicates: int = REPLICATES) -> DataFrame:
    """(key, replicate, n, mean): weighted mean of each replicate, in which a row counts a Poisson number of times of mean 1.

    How often depends on the row's id (a whole number) and the replicate alone,
    so replicates are the same for any partitioning, and all are made by one
    aggregation: tasks add up a table of keys by replicates for each batch.
    Replicates without rows have no mean. Null values and ids are left out.
    """
    steps = np.array(poisson_steps())
    rows = df.select(key, F.col(id_col).cast("long").alias("__id"), value.cast("double").alias("__v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("__w")).where("__id IS NOT NULL AND __v IS NOT NULL AND __w > 0")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(replicates)
        for b in batches:
            code = b.column(0).dictionary_encode()
            names = pa.concat_arrays([code.dictionary, pa.nulls(1, code.dictionary.type)])
            at = code.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
            ids, v, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            sums = np.zeros((3, len(names), replicates))
            for lo in range(0, len(ids), 2048):
                some = slice(lo, lo + 2048)
                times = np.searchsorted(steps, draws(ids[some, None], every[None, :]), side="right")
                for k, amount in enumerate((np.ones(len(times)), w[some], (w * v)[some])):
                    np.add.at(sums[k], at[some], times * amount[:, None])
            group, rep = np.nonzero(sums[0])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(group)), pa.array(rep, pa.int32()), *(pa.array(sums[k][group, rep]) for k in range(3))], names=[key, "replicate", "n", "w", "s"])

    parts = rows.mapInArrow(run, f"`{key}` {kind}, replicate int, n double, w double, s double")
    return parts.groupBy(key, "replicate").agg(F.sum("n").cast("long").alias("n"), (F.sum("s") / F.sum("w")).alias("mean"))


def intervals(replicates: DataFrame, key: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(key, low, high): quantiles of the means of `bootstrap`, a bounded number for each key."""
    q = F.percentile("mean", F.array(F.lit(low), F.lit(high)))
    return replicates.groupBy(key).agg(q.alias("q")).select(key, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


# ------------------------------------------------------------- accumulators

#: Fewer samples than this mark a metric as low in a report.
LOW_N = 20


def partial_errors(df: DataFrame, keys: list[str], metric: str, got: Column, want: Column) -> DataFrame:
    """(keys, acc): per key a map from metric to the sums (n, sum_abs, sum_signed, omit), a state that merges with others.

    A row with ``want`` but without ``got`` is omitted; one without ``want`` says nothing.
    """
    d = got.cast("double") - want.cast("double")
    s = df.where(want.isNotNull() & F.col(metric).isNotNull()).groupBy(*keys, F.col(metric).alias("__m")).agg(
        F.count(d).alias("n"), F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("sum_abs"), F.coalesce(F.sum(d), F.lit(0.0)).alias("sum_signed"), F.sum(F.when(got.isNull(), 1).otherwise(0)).cast("long").alias("omit")
    )
    return s.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__m", F.struct("n", "sum_abs", "sum_signed", "omit")))).alias("acc"))


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, acc): the sum of all states of a key; states of no metric change nothing. One row for each metric is shuffled."""
    each = states.select(*keys, F.explode("acc").alias("__m", "s"))
    s = each.groupBy(*keys, "__m").agg(*(F.sum(f"s.{c}").alias(c) for c in ("n", "sum_abs", "sum_signed", "omit")))
    return s.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__m", F.struct("n", "sum_abs", "sum_signed", "omit")))).alias("acc"))


def resumed(saved: DataFrame, fresh: DataFrame, photo: str, keys: list[str]) -> DataFrame:
    """Saved and new states, one for each item ``photo``: an item that was saved before is not counted again."""
    return saved.unionByName(fresh.join(saved.select(*keys, photo).distinct(), [*keys, photo], "left_anti"))


def report(merged: DataFrame, keys: list[str], low_n: int = LOW_N) -> DataFrame:
    """(keys, metric, n, mae, bias, omit, low): a line for each metric with samples or omissions; no means without samples."""
    each = merged.select(*keys, F.explode("acc").alias("metric", "s")).where("s.n > 0 OR s.omit > 0")
    return each.select(*keys, "metric", F.col("s.n").alias("n"), F.try_divide("s.sum_abs", "s.n").alias("mae"), F.try_divide("s.sum_signed", "s.n").alias("bias"), F.col("s.omit").alias("omit"), (F.col("s.n") < low_n).alias("low"))


def gaps(merged: DataFrame, keys: list[str], scale: Column, curve_n: Column | None = None, curve_sum: Column | None = None) -> DataFrame:
    """(keys, gap, weighted_gap) in per cent: mean error of the metrics as shares of their ``scale`` (of column metric), plain and weighted by samples.

    The weighted one shares out the weight of the metrics by their samples and
    leaves a curve's term (``curve_sum`` over ``curve_n`` samples, of 255) its
    own; with equal samples both are one.
    """
    each = report(merged, keys).where("n > 0").withColumn("share", F.col("mae") / scale)
    s = each.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("share").alias("plain"), (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("mean"))
    term = F.lit(0.0) if curve_n is None else F.coalesce(F.try_divide(curve_sum, curve_n) / 255, F.lit(0.0))
    terms = F.lit(0) if curve_n is None else F.when(curve_n > 0, 1).otherwise(0)
    return s.select(*keys, (100 * (F.col("plain") + term) / (F.col("k") + terms)).alias("gap"), (100 * (F.col("k") * F.col("mean") + term) / (F.col("k") + terms)).alias("weighted_gap"))
