"""Running sums, neighbours and quantiles per key, with no window over a bare key.

Rows are range-partitioned by key and order, so a key that holds all rows is
spread over all partitions. Sums are made per partition and key, carried over
the partition borders (one row a partition and key), and completed inside each
partition. Exact medians and quantiles are read off the running sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.joins import lookup
from sparkloom.staging import materialize, size_checked

_PART = "__part"


def _ranged(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows``, written with the number of the range that holds them; ranges are ordered as ``keys`` and ``order`` are."""
    return materialize(rows.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()), name)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Joined by range and key, null keys too; a carry table that is not small is shuffled as the windows of ``rows`` were."""
    carry = size_checked(materialize(carry.select(F.col(_PART).alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in carry.columns if c not in [_PART, *keys])), "carry"), 64)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col(_PART) == F.col("__p"))
    return rows.join(carry, same).drop("__p", *(f"__k{i}" for i in range(len(keys))), _PART)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], last: str | None = None) -> DataFrame:
    """``rows`` with ``<name>_below`` and ``<name>_all`` for each sum ``name`` of a column: before the row in its key, and over the key.

    With ``last`` also ``last_before``, that column in the row before (null in
    the first row of a key). Rows of one key that are equal in ``order`` follow
    each other in any order. Nulls in a summed column count as nothing.
    """
    table = _ranged(rows, keys, order, "ranged")
    parts = table.groupBy(_PART, *keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"{n}__s") for n, c in sums.items()), *([F.max_by(last, F.struct(*order)).alias("last__s")] if last else []))
    key = W.partitionBy(*keys)  # at most one row for each range
    before = key.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select(_PART, *keys, *(F.coalesce(F.sum(f"{n}__s").over(before), F.lit(0)).alias(f"{n}__c") for n in sums), *(F.sum(f"{n}__s").over(key).alias(f"{n}_all") for n in sums), *([F.lag("last__s").over(key.orderBy(_PART)).alias("last__c")] if last else []))
    inside = W.partitionBy(_PART, *keys).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, -1)
    table = table.select("*", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{n}__i") for n, c in sums.items()), *([F.lag(last).over(inside).alias("last__i"), (F.row_number().over(inside) == 1).alias("first__i")] if last else []))
    out = _with_carry(table, carry, keys)
    extra = [F.when(F.col("first__i"), F.col("last__c")).otherwise(F.col("last__i")).alias("last_before")] if last else []
    return out.select(*rows.columns, *((F.col(f"{n}__c") + F.col(f"{n}__i")).alias(f"{n}_below") for n in sums), *(f"{n}_all" for n in sums), *extra)


def between(rows: DataFrame, keys: list[str], order: list[str], mark: str) -> DataFrame:
    """``rows`` with ``lo`` and ``hi``: the nearest value of ``mark`` that is not null at or before a row of its key, and at or after it.

    Both are running windows, ``hi`` in falling order: a frame that ends with
    the key is read anew for every row, which costs the square of its rows.
    Marked rows of one key that are equal in ``order`` may stand for each other.
    """
    table = _ranged(rows, keys, order, "ranged")
    at = F.when(F.col(mark).isNotNull(), F.struct(*order))
    parts = table.groupBy(_PART, *keys).agg(F.min_by(mark, at).alias("first__s"), F.max_by(mark, at).alias("last__s"))
    key, inside = W.partitionBy(*keys), W.partitionBy(_PART, *keys)
    so_far = lambda c, w, to: F.last(c, True).over(w.rowsBetween(W.unboundedPreceding, to))
    carry = parts.select(_PART, *keys, so_far("last__s", key.orderBy(_PART), -1).alias("lo__c"), so_far("first__s", key.orderBy(F.desc(_PART)), -1).alias("hi__c"))
    table = table.select("*", so_far(mark, inside.orderBy(*order), 0).alias("lo__i"), so_far(mark, inside.orderBy(*map(F.desc, order)), 0).alias("hi__i"))
    out = _with_carry(table, carry, keys)
    return out.select(*rows.columns, F.coalesce("lo__i", "lo__c").alias("lo"), F.coalesce("hi__i", "hi__c").alias("hi"))


def _name(q: float) -> str:
    return f"q{round(100 * q):02d}"


def step_quantiles(df: DataFrame, key: str, value: str, weight: Column, qs: list[float]) -> DataFrame:
    """(key, q05, ...): the least value at which the cumulative weight reaches each share.

    Equal values are one step; weights of zero or less, and nulls, are left out.
    """
    steps = df.select(key, value, weight.alias("w")).where((F.col("w") > 0) & F.col(value).isNotNull()).groupBy(key, value).agg(F.sum("w").alias("w"))
    r = running(steps, [key], [value], {"w": "w"})
    return r.groupBy(key).agg(*(F.coalesce(F.min(F.when(F.col("w_below") + F.col("w") >= q * F.col("w_all"), F.col(value))), F.max(value)).alias(_name(q)) for q in qs))


def interpolated_quantiles(df: DataFrame, key: str, value: str, weight: Column, qs: list[float]) -> DataFrame:
    """(key, q05, ...): rows sorted by value, values interpolated linearly over the cumulative weight as a share.

    At or below the first row's share the first value. Rows of equal value are
    taken by rising weight; null and negative weights count as zero, and where
    all are zero every row counts alike. Null values are left out. A key without
    rows has none.
    """
    rows = df.select(key, F.col(value).cast("double").alias("v"), F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w")).where("v IS NOT NULL")
    # a value's weight, its first row's (the rise from the value before), and rows, for keys without weight
    steps = rows.groupBy(key, "v").agg(F.sum("w").alias("w"), F.min("w").alias("rise"), F.count("*").alias("n"))
    r = running(steps, [key], ["v"], {"w": "w", "n": "n"}, last="v")
    some = F.col("w_all") > 0
    r = r.select(key, "v", "last_before", *(F.when(some, F.col(a)).otherwise(F.col(b).cast("double")).alias(c) for a, b, c in (("w_below", "n_below", "below"), ("w", "n", "own"), ("w_all", "n_all", "total"))), F.when(some, F.col("rise")).otherwise(1.0).alias("rise"))

    def at(q: float) -> Column:
        t = F.least(F.lit(q) * F.col("total"), F.col("total"))
        reached = F.col("below") + F.col("own") >= t
        part = F.try_divide(t - F.col("below"), F.col("rise"))
        found = F.when(F.col("last_before").isNotNull() & (t < F.col("below") + F.col("rise")), F.col("last_before") + part * (F.col("v") - F.col("last_before"))).otherwise(F.col("v"))
        return F.coalesce(F.min_by(F.when(reached, found), F.when(reached, F.col("v"))), F.max("v")).alias(_name(q))  # sums made in another order may not reach 1

    return r.groupBy(key).agg(*map(at, qs))


def mid_shares(df: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """(key, value, w, q): cumulative weight below a value plus half of its own, as a share; one row per distinct value; no weights of zero or less."""
    steps = df.select(key, value, weight.alias("w")).where(F.col(value).isNotNull() & (F.col("w") > 0)).groupBy(key, value).agg(F.sum("w").alias("w"))
    r = running(steps, [key], [value], {"w": "w"})
    return r.select(key, value, "w", F.try_divide(F.col("w_below") + F.col("w") / 2, F.col("w_all")).alias("q"))


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, upper, n): the mean of both middle values, the one at position n div 2 (from 0), and the rows; nulls are left out."""
    steps = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    r = running(steps, [key], [value], {"n": "n"})

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("n_below") <= place) & (place < F.col("n_below") + F.col("n")), F.col(value)))

    upper = at(F.floor(F.col("n_all") / 2))
    return r.groupBy(key).agg(((at(F.floor((F.col("n_all") - 1) / 2)) + upper) / 2).alias("median"), upper.alias("upper"), F.max("n_all").alias("n"))


def deviations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every row (of keys that are not null) with its key's median and median absolute deviation, columns med and mad."""
    med = materialize(medians(df, key, value).select(key, F.col("median").alias("med")), "medians")
    apart = lookup(df.select(key, value), med, key).select(key, F.abs(F.col(value) - F.col("med")).alias("d"))
    mad = materialize(medians(apart, key, "d").select(key, F.col("median").alias("mad")), "medians")
    return lookup(lookup(df, med, key), mad, key)
