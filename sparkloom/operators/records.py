"""Keyed records: nearest match under a limit, merged updates, reconciliation, discards, budgets, number allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import ranks


def nearest_within(left: DataFrame, right: DataFrame, key: str, x: str, left_id: str, right_id: str, most: float) -> DataFrame:
    """(left id, right id, distance): for each left row the right row of its key with the nearest x, at most ``most`` away.

    Ties go to the smaller x, then to the smaller right id. Rows with a null
    key or x find nothing and are not found. The sides are put in one order, in
    ranges (`ranks.between`), so the work does not grow with the pairs of a key.
    """
    r = right.where(F.col(key).isNotNull() & F.col(x).isNotNull()).groupBy(key, x).agg(F.min(right_id).alias("__r"))
    side = F.struct(F.col(x).alias("x"), F.col("__r").alias("id"))
    both = r.select(key, x, F.lit(0).alias("__probe"), F.lit(None).cast(left.schema[left_id].dataType).alias("__l"), side.alias("__s"))
    probes = left.where(F.col(key).isNotNull() & F.col(x).isNotNull())
    both = both.unionByName(probes.select(key, x, F.lit(1).alias("__probe"), F.col(left_id).alias("__l"), F.lit(None).cast(both.schema["__s"].dataType).alias("__s")))
    both = ranks.between(both, [key], [x, "__probe"], "__s")
    below, above = F.col(x) - F.col("lo.x"), F.col("hi.x") - F.col(x)
    low = F.col("hi").isNull() | (below <= above)
    out = both.where("__probe = 1").select(F.col("__l").alias(left_id), F.when(low, F.col("lo.id")).otherwise(F.col("hi.id")).alias(right_id), F.when(low, below).otherwise(above).alias("distance"))
    return out.where(F.col("distance") <= most)


def merged_updates(log: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: the last value of each field that is not null, for an update leaves alone what it does not name.

    Rows with a null key or order are ignored; combines on the map side.
    """
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f)
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(*(last(f) for f in fields))


def reconcile(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, fields) of two tables with unique keys: added, removed, changed or same; null in ``new`` has no opinion."""
    a = old.select(key, F.struct(*fields).alias("__a"))
    b = new.select(key, F.struct(*fields).alias("__b"))
    both = a.join(b, key, "full")
    kept = {f: F.coalesce(F.col(f"__b.{f}"), F.col(f"__a.{f}")) for f in fields}
    same = F.lit(True)
    for f in fields:
        same = same & kept[f].eqNullSafe(F.col(f"__a.{f}"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select(key, state.alias("state"), *(kept[f].alias(f) for f in fields))


def without_discarded(rows: DataFrame, discards: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows whose column is in none of the listed (column, table, column of the table); each an equi-join, null matches nothing."""
    for column, gone, name in discards:
        rows = rows.join(gone.select(F.col(name).alias("__gone")), F.col(column) == F.col("__gone"), "left_anti")
    return rows


def budgeted_text(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """(key, n, block): the first texts of each key whose UTF-8 bytes, and a line feed for each, fit the budget, joined by line feeds.

    The first text that does not fit ends the block. Nulls are left out; keys
    of which nothing fits give no row. What is gathered is bounded by ``budget``.
    """
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    fit = rows.where(F.col(text).isNotNull()).select(key, order, text, F.sum(F.octet_length(text) + 1).over(w).alias("__used")).where(F.col("__used") <= budget)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return fit.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(lines, lambda r: r["t"]), "\n").alias("block"))


def allocate_numbers(requests: DataFrame, taken: DataFrame, key: str, order: str, number: str, mark: str) -> DataFrame:
    """Requests with a new number each, in order, above every number that is taken and above the high-water mark.

    A number once given is not given again, even where its row is gone: the
    mark remembers it. Keys without rows in ``taken`` begin at 1.
    """
    top = taken.groupBy(key).agg(F.greatest(F.max(number), F.max(mark)).cast("long").alias("__top"))
    n = F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long")
    return requests.join(top, key, "left").select(*requests.columns, (F.coalesce("__top", F.lit(0).cast("long")) + n).alias("allocated"))
