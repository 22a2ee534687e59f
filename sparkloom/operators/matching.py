"""Preference, prefix and bracket joins; resumable and incremental state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import ranks


def preference_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[Column, Column]]) -> DataFrame:
    """For each left row the right row of the first tier that matches; (left id, right id, tier from 1).

    A tier is a pair of key columns. Within a tier the smallest right id wins.
    Each tier is an equi-join on keys reduced to one row each.
    """
    found = None
    for i, (a, b) in enumerate(tiers, 1):
        keys = right.select(b.alias("__k"), F.col(right_id).alias("__r")).where("__k IS NOT NULL").groupBy("__k").agg(F.min("__r").alias("__r"))
        hit = left.select(F.col(left_id).alias("__l"), a.alias("__k")).join(keys, "__k").select("__l", F.lit(i).alias("tier"), "__r")
        found = hit if found is None else found.union(hit)
    best = found.groupBy("__l").agg(F.min(F.struct("tier", "__r")).alias("m"))
    return best.select(F.col("__l").alias(left_id), F.col("m.__r").alias(right_id), F.col("m.tier").alias("tier"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str, prefix: str) -> DataFrame:
    """For each distinct name the longest listed prefix that is not followed by a digit; (name, prefix).

    Names are expanded to their own prefixes of the lengths that occur, so the join is on equality.
    """
    p = prefixes.select(F.col(prefix).alias("__p")).where("length(__p) > 0").distinct()
    span = p.agg(F.min(F.length("__p")).alias("lo"), F.max(F.length("__p")).alias("hi"))
    n = names.select(F.col(name).alias("__n")).where("__n IS NOT NULL").distinct().join(F.broadcast(span)).where("length(__n) >= lo")
    cut = n.select("__n", F.explode(F.expr("sequence(lo, least(hi, length(__n)))")).alias("k")).where(~F.expr("substr(__n, k + 1, 1)").rlike("[0-9]"))
    hit = cut.select("__n", F.expr("substr(__n, 1, k)").alias("__p")).join(p, "__p")
    return hit.groupBy("__n").agg(F.max_by("__p", F.length("__p")).alias(prefix)).withColumnRenamed("__n", name)


def bracket_lerp(points: DataFrame, probes: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Value at each probe between the points on either side, linear in x; the nearest point's value beyond the ends.

    A probe at a point has its value. One union, put in order in ranges; no range join.
    """
    p = points.groupBy(key, x).agg(F.max(y).alias("y")).select(key, x, "y", F.lit(0).alias("probe"))
    q = probes.select(key, x, F.lit(None).cast("double").alias("y"), F.lit(1).alias("probe")).distinct()
    at = F.when(F.col("probe") == 0, F.struct(F.col(x).alias("x"), F.col("y").cast("double").alias("y")))
    both = ranks.between(p.unionByName(q).withColumn("at", at), [key], [x, "probe"], "at")
    lo, hi = F.col("lo"), F.col("hi")
    part = (F.col(x) - lo["x"]) / (hi["x"] - lo["x"])
    value = F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (lo["x"] == F.col(x)), lo["y"]).otherwise(lo["y"] + part * (hi["y"] - lo["y"]))
    return both.where("probe = 1").select(key, x, value.alias("value"))


def latest_rows(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key of an append-only log; combines on the map side."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("m"))
    return last.select(key, *(F.col(f"m.{v}").alias(v) for v in values))


def resume_plan(wanted: DataFrame, done: DataFrame, key: str, stamp: str) -> DataFrame:
    """What an interrupted job still has to do: (key, state) with state restored, stale or pending; leftovers are orphaned."""
    a = wanted.select(key, F.col(stamp).alias("__w"), F.lit(True).alias("__in"))
    b = done.select(key, F.col(stamp).alias("__d"), F.lit(True).alias("__was"))
    state = F.when(F.col("__in").isNull(), "orphaned").when(F.col("__was").isNull(), "pending").when(F.col("__w").eqNullSafe(F.col("__d")), "restored").otherwise("stale")
    return a.join(b, key, "full").select(key, state.alias("state"))


def reuse_slots(rows: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(id, digest, slot): rows of equal content share the slot of the smallest id, so work is done once per content."""
    d = rows.select(F.col(id_col).alias("id"), F.sha2(content, 256).alias("digest"))
    slots = d.groupBy("digest").agg(F.min("id").alias("slot"))
    return d.join(slots, "digest").select(F.col("id").alias(id_col), "digest", "slot")


def islands(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Runs of consecutive rows of a key for which ``flag`` holds: first, last, length."""
    w = W.partitionBy(key).orderBy(order)
    r = df.select(key, order, flag.alias("f")).withColumn("g", F.row_number().over(w) - F.row_number().over(W.partitionBy(key, "f").orderBy(order)))
    return r.where("f").groupBy(key, "g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("g")
