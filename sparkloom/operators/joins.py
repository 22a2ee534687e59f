"""Joins with a table of one row per key that no frequent key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import staging

#: A key is frequent if it has more than one in so many rows, or in as many as rows of the table may be broadcast; there are fewer frequent keys than this.
HOT_SHARE = 5000
#: Bytes of the rows of frequent keys that are broadcast, at most.
HOT_BYTES = staging.BROADCAST_BYTES


def lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], how: str = "inner", row_bytes: int = 32, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row per key; ``how`` is inner, left, left_semi or left_anti.

    Both are written tables, for both are read more than once. A table of few
    bytes (``row_bytes`` each) is broadcast. Otherwise the table's rows of
    frequent keys are broadcast, so the rows with these keys stay where they
    are, and only the others are shuffled. A key counts as frequent only from a
    share that holds these rows under `HOT_BYTES`: of few
    ``rows`` every key has a large share. Null keys match nothing and are not
    shuffled either. ``counts`` (keys, __rows), a written table of how many of
    ``rows`` have a key, saves counting them; keys that it lacks are not frequent.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if table.count() * row_bytes <= staging.BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    present = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    known, nulls = rows.where(present), rows.where(f"NOT ({present})")
    most = min(HOT_SHARE, max(1, HOT_BYTES // row_bytes))
    counts = known.groupBy(*keys).agg(F.count("*").alias("__rows")) if counts is None else counts
    hot = counts.where(F.col("__rows") * most > rows.count()).select(*keys)
    hot = staging.materialize(hot, "hot-keys")
    hot_rows = known.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    out = known.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how).unionByName(hot_rows)
    if how in ("left", "left_anti"):
        out = out.unionByName(nulls, allowMissingColumns=True)
    return out.select(*keys, *(c for c in out.columns if c not in keys))
