"""Ordered release: results that arrive in any order leave in the order of their index, on streams and batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def releasable(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Rows of a batch that an ordered writer could have written: those whose index, and all below it from 0, are there.

    Of rows that repeat an index one is taken as present; all its copies leave.
    """
    w = W.partitionBy(key).orderBy(index)
    ranked = rows.where(F.col(index) >= 0).withColumn("__rank", F.dense_rank().over(w) - 1)
    return ranked.where(F.col("__rank") == F.col(index)).drop("__rank")


def release_in_order(stream: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """(key, index, value) of a stream, each key's rows in order of index from 0; rows wait in state until those below came.

    An index that was released, or waits already, is ignored when it comes
    again. State holds what waits, per key. Null keys and indexes are dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"{key} {kinds[key]}, {index} long, {value} {kinds[value]}"
    held = f"next long, indexes array<long>, held array<{kinds[value]}>"

    def run(name: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, waiting = 0, {}
        if state.exists:
            at, indexes, values = state.get
            waiting = dict(zip(indexes, values))
        for part in parts:
            for i, v in zip(part[index], part[value]):
                if i >= at:
                    waiting.setdefault(int(i), v)
        ready = []
        while at in waiting:
            ready.append((name[0], at, waiting.pop(at)))
            at += 1
        state.update((at, list(waiting), list(waiting.values())))
        if ready:
            yield pd.DataFrame(ready, columns=[key, index, value])

    rows = stream.select(key, F.col(index).cast("long").alias(index), value).where(F.col(key).isNotNull() & F.col(index).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


def first_of_each(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, within ``late`` of its first row; state older than that is forgotten."""
    rows = stream.withColumn("__t", F.col(time).cast("timestamp"))
    return (rows.withWatermark("__t", late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else rows.dropDuplicates(keys)).drop("__t")
