"""Reproducible shuffle into shards by a Feistel permutation of row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.staging import materialize

#: Rows that one task numbers, about.
BUCKET_ROWS = 1 << 20
#: Equal rows that one row of the written-out numbering stands for, at most.
REPEATS = 1 << 16


class FeistelPermutation:
    """A keyed bijection of 0 .. n-1, computable for any number by itself.

    A balanced Feistel network permutes the smallest even number of bits that
    holds n - 1; results of n or more are permuted again until they fall below
    n (cycle walking; under four steps on average).
    """

    def __init__(self, n: int, seed: int = 42, rounds: int = 6):
        if n < 0:
            raise ValueError("n must not be negative")
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (_mix(right ^ key) & self.mask)
        return (left << self.half) | right

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = self._once(np.asarray(rows, dtype=np.uint64))
        while (over := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[over] = self._once(x[over])
        return x.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 (fixed values)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_numbers(rows: DataFrame) -> tuple[DataFrame, int]:
    """Number the rows 0 .. n-1 in the order of the hash of all their columns, then of the columns; also their number.

    Returns the rows with __number. It depends on the rows alone: how many
    buckets of hash values are numbered side by side does not matter. Equal
    rows are one row with a count until they are numbered, so rows that repeat,
    in any number, burden no task. One small count per bucket reaches the driver.
    """
    kinds = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).withColumn("__hash", F.xxhash64(*rows.columns))
    kinds = materialize(kinds, "shard-kinds")
    total, most = kinds.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    bits = min(20, max(3, (total // BUCKET_ROWS).bit_length()))
    bucket = (F.shiftright("__hash", 64 - bits) + (1 << (bits - 1))).cast("int")
    counts = np.zeros((1 << bits) + 1, dtype=np.int64)
    for b, n in kinds.groupBy(bucket.alias("b")).agg(F.sum("__n")).collect():
        counts[b + 1] = n
    first = [(i, int(n)) for i, n in enumerate(np.cumsum(counts)[:-1]) if counts[i + 1]]
    first = rows.sparkSession.createDataFrame(first, "__bucket int, __first long")
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__bucket").orderBy("__hash", *rows.columns).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = kinds.withColumn("__bucket", bucket).withColumn("__before", before).join(F.broadcast(first), "__bucket")
    numbered = numbered.withColumn("__number", F.col("__first") + F.col("__before"))
    if most > REPEATS:
        start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(REPEATS).cast("long")))
        numbered = numbered.withColumn("__start", start).repartition(*rows.columns, "__start")
        numbered = numbered.withColumn("__number", F.col("__number") + F.col("__start")).withColumn("__n", F.least(F.col("__n") - F.col("__start"), F.lit(REPEATS)))
    each = F.explode(F.sequence(F.col("__number"), F.col("__number") + F.col("__n") - 1)).alias("__number")
    return numbered.select(*rows.columns, each), int(total)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shuffle all rows reproducibly into shards whose row counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law
    ("rows"), shard, slot (gapless from 0) and grown_shard (null under this law).
    A row's global number g goes through the Feistel permutation of all row
    numbers; shard is p mod shards, slot is p div shards, so either can be
    computed for one row without the others.

    Null text has size 1 and the CRC of no bytes. Null ids are ids like others;
    rows that agree in id, size and CRC may trade places. Other columns are ignored.
    An empty table gives no rows. Texts are not shuffled, only their digests.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered, total = row_numbers(rows)
    permute = FeistelPermutation(total, seed)

    @F.pandas_udf("long")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for n in numbers:
            yield pd.Series(permute(n.to_numpy()))

    p = F.col("__place")
    return numbered.withColumn("__place", place("__number")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (p % shards).cast("int").alias("shard"),
        F.floor(p / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
