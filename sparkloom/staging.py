"""Written intermediate tables in the folder that all executors share.

Iterative operators and operators that read an expensive result twice write
it once as Parquet and read it back: that cuts the lineage, survives lost
executors, and gives the optimizer the true size of the table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
#: Keys of at most this many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
#: Tables and paths written inside the open `scratch` blocks, the innermost last.
_open: list[list[tuple[DataFrame, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; outside a cluster a folder of this process.

    Raises ValueError if a cluster names none: a machine-local folder would be
    invisible to the other machines.
    """
    base = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_DIR} to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set(_DIR, base)
    _delete_on_exit(spark, base)
    return base


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    for block in _open:
        block.append((out, path))
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block after which the tables written in it are deleted, but for those given to the function it yields.

    What leaves the block must not read any other of them.
    """
    block: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _open.append(block)
    try:
        yield keep
    finally:
        _open.pop()
        for table, path in block:
            if not any(table is k for k in kept):
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table written by this process."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_checked(keys: DataFrame, row_bytes: int = 32) -> DataFrame:
    """``keys`` (cheap to count: a written table) with a broadcast hint if it is small enough."""
    from pyspark.sql import functions as F

    return F.broadcast(keys) if keys.count() * row_bytes <= BROADCAST_BYTES else keys
