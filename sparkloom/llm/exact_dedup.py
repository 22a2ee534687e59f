"""Exact deduplication on the JVM: 128-bit content hash, then a byte comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text import ascii_lower
from sparkloom.operators.joins import lookup
from sparkloom.staging import materialize


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. ``keep`` ("max" or "min") says which id of a group stays.

    Rows are grouped by the MD5 of the text. Texts of groups with two rows or
    more are then compared byte by byte (smallest against largest text of the
    group); groups that hold a collision are grouped again by the text itself.
    Only digests and ids of the other rows are shuffled, counts combine on the
    map side, and a group of copies of any size is one row of the group table.

    Null text is the empty text. Rows with a null id take part; ``keep_id`` is
    null only if no row of the group has an id. Rows that repeat an id with
    the same text are the same document: each counts in ``group_size`` and each
    is ``kept``. Other columns are ignored. An empty table gives no rows.
    """
    best = {"max": F.max, "min": F.min}[keep]
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    digest = F.unhex(F.md5("norm"))
    rows = materialize(texts.select("doc_id", digest.alias("digest"), F.sha2("norm", 256).alias("text_sha256")), "dedup-digests")
    groups = rows.groupBy("digest").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups.where("group_size > 1"), "dedup-groups")

    collided = _collisions(texts.withColumn("digest", digest), groups)
    out = lookup(rows, groups, "digest", "left", row_bytes=96)
    if not collided.isEmpty():
        out = _by_text(out, texts.withColumn("digest", digest), collided, best)
    # a digest that is not in the group table belongs to one row, which stays
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _collisions(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests under which two different texts were found."""
    ends = lookup(texts, groups.select("digest"), "digest", "left_semi", row_bytes=96).groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return materialize(ends.where("lo <> hi").select("digest"), "dedup-collisions")


def _by_text(out: DataFrame, texts: DataFrame, collided: DataFrame, best) -> DataFrame:
    """Replace the rows of collided digests by rows grouped by digest and text."""
    again = texts.join(collided, "digest", "left_semi")
    exact = again.groupBy("digest", "norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    fixed = again.join(exact, ["digest", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
    return out.join(collided, "digest", "left_anti").unionByName(fixed.select(*out.columns))


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the largest id of each group of equal texts, with all its columns.

    Rows are told apart by id and text: an id that repeats with another text is
    another row, and of rows that repeat both one stays. A row without an id
    stays only where its group has no id.
    """
    from sparkloom.llm.rows import drop_rows

    # only rows of groups of two or more can go
    verdict = exact_dedup(docs, id_col, text_col).where("group_size > 1").select("doc_id", F.unhex("text_sha256").alias("digest"), "kept")
    verdict = materialize(verdict, "dedup-verdict")
    repeated = verdict.where("kept").groupBy("doc_id", "digest").count().where("count > 1")
    return drop_rows(docs, verdict.where("NOT kept"), repeated, id_col, F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)))
