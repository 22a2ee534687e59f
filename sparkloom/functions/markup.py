"""Markup and message framing: nested elements, framed events, points and fractions written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def element_spans(docs: DataFrame, id_col: str, markup: str, names: list[str]) -> DataFrame:
    """(id, name, opened, closed, level): elements with the closing tag of their own depth; positions count the listed tags from 0.

    Depth is counted per name, so an element may hold others of its name.
    ``closed`` is null where the tag is never closed; closing tags without an
    opening one are left out, and lower the level of what follows by one. Null
    markup has no elements.
    """
    tag = f"</?(?:{'|'.join(names)})(?:[ \\t\\r\\n][^<>]*)?>"
    tags = docs.select(id_col, F.posexplode(F.regexp_extract_all(markup, F.lit(tag), 0)).alias("pos", "tag"))
    t = tags.select(id_col, "pos", F.regexp_extract("tag", "[a-z0-9]+", 0).alias("name"), F.when(F.col("tag").startswith("</"), -1).otherwise(1).alias("step"))
    depth = F.sum("step").over(W.partitionBy(id_col, "name").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("level", F.when(F.col("step") > 0, depth).otherwise(depth + 1))
    # within a level, opening and closing tags take turns
    w = W.partitionBy(id_col, "name", "level").orderBy("pos")
    t = t.withColumn("closed", F.when(F.lead("step").over(w) < 0, F.lead("pos").over(w)))
    return t.where("step > 0").select(id_col, "name", F.col("pos").alias("opened"), "closed", F.col("level").cast("int").alias("level"))


def framed_events(lines: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    """(key, event, data): event-stream lines framed into messages; events count from 0 in each key.

    A blank line ends a message. Its ``data:`` lines lose one space after the
    colon and are joined by line feeds; comments and other fields are passed
    over, messages without data are no events, and a message ``[DONE]`` ends
    the stream. Lines after the last blank one count as a message.
    """
    w = W.partitionBy(key).orderBy(*order)
    n = lines.where(F.col(line).isNotNull()).select(key, *order, line, F.sum(F.when(F.col(line) == "", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("m"))
    data = n.where(F.col(line).startswith("data:")).select(key, "m", F.struct(*order, F.regexp_replace(F.col(line), "^data: ?", "").alias("__t")).alias("r"))
    events = data.groupBy(key, "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["__t"]), "\n").alias("data"))
    by_event = W.partitionBy(key).orderBy("m")
    over = F.max(F.when(F.col("data") == "[DONE]", 1).otherwise(0)).over(by_event.rowsBetween(W.unboundedPreceding, 0))
    events = events.select(key, (F.row_number().over(by_event) - 1).alias("event"), "data", over.alias("over"))
    return events.where("over = 0").drop("over")


def curve_points(markup: Column, top: int = 255) -> Column:
    """Points ``x, y`` of list items as structs (x, y); items that are no two whole numbers from 0 to ``top`` are left out."""
    found = F.regexp_extract_all(markup, F.lit(r"<li>\s*(\d{1,9}\s*,\s*\d{1,9})\s*</li>"), 1)
    pairs = F.transform(found, lambda p: F.struct(F.trim(F.split(p, ",")[0]).cast("int").alias("x"), F.trim(F.split(p, ",")[1]).cast("int").alias("y")))
    return F.filter(pairs, lambda p: (p["x"] <= top) & (p["y"] <= top))


def fraction(text: Column) -> Column:
    """``n/d`` or a plain number as a double; null where it is neither, or d is zero."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, r"^([+-]?\d+(?:\.\d+)?)(?:/(\d+(?:\.\d+)?))?$", i)
    below = F.when(part(2) == "", 1.0).otherwise(part(2).try_cast("double"))
    return F.try_divide(part(1).try_cast("double"), below)


def strip_invisible(text: Column) -> Column:
    """Without the format characters (Unicode class Cf)."""
    return F.regexp_replace(text, r"\p{Cf}", "")
