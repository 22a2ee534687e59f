"""Sources and sinks: tables in common formats, append-only state logs, text sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.texts import xml_unescape
from sparkloom.operators.matching import latest_rows

#: Options that make a format keep what it can: nulls apart from empty texts, times to the microsecond.
_OPTIONS = {
    "csv": {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "json": {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
}


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write as parquet, orc, csv or json, in folders by the columns ``by``."""
    w = df.write.format(kind).options(**_OPTIONS.get(kind, {})).mode(mode)
    (w.partitionBy(*by) if by else w).save(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """Read what ``write_table`` wrote; text formats need the schema, which saves a pass over the data."""
    r = spark.read.format(kind).options(**_OPTIONS.get(kind, {}))
    if schema is None and kind in _OPTIONS:
        raise ValueError(f"{kind} needs a schema")
    return (r.schema(schema) if schema is not None else r).load(path)


def append_log(rows: DataFrame, path: str, version: str, order: str) -> None:
    """Append rows to a log of JSON lines; each row carries the ``version`` of its writer and its place ``order``."""
    rows.withColumn("log_version", F.lit(version)).withColumn("log_order", F.col(order)).drop(*([order] if order != "log_order" else [])).write.mode("append").json(path)


def replay_log(spark: SparkSession, path: str, schema: str, key: str, version: str) -> DataFrame:
    """The last row of each key among those that ``version`` wrote; lines that are no such row are left out.

    ``schema`` names the columns of the rows but not the log's own.
    """
    full = f"{schema}, log_version string, log_order long"
    log = spark.read.schema(full).option("mode", "DROPMALFORMED").json(path).where((F.col("log_version") == version) & F.col(key).isNotNull())
    values = [f.name for f in log.schema.fields if f.name not in (key, "log_version", "log_order")]
    return latest_rows(log, key, ["log_order"], values)


def read_sidecars(spark: SparkSession, path: str, pattern: str = "*.xmp") -> DataFrame:
    """(path, name, value): every attribute name="value" of small XML texts below ``path``, entities decoded.

    A file is one row and one task reads many; attributes are taken by regular
    expression, in the order of the text.
    """
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    found = F.expr(r"""regexp_extract_all(value, '([A-Za-z_][\\w.:-]*)\\s*=\\s*("[^"]*"|\'[^\']*\')', 0)""")
    rows = files.select(F.input_file_name().alias("path"), F.explode(found).alias("a"))
    name = F.regexp_extract("a", r"^([^\s=]+)", 1)
    return rows.select("path", name.alias("name"), xml_unescape(F.regexp_extract("a", r"""(?s)^[^=]*=\s*["'](.*)["']$""", 1)).alias("value"))
