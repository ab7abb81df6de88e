"""Audit and transaction logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.audit import FIELDS, RECORD_SCHEMA, sorted_types
from ..operators.keyed import number_rows


def write_audit(records: DataFrame, path: str, chain: list[str]) -> None:
    """Append chained records, one folder per chain, field order kept.

    A chain segment is bounded, so it is written by one task, in sequence.
    """
    names = [*FIELDS, "prev", "hash"]
    fields = [sorted_types(F.col(n)).alias(n) if n == "types" else F.col(n) for n in names]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    (
        records.repartition(*[F.col(c) for c in chain])
        .sortWithinPartitions(*chain, "seq")
        .select(*chain, line)
        .write.mode("append")
        .partitionBy(*chain)
        .text(path)
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` with 0-based numbers, blank lines counted.

    Row ids hold the read partition and the place inside it, so only the line
    count of each partition has to be summed up.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    split = F.shiftright("_id", 33)
    sizes = rows.groupBy("file", split.alias("_split")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.col("_id")).alias("_first")
    )
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        rows.withColumn("_split", split)
        .join(starts, ["file", "_split"])
        .select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"), "value")
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or more chain files with ``file``, ``line_no`` and
    ``position`` (blank lines skipped). Unparsable lines have null fields."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    placed = number_rows(lines, ["file"], ["line_no"], out="position")
    record = F.from_json("value", RECORD_SCHEMA, {"mode": "PERMISSIVE"})
    return placed.select("file", "line_no", "position", record.alias("_r")).select(
        "file", "line_no", "position", "_r.*"
    )


def write_transactions(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "id string, ts bigint, route string, tenant string, method string, path string, status int, "
        "mode string, detected bigint, types map<string,bigint>, request string, "
        "request_truncated boolean, response string, response_truncated boolean"
    )
    return spark.read.schema(schema).json(path)
