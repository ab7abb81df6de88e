"""Request and response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the largest body that is processed, in bytes.
MAX_BODY_BYTES = 26214400


def read_exchanges(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(fmt).load(path)


def within_cap(body: Column, limit: int = MAX_BODY_BYTES) -> Column:
    return F.coalesce(F.octet_length(body), F.lit(0)) <= F.lit(limit)


def split_oversized(
    df: DataFrame, body: str = "body", limit: int = MAX_BODY_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` by body size."""
    fits = within_cap(F.col(body), limit)
    return df.where(fits), df.where(~fits)


def read_sse(df: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """One row per line of a server-sent event stream, in order.

    Events end at a blank line. ``payload`` holds the JSON of a ``data:`` line;
    it is null for lines that pass unchanged (comments, ``[DONE]``, other
    fields, unparsable data). ``ends`` marks the last line of an event.
    """
    flat = df.select(*key, F.posexplode(F.split(F.col(body), "\n\n")).alias("event", "_e"))
    lines = flat.where(F.col("_e") != "").select(
        *key, "event", F.posexplode(F.split("_e", "\n")).alias("line", "raw")
    )
    data = F.when(F.col("raw").startswith("data:"), F.trim(F.substr("raw", F.lit(6))))
    usable = (data != "[DONE]") & F.try_parse_json(data).isNotNull()
    return lines.withColumn("payload", F.when(usable, data))
