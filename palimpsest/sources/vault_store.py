"""Vault tables on storage, as a log of batches.

A batch is written to a folder of its own, by buckets of scopes, and counts
once its manifest line is appended: a batch that was cut off is never read. A
batch written again replaces what it wrote; readers see the newest entry per
``(scope_key, id)``. Writers that own disjoint id ranges never clobber each other,
because entries are merged one by one. ``compact`` merges batches into one, and
readers that name their scopes open only those scopes' buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentinel import OVERFLOW_ID
from ..operators.vault import seal, unseal

BUCKETS = 64
_SCHEMA = "scope_key string, id bigint, original string, ty string, first_seen bigint, uses bigint"
_FIELDS = ["scope_key", "id", "original", "ty", "first_seen", "uses"]
_MANIFEST = "batch_id bigint, attempt bigint, folder string, base boolean"


def bucket_of(scope_key: Column) -> Column:
    return F.pmod(F.xxhash64(scope_key), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{path}/_manifest")


def live_batches(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """The folders that make up the vault: the last compaction, and each later batch's last attempt."""
    lines = _manifest(spark, path)
    if before_batch is not None:
        lines = lines.where(F.col("batch_id") < before_batch)
    last = F.max(F.struct("attempt", "folder", "base")).alias("_m")
    newest = lines.groupBy("batch_id").agg(last).select("batch_id", "_m.*")
    start = newest.where("base").agg(F.max("batch_id")).first()[0]
    return newest if start is None else newest.where(F.col("batch_id") >= start)


def _append(entries: DataFrame, path: str, batch_id: int, base: bool = False) -> None:
    """Write a folder of entries, then the line that makes it count."""
    spark = entries.sparkSession
    folder = f"folder={uuid.uuid4().hex}"
    (
        entries.withColumn("bucket", bucket_of(F.col("scope_key")))
        .repartition("bucket", F.pmod(F.xxhash64("original"), F.lit(16)))
        .write.partitionBy("bucket")
        .parquet(f"{path}/entries/{folder}")
    )
    last = None
    if _exists(spark, f"{path}/_manifest"):
        last = _manifest(spark, path).where(F.col("batch_id") == batch_id).agg(F.max("attempt")).first()[0]
    line = [(batch_id, 0 if last is None else last + 1, folder, base)]
    spark.createDataFrame(line, _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_manifest")


def commit_batch(
    entries: DataFrame, path: str, batch_id: int, passphrase: str | None = None
) -> None:
    """Write the entries of one batch. Reserved ids are never stored."""
    kept = entries.where(F.col("id") != OVERFLOW_ID).select(*_FIELDS)
    if passphrase is not None:
        kept = kept.withColumn("original", F.base64(seal(F.col("original"), passphrase)))
    _append(kept, path, batch_id)


def _stored(
    spark: SparkSession, path: str, scopes: list[str] | DataFrame | None, before_batch: int | None
) -> DataFrame:
    """Newest stored entries; originals as they lie there."""
    # One row per batch since the last compaction.
    live = live_batches(spark, path, before_batch).select("folder", "batch_id").collect()
    if not live:
        return spark.createDataFrame([], _SCHEMA)
    rows = (
        spark.read.schema(_SCHEMA + ", folder string, bucket int")
        .option("basePath", f"{path}/entries")
        .parquet(*[f"{path}/entries/{r['folder']}" for r in live])
    )
    if scopes is not None:
        wanted = scopes if isinstance(scopes, DataFrame) else spark.createDataFrame([(s,) for s in scopes], "scope_key string")
        wanted = wanted.select(F.col(wanted.columns[0]).cast("string").alias("scope_key")).distinct()
        # At most one row per bucket.
        buckets = [r[0] for r in wanted.select(bucket_of(F.col("scope_key"))).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(buckets)).join(wanted, "scope_key", "left_semi")
    batch = {r["folder"].removeprefix("folder="): r["batch_id"] for r in live}
    order = spark.createDataFrame(list(batch.items()), "folder string, batch_id bigint")
    rows = rows.join(order, "folder")
    newest = rows.groupBy("scope_key", "id").agg(
        F.max_by(F.struct("original", "ty", "first_seen", "uses"), "batch_id").alias("_e")
    )
    return newest.select("scope_key", "id", "_e.*")


def read_vault(
    spark: SparkSession,
    path: str,
    passphrase: str | None = None,
    scopes: list[str] | DataFrame | None = None,
    before_batch: int | None = None,
) -> DataFrame:
    """The merged vault. An unreadable folder is an error, never an empty vault.

    With a passphrase, entries that do not unseal are skipped. ``scopes`` (a
    list, or a table whose first column names them) opens only the buckets
    those scopes lie in. ``before_batch`` leaves out a batch that is being
    written again, and later ones.
    """
    merged = _stored(spark, path, scopes, before_batch)
    if passphrase is None:
        return merged
    opened = merged.withColumn("original", unseal(F.unbase64("original"), passphrase))
    return opened.where(F.col("original").isNotNull())


def unsealable(spark: SparkSession, path: str, passphrase: str) -> DataFrame:
    """Entries that ``read_vault`` skips; their placeholders stay verbatim."""
    merged = read_vault(spark, path)
    return merged.where(unseal(F.unbase64("original"), passphrase).isNull()).select("scope_key", "id")


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Merge all batches up to ``upto`` into one folder; later readers open it in their place.

    ``upto`` has to be done: no batch up to it may be written again. Sealed
    entries stay sealed. The folders before stay for readers that hold them.
    """
    _append(_stored(spark, path, None, upto + 1).select(*_FIELDS), path, upto, base=True)
