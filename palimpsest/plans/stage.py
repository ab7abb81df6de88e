"""Written intermediate tables.

Plans that read one intermediate result several times write it once, as
parquet in the shared folder the session names, so that lost executors cost a
re-read and not a re-run, and so that later joins know its size. They go when
the session ends: some hold texts before masking.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or a folder of its warehouse on a local master without one."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/palimpsest-stages"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return folder.rstrip("/")


def stage(df: DataFrame, name: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Rows are parted into folders by the columns ``by``, which come last.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
