"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import archive_round_trip
from .language import identify
from .negatives import hard_negatives, scaled
from .ngram_join import ngram_jaccard
from .packing import pack
from .passages import duplicate_passages
from .periods import run_report, with_planted_repeats
from .positional import decontaminate
from .pseudonyms import pseudonymize
from .quality import quality
from .secrets import secret_report
from .vectors import near_vectors
from .webtext import main_text

# Stands for the key that a real run is given.
SECRET = "0f" * 32


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_passages(_table(spark, folder, "documents"))


def op4_language_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return identify(_table(spark, folder, "documents"))


def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(_table(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard(_table(spark, folder, "documents"))


def op7_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    return archive_round_trip(_table(spark, folder, "pages"))


def op8_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


def op10_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymize(_table(spark, folder, "documents"), SECRET)


def op11_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = scaled(_table(spark, folder, "embeddings"))
    # Every seventh row gets another label, so that near copies stand on both sides.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_tag_path_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(_table(spark, folder, "pages"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(with_planted_repeats(_table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules,
        op2_decontamination,
        op3_compact_windows,
        op4_language_kernels,
        op5_secret_scans,
        op6_ngram_join,
        op7_warc_packages,
        op8_vector_graph,
        op9_best_fit_packing,
        op10_feistel_pseudonyms,
        op11_cover_tree,
        op12_tag_path_ratios,
        op13_periodic_runs,
    )
}
