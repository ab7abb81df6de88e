"""Reports: counts by type, never values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import explode_once, let

UNTYPED = "UNTYPED"


def report_of(spans: Column) -> Column:
    """``struct<by_type: map, total, summary>`` of one row's spans."""

    def tally(types: Column) -> Column:
        names = F.array_sort(F.array_distinct(types))
        pairs = F.transform(
            names,
            lambda n: F.struct(
                n.alias("key"),
                F.size(F.filter(types, lambda t: t == n)).cast("bigint").alias("value"),
            ),
        )
        return let(
            pairs,
            lambda p: F.struct(
                F.map_from_entries(p).alias("by_type"),
                F.size(types).cast("bigint").alias("total"),
                _joined(p).alias("summary"),
            ),
        )

    return let(F.transform(spans, lambda s: F.coalesce(s["ty"], F.lit(UNTYPED))), tally)


def _joined(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"].cast("string"))), ","
    )


def summary(by_type: Column) -> Column:
    """``EMAIL=2,SECRET=1`` in byte order of the types; empty if none."""
    return _joined(F.array_sort(F.map_entries(by_type)))


def report(spans: DataFrame, key: Sequence[str], ty: str = "ty") -> DataFrame:
    """Report per key over exploded spans."""
    counted = spans.groupBy(*key, F.coalesce(F.col(ty), F.lit(UNTYPED)).alias("_ty")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_ty").alias("key"), F.col("_n").alias("value"))))
    return (
        counted.groupBy(*key)
        .agg(pairs.alias("_pairs"), F.sum("_n").alias("total"))
        .select(
            *key,
            F.map_from_entries("_pairs").alias("by_type"),
            "total",
            _joined(F.col("_pairs")).alias("summary"),
        )
    )


def compliance_report(
    reported: DataFrame, dims: Sequence[str], report: str = "report", rollup: bool = False
) -> DataFrame:
    """Detections by dimensions and type."""
    flat = reported.select(*dims, F.explode(F.col(report)["by_type"]).alias("ty", "n"))
    grouped = flat.rollup(*dims, "ty") if rollup else flat.groupBy(*dims, "ty")
    return grouped.agg(F.sum("n").alias("detected"), F.count(F.lit(1)).alias("rows_hit"))


def distinct_originals(
    detected: DataFrame, scope: Sequence[str], spans: str = "spans", approximate: bool = False
) -> DataFrame:
    """Distinct originals per scope; the sketch form for whole corpora."""
    flat = explode_once(detected, spans, *scope, out="_s").select(
        *scope, F.col("_s.original").alias("original")
    )
    if approximate:
        return flat.groupBy(*scope).agg(F.approx_count_distinct("original").alias("originals"))
    # Two steps: a hot scope is deduplicated over all tasks first.
    return flat.distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("originals"))


def coverage_by_detector(detected: DataFrame, candidates: str, accepted: str) -> DataFrame:
    """Candidates against accepted spans per detector: what was shadowed."""

    def side(column: str, flag: int) -> DataFrame:
        return explode_once(detected, column).select(
            F.col("s.detector").alias("detector"), F.lit(flag).alias("_kept")
        )

    return (
        side(candidates, 0)
        .unionAll(side(accepted, 1))
        .groupBy("detector")
        .agg(
            F.sum(1 - F.col("_kept")).alias("candidates"),
            F.sum("_kept").alias("accepted"),
        )
        .withColumn("shadowed", F.col("candidates") - F.col("accepted"))
    )


def worst(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``by`` (a top-k report)."""
    return df.orderBy(F.col(by).desc(), *[c for c in df.columns if c != by]).limit(n)
