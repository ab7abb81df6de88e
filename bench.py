"""Headline jobs over whole tables; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads. Each job
runs once after a short warm-up; its rows go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import audit
from palimpsest.operators.detect import detect
from palimpsest.operators.mask import mask_request, mask_session
from palimpsest.operators.rehydrate import rehydrate
from palimpsest.operators.ruleset import Names, Rule, Ruleset, curated
from palimpsest.plans import catalog
from palimpsest.plans.stage import stage

SECRET = catalog.SECRET


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # The tables are single small files: split them over the threads.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def jobs(spark: SparkSession, folder: str):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    # One row group cannot be split by the reader.
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    two = Ruleset(catalog.RULES.rules[:2])
    pack = curated(entropy=False)
    fifty = Ruleset(pack.rules + tuple(Rule(f"x{i}", "X", f"\\bkey{i:02d}_[0-9a-f]{{16}}\\b", 45) for i in range(28)))
    kept: dict[str, DataFrame] = {}

    def session_job(sharded: bool) -> DataFrame:
        masked, vault = mask_session(
            detect(docs, catalog.RULES), SECRET, ["doc_id"], "source", ["doc_id"], sharded=sharded, stage=stage
        )
        kept["masked"], kept["vault"] = masked, vault
        return masked

    def stored() -> tuple[DataFrame, DataFrame]:
        kept["stored"] = stage(kept["masked"].select("doc_id", "source", "masked"), "masked")
        kept["chains"] = stage(catalog._chains(spark, folder), "chains")
        return kept["stored"], kept["vault"]

    yield "scan", lambda: docs.select(F.length("text"))
    yield "find_spans_2_rules", lambda: detect(docs, two)
    yield "find_spans_22_rules", lambda: detect(docs, pack)
    yield "find_spans_22_rules_unguarded", lambda: detect(docs, pack, guarded=False)
    yield "find_spans_50_rules", lambda: detect(docs, fifty)
    yield "find_spans_entropy", lambda: detect(docs, curated())
    yield "find_spans_names", lambda: detect(docs, Ruleset(names=Names(True)))
    yield "mask_request", lambda: mask_request(docs, pack, SECRET, "doc_id")
    yield "mask_session", lambda: session_job(False)
    yield "mask_sharded", lambda: session_job(True)
    masked, vault = stored()
    yield "rehydrate", lambda: rehydrate(masked, vault, SECRET, ["doc_id"], "source")
    yield "chain_verify", lambda: audit.chain_verify(kept["chains"], ["chain", "segment"])
    for name in ("glossary_spans", "glossary_large", "resolve_mixed", "mask_session_scope", "mask_json_bodies",
                 "audit_chain", "sse_rehydrate", "route_match", "effective_policy", "compliance"):
        yield name, lambda name=name: catalog.QUERIES[name](spark, folder)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    only = set(sys.argv[1:])
    # Warm the JVM on a little data that is thrown away.
    small = spark.read.parquet(f"{folder}/benchmark.parquet")
    mask_request(small, curated(), SECRET, "item_id").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name, build in jobs(spark, folder):
        if only and name not in only and name not in ("mask_session", "mask_sharded"):
            continue
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
