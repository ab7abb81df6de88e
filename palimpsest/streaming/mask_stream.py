"""Masking unbounded input.

* request scope: ``operators.mask.mask_request`` is one projection and runs on
  a stream as it is;
* session scope with an idle timeout: ``mask_session_stream`` keeps one small
  state per session;
* session scope over a vault table: ``VaultMasker`` interns each micro-batch
  with the batch operators, which also serves scopes of any size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expr import explode_once
from ..functions.sentinel import mac_pads, scope_key_hex
from ..operators.detect import detect
from ..operators.mask import apply_spans, mask_session
from ..operators.report import report_of
from ..operators.ruleset import Ruleset
from ..operators.vault import row_scope
from ..plans.stage import stage
from ..sources.config import Settings, load_settings
from ..sources.vault_store import commit_batch, read_vault

_SPANS = (
    "array<struct<start:int,end:int,byte_start:int,byte_end:int,ty:string,priority:int,"
    "detector:string,original:string>>"
)
_STATE = "next_id bigint, originals array<string>, ids array<bigint>"


def stream_texts(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """An unbounded table of texts from a folder of files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def mask_session_stream(
    texts: DataFrame,
    ruleset: Ruleset,
    secret: bytes | str,
    key: str,
    scope: str,
    order: str,
    text: str = "text",
    ttl_seconds: int | None = 1800,
    style: str = "typed-sentinel",
) -> DataFrame:
    """Mask a stream with one vault per session, forgotten after ``ttl_seconds``
    without access (None: never, for streams that end). Adds ``masked``, ``entries`` (ids used by the row) and
    ``report``. Columns kept: key, scope, order, text. A row without a session has a vault of its own,
    named by its key."""
    detected = detect(
        texts.select(
            F.col(key).cast("string").alias(key),
            row_scope(scope, [key]).alias("scope_key"),
            F.col(order).cast("bigint").alias(order),
            F.col(text).alias(text),
        ),
        ruleset,
        text,
    )
    flat = detected.select(
        key,
        "scope_key",
        order,
        text,
        F.to_json("spans").alias("spans"),
        F.transform("spans", lambda s: s["original"]).alias("originals"),
    )
    ttl_ms = None if ttl_seconds is None else max(int(ttl_seconds * 1000), 1)

    def number(
        scope_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        next_id, originals, ids = state.get if state.exists else (0, [], [])
        known = dict(zip(originals, ids))
        rows = pd.concat(list(batches), ignore_index=True).sort_values([order, key])
        out = []
        for found in rows["originals"]:
            row = []
            for o in found:
                if o not in known:
                    known[o] = next_id
                    next_id += 1
                row.append(known[o])
            out.append(row)
        state.update((next_id, list(known), list(known.values())))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        rows["ids"] = out
        yield rows[[key, "scope_key", order, text, "spans", "ids"]]

    numbered = flat.groupBy("scope_key").applyInPandasWithState(
        number,
        f"{key} string, scope_key string, {order} bigint, {text} string, spans string, ids array<bigint>",
        _STATE,
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout,
    )
    spans = F.zip_with(
        F.from_json("spans", _SPANS), "ids", lambda s, i: s.withField("id", i)
    )
    ready = numbered.withColumn("_s", spans)
    pads = mac_pads(scope_key_hex(secret, F.col("scope_key")))
    used = F.array_distinct(
        F.transform("_s", lambda s: F.struct(s["id"].alias("id"), s["original"].alias("original")))
    )
    return ready.select(
        key,
        "scope_key",
        order,
        text,
        apply_spans(F.col(text), F.col("_s"), lambda s: s["id"], pads, style).alias("masked"),
        used.alias("entries"),
        report_of(F.col("_s")).alias("report"),
    )


class RuleRefresher:
    """The newest valid settings of a file.

    The first load must succeed. Later, a file that cannot be read or does not
    check keeps the last good settings in force, so a bad edit never turns
    masking off.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self.settings: Settings = load_settings(spark, path)
        self.last_error: Exception | None = None

    def current(self) -> Settings:
        try:
            self.settings = load_settings(self._spark, self._path)
            self.last_error = None
        except Exception as e:  # noqa: BLE001 - any failure keeps the last good rules
            self.last_error = e
        return self.settings


class VaultMasker:
    """``foreachBatch`` body: intern, commit the vault, then write the rows.

    The order matters: a masked row may only leave once its originals are
    stored. A replayed batch ignores what its first attempt stored and
    replaces it, so the outcome is the same. ``glossary`` as in ``detect``; terms
    may be as many as a table holds.
    """

    def __init__(
        self,
        rules: Ruleset | RuleRefresher,
        secret: bytes | str,
        vault_path: str,
        out_path: str,
        key: Sequence[str],
        scope: str,
        order: Sequence[str],
        text: str = "text",
        style: str = "typed-sentinel",
        sharded: bool = False,
        passphrase: str | None = None,
        glossary: DataFrame | None = None,
    ):
        self.rules, self.secret = rules, secret
        self.vault_path, self.out_path = vault_path, out_path
        self.key, self.scope, self.order = list(key), scope, list(order)
        self.text, self.style, self.sharded = text, style, sharded
        self.passphrase, self.glossary = passphrase, glossary

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rules = self.rules.current().ruleset if isinstance(self.rules, RuleRefresher) else self.rules
        if batch_id == 0:
            empty = spark.createDataFrame(
                [], "scope_key string, id bigint, original string, ty string, first_seen bigint, uses bigint"
            )
            commit_batch(empty, self.vault_path, -1, self.passphrase)
        # Of the vault, only the buckets of the batch's own scopes are opened.
        scopes = batch.select(row_scope(self.scope, self.key).alias("scope_key"))
        known = read_vault(spark, self.vault_path, self.passphrase, scopes, before_batch=batch_id)
        masked, new = mask_session(
            detect(batch, rules, self.text, glossary=self.glossary, key=self.key),
            self.secret,
            self.key,
            self.scope,
            self.order,
            vault=known,
            text=self.text,
            style=self.style,
            sharded=self.sharded,
            stage=stage,
        )
        commit_batch(new, self.vault_path, batch_id, self.passphrase)
        masked.drop(self.text).write.mode("overwrite").parquet(
            f"{self.out_path}/batch_id={batch_id}"
        )


def detection_metrics(
    texts: DataFrame,
    ruleset: Ruleset,
    ts: str = "ts",
    text: str = "text",
    window: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Findings by type per event-time window; late rows up to ``delay`` count."""
    found = explode_once(detect(texts, ruleset, text), "spans", ts, out="_s")
    return (
        found.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"), F.col("_s.ty").alias("ty"))
        .agg(F.count(F.lit(1)).alias("detected"))
        .select(F.col("w.start").alias("window_start"), "ty", "detected")
    )
