"""Rehydrating fragmented response streams.

A placeholder may be cut anywhere between chunks. ``reframe`` holds back what
could still become one (fewer than 64 bytes per leaf) and emits rows that
never cut a placeholder; resolving these rows is stateless.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.codec import BASE62, U32_MAX
from ..functions.expr import explode_once, let
from ..functions.sentinel import CLOSE, MAX_SENTINEL_BYTES, OPEN, SEP
from ..operators.jsonpaths import ALL, leaves, tree_texts
from ..operators.rehydrate import join_chunks, rehydrate
from ..plans.stage import stage
from ..sources.exchanges import read_sse

_TAIL = re.compile(f"{SEP}([0-9A-Za-z]+){SEP}([0-9A-Za-z]+)\\Z")


def _number(text: str) -> int:
    n = 0
    for c in text:
        n = n * 62 + BASE62.index(c)
    return n


def _sentinel_end(text: str, start: int) -> int:
    """End of the placeholder that opens at ``start``, or -1."""
    close = text.find(CLOSE, start)
    if close < 0 or len(text[start : close + 1].encode()) > MAX_SENTINEL_BYTES:
        return -1
    m = _TAIL.search(text, start + len(OPEN), close)
    if m is None or max(map(_number, m.groups())) > U32_MAX:
        return -1
    return close + 1


def ready_length(text: str) -> int:
    """Characters of ``text`` that later chunks cannot change."""
    at = 0
    while True:
        start = text.find(OPEN, at)
        if start < 0:
            return len(text) - (1 if text.endswith(OPEN[0]) and len(text) > at else 0)
        end = _sentinel_end(text, start)
        if end > 0:
            at = end
        elif len(text[start : start + MAX_SENTINEL_BYTES].encode()) >= MAX_SENTINEL_BYTES:
            at = start + 1
        else:
            return start


def reframe(chunks: DataFrame, idle_seconds: int | None = 600, forget_seconds: int = 86_400) -> DataFrame:
    """Cut-free rows of ``(response_id, leaf_path, seq, text, eos)`` chunks.

    A row with ``eos`` ends its leaf, and so does an idle time (None:
    never, for streams that end). What is held
    then leaves with ``verbatim`` set: it is never resolved. Chunks that come
    after the end, or behind one already taken, get ``late``; what is known of
    an ended leaf is kept for ``forget_seconds`` after its last chunk.
    """
    idle_ms = None if idle_seconds is None else max(int(idle_seconds * 1000), 1)
    forget_ms = max(int(forget_seconds * 1000), 1)
    columns = ["response_id", "leaf_path", "seq", "text", "verbatim", "late"]

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        carry, last, closed, buried = state.get if state.exists else ("", -1, False, False)
        if state.hasTimedOut:
            if buried:
                state.remove()
                return
            # Only the end stays known, so that what comes later is late.
            state.update(("", last, True, True))
            state.setTimeoutDuration(forget_ms)
            if carry:
                yield pd.DataFrame([[*key, last, carry, True, False]], columns=columns)
            return
        out = []
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        seqs, texts, ends = (rows[c].tolist() for c in ("seq", "text", "eos"))
        # Sorted outside of the frame: most groups are small, and there are many.
        for i in np.argsort(rows["seq"].to_numpy(), kind="stable"):
            seq, text, eos = seqs[i], texts[i], ends[i]
            text = text if isinstance(text, str) else ""
            if closed or seq <= last:
                out.append((seq, text, True, True))
                continue
            carry, last = carry + text, int(seq)
            n = ready_length(carry)
            if n:
                out.append((seq, carry[:n], False, False))
            carry = carry[n:]
            if eos:
                closed = True
                if carry:
                    out.append((seq, carry, True, False))
                carry = ""
        state.update((carry, last, closed, buried))
        if idle_ms:
            state.setTimeoutDuration(forget_ms if buried else idle_ms)
        if out:
            names = [[k] * len(out) for k in key]
            yield pd.DataFrame(dict(zip(columns, [*names, *zip(*out)])))

    return chunks.groupBy("response_id", "leaf_path").applyInPandasWithState(
        step,
        "response_id string, leaf_path string, seq bigint, text string, verbatim boolean, late boolean",
        "carry string, last bigint, closed boolean, buried boolean",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )


class StreamResolver:
    """``foreachBatch`` body: resolve reframed rows against a vault table.

    ``vault`` is called per batch, so entries committed meanwhile are seen.
    ``scopes`` has ``response_id`` and ``scope_key``.
    """

    def __init__(self, vault, scopes: DataFrame, secret: bytes | str, out_path: str, late_path: str):
        self.vault, self.scopes, self.secret = vault, scopes, secret
        self.out_path, self.late_path = out_path, late_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch, "frames")
        key = ["response_id", "leaf_path", "seq", "verbatim"]
        on_time = rows.where(~F.col("late")).drop("late")
        named = on_time.where(~F.col("verbatim")).join(self.scopes, "response_id", "left")
        done = rehydrate(
            named,
            self.vault(),
            self.secret,
            key,
            "scope_key",
            "text",
            "rehydrated",
            tail_mode="resolve",
        ).select(*key, "rehydrated")
        held = on_time.where("verbatim").select(*key, F.col("text").alias("rehydrated"))
        done.unionByName(held).write.mode("overwrite").parquet(f"{self.out_path}/batch_id={batch_id}")
        rows.where("late").drop("late", "verbatim").write.mode("overwrite").parquet(
            f"{self.late_path}/batch_id={batch_id}"
        )


def sse_chunks(bodies: DataFrame, key: str, paths: Sequence[str], body: str = "body") -> DataFrame:
    """Text chunks per concrete leaf of event streams, in order.

    Columns ``response_id, leaf_path, seq, text``. Leaves such as
    ``choices[0]…`` and ``choices[1]…`` never mix.
    """
    lines = read_sse(bodies, [key], body).where(F.col("payload").isNotNull())
    # An event has fewer than 2 ** 31 lines.
    place = F.shiftleft(F.col("event").cast("bigint"), 31) + F.col("line")
    return explode_once(
        lines.withColumn("_a", leaves(F.col("payload"), paths)),
        "_a",
        F.col(key).cast("string").alias("response_id"),
        place.alias("seq"),
        out="_l",
    ).select(
        "response_id", F.col("_l.path").alias("leaf_path"), "seq", F.col("_l.text").alias("text")
    )


def sse_texts(bodies: DataFrame, key: str, paths: Sequence[str], body: str = "body") -> DataFrame:
    """Whole text of each response leaf of recorded event streams.

    Columns ``response_id, leaf_path, text``. A recorded stream is one row, so its
    chunks are put together in place: each event is parsed once, and no chunk
    is shuffled.
    """
    if ALL in paths:
        return join_chunks(sse_chunks(bodies, key, paths, body), ["response_id", "leaf_path"])
    lines = F.flatten(F.transform(F.split(F.col(body), "\n\n"), lambda e: F.split(e, "\n")))
    data = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("data:")), F.trim(F.substr(x, F.lit(6)))))
    events = F.filter(data, lambda x: x.isNotNull() & (x != "[DONE]"))
    chunks = F.flatten(F.transform(events, lambda x: let(F.try_parse_json(x), lambda v: tree_texts(v, paths))))
    ordered = F.array_sort(
        F.transform(chunks, lambda c, i: F.struct(c["path"].alias("path"), i.alias("i"), c["text"].alias("text")))
    )

    def joined(all_: Column) -> Column:
        heads = F.filter(
            F.transform(all_, lambda c, i: F.when(F.coalesce(F.get(all_, i - 1)["path"] != c["path"], F.lit(True)), i)),
            lambda i: i.isNotNull(),
        )

        def one(h: Column) -> Column:
            def leaf(first: Column, j: Column) -> Column:
                own = F.slice(all_, first + 1, F.coalesce(F.get(h, j + 1), F.size(all_)) - first)
                text = F.array_join(F.transform(own, lambda c: c["text"]), "")
                return F.struct(F.get(all_, first)["path"].alias("path"), text.alias("text"))

            return F.transform(h, leaf)

        return let(heads, one)

    whole = bodies.withColumn("_a", let(ordered, joined))
    return explode_once(whole, "_a", F.col(key).cast("string").alias("response_id"), out="_l").select(
        "response_id", F.col("_l.path").alias("leaf_path"), F.col("_l.text").alias("text")
    )


def rehydrate_sse(
    bodies: DataFrame,
    vault: DataFrame,
    secret: bytes | str,
    key: str,
    scope: str,
    paths: Sequence[str],
    body: str = "body",
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Whole rehydrated text per response leaf of recorded event streams.

    ``keep`` (see ``plans.stage``) writes the reassembled texts once, because
    rehydration reads them more than once.
    """
    whole = sse_texts(bodies, key, paths, body)
    if keep is not None:
        whole = keep(whole, "responses")
    scopes = bodies.select(
        F.col(key).cast("string").alias("response_id"), F.col(scope).cast("string").alias("scope_key")
    )
    named = whole.join(scopes, "response_id")
    return rehydrate(
        named, vault, secret, ["response_id", "leaf_path"], "scope_key", "text", "rehydrated"
    ).select("response_id", "leaf_path", "rehydrated")
