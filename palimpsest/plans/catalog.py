"""Registered queries: each operator over the given tables, whole.

Every entry takes ``(spark, folder)`` and returns a DataFrame of flat columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import base62_decode, base62_encode, id_space, parse_duration
from ..functions.expr import explode_once, let
from ..functions.sentinel import mac_pads, scope_key_hex, sentinel_encode, sentinel_tag
from ..functions.text import is_internal_address, json_escape, request_id, shannon_bits
from ..operators import audit, policy
from ..operators.detect import (
    candidate_spans,
    detect,
    detect_entropy,
    detect_literals,
    detect_rules,
    explode_spans,
    prefilter,
    resolve_overlaps,
    with_originals,
)
from ..operators.glossary import detect_literals_large
from ..operators.jsonpaths import (
    extract_leaves, mask_json, mask_json_session, mask_json_typed, typed_leaves, unmatched_paths,
)
from ..operators.mask import dry_run, mask_request, mask_session
from ..operators.rehydrate import (
    audit_sentinels,
    join_chunks,
    leak_check,
    rehydrate,
    rehydrate_inline,
    verify_round_trip,
)
from ..operators.report import (
    compliance_report,
    coverage_by_detector,
    distinct_originals,
    report,
    report_of,
    worst,
)
from ..operators.ruleset import Entropy, Names, Rule, Ruleset, Term, curated
from ..operators.vault import (
    first_seen,
    intern_session,
    intern_sharded,
    merge_vault,
    namespace,
    own_space,
    seal,
    sessionize,
    storable,
    unseal,
)
from ..sources.exchanges import read_sse, split_oversized
from ..sources.vault_store import commit_batch, compact, read_vault
from ..sources.terms import terms_from_dotenv, terms_from_kv_export, terms_from_lines
from ..streaming.mask_stream import detection_metrics, mask_session_stream, stream_texts
from ..streaming.rehydrate_stream import StreamResolver, reframe, rehydrate_sse
from .stage import shared_folder, stage

SECRET = "0f" * 32

# Explicit classes and no word boundary: these read alike in every dialect.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ASSIGNED = r"""(?i:token|secret|password|api_key)[ ]*[=:][ ]*["']?[A-Za-z0-9\-_./+]{12,}"""
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"

RULES = Ruleset(
    rules=(
        Rule("email", "EMAIL", EMAIL, 50),
        Rule("assigned", "SECRET", ASSIGNED, 60),
        Rule("ipv4", "IP", IPV4, 40),
    )
)
# Nested on purpose: the longest term at a position wins.
WORDS = (
    Term("que", "WORD", 10),
    Term("queeau", "WORD", 10),
    Term("schein", "NOUN", 10),
    Term("sch", "WORD", 10),
    Term("tion", "NOUN", 10),
    Term("the", "WORD", 10),
)
GLOSSARY = Ruleset(terms=WORDS)


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _epoch(ts: str) -> Column:
    """Seconds of a timestamp without zone, read as UTC."""
    day = F.unix_date(F.col(ts).cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly: a table of a few large row groups is read by as few tasks."""
    return rows.hint("rebalance")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "documents")


# --- detection --------------------------------------------------------------


def detect_email_counts(spark, d):
    docs = _documents(spark, d).select("doc_id", "text")
    found = detect(docs, Ruleset(rules=(RULES.rules[0],)))
    return found.select("doc_id", F.size("spans").cast("bigint").alias("emails")).where("emails > 0")


def detect_spans_multi(spark, d):
    found = detect(_documents(spark, d).select("doc_id", "text"), RULES)
    return explode_spans(found, ["doc_id"]).select(
        "doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("start", "end", "byte_start", "byte_end")],
        "ty",
        "original",
    )


def detect_pages(spark, d):
    found = detect(_t(spark, d, "pages").select("page_id", F.col("html").alias("text")), RULES)
    return explode_spans(found, ["page_id"]).select("page_id", F.col("start").cast("bigint"), "ty", "original")


def glossary_spans(spark, d):
    docs = _documents(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = _t(spark, d, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text"
    )
    found = docs.unionByName(turns).withColumn("spans", detect_literals(F.col("text"), WORDS))
    return explode_once(found, "spans", "id").select(
        "id", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), "s.ty"
    )


def _benchmark_terms(spark, d) -> DataFrame:
    """Every run of four words of the benchmark texts."""
    words = _t(spark, d, "benchmark").select(F.split("text", " ").alias("w"))
    runs = words.where(F.size("w") >= 4).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, F.lit(4)), " ")
            )
        ).alias("term")
    )
    return runs.distinct().select(
        F.xxhash64("term").alias("term_ord"),
        "term",
        F.lit("PASSAGE").alias("ty"),
        F.lit(70).alias("priority"),
        F.lit(None).cast("string").alias("tenant"),
    )


def glossary_large(spark, d):
    docs = _documents(spark, d).select("doc_id", "text")
    found = detect_literals_large(docs, _benchmark_terms(spark, d), ["doc_id"])
    return explode_once(found, "spans", "doc_id", "text").select(
        "doc_id",
        F.col("s.start").cast("bigint").alias("start"),
        F.col("s.end").cast("bigint").alias("end"),
        F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("original"),
    )


def glossary_reports(spark, d):
    """A large glossary inside detection."""
    docs = _documents(spark, d).select("doc_id", "text")
    found = dry_run(docs, Ruleset(), glossary=_benchmark_terms(spark, d), key=["doc_id"])
    return found.select("doc_id", F.col("report.total").alias("detected"))


def entropy_tokens(spark, d):
    cfg = Entropy(enabled=True, min_bits=3.5, min_len=20)
    docs = _documents(spark, d).select("doc_id", "text")
    found = docs.withColumn("spans", with_originals(F.col("text"), detect_entropy(F.col("text"), cfg)))
    return explode_once(found, "spans", "doc_id").select(
        "doc_id", F.col("s.start").cast("bigint").alias("start"), F.col("s.original").alias("token")
    )


def shannon(spark, d):
    keys = _t(spark, d, "orders").select(
        "o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("token")
    )
    return keys.select(
        "o_orderkey", F.round(shannon_bits(F.col("token")).cast("double"), 3).alias("bits")
    )


_MIXED = Ruleset(
    rules=RULES.rules,
    terms=(Term("token", "WORD", 55), Term("mail", "WORD", 70), Term("example.com", "HOST", 5)),
    entropy=Entropy(enabled=True, min_bits=3.0, min_len=20, priority=58, entity_type="RANDOM"),
)


def resolve_mixed(spark, d):
    found = detect(_documents(spark, d).select("doc_id", "text"), _MIXED)
    return explode_spans(found, ["doc_id"]).select(
        "doc_id", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "ty", F.col("priority").cast("bigint")
    )


def coverage(spark, d):
    docs = _documents(spark, d).select("text")
    both = docs.select(candidate_spans(F.col("text"), _MIXED).alias("candidates")).select(
        "candidates", resolve_overlaps(F.col("candidates")).alias("accepted")
    )
    return coverage_by_detector(both, "candidates", "accepted")


def prefilter_rows(spark, d):
    docs = _documents(spark, d)
    kept = docs.select("lang", prefilter(F.col("text"), RULES.rules).alias("may"),
                       (F.size(detect_rules(F.col("text"), RULES.rules)) > 0).alias("has"))
    return kept.groupBy("lang").agg(
        F.count_if("has").alias("rows_hit"), F.count_if(F.col("has") & ~F.col("may")).alias("rows_missed")
    )


def curated_rules(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    kind = F.pmod("o_orderkey", F.lit(9))
    shapes = [
        F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))),
        F.concat(F.lit("ghp_"), h, F.lit("abcd")),
        F.concat(F.lit("glpat-"), F.substring(h, 1, 20)),
        F.concat(F.lit("xoxb-"), h),
        F.concat(F.lit("sk_live_"), h),
        F.concat(F.lit("AIza"), h, F.lit("xyz")),
        F.concat(F.lit("sk-ant-"), h),
        F.concat(F.lit("npm_"), h, F.lit("WXYZ")),
    ]
    token = F.concat(F.lit("u"), h, F.lit("@mail.example.org"))
    for i, s in enumerate(shapes):
        token = F.when(kind == i, s).otherwise(token)
    text = F.concat(F.lit("order "), "o_orderkey", F.lit(" has ("), token, F.lit(") — done"))
    notes = _t(spark, d, "orders").select("o_orderkey", text.alias("text"))
    found = detect(notes, curated(entropy=False))
    return explode_spans(found, ["o_orderkey"]).select("o_orderkey", "ty", "original")


def curated_documents(spark, d):
    found = detect(_documents(spark, d).select("doc_id", "text"), curated())
    return explode_spans(found, ["doc_id"]).select("doc_id", F.col("start").cast("bigint"), "ty", "original")


def names_heuristic(spark, d):
    who = F.initcap("event_type")
    text = F.concat(
        F.lit("Dear "), who, F.lit(" Connor, my name is James "), who, F.lit(". ask wong, Dr. 42 O'"), who
    )
    notes = _t(spark, d, "events").select("event_id", text.alias("text"))
    found = detect(notes, Ruleset(names=Names(enabled=True)))
    return found.select("event_id", F.array_join(F.transform("spans", lambda s: s["original"]), "|").alias("names"))


def names_documents(spark, d):
    found = detect(_documents(spark, d).select("doc_id", "text"), Ruleset(names=Names(enabled=True)))
    return explode_spans(found, ["doc_id"]).select("doc_id", F.col("start").cast("bigint"), "original")


_FOUND = T.ArrayType(
    T.StructType()
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("ty", T.StringType())
    .add("priority", T.IntegerType())
)


@F.pandas_udf(_FOUND)
def _first_hash(text: pd.Series) -> pd.Series:
    at = text.str.find("#")
    return pd.Series(
        [[{"start": int(i), "end": int(i) + 1, "ty": "HASH", "priority": 1}] if i >= 0 else [] for i in at]
    )


def custom_detector(spark, d):
    found = detect(_documents(spark, d).select("doc_id", "text"), RULES, custom=[_first_hash])
    return explode_spans(found, ["doc_id"]).where("detector = 'custom'").select(
        "doc_id", F.col("start").cast("bigint"), F.col("byte_start").cast("bigint")
    )


def tenant_terms(spark, d):
    rules = Ruleset(
        terms=(Term("tion", "WORD", 10), Term("que", "OWN", 10, "src3"), Term("the", "OWN", 20, "src5"))
    )
    docs = _documents(spark, d).select("doc_id", "source", "text")
    found = detect(docs, rules, tenant="source")
    return explode_spans(found, ["doc_id", "source"]).groupBy("source", "ty").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- masking ----------------------------------------------------------------


def _request(spark, d, style="typed-sentinel") -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "text")
    return mask_request(docs, RULES, SECRET, "doc_id", style=style)


def mask_request_scope(spark, d):
    return _request(spark, d).select(
        "doc_id",
        "masked",
        F.col("report.summary").alias("summary"),
        F.size("entries").cast("bigint").alias("originals"),
    )


def mask_bare_style(spark, d):
    return _request(spark, d, "bare-sentinel").select("doc_id", "masked")


def dry_run_reports(spark, d):
    done = dry_run(_documents(spark, d).select("doc_id", "text"), RULES)
    return done.select(
        "doc_id", "text", F.col("report.total").alias("total"), F.col("report.summary").alias("summary")
    )


def reports_by_key(spark, d):
    found = detect(_documents(spark, d).select("source", "text"), RULES)
    return report(explode_spans(found, ["source"]), ["source"]).select("source", "total", "summary")


def _session(spark, d) -> tuple[DataFrame, DataFrame]:
    turns = _dealt(_t(spark, d, "conversations").select("conv_id", "turn", "text"))
    found = detect(turns, GLOSSARY)
    return mask_session(found, SECRET, ["conv_id", "turn"], "conv_id", ["turn"], stage=stage)


def mask_session_scope(spark, d):
    masked, _ = _session(spark, d)
    return masked.select("conv_id", "turn", "masked")


def _corpus_docs(spark, d) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "text", F.lit("corpus").alias("scope"))
    return detect(docs, RULES)


def _sharded(spark, d) -> tuple[DataFrame, DataFrame]:
    return mask_session(
        _corpus_docs(spark, d), SECRET, ["doc_id"], "scope", ["doc_id"],
        sharded=True, shard_hash="md5", stage=stage,
    )


def mask_sharded(spark, d):
    masked, _ = _sharded(spark, d)
    return masked.select("doc_id", "masked")


def intern_sharded_vault(spark, d):
    first = first_seen(_corpus_docs(spark, d), "scope", ["doc_id"])
    return intern_sharded(first, how="md5").select("scope_key", "id", "original", "ty", "uses")


def intern_overflow(spark, d):
    """Shards of two ids each: what does not fit gets the reserved id."""
    first = first_seen(_corpus_docs(spark, d), "scope", ["doc_id"])
    new = intern_sharded(first, shards=16, how="md5", shard_size=2)
    return new.select("id", "original")


def intern_hot_scope(spark, d):
    """One scope for all: numbered in ranges, not in one window."""
    first = first_seen(_corpus_docs(spark, d), "scope", ["doc_id"])
    return intern_session(first, target=20).select("scope_key", "id", "original")


def vault_merge(spark, d):
    old = stage(intern_session(first_seen(_corpus_docs(spark, d), "scope", ["doc_id"])), "vault")
    pages = _t(spark, d, "pages").select(
        "page_id", F.col("html").alias("text"), F.lit("corpus").alias("scope")
    )
    new = intern_session(first_seen(detect(pages, RULES), "scope", ["page_id"]), vault=old)
    return merge_vault(old, storable(new)).select("scope_key", "id", "original")


def vault_store_roundtrip(spark, d):
    """Some scopes of a vault that three batches, one of them twice, and a compaction have written."""
    _, vault = _session(spark, d)
    path = f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"
    part = F.pmod(F.col("scope_key").cast("bigint"), F.lit(3))
    for batch in (0, 1, 1, 2):
        commit_batch(vault.where(part == batch), path, batch)
        if batch == 1:
            compact(spark, path, 0)
    scopes = _t(spark, d, "conversations").where("conv_id % 5 = 0").select("conv_id")
    return stage(read_vault(spark, path, scopes=scopes).select("scope_key", "id", "original"), "vault")


def vault_own_space(spark, d):
    first = first_seen(_corpus_docs(spark, d), "scope", ["doc_id"])
    vault = intern_sharded(first, how="md5")
    return own_space(vault, 1024 << 20, 2048 << 20).select("id", "original")


def seal_roundtrip(spark, d):
    first = first_seen(_corpus_docs(spark, d), "scope", ["doc_id"])
    sealed = stage(first.select("original", seal(F.col("original"), "pass").alias("sealed")), "sealed")
    return sealed.select(
        "original",
        unseal(F.col("sealed"), "pass").alias("opened"),
        (F.octet_length("sealed") - F.octet_length("original")).cast("bigint").alias("overhead"),
        unseal(F.col("sealed"), "other").isNull().alias("wrong_key_fails"),
    )


def tag_keys(spark, d):
    keys = _t(spark, d, "events").select("event_id", "user_id")
    pads = mac_pads(scope_key_hex(SECRET, F.col("user_id")))
    return keys.select("event_id", let(pads, lambda p: sentinel_tag(p, F.col("event_id"))).alias("tag"))


def sentinels(spark, d):
    pads = mac_pads(SECRET)
    return _t(spark, d, "orders").select(
        "o_orderkey",
        sentinel_encode(F.col("o_orderpriority").substr(1, 1), F.col("o_orderkey"), sentinel_tag(pads, F.col("o_orderkey"))).alias("sentinel"),
    )


# --- rehydration ------------------------------------------------------------


def _by_source(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, d).select("doc_id", "source", "text")
    masked, vault = mask_session(
        detect(docs, RULES), SECRET, ["doc_id"], "source", ["doc_id"], stage=stage
    )
    return stage(masked.select("doc_id", "source", "text", "masked"), "masked"), vault


def rehydrate_join(spark, d):
    masked, vault = _by_source(spark, d)
    return rehydrate(masked.drop("text"), vault, SECRET, ["doc_id"], "source").select(
        "doc_id", "rehydrated"
    )


def round_trip(spark, d):
    back = _request(spark, d).withColumn(
        "rehydrated",
        rehydrate_inline(
            F.col("masked"), F.col("entries"), mac_pads(scope_key_hex(SECRET, F.col("doc_id")))
        ),
    )
    return back.agg(
        F.count_if(~F.col("text").eqNullSafe(F.col("rehydrated"))).alias("failures"),
        F.sum(F.length("rehydrated")).alias("chars"),
    )


def round_trip_failures(spark, d):
    masked, vault = _session(spark, d)
    back = rehydrate(stage(masked, "masked"), vault, SECRET, ["conv_id", "turn"], "conv_id")
    return verify_round_trip(back, "text", "rehydrated").select("conv_id", "turn")


def leaks_after_rehydration(spark, d):
    masked, vault = _by_source(spark, d)
    back = rehydrate(masked, vault, SECRET, ["doc_id"], "source")
    return leak_check(back, "rehydrated").select("doc_id")


def sentinel_audit(spark, d):
    masked, vault = _by_source(spark, d)
    planted = masked.withColumn(
        "masked", F.concat("masked", F.lit(" ⟦S:EMAIL·0·1⟧ ⟦S·zz⟧ ⟦S·4gfFC3·1⟧"))
    )
    return (
        audit_sentinels(planted, vault, SECRET, ["doc_id"], "source")
        .groupBy("verdict")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _cut(text: Column, width: int) -> Column:
    """``array<struct<seq,text>>``: the text in pieces of ``width`` characters."""
    last = F.greatest(F.call_function("div", F.length(text) - 1, F.lit(width)), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.cast("bigint").alias("seq"), F.substr(text, i * width + 1, F.lit(width)).alias("text")
        ),
    )


def chunk_rehydrate(spark, d):
    masked, vault = _by_source(spark, d)
    chunks = masked.select("doc_id", "source", F.explode(_cut(F.col("masked"), 700)).alias("c")).select(
        "doc_id", "source", "c.*"
    )
    whole = stage(join_chunks(chunks, ["doc_id", "source"]), "responses")
    return rehydrate(whole, vault, SECRET, ["doc_id"], "source", "text").select("doc_id", "rehydrated")


def _sse_bodies(masked: DataFrame) -> DataFrame:
    event = lambda c: F.concat(
        F.lit("data: "),
        F.to_json(F.struct(F.array(F.struct(F.struct(c["text"].alias("content")).alias("delta"))).alias("choices"))),
    )
    body = F.concat(
        F.array_join(F.transform(_cut(F.col("masked"), 9), event), "\n\n"), F.lit("\n\ndata: [DONE]\n\n")
    )
    return masked.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"), F.col("conv_id").alias("scope"), body.alias("body")
    )


def sse_rehydrate(spark, d):
    masked, vault = _session(spark, d)
    bodies = stage(_sse_bodies(masked), "bodies")
    return rehydrate_sse(bodies, vault, SECRET, "response_id", "scope", ["choices[].delta.content"], keep=stage)


def sse_lines(spark, d):
    turns = _t(spark, d, "conversations").withColumn("masked", F.col("text"))
    return (
        read_sse(_sse_bodies(turns), ["response_id"])
        .groupBy("response_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count("payload").alias("payloads"),
        )
    )


def rehydrate_json_body(spark, d):
    """Raw JSON text: originals are escaped on the way back in."""
    quoted = Ruleset(rules=(Rule("assigned", "SECRET", ASSIGNED + "\"?", 60),))
    docs = _documents(spark, d).select("doc_id", "source", "text")
    masked, vault = mask_session(
        detect(docs, quoted), SECRET, ["doc_id"], "source", ["doc_id"], stage=stage
    )
    bodies = masked.select("doc_id", "source", F.to_json(F.struct(F.col("masked").alias("t"))).alias("masked"))
    back = rehydrate(bodies, vault, SECRET, ["doc_id"], "source", encoding="json")
    return back.select("doc_id", F.get_json_object("rehydrated", "$.t").alias("text"))


# --- JSON bodies ------------------------------------------------------------


def _chat_bodies(spark, d) -> DataFrame:
    """One request body per conversation."""
    turns = _t(spark, d, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy("conv_id").agg(messages.alias("messages")).select(
        "conv_id", F.to_json(F.struct(F.lit("m").alias("model"), "messages")).alias("body")
    )


def json_path_leaves(spark, d):
    found = extract_leaves(_chat_bodies(spark, d), ["conv_id"], "body", ["messages[].content"])
    return found.select("conv_id", F.col("leaf_ord").cast("bigint"), "leaf_path", "text")


def _event_bodies(spark, d) -> DataFrame:
    nested = F.struct(
        F.col("event_type").alias("e"),
        F.array("event_type", F.to_json(F.struct(F.col("value").alias("v")))).alias("list"),
        F.struct(F.col("user_id").alias("n"), F.col("props").alias("z")).alias("o"),
    )
    events = _dealt(_t(spark, d, "events").select("event_id", "event_type", "value", "user_id", "props"))
    return events.select("event_id", nested.alias("typed"), F.to_json(nested).alias("body"))


def all_leaves(spark, d):
    found = extract_leaves(_event_bodies(spark, d).drop("typed"), ["event_id"], "body", ["**"])
    return found.groupBy("leaf_path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def all_leaves_typed(spark, d):
    bodies = _event_bodies(spark, d)
    kind = bodies.schema["typed"].dataType
    flat = bodies.select(F.explode(typed_leaves(F.col("typed"), kind)).alias("l"))
    return flat.groupBy(F.col("l.path").alias("leaf_path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("l.text")).alias("chars")
    )


def mask_json_bodies(spark, d):
    bodies = _documents(spark, d).select(
        "doc_id", F.to_json(F.struct(F.struct("text").alias("in"), "source")).alias("body")
    )
    done = mask_json(bodies, RULES, SECRET, "doc_id", paths=["in.text", "source"])
    return done.select(
        "doc_id",
        F.get_json_object("masked_body", "$.in.text").alias("masked"),
        F.col("report.summary").alias("summary"),
    )


def mask_json_all(spark, d):
    bodies = _documents(spark, d).select("doc_id", F.to_json(F.struct("text", "source")).alias("body"))
    done = mask_json(bodies, RULES, SECRET, "doc_id", paths=["**"])
    return done.select(
        "doc_id", F.get_json_object("masked_body", "$.text").alias("masked"), F.col("report.total").alias("total")
    )


def mask_json_typed_columns(spark, d):
    """Strings of a nested column, which keeps its type."""
    kept = F.struct("source", F.array(F.struct("text", F.lit(1).alias("n"))).alias("parts"))
    done = mask_json_typed(_documents(spark, d).select("doc_id", kept.alias("body")), RULES, SECRET, "doc_id")
    return done.select("doc_id", F.col("masked_body.parts")[0]["text"].alias("masked"), F.col("report.summary").alias("summary"))


def mask_json_in_session(spark, d):
    """Turns as request bodies that share a vault per conversation."""
    body = F.to_json(F.struct("role", F.array(F.struct(F.col("text").alias("content"))).alias("messages")))
    turns = _t(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))
    masked, _ = mask_json_session(
        turns, GLOSSARY, SECRET, ["conv_id", "turn"], "conv_id", ["turn"], paths=["messages[].content"], stage=stage
    )
    return masked.select("conv_id", "turn", F.get_json_object("masked_body", "$.messages[0].content").alias("masked"))


def json_unmatched(spark, d):
    paths = ["messages[].content", "messages[].parts[].text", "model[]"]
    return unmatched_paths(_chat_bodies(spark, d), ["conv_id"], "body", paths).groupBy("path").agg(
        F.count(F.lit(1)).alias("n")
    )


def _cut_bodies(spark, d) -> DataFrame:
    turns = _t(spark, d, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("content")))
    return turns.select(
        "conv_id",
        "turn",
        F.when(F.pmod("turn", F.lit(3)) == 0, F.substr(body, F.lit(1), F.length(body) - 2)).otherwise(body).alias("body"),
        F.when(F.pmod("turn", F.lit(2)) == 0, "enforce").otherwise("dry-run").alias("mode"),
    )


def fail_closed(spark, d):
    sent, refused = policy.fail_closed_split(_cut_bodies(spark, d))
    side = lambda df, name: df.select("conv_id", "turn", F.lit(name).alias("outcome"))
    return side(sent, "forwarded").unionByName(side(refused, "rejected"))


def oversized_bodies(spark, d):
    docs = _documents(spark, d).select("doc_id", F.col("text").alias("body"))
    fits, refused = split_oversized(docs, limit=4000)
    side = lambda df, name: df.select("doc_id", F.lit(name).alias("outcome"))
    return side(fits, "accepted").unionByName(side(refused, "refused"))


# --- policy -----------------------------------------------------------------


def _routes(spark) -> DataFrame:
    rows = [
        (0, "/click", None, "chat", None, None, None),
        (1, "/view/v1", None, "chat", "dry-run", "session", None),
        (2, "/view", None, "gone", "enforce", None, "bare-sentinel"),
        (3, "/err", None, None, "dry-run", None, None),
        (4, "", "h1.example.com", "bare", "enforce", None, None),
        (5, "", "h1.example.com", "chat", None, None, None),
        (6, "/purchase", None, "bare", None, "session", None),
    ]
    names = "listen_path string, host string, profile string, mode string, scope string, style string"
    return spark.createDataFrame(rows, "route_ord int, " + names)


def _profiles(spark) -> DataFrame:
    rows = [("chat", ["messages[].content"], []), ("bare", [], [])]
    return spark.createDataFrame(
        rows, "name string, scan_paths array<string>, stream_paths array<string>"
    )


def _tenants(spark) -> DataFrame:
    rows = [
        (0, "acme", ["k1", "k2"], "dry-run", None, None),
        (1, "globex", ["k2", "k3"], None, "session", "bare-sentinel"),
    ]
    return spark.createDataFrame(
        rows,
        "tenant_ord int, id string, keys array<string>, mode string, scope string, style string",
    )


def _requests(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.concat(
            F.lit("/"), "event_type", F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("/v1/"), "user_id")).otherwise("")
        ).alias("path"),
        F.concat(F.lit("h"), F.pmod("user_id", F.lit(3)), F.lit(".example.com:8443")).alias("host"),
        F.concat(F.lit("k"), F.pmod("user_id", F.lit(6))).alias("key"),
    )


def route_match(spark, d):
    got = policy.match_route(_requests(spark, d), _routes(spark))
    return got.select("event_id", F.col("route_ord").cast("bigint"), "rest")


def host_match(spark, d):
    got = policy.match_host(_requests(spark, d), _routes(spark))
    return got.select("event_id", F.col("host_route_ord").cast("bigint"))


def tenant_attribution(spark, d):
    return policy.attribute_tenant(_requests(spark, d), _tenants(spark)).select("event_id", "tenant")


def authorize(spark, d):
    flat = spark.createDataFrame([("k5",)], "key string")
    accepted = policy.accepted_keys(flat, _tenants(spark))
    return policy.authorize(_requests(spark, d), accepted).select("event_id", "authorized")


def rejected_requests(spark, d):
    flat = spark.createDataFrame([("k5",)], "key string")
    accepted = policy.accepted_keys(flat, _tenants(spark))
    return policy.rejected(_requests(spark, d), accepted).select("event_id", "key")


def effective_policy(spark, d):
    routed = policy.match_route(_requests(spark, d), _routes(spark))
    known = policy.attribute_tenant(routed, _tenants(spark))
    return policy.effective_policy(known, _routes(spark), _tenants(spark)).select(
        "event_id", "mode", "scope", "style"
    )


def lint_policy(spark, d):
    """Requests that unsafe routes would have let through, by problem."""
    routed = policy.match_route(_requests(spark, d), _routes(spark))
    problems = policy.lint_policy(_routes(spark), _profiles(spark))
    return routed.join(problems, "route_ord").groupBy("route_ord", "problem").agg(
        F.count(F.lit(1)).alias("requests")
    ).select(F.col("route_ord").cast("bigint"), "problem", "requests")


def scan_gate(spark, d):
    turns = _t(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "application/json; charset=utf-8").otherwise("text/JSON").alias("content_type"),
        F.when(F.pmod("turn", F.lit(4)) == 0, "").otherwise(F.col("text")).alias("body"),
    )
    return policy.gate_content_type(turns, F.pmod("conv_id", F.lit(5)) != 0).select("conv_id", "turn", "scan_status")


def header_rules(spark, d):
    headers = F.create_map(
        F.lit("Host"), F.col("host"), F.lit("X-Client-Key"), F.col("key"),
        F.lit("accept-encoding"), F.lit("gzip"), F.lit("x-user"), F.col("user_id").cast("string"),
    )
    sent = policy.strip_request_headers(headers, "x-client-key")
    return _requests(spark, d).select(
        "event_id", F.array_join(F.transform(F.array_sort(F.map_entries(sent)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("sent")
    )


def session_namespaces(spark, d):
    known = policy.attribute_tenant(_requests(spark, d), _tenants(spark))
    return known.select("event_id", F.hex(namespace(F.col("user_id").cast("string"), F.col("tenant"))).alias("ns"))


def internal_targets(spark, d):
    ip = F.concat_ws(
        ".", *[F.pmod(c, F.lit(256)) for c in ("l_orderkey", "l_partkey", "l_suppkey")], F.col("l_linenumber") - 1
    )
    return _t(spark, d, "lineitem").select(ip.alias("ip")).where(is_internal_address(F.col("ip"))).groupBy("ip").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- reports and windows ----------------------------------------------------


def sessionize_ttl(spark, d):
    events = _t(spark, d, "events").select("event_id", "user_id", "ts")
    return sessionize(events, ["user_id"], "ts", 21600).select("event_id", F.col("generation").cast("bigint"))


def compliance(spark, d):
    done = dry_run(_documents(spark, d).select("lang", "source", "text"), RULES)
    return compliance_report(done, ["lang", "source"]).select("lang", "source", "ty", "detected", "rows_hit")


def originals_per_scope(spark, d):
    found = detect(_documents(spark, d).select("source", "text"), RULES)
    return distinct_originals(found, ["source"])


def worst_sources(spark, d):
    done = dry_run(_documents(spark, d).select("source", "text"), RULES)
    totals = done.groupBy("source").agg(F.sum("report.total").alias("detected"))
    return worst(totals, "detected", 5)


# --- audit and transactions -------------------------------------------------

_SEGMENT = 500


def _records(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(
        F.col("event_type").alias("chain"),
        _epoch("ts").alias("ts"),
        "event_id",
        F.concat(F.lit("/"), "event_type").alias("route"),
        F.when(F.pmod("user_id", F.lit(4)) != 0, F.concat(F.lit("t"), F.pmod("user_id", F.lit(4)))).alias("tenant"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "enforce").otherwise("dry-run").alias("mode"),
        F.pmod("event_id", F.lit(5)).alias("detected"),
        F.when(
            F.pmod("event_id", F.lit(5)) > 0, F.create_map(F.lit("EMAIL"), F.pmod("event_id", F.lit(5)))
        ).otherwise(F.create_map().cast("map<string,bigint>")).alias("types"),
    )


def _chains(spark, d) -> DataFrame:
    return audit.chain_append(_records(spark, d), ["chain"], ["ts", "event_id"], segment_rows=_SEGMENT)


def audit_chain(spark, d):
    return _chains(spark, d).select("chain", "segment", "seq", "event_id", "prev", "hash")


def _tampered(spark, d) -> DataFrame:
    """Edited, cut and intact segments side by side."""
    log = stage(_chains(spark, d), "chains")
    edited = (F.col("segment") == 1) & (F.col("seq") == 7)
    removed = (F.col("segment") == 2) & (F.col("seq") == 9)
    return log.where(~removed).withColumn(
        "detected", F.when(edited, F.col("detected") + 7).otherwise(F.col("detected"))
    )


def audit_verify(spark, d):
    return audit.chain_verify(_tampered(spark, d), ["chain", "segment"]).select(
        "chain", "segment", "count", "broken_at"
    )


def audit_tampering(spark, d):
    return audit.tamper_localise(_tampered(spark, d), ["chain", "segment"])


def audit_history(spark, d):
    """Three cuts of each chain, under two lengths of segments."""
    out = []
    for size in (50, 10_000):
        log = audit.chain_append(_records(spark, d), ["chain"], ["ts", "event_id"], segment_rows=size)
        log = stage(log, "chains")
        case = F.explode(F.array(*map(F.lit, ("edit", "segment", "tail", "whole")))).alias("case")
        seals = audit.chain_seals(log, ["chain"]).select("*", case)
        at = F.col("segment") * size + F.col("seq")
        cut = ((F.col("case") == "tail") & at.between(145, 149)) | ((F.col("case") == "segment") & at.between(100, 149))
        edited = (F.col("case") == "edit") & (at == 57)
        seen = log.select("*", case).where(~cut).withColumn("detected", F.col("detected") + F.when(edited, 7).otherwise(0))
        verdict = audit.verify_history(seen, seals, ["chain", "case"])
        out.append(
            verdict.select("chain", "case", F.lit(size).alias("size"), "count", F.col("problem").isNull().alias("intact"))
        )
    return out[0].unionByName(out[1])


def transactions_bounded(spark, d):
    turns = _t(spark, d, "conversations").select(
        "conv_id",
        "turn",
        (F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
        F.lit("/chat").alias("route"),
        F.lit(None).cast("string").alias("tenant"),
        F.lit("POST").alias("method"),
        F.lit("/chat/v1").alias("path"),
        F.lit(200).alias("status"),
        F.lit("enforce").alias("mode"),
        F.col("text").alias("request"),
        F.reverse("text").alias("response"),
        report_of(detect_literals(F.col("text"), WORDS)).alias("report"),
    )
    return audit.transactions(turns, ["conv_id", "turn"], 101).select(
        "id", "ts", "detected", "request", "request_truncated", "response_truncated"
    )


def secret_free(spark, d):
    """Masked rows hold no original of their scope; the originals' rows do."""
    masked, vault = _by_source(spark, d)
    logged = masked.select("doc_id", "source", F.col("masked").alias("body")).unionByName(
        masked.select((-F.col("doc_id") - 1).alias("doc_id"), "source", F.col("text").alias("body"))
    )
    return audit.secret_free_check(logged, vault, ["doc_id"], "body", "source").select("doc_id")


# --- scalars and sources ----------------------------------------------------


def base62(spark, d):
    n = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729, F.lit(4294967296))
    keys = _t(spark, d, "lineitem").select(n.alias("n")).distinct()
    code = base62_encode(F.col("n"))
    return keys.select("n", code.alias("code")).withColumn("back", base62_decode(F.col("code")))


def json_escapes(spark, d):
    return _documents(spark, d).select("doc_id", json_escape(F.col("text")).alias("escaped"))


def durations(spark, d):
    k = F.col("o_orderkey").cast("string")
    kind = F.pmod("o_orderkey", F.lit(7))
    text = (
        F.when(kind == 0, F.concat(k, F.lit("m")))
        .when(kind == 1, F.concat(F.lit(" "), k, F.lit("h ")))
        .when(kind == 2, F.concat(k, F.lit(" s")))
        .when(kind == 3, k)
        .when(kind == 4, F.concat(k, F.lit("x")))
        .when(kind == 5, F.lit(""))
    )
    return _t(spark, d, "orders").select("o_orderkey", parse_duration(text, 99).alias("seconds"))


def id_spaces(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", id_space(F.col("o_orderkey")).alias("s")).select(
        "o_orderkey", "s.base", F.col("s.end").alias("upper")
    )


def request_ids(spark, d):
    return _t(spark, d, "conversations").select(
        "conv_id", "turn", request_id(F.col("conv_id"), F.col("turn")).alias("id")
    )


def dotenv_terms(spark, d):
    kind = F.pmod("o_orderkey", F.lit(4))
    line = (
        F.when(kind == 0, F.concat(F.lit("KEY_"), "o_orderkey", F.lit("=v-"), "o_orderkey", F.lit("-secret")))
        .when(kind == 1, F.concat(F.lit("export A = \"q "), "o_orderkey", F.lit("\"")))
        .when(kind == 2, F.concat(F.lit("# C="), "o_orderkey", F.lit("-secret")))
        .otherwise(F.lit("SHORT=1234"))
    )
    lines = _t(spark, d, "orders").select(line.alias("value"))
    return terms_from_dotenv(lines).select("term", "ty", F.col("priority").cast("bigint"))


def line_terms(spark, d):
    lines = _documents(spark, d).select(F.explode(F.split("text", "\n")).alias("value"))
    return terms_from_lines(lines, min_len=5).select("term")


def kv_terms(spark, d):
    inner = F.struct(
        F.concat(F.lit("key-"), "o_orderkey").alias("api_key"),
        F.lit("8200").alias("port"),
        F.col("o_orderkey").alias("number"),
    )
    docs = _t(spark, d, "orders").select(
        F.to_json(F.struct(F.struct(inner.alias("data")).alias("data"))).alias("value")
    )
    return terms_from_kv_export(docs).select("term")


# --- streaming --------------------------------------------------------------


def _sink(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read its output back."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{root}/out" if mode == "complete" else f"{root}/out/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out").select(*df.columns)


def _stream(spark, d, name: str) -> DataFrame:
    """The table as a stream of files, be it one file or a folder of them."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(_t(spark, d, name).schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # A stream reads folders only.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def stream_mask(spark, d):
    docs = _stream(spark, d, "documents").select("doc_id", "text")
    done = mask_request(docs, RULES, SECRET, "doc_id").select(
        "doc_id", "masked", F.col("report.summary").alias("summary")
    )
    return _sink(done, "stream-mask")


def stream_mask_session(spark, d):
    turns = _stream(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("row_id"), "conv_id", "turn", "text"
    )
    done = mask_session_stream(turns, GLOSSARY, SECRET, "row_id", "conv_id", "turn", ttl_seconds=None)
    return _sink(done.select("row_id", "masked"), "stream-session")


def stream_rehydrate(spark, d):
    masked, vault = _session(spark, d)
    masked = stage(masked, "masked")
    cut = masked.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        F.lit("content").alias("leaf_path"),
        F.explode(_cut(F.col("masked"), 40)).alias("c"),
        F.length("masked").alias("n"),
    ).select(
        "response_id",
        "leaf_path",
        "c.seq",
        "c.text",
        (F.col("c.seq") == F.greatest(F.call_function("div", F.col("n") - 1, F.lit(40)), F.lit(0))).alias("eos"),
    )
    root = f"{shared_folder(spark)}/stream-rehydrate-{uuid.uuid4().hex}"
    cut.write.parquet(f"{root}/in")
    scopes = masked.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        F.col("conv_id").cast("string").alias("scope_key"),
    )
    chunks = stream_texts(
        spark, f"{root}/in", "response_id string, leaf_path string, seq bigint, text string, eos boolean"
    )
    resolver = StreamResolver(lambda: vault, stage(scopes, "scopes"), SECRET, f"{root}/out", f"{root}/late")
    query = (
        reframe(chunks, idle_seconds=None)
        .writeStream.option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(resolver)
        .start()
    )
    query.awaitTermination()
    out = spark.read.schema(
        "response_id string, leaf_path string, seq bigint, verbatim boolean, rehydrated string"
    ).parquet(f"{root}/out")
    rows = F.array_sort(F.collect_list(F.struct("seq", "verbatim", "rehydrated")))
    return out.groupBy("response_id").agg(
        F.array_join(F.transform(rows, lambda r: r["rehydrated"]), "").alias("rehydrated")
    )


def stream_metrics(spark, d):
    text = F.concat(F.lit("user"), "user_id", F.lit("@mail.example.com from 10.0.0."), F.pmod("user_id", F.lit(256)))
    events = _stream(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), text.alias("text")
    )
    done = detection_metrics(events, RULES, window="1 hour")
    return _sink(done, "stream-metrics", "complete").select(
        _epoch("window_start").alias("window_start"), "ty", "detected"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        detect_email_counts, detect_spans_multi, detect_pages, glossary_spans, glossary_large, glossary_reports,
        entropy_tokens, shannon, resolve_mixed, coverage, prefilter_rows, curated_rules,
        curated_documents, names_heuristic, names_documents, custom_detector, tenant_terms,
        mask_request_scope, mask_bare_style, dry_run_reports, reports_by_key, mask_session_scope,
        mask_sharded, intern_sharded_vault, intern_overflow, intern_hot_scope, vault_merge,
        vault_store_roundtrip, vault_own_space, seal_roundtrip, tag_keys, sentinels, rehydrate_join, round_trip,
        round_trip_failures, leaks_after_rehydration, sentinel_audit, chunk_rehydrate,
        sse_rehydrate, sse_lines, rehydrate_json_body, json_path_leaves, all_leaves,
        all_leaves_typed, mask_json_bodies, mask_json_all, mask_json_typed_columns,
        mask_json_in_session, json_unmatched, fail_closed,
        oversized_bodies, route_match, host_match, tenant_attribution, authorize,
        rejected_requests, effective_policy, lint_policy, scan_gate, header_rules,
        session_namespaces, internal_targets, sessionize_ttl, compliance, originals_per_scope,
        worst_sources, audit_chain, audit_verify, audit_tampering, audit_history, transactions_bounded,
        secret_free, base62, json_escapes, durations, id_spaces, request_ids, dotenv_terms,
        line_terms, kv_terms, stream_mask, stream_mask_session, stream_rehydrate, stream_metrics,
    )
}
