"""Routing, attribution, authorisation and effective policy as joins.

Dimension tables are written by hand and small. No broadcast is forced: Spark
broadcasts a side whose size it knows to be small and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsonpaths import parsed

# Headers that do not survive forwarding or rewriting.
REQUEST_DROP = ("host", "content-length", "accept-encoding", "connection")
RESPONSE_DROP = ("content-length", "content-encoding", "transfer-encoding", "connection")

# Policy defaults.
DEFAULTS = {"mode": "enforce", "scope": "request", "style": "typed-sentinel"}


def match_route(df: DataFrame, routes: DataFrame, path: str = "path") -> DataFrame:
    """First route in order whose ``listen_path`` is the path or a prefix of it
    that ends at a slash. Adds ``route_ord`` and ``rest`` (null if none).

    A path has few such prefixes, so they are exploded and equi-joined; the
    distinct paths are matched, not the requests.
    """
    first = (
        routes.where(F.coalesce(F.col("listen_path"), F.lit("")) != "")
        .groupBy("listen_path")
        .agg(F.min("route_ord").alias("route_ord"))
    )
    paths = df.select(F.col(path).alias("_path")).distinct()
    cuts = F.filter(
        F.sequence(F.lit(1), F.length("_path")),
        lambda i: (i == F.length("_path")) | (F.substr("_path", i + 1, F.lit(1)) == "/"),
    )
    prefixes = paths.where(F.length("_path") > 0).select("_path", F.explode(cuts).alias("_n")).select(
        "_path", "_n", F.substr("_path", F.lit(1), F.col("_n")).alias("listen_path")
    )
    rest = F.substr("_path", F.col("_n") + 1, F.length("_path"))
    matched = (
        prefixes.join(first, "listen_path")
        .groupBy("_path")
        .agg(
            F.min("route_ord").alias("route_ord"),
            F.min_by(F.when(rest == "", F.lit("/")).otherwise(rest), "route_ord").alias("rest"),
        )
    )
    return df.join(matched, df[path] == matched["_path"], "left").drop("_path")


def match_host(df: DataFrame, routes: DataFrame, host: str = "host") -> DataFrame:
    """First route with exactly this host, port ignored. Adds ``host_route_ord``."""
    first = (
        routes.where(F.col("host").isNotNull())
        .groupBy(F.col("host").alias("_host"))
        .agg(F.min("route_ord").alias("host_route_ord"))
    )
    bare = F.substring_index(F.col(host), ":", 1)
    return df.join(first, bare == F.col("_host"), "left").drop("_host")


def key_digest(key: Column) -> Column:
    return F.sha2(key, 256)


def tenant_keys(tenants: DataFrame) -> DataFrame:
    """``(digest, tenant)``; a key listed by two tenants belongs to the last."""
    return (
        tenants.select("tenant_ord", F.col("id").alias("tenant"), F.explode("keys").alias("_k"))
        .groupBy(key_digest(F.col("_k")).alias("digest"))
        .agg(F.max_by("tenant", "tenant_ord").alias("tenant"))
    )


def attribute_tenant(df: DataFrame, tenants: DataFrame, key: str = "key") -> DataFrame:
    """Add ``tenant`` (null if the key belongs to none)."""
    return df.join(
        tenant_keys(tenants), key_digest(F.col(key)) == F.col("digest"), "left"
    ).drop("digest")


def accepted_keys(flat_keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """Digests of the flat keys and of every tenant's keys."""
    return (
        flat_keys.select(key_digest(F.col("key")).alias("digest"))
        .unionAll(tenant_keys(tenants).select("digest"))
        .distinct()
    )


def authorize(
    df: DataFrame, accepted: DataFrame, key: str = "key", enabled: bool = True
) -> DataFrame:
    """Add ``authorized``. Auth is on when enabled or when tenants exist."""
    if not enabled:
        return df.withColumn("authorized", F.lit(True))
    known = accepted.select("digest", F.lit(True).alias("_known"))
    return (
        df.join(known, key_digest(F.col(key)) == F.col("digest"), "left")
        .withColumn("authorized", F.coalesce("_known", F.lit(False)))
        .drop("digest", "_known")
    )


def rejected(df: DataFrame, accepted: DataFrame, key: str = "key") -> DataFrame:
    """Rows without an accepted key."""
    return df.join(accepted, key_digest(F.col(key)) == F.col("digest"), "left_anti")


def effective_policy(
    df: DataFrame, routes: DataFrame, tenants: DataFrame, defaults: dict | None = None
) -> DataFrame:
    """Add ``mode``, ``scope`` and ``style``: tenant over route over default.

    Needs columns ``route_ord`` and ``tenant``.
    """
    chosen = {**DEFAULTS, **(defaults or {})}
    fields = ("mode", "scope", "style")
    r = routes.select("route_ord", *[F.col(f).alias(f"_r_{f}") for f in fields])
    t = tenants.select(F.col("id").alias("tenant"), *[F.col(f).alias(f"_t_{f}") for f in fields])
    joined = df.join(r, "route_ord", "left").join(t, "tenant", "left")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(f"_t_{f}", f"_r_{f}", F.lit(chosen[f])).alias(f)
            for f in fields
        ],
    )


def lint_policy(routes: DataFrame, profiles: DataFrame, default_mode: str = "enforce") -> DataFrame:
    """Routes that let text pass unmasked: ``(route_ord, problem)``."""
    named = routes.where(F.col("profile").isNotNull())
    unknown = named.join(profiles, named["profile"] == profiles["name"], "left_anti").select(
        "route_ord", F.lit("unknown profile").alias("problem")
    )
    paths = profiles.select(F.col("name").alias("profile"), F.size("scan_paths").alias("_n"))
    blind = (
        routes.where(F.coalesce("mode", F.lit(default_mode)) != "dry-run")
        .join(paths, "profile", "left")
        .where(F.coalesce("_n", F.lit(0)) <= 0)
        .select("route_ord", F.lit("no scan paths").alias("problem"))
    )
    return unknown.unionByName(blind)


def scan_status(content_type: Column, has_paths: Column, body: Column) -> Column:
    """``scan``, or why the body passes unmasked."""
    return (
        F.when(~F.coalesce(F.contains(content_type, F.lit("json")), F.lit(False)), "not json")
        .when(~has_paths, "no scan paths")
        .when(F.coalesce(F.octet_length(body), F.lit(0)) == 0, "empty")
        .otherwise("scan")
    )


def gate_content_type(
    df: DataFrame, has_paths: Column, content_type: str = "content_type", body: str = "body"
) -> DataFrame:
    return df.withColumn("scan_status", scan_status(F.col(content_type), has_paths, F.col(body)))


def fail_closed_split(
    df: DataFrame, body: str = "body", mode: str = "mode"
) -> tuple[DataFrame, DataFrame]:
    """``(forwarded, rejected)``: a body that a strict reader refuses goes no further when enforcing."""
    broken = parsed(F.col(body)).isNull() & (F.col(mode) == "enforce")
    return df.where(~broken), df.where(broken)


def strip_request_headers(headers: Column, auth_header: str | None = None) -> Column:
    drop = {*REQUEST_DROP, *([auth_header.lower()] if auth_header else [])}
    kept = F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*sorted(drop)))
    return F.map_concat(kept, F.create_map(F.lit("accept-encoding"), F.lit("identity")))


def strip_response_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*RESPONSE_DROP))
