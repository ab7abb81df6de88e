"""Detection and policy settings from one YAML document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import PREFIX, adapt
from ..operators.policy import DEFAULTS
from ..operators.ruleset import Entropy, Names, Rule, Ruleset, Term

# Defaults of secret sources, sessions and logs.
SOURCE_DEFAULTS = {"entity_type": "SECRET", "priority": 80, "min_len": 5}
TTL_DEFAULT_SECONDS = 1800


@dataclass(frozen=True)
class Settings:
    """A rule set plus its policy tables. Written by hand, hence small."""

    ruleset: Ruleset
    routes: list[dict] = field(default_factory=list)
    profiles: list[dict] = field(default_factory=list)
    tenants: list[dict] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)
    defaults: dict = field(default_factory=lambda: dict(DEFAULTS))
    auth_enabled: bool = False
    auth_header: str | None = None
    auth_keys: list[str] = field(default_factory=list)
    session_header: str | None = None
    ttl: str | None = None
    max_body_bytes: int = 65536

    def rules_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.ty, r.pattern, r.priority) for i, r in enumerate(self.ruleset.rules)]
        return spark.createDataFrame(
            rows, "rule_ord int, name string, ty string, pattern string, priority int"
        )

    def terms_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.term, t.ty, t.priority, t.tenant) for i, t in enumerate(self.ruleset.terms)]
        return spark.createDataFrame(
            rows, "term_ord int, term string, ty string, priority int, tenant string"
        )

    def routes_df(self, spark: SparkSession) -> DataFrame:
        names = ("listen_path", "host", "upstream", "profile", "mode", "scope", "style")
        rows = [(i, *[r.get(n) for n in names]) for i, r in enumerate(self.routes)]
        return spark.createDataFrame(
            rows, "route_ord int, " + ", ".join(f"{n} string" for n in names)
        )

    def profiles_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p["name"], p["scan_paths"], p["stream_paths"]) for p in self.profiles]
        return spark.createDataFrame(
            rows, "name string, scan_paths array<string>, stream_paths array<string>"
        )

    def tenants_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, t["id"], t["keys"], t.get("mode"), t.get("scope"), t.get("style"))
            for i, t in enumerate(self.tenants)
        ]
        return spark.createDataFrame(
            rows,
            "tenant_ord int, id string, keys array<string>, mode string, scope string, style string",
        )


def _term(entry: dict, tenant: str | None = None) -> Term:
    return Term(entry["term"], entry["type"], int(entry.get("priority", 0)), tenant)


def parse_settings(text: str) -> Settings:
    """Settings of a YAML text, defaults filled in. Unknown keys are ignored."""
    import yaml

    doc = yaml.safe_load(text) or {}
    tenants = doc.get("tenants") or []
    terms = [_term(g) for g in doc.get("glossary") or []]
    for t in tenants:
        terms += [_term(g, t["id"]) for g in t.get("glossary") or []]
    rules = [
        Rule(r["name"], r["type"], r["pattern"], int(r.get("priority", 0)))
        for r in doc.get("rules") or []
    ]
    for r in rules:
        adapt(r.pattern)
    ent, ner = doc.get("entropy") or {}, doc.get("ner") or {}
    entropy = Entropy(**{k: ent[k] for k in Entropy.__dataclass_fields__ if k in ent})
    names = Names(
        **{k: ner[k] for k in ("enabled", "entity_type", "priority") if k in ner},
        names=tuple(ner.get("names") or ()),
    )
    masking, auth = doc.get("masking") or {}, doc.get("auth") or {}
    log = doc.get("transactions") or {}
    modes = {"mode": ("enforce", "dry-run"), "scope": ("request", "session"), "style": ("typed-sentinel", "bare-sentinel")}
    for holder in [masking, *(doc.get("routes") or []), *tenants]:
        for name, allowed in modes.items():
            if holder.get(name) is not None and holder[name] not in allowed:
                raise ValueError(f"{name} is {holder[name]!r}, not one of {allowed}")
    return Settings(
        ruleset=Ruleset(tuple(rules), tuple(terms), entropy, names),
        routes=[
            {**r, "listen_path": r.get("listen_path", ""), "upstream": r["upstream"].rstrip("/")}
            for r in doc.get("routes") or []
        ],
        profiles=[
            {
                "name": n,
                "scan_paths": list(p.get("scan_paths") or []),
                "stream_paths": list(p.get("stream_paths") or []),
            }
            for n, p in (doc.get("profiles") or {}).items()
        ],
        tenants=[{**t, "keys": list(t["keys"])} for t in tenants],
        sources=[{**SOURCE_DEFAULTS, **s} for s in doc.get("sources") or []],
        defaults={**DEFAULTS, **{k: masking[k] for k in DEFAULTS if masking.get(k)}},
        auth_enabled=bool(auth.get("enabled", False)),
        auth_header=auth.get("header"),
        auth_keys=list(auth.get("keys") or []),
        session_header=masking.get("session_header"),
        ttl=masking.get("ttl"),
        max_body_bytes=int(log.get("max_body_bytes", 65536)),
    )


def load_settings(spark: SparkSession, path: str) -> Settings:
    """Read and check one settings file from any file system Spark knows."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one settings file")
    settings = parse_settings(rows[0][0])
    # The JVM compiles the patterns now, not in the middle of a job.
    checks = [F.lit("").rlike(PREFIX + adapt(r.pattern)) for r in settings.ruleset.rules]
    if checks:
        spark.range(1).select(*checks).collect()
    return settings
