"""Literal terms from secret stores. Input is one line or document per row.

Values shorter than ``min_len`` bytes are skipped: masking them would hit
ordinary text everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ruleset import Term

# Terms read onto the driver for one alternation.
MAX_DRIVER_TERMS = 500


def _terms(df: DataFrame, term: Column, ty: str, priority: int, min_len: int) -> DataFrame:
    return (
        df.select(term.alias("term"))
        .where(F.col("term").isNotNull() & (F.octet_length("term") >= min_len))
        .distinct()
        .select(
            # A stable order: the same file always ranks its terms alike.
            F.xxhash64("term").alias("term_ord"),
            "term",
            F.lit(ty).alias("ty"),
            F.lit(priority).alias("priority"),
            F.lit(None).cast("string").alias("tenant"),
        )
    )


def terms_from_dotenv(
    lines: DataFrame, ty: str = "SECRET", priority: int = 80, min_len: int = 5, column: str = "value"
) -> DataFrame:
    """Values of ``KEY=VALUE`` lines.

    Comments and lines without ``=`` are skipped, an ``export`` prefix and one
    pair of surrounding quotes are dropped. Comments after a value are kept:
    a secret may hold ``#``.
    """
    line = F.trim(F.col(column))
    body = F.regexp_extract(line, r"^(?:export\s+)?[A-Za-z_][A-Za-z0-9_.]*\s*=\s*([\s\S]*)\z", 1)
    bare = F.regexp_replace(F.trim(body), r"^(?:\"([\s\S]*)\"|'([\s\S]*)')\z", "$1$2")
    kept = lines.where(~line.startswith("#"))
    return _terms(kept, F.when(bare != "", bare), ty, priority, min_len)


def terms_from_lines(
    lines: DataFrame, ty: str = "SECRET", priority: int = 80, min_len: int = 5, column: str = "value"
) -> DataFrame:
    """Each non-empty line that is no comment."""
    line = F.trim(F.col(column))
    kept = lines.where((line != "") & ~line.startswith("#"))
    return _terms(kept, line, ty, priority, min_len)


def terms_from_kv_export(
    docs: DataFrame, ty: str = "SECRET", priority: int = 80, min_len: int = 5, column: str = "value"
) -> DataFrame:
    """String values under ``data.data`` of exported key-value documents."""
    pairs = F.try_variant_get(
        F.try_parse_json(F.col(column)), "$.data.data", "map<string,variant>"
    )
    flat = docs.select(F.explode(F.map_values(pairs)).alias("_v"))
    text = F.when(
        F.schema_of_variant("_v") == "STRING", F.try_variant_get("_v", "$", "string")
    )
    return _terms(flat, text, ty, priority, min_len)


def as_terms(terms: DataFrame) -> list[Term]:
    """Terms of a small table, for a rule set. Larger ones stay tables: use
    ``glossary.detect_literals_large``."""
    rows = terms.orderBy("term_ord").limit(MAX_DRIVER_TERMS + 1).collect()
    if len(rows) > MAX_DRIVER_TERMS:
        raise ValueError("too many terms for a rule set; use detect_literals_large")
    return [Term(r["term"], r["ty"], r["priority"], r["tenant"]) for r in rows]
