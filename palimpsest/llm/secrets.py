"""Secret scans with corpus-wide ownership frequency, in DataFrame operations.

Candidates are found by patterns and measured in code points. Over the whole
corpus, each candidate's hash is counted by distinct repositories (documents)
and owners (sources). In the report, a value that several owners hold counts as
copied. Only an example stays when secrets are replaced: a value that many
different texts of several owners hold, or one spelled like a placeholder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import block_numbers, block_range, explode_once, let, substr
from ..plans.stage import stage

# Characters that replacing looks through at once.
BLOCK = 512
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that is the secret, and its least length."""

    name: str
    pattern: str
    group: int
    least: int
    guard: str


# The first three are the base kinds; the last is added by this operator.
KINDS = (
    Kind(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"(?i)(?:password|passwd|secret|token|api_?key)",
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Kind("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Kind(
        "provider",
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}",
        0,
        15,
        "gh[pousr]_|xox[abprs]-|sk_live_|AIza",
    ),
)
BASE = ("assign", "access", "hex")
# An example is in this many different texts, of this many owners.
EXAMPLE_TEXTS, EXAMPLE_OWNERS = 10, 3
# A short unit said again and again, or words that stand for a value.
PLACEHOLDER = r"(?i)^(.{1,8}?)\1{2,}+$|example|change_?me|placeholder|redacted|dummy|your[_-]?(?:api|key|token|secret|password)"


def running(values: Column) -> Column:
    """Sums of the elements before each element, and the sum of all as the last.

    Taken inside blocks and over block totals, so long arrays stay near linear.
    """
    zero = F.array(F.lit(0).cast("int"))

    def grow(t: Column, x: Column) -> Column:
        return F.concat(t, F.array(F.element_at(t, -1) + x))

    def build(v: Column) -> Column:
        def block(k: Column) -> Column:
            return F.transform(block_range(v, k), lambda i: F.get(v, i))

        totals = F.transform(
            block_numbers(v), lambda k: F.aggregate(block(k), F.lit(0).cast("int"), lambda t, x: t + x)
        )

        def inside(starts: Column) -> Column:
            parts = F.transform(
                block_numbers(v),
                lambda k: F.slice(F.aggregate(block(k), F.array(F.get(starts, k)), grow), 1, F.size(block_range(v, k))),
            )
            return F.concat(F.flatten(parts), F.slice(starts, -1, 1))

        return let(F.aggregate(totals, zero, grow), inside)

    return let(values, build)


def kind_spans(text: Column, kind: Kind, rank: int) -> Column:
    """Leftmost non-overlapping matches whose secret is long enough."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(kind.group))
    # Between n matches lie n + 1 gaps, empty ones included.
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)

    def place(found: Column) -> Column:
        lengths = F.transform(found["whole"], F.length)
        steps = F.zip_with(found["gaps"], lengths, lambda g, m: g + F.coalesce(m, F.lit(0)))

        def span(w: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.get(found["gaps"], i)
            return F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind.name).alias("kind"),
                (start + F.length(w)).alias("end"),
                F.get(found["value"], i).alias("value"),
            )

        spans = let(running(steps), lambda before: F.transform(found["whole"], lambda w, i: span(w, i, before)))
        return F.filter(spans, lambda s: F.length(s["value"]) >= kind.least)

    bound = F.struct(whole.alias("whole"), value.alias("value"), gaps.alias("gaps"))
    none = F.array().cast(SPANS)
    return F.when(F.rlike(text, F.lit(kind.guard)), let(bound, place).cast(SPANS)).otherwise(none)


def find_secrets(text: Column) -> Column:
    """Spans of all kinds, by start and then kind; none for null."""
    found = F.concat(*[kind_spans(text, k, i) for i, k in enumerate(KINDS)])
    return F.coalesce(F.sort_array(found), F.array().cast(SPANS))


def hashed(spans: Column) -> Column:
    """Spans with a hash, and whether it is spelled like a placeholder, in place of the value."""

    def one(s: Column) -> Column:
        return F.struct(
            *(s[n].alias(n) for n in ("start", "rank", "kind", "end")),
            F.sha2(s["value"].cast("binary"), 256).alias("hash"),
            F.rlike(s["value"], F.lit(PLACEHOLDER)).alias("placeholder"),
        )

    return F.transform(spans, one)


def ownership(candidates: DataFrame, hash: str, repository: str, owner: str) -> DataFrame:
    """``(hash, n_rows, n_repositories, n_owners)`` of each candidate's hash.

    Counted in steps, so that a value in a third of all rows is summed before
    it moves. Rows of unknown (null) owner count as one owner.
    """
    rows = candidates.select(F.col(hash).alias("hash"), F.col(owner).alias("o"), F.col(repository).alias("r"))
    by_repository = rows.groupBy("hash", "o", "r").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "o").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("hash").agg(
        F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")
    )


def examples(candidates: DataFrame, hash: str, placeholder: str, copy: str, owner: str) -> DataFrame:
    """``(hash, example)`` of each candidate's hash.

    Equal texts (``copy``) count once, and for one owner, so that copies of one
    document never make an example.
    """
    rows = candidates.select(
        F.col(hash).alias("hash"),
        F.col(placeholder).alias("p"),
        F.col(copy).alias("c"),
        F.col(owner).alias("o"),
    )
    by_text = rows.groupBy("hash", "p", "c").agg(F.min("o").alias("o"))
    by_owner = by_text.groupBy("hash", "p", "o").agg(F.count(F.lit(1)).alias("n"))
    spread = by_owner.groupBy("hash", "p").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"))
    wide = (F.col("n") >= EXAMPLE_TEXTS) & (F.col("owners") >= EXAMPLE_OWNERS)
    return spread.select("hash", (F.col("p") | wide).alias("example"))


def _spans(docs: DataFrame, key: str, text: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their spans, and one row for each span; no value is written."""
    row = F.xxhash64(F.lit("row"), F.col(key), F.col(text))
    found = hashed(find_secrets(F.col(text))).alias("spans")
    copy = F.xxhash64(F.lit("copy"), F.col(text)).alias("copy")
    rows = docs.select(row.alias("row"), F.col(key).alias("key"), F.col(owner).alias("owner"), copy, found)
    rows = stage(rows, "secret-spans")
    return rows, explode_once(rows, "spans", "row", "key", "owner", "copy").select("row", "key", "owner", "copy", "s.*")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", max_owners: int = 1):
    """Two tables: ``rows`` with the spans of each row, and ``candidates``.

    ``rows``: (row, key, spans), one for each row of ``docs``; a null text has
    no spans. ``candidates``: (row, key, start, end, kind, hash, n_rows,
    n_repositories, n_owners, live), one for each span; ``live`` where at most
    ``max_owners`` owners hold the value. ``row`` names a row by its content,
    so repeated keys with other texts stay apart and repeated rows are equal.
    """
    rows, flat = _spans(docs, key, text, owner)
    owners = stage(ownership(flat, "hash", "key", "owner"), "owners")
    candidates = flat.drop("placeholder", "owner", "copy").join(owners, "hash")
    return rows, candidates.withColumn("live", F.col("n_owners") <= max_owners)


def _said(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Per row: counts by base kind, spans, and how many look live or copied."""
    rows, candidates = scan(docs, key, text, owner)
    judged = candidates.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("live"), F.count(F.lit(1)).alias("all")
    )
    # Rows that repeat count their spans once each.
    times = rows.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    judged = judged.join(times, "row").select(
        "row", F.expr("live div times").alias("n_live"), F.expr("(all - live) div times").alias("n_copied")
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    none = F.lit(0).cast("long")
    return rows.join(judged, "row", "left").select(
        F.col("key").alias(key),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_said(base).cast("binary"), 256).alias("base_sha256"),
        _said(F.col("spans")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"),
        F.coalesce("n_copied", none).alias("n_copied"),
    )


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, of which ``blocks`` holds ``BLOCK`` characters each."""
    a, b = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
    first, rest = F.coalesce(F.get(blocks, a), F.lit("")), F.coalesce(F.get(blocks, b), F.lit(""))
    head = substr(first, start % BLOCK + 1, F.lit(BLOCK))
    whole = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    within = substr(first, start % BLOCK + 1, F.greatest(end - start, F.lit(0)))
    return F.when(a == b, within).otherwise(F.concat(head, whole, substr(rest, F.lit(1), end % BLOCK)))


def _replaced(text: Column, cuts: Column) -> Column:
    """``text`` with ``[kind]`` for each of ``cuts``: (start, end, kind, at), where the text before goes from ``at``."""

    def build(blocks: Column) -> Column:
        one = lambda c: F.concat(_between(blocks, c["at"], c["start"]), F.lit("["), c["kind"], F.lit("]"))
        last = _between(blocks, F.element_at(cuts, -1)["last"], F.length(text))
        return F.concat(F.array_join(F.transform(cuts, one), ""), last)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), build)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """``docs`` with all spans replaced by ``[kind]`` but those of examples (see ``examples``).

    A span that begins inside an earlier one goes with it, and with its rest.
    """
    _, flat = _spans(docs, key, text, owner)
    judged = stage(examples(flat, "hash", "placeholder", "copy", "owner").where("example").select("hash"), "examples")
    live = flat.join(judged, "hash", "left_anti").select("row", "start", "end", "kind").distinct()
    # How far the spans of a text have come before each, and with it.
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("at", F.coalesce(before, F.lit(0))).withColumn("last", F.max("end").over(Window.partitionBy("row")))
    cuts = F.sort_array(F.collect_list(F.struct("start", "end", "kind", "at", "last")))
    live = live.where(F.col("start") >= F.col("at")).groupBy("row").agg(cuts.alias("__secret_live"))
    live = stage(live.withColumnRenamed("row", "__secret_row"), "live")
    row = F.xxhash64(F.lit("row"), F.col(key), F.col(text))
    touched = F.size(find_secrets(F.col(text))) > 0
    some = docs.withColumn("__secret_row", F.when(touched, row))
    # Only rows with spans meet the table; the others keep their place.
    met = some.where(F.col("__secret_row").isNotNull()).join(live, "__secret_row", "left")
    cuts = F.col("__secret_live")
    new = F.when(cuts.isNull(), F.col(text)).otherwise(_replaced(F.col(text), cuts))
    changed = met.withColumn(text, new).select(*docs.columns)
    return some.where(F.col("__secret_row").isNull()).select(*docs.columns).unionByName(changed)
