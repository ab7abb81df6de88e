"""Detection: every finding in a text as an array of span structs.

The work is one narrow projection: no shuffle and no Python on the data path.
Spark has no function for regex match positions. Matches are therefore wrapped
in private-use characters by ``regexp_replace`` and the pieces between them
are measured. Spans carry code point and byte offsets, because overlap rules
compare byte lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import block_numbers, block_range, byte_slice, let, substr
from ..functions.text import shannon_bits
from .fixed import FIRST_NAMES, MAX_NAME_WORDS, NAME_CUES
from .patterns import PREFIX, adapt, ignores_case, quote, required_substrings
from .ruleset import Entropy, Names, Rule, Ruleset, Term

SPAN_FIELDS = (
    "start int, end int, byte_start int, byte_end int, ty string, priority int, detector string"
)
CANDIDATES = f"array<struct<{SPAN_FIELDS.replace(' int', ':int').replace(' string', ':string')}>>"

# Private-use characters that delimit a match, and that separate rule slots.
BEGIN, SLOT, END = "\ue000", "\ue001", "\ue002"
# Code point for code point stand-in while a text is being marked.
_STAND_IN = "\ufffd" * 3

# Glossaries up to this many terms become one alternation; ``detect`` sends
# larger ones through ``glossary.detect_literals_large``.
MAX_ALTERNATION_TERMS = 500


def no_spans() -> Column:
    return F.array().cast(CANDIDATES)


def _span(start, end, byte_start, byte_end, ty, priority, detector) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        byte_start.cast("int").alias("byte_start"),
        byte_end.cast("int").alias("byte_end"),
        ty.cast("string").alias("ty"),
        priority.cast("int").alias("priority"),
        detector.cast("string").alias("detector"),
    )


def unmarked(text: Column) -> Column:
    """The text without delimiter characters; offsets are unchanged."""
    hit = F.contains(text, F.lit(BEGIN)) | F.contains(text, F.lit(SLOT)) | F.contains(text, F.lit(END))
    return F.when(hit, F.translate(text, BEGIN + SLOT + END, _STAND_IN)).otherwise(text)


def _measure(
    marked: Column,
    label: Callable[[Column, Column], Column],
    keep: Callable[[Column], Column] | None = None,
) -> Column:
    """Spans of a marked text; ``label(slot, match)`` gives ty/priority/detector.

    Pieces alternate between plain text and match. Offsets are running sums,
    taken inside blocks and over block totals: a fold that carries one growing
    array would copy it at each step.
    """

    def size_up(piece: Column, i: Column) -> Column:
        def match(bare: Column) -> Column:
            slot = F.length(piece) - F.length(F.ltrim(piece, F.lit(SLOT)))
            return F.struct(
                F.length(bare).alias("c"),
                F.octet_length(bare).alias("b"),
                (F.lit(True) if keep is None else keep(bare)).alias("hit"),
                label(slot, bare).alias("meta"),
            )

        plain = F.struct(
            F.length(piece).alias("c"),
            F.octet_length(piece).alias("b"),
            F.lit(False).alias("hit"),
            _label(None, 0, "").alias("meta"),
        )
        return F.when(i % 2 == 1, let(F.trim(piece, F.lit(SLOT)), match)).otherwise(plain)

    def pair(c: Column, b: Column) -> Column:
        return F.struct(c.alias("c"), b.alias("b"))

    def place(parts: Column) -> Column:
        blocks = block_numbers(parts)

        def block(k: Column) -> Column:
            return F.transform(block_range(parts, k), lambda i: F.get(parts, i))

        totals = F.transform(
            blocks,
            lambda k: F.aggregate(
                block(k), pair(F.lit(0), F.lit(0)), lambda a, m: pair(a["c"] + m["c"], a["b"] + m["b"])
            ),
        )
        zero = F.array(pair(F.lit(0), F.lit(0)))
        starts = F.aggregate(
            totals,
            zero,
            lambda a, t: F.concat(
                a, F.array(pair(F.element_at(a, -1)["c"] + t["c"], F.element_at(a, -1)["b"] + t["b"]))
            ),
        )

        def within(at: Column) -> Column:
            def spans(k: Column) -> Column:
                origin = F.struct(
                    F.get(at, k)["c"].alias("c"), F.get(at, k)["b"].alias("b"), no_spans().alias("out")
                )

                def step(a: Column, m: Column) -> Column:
                    span = _span(
                        a["c"],
                        a["c"] + m["c"],
                        a["b"],
                        a["b"] + m["b"],
                        m["meta"]["ty"],
                        m["meta"]["priority"],
                        m["meta"]["detector"],
                    )
                    return F.struct(
                        (a["c"] + m["c"]).alias("c"),
                        (a["b"] + m["b"]).alias("b"),
                        F.when(m["hit"], F.concat(a["out"], F.array(span)))
                        .otherwise(a["out"])
                        .alias("out"),
                    )

                return F.aggregate(block(k), origin, step, lambda a: a["out"])

            return F.flatten(F.transform(blocks, spans))

        return let(starts, within)

    pieces = F.transform(F.split(marked, f"[{BEGIN}{END}]"), size_up)
    return F.when(F.contains(marked, F.lit(END)), let(pieces, place)).otherwise(no_spans())


def _label(ty: str | None, priority: int, detector: str) -> Column:
    return F.struct(
        F.lit(ty).cast("string").alias("ty"),
        F.lit(priority).cast("int").alias("priority"),
        F.lit(detector).alias("detector"),
    )


# --- literals ---------------------------------------------------------------


def detect_literals(text: Column, terms: Sequence[Term]) -> Column:
    """Glossary hits: case-sensitive substrings, leftmost-longest.

    Priorities play no part inside the set. A term listed twice keeps the
    metadata of its first entry.
    """
    first: dict[str, Term] = {}
    for t in terms:
        first.setdefault(t.term, t)
    if not first:
        return no_spans()
    if len(first) > MAX_ALTERNATION_TERMS:
        raise ValueError("too many terms for one alternation; give detect a key")
    longest_first = sorted(first, key=len, reverse=True)
    heads = "".join(sorted({quote(t[0]) for t in first}))
    pattern = f"(?=[{heads}])(?:{'|'.join(quote(t) for t in longest_first)})"
    labels = F.create_map(
        *[c for t in first.values() for c in (F.lit(t.term), _label(t.ty, t.priority, "literal"))]
    )
    # Terms holding a delimiter character are looked up in their marked form.
    plain = str.maketrans(dict(zip(BEGIN + SLOT + END, _STAND_IN)))
    if any(t != t.translate(plain) for t in first):
        raise ValueError("terms may not hold U+E000, U+E001 or U+E002")
    marked = F.regexp_replace(unmarked(text), pattern, f"{BEGIN}$0{END}")
    if len(first) <= 32:
        hit = _any_of([F.contains(text, F.lit(t)) for t in first])
        marked = F.when(hit, marked).otherwise(F.lit(""))
    return let(marked, lambda m: _measure(m, lambda _, match: F.element_at(labels, match)))


def _any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# --- rules ------------------------------------------------------------------


def by_priority(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -r.priority)


def rule_guard(rule: Rule, text: Column, lowered: Column) -> Column | None:
    """Condition that every text matched by the rule fulfils, or None."""
    clauses = required_substrings(rule.pattern)
    if not clauses:
        return None
    ci = ignores_case(rule.pattern)
    side = lowered if ci else text
    guard = None
    for clause in clauses:
        some = _any_of([F.contains(side, F.lit(s)) for s in sorted(clause)])
        guard = some if guard is None else guard & some
    # U+017F folds to s but is already lower case.
    return guard | F.contains(text, F.lit("\u017f")) if ci else guard


def prefilter(text: Column, rules: Sequence[Rule]) -> Column:
    """True where some rule might match; false rows cannot hold a match."""

    def test(lowered: Column) -> Column:
        guards = [rule_guard(r, text, lowered) for r in rules]
        if not guards:
            return F.lit(False)
        if any(g is None for g in guards):
            return F.lit(True)
        return _any_of(guards)

    return let(F.lower(text), test)


def detect_rules(text: Column, rules: Sequence[Rule], guarded: bool = True) -> Column:
    """All rules in one leftmost scan: a match consumes its text.

    At equal starts the higher priority wins. Cost grows with the number of
    patterns, so each row first tests the substrings its rules require: a row
    no rule can match is not scanned, and a row just one rule can match is
    scanned for that rule alone. Neither changes the result.
    """
    ordered = by_priority(rules)
    if not ordered:
        return no_spans()
    bodies = [f"(?:{adapt(r.pattern)})" for r in ordered]
    union = PREFIX + "|".join(f"(?<r{i}>{b})" for i, b in enumerate(bodies))
    slots = SLOT.join(f"${{r{i}}}" for i in range(len(bodies)))
    labels = F.array(*[_label(r.ty, r.priority, r.name) for r in ordered])

    def scan_all(t: Column) -> Column:
        return F.regexp_replace(t, union, BEGIN + slots + END)

    def scan_one(t: Column, i: int) -> Column:
        return F.regexp_replace(t, PREFIX + bodies[i], f"{BEGIN}{SLOT * i}$0{END}")

    def mark(t: Column) -> Column:
        if not guarded:
            return scan_all(t)

        def dispatch(lowered: Column) -> Column:
            guards = [rule_guard(r, t, lowered) for r in ordered]
            flags = F.array(*[F.lit(True) if g is None else g for g in guards])
            active = F.filter(
                F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull()
            )

            def choose(live: Column) -> Column:
                only = F.get(live, F.lit(0))
                out = F.when(F.size(live) == 0, F.lit("")).when(F.size(live) > 1, scan_all(t))
                for i in range(len(bodies)):
                    out = out.when(only == i, scan_one(t, i))
                return out

            return let(active, choose)

        any_ci = any(ignores_case(r.pattern) for r in ordered)
        return let(F.lower(t) if any_ci else t, dispatch)

    marked = let(unmarked(text), mark)
    return let(marked, lambda m: _measure(m, lambda slot, _: F.get(labels, slot)))


# --- entropy ----------------------------------------------------------------


def detect_entropy(text: Column, cfg: Entropy) -> Column:
    """Maximal runs of token characters that are long and random enough."""
    token = "[A-Za-z0-9+/=_-]"
    run = f"(?<!{token}){token}{{{max(cfg.min_len, 1)},}}+"
    marked = F.regexp_replace(unmarked(text), run, f"{BEGIN}$0{END}")
    label = _label(cfg.entity_type, cfg.priority, "entropy")
    floor = F.lit(cfg.min_bits).cast("float")
    return let(
        marked, lambda m: _measure(m, lambda *_: label, keep=lambda s: shannon_bits(s) >= floor)
    )


# --- person names -----------------------------------------------------------


def _any_case(word: str) -> str:
    """The word as character classes: per-letter case, plus the Kelvin sign."""
    out = []
    for c in word:
        forms = {c, c.upper()} | ({"\u212a"} if c == "k" else set())
        out.append("[" + "".join(sorted(f for f in forms if len(f) == 1)) + "]" if c.isalpha() else quote(c))
    return "".join(out)


_WORD = r"\p{IsAlphabetic}'\-"


def _name_is() -> str:
    """``name`` and the word ``is`` behind it, whatever stands between."""
    return rf"{PREFIX}(?<![{_WORD}]){_any_case('name')}[^{_WORD}]++{_any_case('is')}(?![{_WORD}])"


def name_pattern(extra: Sequence[str] = ()) -> str:
    """Cues and names in a text where ``SLOT`` follows each ``is`` that ``name`` precedes.

    The ``name`` may already belong to an earlier match, so the mark stands in
    for a look-behind without a bound.
    """
    cap = rf"\p{{IsUppercase}}[{_WORD}]*+"
    more = rf"(?:{SLOT}?\s+{cap})"
    run = rf"{cap}{more}{{0,{MAX_NAME_WORDS - 1}}}"
    at, over = rf"(?<![{_WORD}])", rf"(?![{_WORD}])"
    cues = "|".join(map(_any_case, NAME_CUES))
    names = "|".join(_any_case(n) for n in dict.fromkeys([*FIRST_NAMES, *(n.lower() for n in extra)]))
    # First letters are tested before word lists: most words fail there.
    heads = "".join(sorted({f for w in NAME_CUES for f in _any_case(w[0])[1:-1]}))
    lead = rf"(?:{at}(?=[{heads}])(?:{cues}){over}|{_any_case('is')}(?={SLOT}))[^{_WORD}]++"
    known = rf"(?=\p{{IsUppercase}}){at}(?<known>(?:{names}){over}{more}{{1,{MAX_NAME_WORDS - 1}}})"
    return rf"{PREFIX}(?<lead>{lead})(?<cued>{run})|{known}"


def detect_names(text: Column, cfg: Names) -> Column:
    """Person names: a cue then capitalised words, or a first name and surname."""
    cued = F.regexp_replace(unmarked(text), _name_is(), "$0" + SLOT)
    marked = F.regexp_replace(cued, name_pattern(cfg.names), "${lead}" + BEGIN + "${cued}${known}" + END)
    label = _label(cfg.entity_type, cfg.priority, "names")
    return let(F.replace(marked, F.lit(SLOT), F.lit("")), lambda m: _measure(m, lambda *_: label))


# --- user detectors ---------------------------------------------------------


def detect_custom(text: Column, detector, name: str = "custom") -> Column:
    """Findings of a user's pandas UDF ``text -> array<struct<start,end,ty,priority>>``.

    Offsets are code points, half open.
    """

    def widen(found: Column) -> Column:
        def one(s: Column) -> Column:
            return _span(
                s["start"],
                s["end"],
                F.octet_length(substr(text, F.lit(1), s["start"])),
                F.octet_length(substr(text, F.lit(1), s["end"])),
                s["ty"],
                s["priority"],
                F.lit(name),
            )

        return F.coalesce(F.transform(found, one), no_spans())

    return widen(detector(text))


# --- overlaps ---------------------------------------------------------------


def _greedy(group: Column) -> Column:
    """Accept by priority, byte length, start, then order of arrival."""
    ranked = F.array_sort(
        F.transform(
            group,
            lambda s: F.struct(
                (-s["priority"].cast("bigint")).alias("p"),
                (s["byte_start"] - s["byte_end"]).alias("l"),
                s["byte_start"].alias("b"),
                s["arrival"].alias("a"),
                s.alias("s"),
            ),
        )
    )

    def accept(kept: Column, r: Column) -> Column:
        s = r["s"]
        clash = F.exists(
            kept,
            lambda k: (k["byte_start"] < s["byte_end"]) & (s["byte_start"] < k["byte_end"]),
        )
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(ranked, F.array().cast(_ARRIVED), accept)


_ARRIVED = (
    "array<struct<byte_start:int,byte_end:int,arrival:int,start:int,end:int,"
    "ty:string,priority:int,detector:string>>"
)


def _cluster_starts(ordered: Column) -> Column:
    """Positions where a span starts at or after every earlier end."""
    blocks = block_numbers(ordered)

    def reach(k: Column) -> Column:
        ends = F.transform(block_range(ordered, k), lambda i: F.get(ordered, i)["byte_end"])
        return F.array_max(ends)

    heads = F.aggregate(
        F.transform(blocks, reach),
        F.array(F.lit(-1)),
        lambda a, t: F.concat(a, F.array(F.greatest(F.element_at(a, -1), t))),
    )

    def within(before: Column) -> Column:
        def firsts(k: Column) -> Column:
            zero = F.struct(
                F.get(before, k).alias("reach"), F.array().cast("array<int>").alias("out")
            )

            def step(a: Column, i: Column) -> Column:
                s = F.get(ordered, i)
                opens = s["byte_start"] >= a["reach"]
                return F.struct(
                    F.greatest(a["reach"], s["byte_end"]).alias("reach"),
                    F.when(opens, F.concat(a["out"], F.array(i))).otherwise(a["out"]).alias("out"),
                )

            return F.aggregate(block_range(ordered, k), zero, step, lambda a: a["out"])

        return F.flatten(F.transform(blocks, firsts))

    return let(heads, within)


def resolve_overlaps(candidates: Column) -> Column:
    """The non-overlapping subset, ordered by start.

    Spans only compete inside a cluster of touching intervals, so the greedy
    choice runs per cluster. Long lists of scattered findings stay cheap.
    """
    by_start = F.array_sort(
        F.transform(
            candidates,
            lambda s, i: F.struct(
                s["byte_start"].alias("byte_start"),
                s["byte_end"].alias("byte_end"),
                i.alias("arrival"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["ty"].alias("ty"),
                s["priority"].alias("priority"),
                s["detector"].alias("detector"),
            ),
        )
    )
    def bare(spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: _span(
                s["start"],
                s["end"],
                s["byte_start"],
                s["byte_end"],
                s["ty"],
                s["priority"],
                s["detector"],
            ),
        )

    def clusters(ordered: Column, firsts: Column) -> Column:
        def settle(first: Column, j: Column) -> Column:
            end = F.coalesce(F.get(firsts, j + 1), F.size(ordered))
            group = F.transform(F.sequence(first, end - 1), lambda i: F.get(ordered, i))
            alone = end - first == 1
            return F.when(alone, group).otherwise(F.array_sort(_greedy(group)))

        return bare(F.flatten(F.transform(firsts, settle)))

    def pick(ordered: Column) -> Column:
        # Where no span reaches beyond the next start, nothing competes.
        touch = F.exists(
            F.transform(
                ordered,
                lambda s, i: F.coalesce(
                    s["byte_start"] < F.get(ordered, i - 1)["byte_end"], F.lit(False)
                ),
            ),
            lambda t: t,
        )
        contested = let(_cluster_starts(ordered), lambda firsts: clusters(ordered, firsts))
        return F.when(touch, contested).otherwise(bare(ordered))

    return F.when(F.size(candidates) < 2, candidates).otherwise(let(by_start, pick))


# --- composition ------------------------------------------------------------


def candidate_spans(
    text: Column, ruleset: Ruleset, custom: Sequence = (), guarded: bool = True, literals: Column | None = None
) -> Column:
    """Candidates of every detector: literals, rules, entropy, custom, names.

    ``literals`` holds glossary hits found before, in place of ``ruleset.terms``.
    """
    parts = []
    if literals is not None:
        parts.append(literals)
    elif ruleset.terms:
        parts.append(detect_literals(text, ruleset.terms))
    if ruleset.rules:
        parts.append(detect_rules(text, ruleset.rules, guarded))
    if ruleset.entropy.enabled:
        parts.append(detect_entropy(text, ruleset.entropy))
    parts.extend(detect_custom(text, d) for d in custom)
    if ruleset.names.enabled:
        parts.append(detect_names(text, ruleset.names))
    if not parts:
        return no_spans()
    return F.coalesce(F.concat(*parts) if len(parts) > 1 else parts[0], no_spans())


def find_spans(
    text: Column,
    ruleset: Ruleset,
    tenant: Column | None = None,
    custom: Sequence = (),
    guarded: bool = True,
    literals: Column | None = None,
) -> Column:
    """Resolved spans of a text. With ``tenant``, each row also gets the
    tenant's own terms, which no other tenant sees."""

    def spans(rs: Ruleset) -> Column:
        found = candidate_spans(text, rs, custom, guarded, literals)
        return let(found, resolve_overlaps)

    owners = [] if literals is not None else ruleset.tenants()
    general = spans(ruleset.for_tenant(None))
    if tenant is None or not owners:
        return general
    out = None
    for owner in owners:
        own = spans(ruleset.for_tenant(owner))
        out = F.when(tenant == owner, own) if out is None else out.when(tenant == owner, own)
    return out.otherwise(general)


def with_originals(text: Column, spans: Column) -> Column:
    """The spans with the covered text as field ``original``."""

    def attach(binary: Column) -> Column:
        return F.transform(
            spans,
            lambda s: s.withField("original", byte_slice(binary, s["byte_start"], s["byte_end"])),
        )

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-8"), attach)).otherwise(
        F.array().cast(CANDIDATES.replace("detector:string", "detector:string,original:string"))
    )


def detect(
    df: DataFrame,
    ruleset: Ruleset,
    text: str = "text",
    tenant: str | None = None,
    custom: Sequence = (),
    guarded: bool = True,
    out: str = "spans",
    glossary: DataFrame | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Add column ``spans`` (with originals) to ``df``. Narrow: no shuffle.

    Only a large glossary may need one: ``glossary`` (``term_ord, term, ty,
    priority, tenant``) and the rule set's terms, where those are too many for
    an alternation, are found by ``detect_literals_large``. Then ``key`` has to
    name the row.
    """
    owner = F.col(tenant) if tenant else None
    if glossary is None and len(ruleset.terms) <= MAX_ALTERNATION_TERMS:
        found = find_spans(F.col(text), ruleset, owner, custom, guarded)
        return df.withColumn(out, let(found, lambda s: with_originals(F.col(text), s)))
    if not key:
        raise ValueError("a large glossary needs the columns that name a row")
    from .glossary import detect_literals_large

    # The rule set's own terms are listed first.
    rows = [(i, t.term, t.ty, t.priority, t.tenant) for i, t in enumerate(ruleset.terms)]
    terms = df.sparkSession.createDataFrame(rows, "term_ord long, term string, ty string, priority int, tenant string")
    if glossary is not None:
        listed = glossary.select(F.col("term_ord").cast("long").alias("term_ord"), "term", "ty", F.col("priority").cast("int"), "tenant")
        # Which list a term is on counts before its place there.
        both = terms.withColumn("_list", F.lit(0)).unionByName(listed.withColumn("_list", F.lit(1)))
        terms = both.select(F.struct("_list", "term_ord").alias("term_ord"), "term", "ty", "priority", "tenant")
    hits = detect_literals_large(df, terms, key, text, tenant, "__literals")
    found = find_spans(F.col(text), ruleset, owner, custom, guarded, F.col("__literals"))
    return hits.withColumn(out, let(found, lambda s: with_originals(F.col(text), s))).drop("__literals")


def explode_spans(df: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """One row per span."""
    rows = df.select(*keys, F.posexplode_outer(spans).alias("span_ord", "s"))
    return rows.where(F.col("s").isNotNull()).select(*keys, "span_ord", "s.*")
