"""JSON bodies: string leaves by path, and bodies put together again.

A path is dotted; ``[]`` after a name descends into every element of an array,
and ``**`` means every string leaf. Only strings are leaves. A missing key or
a value of another kind is skipped without notice; ``unmatched_paths`` shows
where that happens.

A body is cut at its quotes once. What a parser sees is the body with every
string value replaced by ``"#k"``, ``k`` its place among the pieces, so texts are
neither parsed nor copied; paths lead to places, and new texts are put in those
places. All of it stays in the JVM. Bodies that a strict reader refuses have no
leaves: bad syntax, keys that occur twice, half a surrogate pair, raw control
characters, numbers beyond a double.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import BLOCK, block_numbers, block_range, let
from ..functions.sentinel import mac_pads, scope_key_hex
from ..functions.text import json_escape
from .detect import MAX_ALTERNATION_TERMS, detect, find_spans, with_originals
from .mask import apply_spans, intern_row, mask_session
from .report import report_of
from .ruleset import Ruleset

ALL = "**"
LEAVES = "array<struct<path:string,steps:array<string>,text:string>>"
_PLACES = "array<struct<path:string,steps:array<string>,at:int>>"
_NODES = "array<struct<order:array<string>,steps:array<string>,path:string,v:variant>>"
_FOUND = "array<struct<order:array<string>,steps:array<string>,path:string,at:int>>"
# Stand for an escaped quote and an escaped backslash; no JSON text holds them raw.
_QUOTE, _SLASH = "\x01", "\x02"
# No place is named like this.
_END = "#end"
# Escapes of one letter.
_SHORT = (("\\b", "\b"), ("\\f", "\f"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\/", "/"))
# Levels a parser follows.
_DEEPEST = 1000
_CONTROL, _BAD_RAW = r"[\x00-\x1F]", r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_BAD_ESCAPE = r"\\(?![bfnrt/]|u[0-9a-fA-F]{4})"
_HALF_PAIR = (
    r"\\u[dD](?:[89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})"
    r"|(?<!\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD])[c-fC-F][0-9a-fA-F]{2})"
)
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


# --- reading ----------------------------------------------------------------


def _cut(body: Column) -> Column:
    """Pieces between quotes; those at odd places are strings."""
    plain = F.replace(F.replace(body, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.split(plain, '"')


def _outside(pieces: Column) -> Column:
    return F.array_join(F.filter(pieces, lambda _, i: ~_is_string(i)), '"')


def _raw(piece: Column) -> Column:
    return F.replace(F.replace(piece, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def _is_string(i: Column) -> Column:
    return F.pmod(i, F.lit(2)) == 1


def _is_value(pieces: Column, i: Column) -> Column:
    return _is_string(i) & ~F.startswith(F.ltrim(F.get(pieces, i + 1), F.lit(" \t\r\n")), F.lit(":"))


def parsed(body: Column) -> Column:
    """``struct<pieces,tree,depth>`` of a JSON text, null where a strict reader refuses it.

    ``depth`` is at least the number of levels.
    """

    def read(pieces: Column) -> Column:
        def shown(p: Column, i: Column) -> Column:
            name = F.when(_is_value(pieces, i), F.concat(F.lit("#"), i.cast("string"))).otherwise(_raw(p))
            return F.when(_is_string(i), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(p)

        def check(shadow: Column) -> Column:
            huge = F.exists(
                F.regexp_extract_all(_outside(pieces), F.lit(_NUMBER), F.lit(0)),
                lambda x: F.abs(x.try_cast("double")) == F.lit(float("inf")),
            )
            # Only a long number or a large exponent can leave the range of a double.
            endless = F.when(shadow.rlike(r"[eE]\+?[0-9]{3}|[0-9]{300}"), huge).otherwise(F.lit(False))
            badly = lambda p: p.rlike(_BAD_ESCAPE) | (F.contains(p, F.lit("\\u")) & p.rlike(_HALF_PAIR))
            broken = F.contains(body, F.lit("\\")) & F.exists(pieces, badly)
            # Line ends and tabs may stand between strings only.
            inside = F.exists(F.transform(pieces, lambda p, i: _is_string(i) & p.rlike(r"[\t\r\n]")), lambda x: x)
            raw = F.when(body.rlike(_CONTROL), body.rlike(_BAD_RAW) | inside).otherwise(F.lit(False))
            depth = F.length(shadow) - F.length(F.translate(shadow, "{[", ""))

            def whole(list_: Column) -> Column:
                # A parser may stop behind the first value; then it does not meet the mark behind the body.
                all_read = F.size(F.try_variant_get(list_, "$", "array<variant>")) == 2
                marked = F.try_variant_get(list_, "$[1]", "string") == _END
                tree = F.try_variant_get(list_, "$[0]", "variant")
                good = F.coalesce(all_read & marked, F.lit(False)) & ~raw & ~endless & ~broken
                return F.when(good, F.struct(pieces.alias("pieces"), tree.alias("tree"), depth.alias("depth")))

            return let(F.try_parse_json(F.concat(F.lit("["), shadow, F.lit(f',"{_END}"]'))), whole)

        return F.when(F.pmod(F.size(pieces), F.lit(2)) == 1, let(F.array_join(F.transform(pieces, shown), ""), check))

    return let(_cut(body), read)


def _no_places() -> Column:
    return F.array().cast(_PLACES)


def _key_path(name: str) -> str:
    mark = '"' if "'" in name else "'"
    if mark in name:
        raise ValueError(f"a key may not hold both quote characters: {name!r}")
    return f"$[{mark}{name}{mark}]"


def _place(text: Column) -> Column:
    """Place of a string value; null for what is no string."""
    return F.when(F.startswith(text, F.lit("#")), F.substring(text, 2, 12).cast("int"))


def _dotted(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _indexed(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def _descend(
    value: Column, segments: list[str], path: Column, steps: Column, leaf: Callable[[Column, Column, Column], Column]
) -> Column:
    if not segments:
        return leaf(value, path, steps)
    head, rest = segments[0], segments[1:]
    many = head.endswith("[]")
    name = head[:-2] if many else head
    here, trail = _dotted(path, F.lit(name)), F.concat(steps, F.array(F.lit(name)))
    if not many:
        child = F.try_variant_get(value, _key_path(name), "variant")
        return let(child, lambda v: _descend(v, rest, here, trail, leaf))
    items = F.try_variant_get(value, _key_path(name), "array<variant>")
    below = F.transform(
        items, lambda v, i: _descend(v, rest, _indexed(here, i), F.concat(trail, F.array(i.cast("string"))), leaf)
    )
    return F.flatten(below)


def _placed(value: Column, path: Column, steps: Column) -> Column:
    found = lambda at: F.when(
        at.isNotNull(), F.array(F.struct(path.alias("path"), steps.alias("steps"), at.alias("at")))
    )
    return F.coalesce(let(_place(F.try_variant_get(value, "$", "string")), found), _no_places())


def tree_texts(tree: Column, paths: Sequence[str]) -> Column:
    """``array<struct<path,text>>`` of the strings that named paths reach in a parsed value.

    For small values whose texts need not be put back, such as stream events.
    """

    def said(value: Column, path: Column, _: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return F.when(F.schema_of_variant(value) == "STRING", F.array(F.struct(path.alias("path"), text.alias("text"))))

    none = F.array().cast("array<struct<path:string,text:string>>")
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(_descend(tree, p.split("."), F.lit(""), empty, said), none) for p in paths]
    found = reduce(F.concat, parts, none)
    return found if len(parts) < 2 else F.array_distinct(found)


def _everywhere(body: Column) -> Column:
    """Places of all string leaves, object keys in order: one level of the tree a step."""

    def opened(s: Column) -> Column:
        """``struct<below,leaf>``: the nodes under a node, or the node itself if it is a string."""

        def child(order: Column, step: Column, path: Column, v: Column) -> Column:
            return F.struct(
                F.concat(s["order"], F.array(order)).alias("order"),
                F.concat(s["steps"], F.array(step)).alias("steps"),
                path.alias("path"),
                v.alias("v"),
            )

        def node(below: Column, at: Column) -> Column:
            leaf = F.struct(s["order"].alias("order"), s["steps"].alias("steps"), s["path"].alias("path"), at.alias("at"))
            return F.struct(below.cast(_NODES).alias("below"), F.when(at.isNotNull(), leaf).alias("leaf"))

        none, nowhere = F.array().cast(_NODES), F.lit(None).cast("int")

        def scalar() -> Column:
            return let(_place(F.try_variant_get(s["v"], "$", "string")), lambda at: node(none, at))

        def listed(items: Column) -> Column:
            inner = F.transform(
                items,
                lambda v, i: child(F.lpad(i.cast("string"), 10, "0"), i.cast("string"), _indexed(s["path"], i), v),
            )
            return F.when(items.isNull(), scalar()).otherwise(node(inner, nowhere))

        def named(fields: Column) -> Column:
            inner = F.transform(
                F.map_entries(fields), lambda e: child(e["key"], e["key"], _dotted(s["path"], e["key"]), e["value"])
            )
            items = let(F.try_variant_get(s["v"], "$", "array<variant>"), listed)
            return F.when(fields.isNull(), items).otherwise(node(inner, nowhere))

        return let(F.try_variant_get(s["v"], "$", "map<string,variant>"), named)

    def step(acc: Column, _: Column) -> Column:
        def onward(nodes: Column) -> Column:
            leaves_ = F.filter(F.transform(nodes, lambda n: n["leaf"]), lambda x: x.isNotNull())
            return F.struct(
                F.flatten(F.transform(nodes, lambda n: n["below"])).alias("open"),
                F.concat(acc["found"], leaves_).alias("found"),
            )

        return F.when(F.size(acc["open"]) == 0, acc).otherwise(let(F.transform(acc["open"], opened), onward))

    empty = F.array().cast("array<string>")
    root = F.struct(empty.alias("order"), empty.alias("steps"), F.lit("").alias("path"), body["tree"].alias("v"))
    start = F.struct(F.array(root).cast(_NODES).alias("open"), F.array().cast(_FOUND).alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(_DEEPEST), body["depth"])), start, step, lambda acc: F.array_sort(acc["found"]))
    return F.transform(
        found, lambda x: F.struct(x["path"].alias("path"), x["steps"].alias("steps"), x["at"].alias("at"))
    )


def places(body: Column, paths: Sequence[str]) -> Column:
    """``array<struct<path,steps,at>>`` of a parsed body, in path order, each leaf once."""
    empty = F.array().cast("array<string>")
    named = lambda p: _descend(body["tree"], p.split("."), F.lit(""), empty, _placed)
    parts = [_everywhere(body) if p == ALL else F.coalesce(named(p), _no_places()) for p in paths]
    if not parts:
        return _no_places()
    found = F.coalesce(reduce(F.concat, parts), _no_places())
    return found if len(parts) == 1 else F.array_distinct(found)


def text_at(pieces: Column, at: Column) -> Column:
    """The string at a place, escapes read."""

    def read(piece: Column) -> Column:
        # Escaped backslashes are out of the way, so each that is left begins an escape.
        short = piece
        for escape, char in (*_SHORT, (_QUOTE, '"'), (_SLASH, "\\")):
            short = F.replace(short, F.lit(escape), F.lit(char))
        quoted = F.concat(F.lit('"'), _raw(piece), F.lit('"'))
        long = F.try_variant_get(F.try_parse_json(quoted), "$", "string")
        plain = ~(F.contains(piece, F.lit("\\")) | F.contains(piece, F.lit(_QUOTE)) | F.contains(piece, F.lit(_SLASH)))
        return F.when(plain, piece).when(F.contains(piece, F.lit("\\u")), long).otherwise(short)

    return let(F.get(pieces, at), read)


def leaves(body: Column, paths: Sequence[str]) -> Column:
    """String leaves of a JSON text as ``array<struct<path,steps,text>>``.

    In path order; a leaf that several paths reach is listed once. A refused
    body has none.
    """

    def listed(p: Column) -> Column:
        return F.transform(
            places(p, paths),
            lambda l: F.struct(l["path"].alias("path"), l["steps"].alias("steps"), text_at(p["pieces"], l["at"]).alias("text")),
        )

    return F.coalesce(let(parsed(body), listed), F.array().cast(LEAVES))


def typed_leaves(value: Column, schema: T.DataType) -> Column:
    """Every string leaf of a typed column, as an expression of its schema.

    Preferred over ``**`` on raw text: it prunes columns and needs no Python.
    """
    empty = F.array().cast("array<string>")

    def visit(v: Column, kind: T.DataType, path: Column, steps: Column) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(v.isNotNull(), F.array(F.struct(path.alias("path"), steps.alias("steps"), v.alias("text")))).otherwise(F.array().cast(LEAVES))
        if isinstance(kind, T.StructType):
            parts = [
                visit(
                    v[f.name],
                    f.dataType,
                    F.concat(path, F.when(path == "", "").otherwise("."), F.lit(f.name)),
                    F.concat(steps, F.array(F.lit(f.name))),
                )
                for f in sorted(kind.fields, key=lambda f: f.name)
            ]
            return F.concat(*parts) if parts else F.array().cast(LEAVES)
        if isinstance(kind, T.ArrayType):
            inner = F.transform(
                v,
                lambda x, i: visit(
                    x,
                    kind.elementType,
                    F.concat(path, F.lit("["), i.cast("string"), F.lit("]")),
                    F.concat(steps, F.array(i.cast("string"))),
                ),
            )
            return F.coalesce(F.flatten(inner), F.array().cast(LEAVES))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            inner = F.transform(
                F.array_sort(F.map_keys(v)),
                lambda k: visit(
                    F.element_at(v, k),
                    kind.valueType,
                    F.concat(path, F.when(path == "", "").otherwise("."), k),
                    F.concat(steps, F.array(k)),
                ),
            )
            return F.coalesce(F.flatten(inner), F.array().cast(LEAVES))
        return F.array().cast(LEAVES)

    return visit(value, schema, F.lit(""), empty)


def extract_leaves(
    df: DataFrame, key: Sequence[str], body: str, paths: Sequence[str]
) -> DataFrame:
    """One row per leaf: key, ``leaf_ord``, ``leaf_path``, ``steps``, ``text``."""
    rows = df.withColumn("_a", leaves(F.col(body), paths)).select(
        *key, F.posexplode_outer("_a").alias("leaf_ord", "_l")
    )
    return rows.where(F.col("_l").isNotNull()).select(
        *key,
        "leaf_ord",
        F.col("_l.path").alias("leaf_path"),
        F.col("_l.steps").alias("steps"),
        F.col("_l.text").alias("text"),
    )


# --- putting together -------------------------------------------------------


def _tidy_order(tidy: Column) -> Column:
    """``(slot, at)`` of the string values of a tidy text's pieces, in order."""
    spots = F.transform(
        tidy,
        lambda p, i: F.when(
            _is_string(i) & ~F.startswith(F.get(tidy, i + 1), F.lit(":")), F.struct(i.alias("slot"), _place(p).alias("at"))
        ),
    )
    return F.filter(spots, lambda x: x.isNotNull())


def rebuild_body(body: Column, edits: Column) -> Column:
    """A parsed body as text, with the strings of some places replaced.

    ``edits`` is ``array<struct<at:int,text:string>>``, each place once. Compact,
    object keys in order; strings that are not replaced keep their spelling.
    """

    def build(tidy: Column) -> Column:
        # New texts meet the places by sorting, so many of them stay cheap.
        def literals(order: Column) -> Column:
            spots = F.transform(
                order,
                lambda x, j: F.struct(x["at"].alias("at"), F.lit(1).alias("kind"), j.alias("j"), x["slot"].alias("slot"), F.lit(None).cast("string").alias("text")),
            )
            news = F.transform(
                edits,
                lambda e: F.struct(
                    e["at"].alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("j"),
                    F.lit(None).cast("int").alias("slot"), e["text"].alias("text"),
                ),
            )

            def paired(both: Column) -> Column:
                def one(x: Column, k: Column) -> Column:
                    before = F.get(both, k - 1)
                    fresh = F.when((before["at"] == x["at"]) & (before["kind"] == 0), json_escape(before["text"]))
                    return F.when(
                        x["kind"] == 1,
                        F.struct(x["j"].alias("j"), x["slot"].alias("slot"), F.coalesce(fresh, F.get(body["pieces"], x["at"])).alias("said")),
                    )

                return F.array_sort(F.filter(F.transform(both, one), lambda x: x.isNotNull()))

            return let(F.array_sort(F.concat(spots, news)), paired)

        def join(said: Column) -> Column:
            def segment(x: Column, k: Column) -> Column:
                last = F.coalesce(F.get(said, k - 1)["slot"], F.lit(-1))
                between = F.array_join(F.slice(tidy, last + 2, x["slot"] - last - 1), '"')
                return F.concat(between, F.lit('"'), x["said"])

            last = F.coalesce(F.element_at(said, -1)["slot"], F.lit(-1))
            rest = F.array_join(F.slice(tidy, last + 2, F.size(tidy) - last - 1), '"')
            return _raw(F.array_join(F.concat(F.transform(said, segment), F.array(rest)), '"'))

        return let(let(_tidy_order(tidy), literals), lambda said: F.when(F.size(said) == 0, _raw(F.array_join(tidy, '"'))).otherwise(join(said)))

    return let(_cut(F.to_json(body["tree"])), build)


# --- typed columns ----------------------------------------------------------


def _slots(value: Column, kind: T.DataType) -> int | Column:
    """String slots of a typed value, nulls included: a number where all values have as many."""
    if isinstance(kind, T.StringType):
        return 1
    if isinstance(kind, T.StructType):
        return reduce(_plus, [_slots(value[f.name], f.dataType) for f in kind.fields], 0)
    if isinstance(kind, T.ArrayType):
        each = _slots(F.get(value, F.lit(0)), kind.elementType)
        if isinstance(each, int):
            return F.coalesce(F.array_size(value), F.lit(0)) * each if each else 0
        counts = F.transform(value, lambda x: _slots(x, kind.elementType))
        return F.coalesce(F.aggregate(counts, F.lit(0), lambda a, n: a + n), F.lit(0))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _slots(_by_key(value, kind), _entry_list(kind))
    return 0


def _plus(a: int | Column, b: int | Column) -> int | Column:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    return (F.lit(a) if isinstance(a, int) else a) + (F.lit(b) if isinstance(b, int) else b)


def _by_key(value: Column, kind: T.MapType) -> Column:
    """Entries of a map by key; keys are no slots, so they sit in a field of another type."""
    entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.transform(entries, lambda e: F.struct(F.encode(e["key"], "UTF-8").alias("key"), e["value"].alias("value")))


def _entry_list(kind: T.MapType) -> T.ArrayType:
    return T.ArrayType(T.StructType().add("key", T.BinaryType()).add("value", kind.valueType))


def _texts(value: Column, kind: T.DataType) -> Column:
    """All slots of a typed value, in path order."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array(value)
    if isinstance(kind, T.StructType):
        parts = [_texts(value[f.name], f.dataType) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: _texts(x, kind.elementType))), none)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _texts(_by_key(value, kind), _entry_list(kind))
    return none


def _before(counts: Column) -> Column:
    """Sum of the counts before each place, in blocks."""
    add = lambda a, n: a + n
    heads = F.aggregate(
        F.transform(block_numbers(counts), lambda k: F.aggregate(F.transform(block_range(counts, k), lambda i: F.get(counts, i)), F.lit(0), add)),
        F.array(F.lit(0)),
        lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
    )

    def within(h: Column) -> Column:
        def place(i: Column) -> Column:
            k = F.call_function("div", i, F.lit(BLOCK)).cast("int")
            rows = F.slice(counts, k * BLOCK + 1, i - k * BLOCK)
            return F.get(h, k) + F.aggregate(rows, F.lit(0), add)

        return F.transform(F.sequence(F.lit(0), F.size(counts) - 1), place)

    return F.when(F.size(counts) > 0, let(heads, within)).otherwise(F.array().cast("array<int>"))


def rewrite(value: Column, kind: T.DataType, texts: Column, first: Column | None = None) -> Column:
    """A typed value whose string slots hold ``texts``, in the order of ``_texts``."""
    first = F.lit(0) if first is None else first
    if isinstance(_slots(value, kind), int) and _slots(value, kind) == 0:
        return value
    if isinstance(kind, T.StringType):
        return F.get(texts, first).cast(kind)
    if isinstance(kind, T.StructType):
        at, done = first, {}
        for f in sorted(kind.fields, key=lambda f: f.name):
            done[f.name] = rewrite(value[f.name], f.dataType, texts, at).alias(f.name)
            at = _plus(at, _slots(value[f.name], f.dataType))
        return F.when(value.isNotNull(), F.struct(*[done[f.name] for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        each = _slots(F.get(value, F.lit(0)), kind.elementType)
        if isinstance(each, int):
            return F.transform(value, lambda x, i: rewrite(x, kind.elementType, texts, first + i * each))
        counts = F.transform(value, lambda x: _slots(x, kind.elementType))
        starts = lambda r: F.transform(
            value, lambda x, i: rewrite(x, kind.elementType, texts, first + F.get(r, i))
        )
        return F.when(value.isNotNull(), let(let(counts, _before), starts))
    entries = rewrite(_by_key(value, kind), _entry_list(kind), texts, first)
    back = F.transform(entries, lambda e: F.struct(F.decode(e["key"], "UTF-8").alias("key"), e["value"].alias("value")))
    return F.when(value.isNotNull(), F.map_from_entries(back))


# --- masking ----------------------------------------------------------------


def _spans_of(text: Column, spans: Column, leaf: Column) -> Column:
    return F.transform(
        with_originals(text, spans),
        lambda s: F.struct(
            leaf.cast("int").alias("leaf"), s["byte_start"].alias("start"), s["byte_end"].alias("end"),
            s["ty"].alias("ty"), s["original"].alias("original"),
        ),
    )


_SPANS = "array<struct<leaf:int,start:int,end:int,ty:string,original:string,byte_start:int>>"


def detect_leaves(
    df: DataFrame,
    texts: str,
    ruleset: Ruleset,
    tenant: str | None = None,
    custom: Sequence = (),
    glossary: DataFrame | None = None,
    key: Sequence[str] = (),
    out: str = "spans",
) -> DataFrame:
    """Findings in an array of texts, as one list ordered by text and place.

    ``byte_start`` numbers the findings of a row; ``leaf``, ``start`` and ``end`` say
    where they stand. Rules and few terms are read in place. User detectors and
    large glossaries read one row per text, and their findings return to the row
    by ``key``; texts do not come back, and rows without findings do not move.
    """
    owner = F.col(tenant) if tenant else None
    if not custom and glossary is None and len(ruleset.terms) <= MAX_ALTERNATION_TERMS:
        nested = F.transform(
            texts, lambda t, j: let(find_spans(t, ruleset, owner), lambda s: _spans_of(t, s, j))
        )
        flat = F.flatten(nested)
        found = df
    else:
        if not key:
            raise ValueError("user detectors and large glossaries need the columns that name a row")
        names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
        kept = [f"_k{i}" for i in range(len(key))]
        rows = df.select(*names, *([owner.alias("_tenant")] if tenant else []), F.posexplode(texts).alias("_leaf", "_text"))
        seen = detect(rows.where(F.col("_text").isNotNull()), ruleset, "_text", "_tenant" if tenant else None, custom,
                      out="_s", glossary=glossary, key=[*kept, "_leaf"])
        parts = seen.select(
            *kept, "_leaf", F.transform("_s", lambda s: F.struct(
                F.col("_leaf").alias("leaf"), s["byte_start"].alias("start"), s["byte_end"].alias("end"),
                s["ty"].alias("ty"), s["original"].alias("original"))).alias("_s")
        ).where(F.size("_s") > 0)
        whole = parts.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("_leaf", "_s"))).alias("_p"))
        back = whole.select(*[F.col(n).alias(k) for n, k in zip(kept, key)], F.flatten(F.transform("_p", lambda x: x["_s"])).alias("_flat"))
        found = df.join(back, list(key), "left")
        flat = F.col("_flat")
    numbered = F.transform(flat, lambda s, i: s.withField("byte_start", i))
    return found.withColumn(out, F.coalesce(numbered, F.array()).cast(_SPANS)).drop("_flat")


def _edits(texts: Column, spans: Column, id_of: Callable[[Column], Column], pads: Column, style) -> Column:
    """``array<struct<leaf,text>>``: the masked text of each leaf that has findings."""
    heads = F.filter(
        F.transform(spans, lambda s, i: F.when(F.coalesce(F.get(spans, i - 1)["leaf"] != s["leaf"], F.lit(True)), i)),
        lambda i: i.isNotNull(),
    )

    def masked(h: Column) -> Column:
        def one(first: Column, j: Column) -> Column:
            end = F.coalesce(F.get(h, j + 1), F.size(spans))
            own = F.transform(
                F.slice(spans, first + 1, end - first),
                lambda s: s.withField("byte_start", s["start"]).withField("byte_end", s["end"]),
            )
            leaf = F.get(spans, first)["leaf"]
            return F.struct(
                leaf.alias("leaf"),
                let(own, lambda o: let(F.get(texts, leaf), lambda t: apply_spans(t, o, id_of, pads, style))).alias("text"),
            )

        return F.transform(h, one)

    return let(heads, masked)


class _Body:
    """A JSON column as texts and back."""

    def __init__(self, body: str, paths: Sequence[str]):
        self.body, self.paths = body, paths

    def read(self, df: DataFrame) -> DataFrame:
        ready = df.withColumn("_json", parsed(F.col(self.body)))
        ats = F.transform(places(F.col("_json"), self.paths), lambda l: l["at"])
        ready = ready.withColumn("_at", F.coalesce(ats, F.array().cast("array<int>")))
        return ready.withColumn("_texts", F.transform("_at", lambda at: text_at(F.col("_json.pieces"), at)))

    def write(self, edits: Column) -> Column:
        moved = F.transform(edits, lambda e: F.struct(F.get(F.col("_at"), e["leaf"]).alias("at"), e["text"].alias("text")))
        return rebuild_body(F.col("_json"), moved)

    # What cannot be read cannot be masked: it does not go on.
    def plain(self) -> Column:
        return F.when(F.col("_json").isNotNull() | (F.coalesce(F.length(self.body), F.lit(0)) == 0), F.col(self.body))


class _Typed:
    """A struct, array or map column as texts and back."""

    def __init__(self, body: str, kind: T.DataType):
        self.body, self.kind = body, kind

    def read(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_texts", _texts(F.col(self.body), self.kind))

    def write(self, edits: Column) -> Column:
        def put(e: Column) -> Column:
            slots = F.transform("_texts", lambda t, j: F.struct(j.alias("leaf"), F.lit(1).alias("kind"), t.alias("text")))
            news = F.transform(e, lambda x: F.struct(x["leaf"].alias("leaf"), F.lit(0).alias("kind"), x["text"].alias("text")))

            def merged(both: Column) -> Column:
                one = lambda x, k: F.when(
                    x["kind"] == 1,
                    F.struct(F.when((F.get(both, k - 1)["leaf"] == x["leaf"]) & (F.get(both, k - 1)["kind"] == 0), F.get(both, k - 1)["text"])
                             .otherwise(x["text"]).alias("t")),
                )
                return F.transform(F.filter(F.transform(both, one), lambda x: x.isNotNull()), lambda x: x["t"])

            return let(let(F.array_sort(F.concat(slots, news)), merged), lambda t: rewrite(F.col(self.body), self.kind, t))

        return let(edits, put)

    def plain(self) -> Column:
        return F.col(self.body)


def _mask_rows(
    df: DataFrame, form: _Body | _Typed, ruleset: Ruleset, secret, scope, style, enforce, tenant, custom, glossary, key
) -> DataFrame:
    found = detect_leaves(form.read(df), "_texts", ruleset, tenant, custom, glossary, key, "_spans")
    # One read of the text serves the masked body, the vault and the report.
    found = found.withColumn("report", report_of(F.col("_spans")))
    if not enforce:
        none = F.array().cast("array<struct<id:bigint,original:string>>")
        return found.select(*df.columns, F.col(form.body).alias("masked_body"), none.alias("entries"), "report")
    numbered = found.withColumn("_row", intern_row(F.transform("_spans", lambda s: s["original"]))).withColumn(
        "_numbered", F.zip_with("_spans", "_row.ids", lambda s, i: s.withField("id", i))
    )
    named = F.coalesce(F.col(scope).cast("string"), F.lit("r\x1f"))
    edits = let(
        mac_pads(scope_key_hex(secret, named)),
        lambda pads: _edits(F.col("_texts"), F.col("_numbered"), lambda s: s["id"], pads, style),
    )
    edited = numbered.withColumn("_edits", F.when(F.size("_numbered") > 0, edits))
    body = F.when(F.size("_numbered") > 0, form.write(F.col("_edits"))).otherwise(form.plain())
    return edited.select(*df.columns, body.alias("masked_body"), F.col("_row.entries").alias("entries"), "report")


def mask_json(
    df: DataFrame,
    ruleset: Ruleset,
    secret: bytes | str,
    scope: str,
    body: str = "body",
    paths: Sequence[str] = (ALL,),
    style: str = "typed-sentinel",
    enforce: bool = True,
    tenant: str | None = None,
    custom: Sequence = (),
    glossary: DataFrame | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Detect, report and mask the leaves of a JSON body.

    All leaves of a body share one vault of its own, ids by first sight in
    path order. One projection, no shuffle; ``custom`` detectors and a
    ``glossary`` (or very many terms) need ``key``, see ``detect_leaves``. With
    ``enforce=False`` the body stays as it is and the vault is empty. A body that
    does not parse gives null when enforced: see also
    ``policy.fail_closed_split``. Rows without a scope share one tag key.
    """
    return _mask_rows(df, _Body(body, paths), ruleset, secret, scope, style, enforce, tenant, custom, glossary, key)


def mask_json_typed(
    df: DataFrame,
    ruleset: Ruleset,
    secret: bytes | str,
    scope: str,
    body: str = "body",
    style: str = "typed-sentinel",
    enforce: bool = True,
    tenant: str | None = None,
    custom: Sequence = (),
    glossary: DataFrame | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """``mask_json`` of every string in a struct, array or map column; the column keeps its type."""
    form = _Typed(body, df.schema[body].dataType)
    return _mask_rows(df, form, ruleset, secret, scope, style, enforce, tenant, custom, glossary, key)


def mask_json_session(
    df: DataFrame,
    ruleset: Ruleset,
    secret: bytes | str,
    key: Sequence[str],
    scope: str,
    order: Sequence[str],
    body: str = "body",
    paths: Sequence[str] = (ALL,),
    vault: DataFrame | None = None,
    style: str = "typed-sentinel",
    tenant: str | None = None,
    custom: Sequence = (),
    glossary: DataFrame | None = None,
    stage: Callable[..., DataFrame] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Mask bodies that share a vault per scope: ``(rows with masked_body and report, new entries)``.

    Findings of all leaves meet the vault by (scope, original) and return to
    their body by row, leaf and place; bodies without findings are not
    shuffled. Ids go by ``order``, then path order. A body whose scope is null has
    a vault of its own, named by its key. A body that does not parse gives null.
    ``options`` as in ``mask_session``.
    """
    form = _Body(body, paths)
    read = detect_leaves(form.read(df), "_texts", ruleset, tenant, custom, glossary, key, "spans")
    found = read.withColumn("_plain", form.plain()).select(*df.columns, "_plain", "spans")

    def render(id_of: Callable[[Column], Column], pads: Column) -> Column:
        # Staged rows carry findings only; their bodies are cut anew.
        def place(p: Column) -> Column:
            def write(ats: Column) -> Column:
                texts = F.transform(ats, lambda at: text_at(p["pieces"], at))

                def put(t: Column) -> Column:
                    edits = let(pads, lambda k: _edits(t, F.col("spans"), id_of, k, style))
                    moved = F.transform(edits, lambda e: F.struct(F.get(ats, e["leaf"]).alias("at"), e["text"].alias("text")))
                    return rebuild_body(p, moved)

                return let(texts, put)

            return let(F.transform(places(p, paths), lambda l: l["at"]), write)

        return let(parsed(F.col(body)), place)

    masked, entries = mask_session(
        found, secret, key, scope, order, vault, "_plain", style, stage=stage, render=render, **options
    )
    return masked.withColumnRenamed("masked", "masked_body").drop("_plain"), entries


def unmatched_paths(df: DataFrame, key: Sequence[str], body: str, paths: Sequence[str]) -> DataFrame:
    """Paths that reached no string in a parsable body: that text is unscanned."""

    def checks(p: Column) -> Column:
        return F.array(
            *[F.struct(F.lit(path).alias("path"), F.size(places(p, [path])).alias("hits")) for path in paths]
        )

    return (
        df.select(*key, F.explode(let(parsed(F.col(body)), lambda p: F.when(p.isNotNull(), checks(p)))).alias("_c"))
        .where(F.col("_c.hits") == 0)
        .select(*key, F.col("_c.path").alias("path"))
    )
