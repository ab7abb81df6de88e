"""Benchmark decontamination by a positional inverted index, in DataFrame operations.

A benchmark item is cut into windows of ten words. Counts of the benchmark's
words over the corpus say which word of each window is the rarest. Only the
postings of those words, (word, row, position), are stored; each gives, by the
word's offset in its windows, the places where a window can start. The other
words of a window are compared at their offsets in those texts alone, exactly
(``phrases``) or within a slop and in any order (``near``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import explode_once
from ..plans.stage import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Words of a text; none if it is null."""
    found = F.array_remove(F.split(lower_ascii(text), _BREAKS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _row(key: str, text: str) -> Column:
    """Names a row by what it holds, so that repeated keys with other texts stay apart."""
    return F.xxhash64(F.lit("row"), F.col(key), F.col(text))


def windows_of(items: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """``(item, phrase, len, words)``: distinct windows of each item."""
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), words_of(F.col(text)).alias("w"))
    rows = rows.where(F.size("w") > 0)
    length = F.least(F.lit(size), F.size("w"))
    at = F.sequence(F.lit(1), F.size("w") - length + 1)
    rows = rows.select("item", length.alias("len"), "w", F.explode(at).alias("i"))
    rows = rows.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("words"))
    return rows.withColumn("phrase", F.array_join("words", " ")).distinct()


def rarest_terms(docs: DataFrame, text: str, windows: DataFrame, exact: bool = True) -> DataFrame:
    """``(word, offset, phrase, len)``: the rarest word of each window.

    A window with a word that no text has cannot occur exactly; otherwise
    (``exact=False``) the rarest of the words that texts have stands for it.
    """
    terms = windows.dropDuplicates(["phrase"]).select("phrase", "len", F.posexplode("words").alias("offset", "word"))
    terms = stage(terms, "terms")
    vocabulary = stage(terms.select("word").distinct(), "vocabulary")
    seen = explode_once(docs.select(words_of(F.col(text)).alias("w")), "w", out="word")
    counts = seen.join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    least = terms.join(counts, "word", "left" if exact else "inner").groupBy("phrase", "len").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("m")
    )
    return least.where("m.n > 0").select("m.word", "m.offset", "phrase", "len")


def postings(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """The index of ``words``: ``(word, key, row, position)``, positions from 0."""
    rows = docs.select(F.col(key).alias("key"), _row(key, text).alias("row"), words_of(F.col(text)).alias("w"))
    flat = rows.select("key", "row", F.posexplode("w").alias("position", "word"))
    return flat.join(words, "word", "left_semi")


def _places(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, size: int, slop: int):
    """Windows, and texts' words at the places where they can start."""
    windows = stage(windows_of(items, item_key, item_text, size), "windows")
    anchors = stage(rarest_terms(docs, text, windows, exact=not slop), "anchors")
    index = stage(postings(docs, key, text, anchors.select("word").distinct()), "postings")
    # Offset-adjusted: a posting minus the word's offset is a start.
    starts = index.join(anchors, "word").select(
        "key", "row", (F.col("position") - F.col("offset")).alias("start"), "len", F.xxhash64("phrase").alias("h")
    )
    starts = starts.where(F.col("start") >= -slop)
    per_row = starts.groupBy("key", "row").agg(F.collect_set(F.struct("start", "len", "h")).alias("starts"))
    texts = docs.select(F.col(key).alias("_key"), _row(key, text).alias("_row"), F.col(text).alias("_text"))
    met = per_row.join(texts, (F.col("row") == F.col("_row")) & F.col("key").eqNullSafe(F.col("_key")))
    return windows, met.select("key", "row", "starts", words_of(F.col("_text")).alias("w"))


def phrases(docs, items, key="doc_id", text="text", item_key="item_id", item_text="text", size=WINDOW):
    """``(key, row, start, len, phrase)``, every exact occurrence of a window; and the windows."""
    windows, met = _places(docs, items, key, text, item_key, item_text, size, 0)

    def read(w: Column, s: Column) -> Column:
        fits = (s["start"] >= 0) & (s["start"] + s["len"] <= F.size(w))
        said = F.array_join(F.slice(w, s["start"] + 1, s["len"]), " ")
        return F.struct(s["start"].alias("start"), s["len"].alias("len"), s["h"].alias("h"), F.when(fits, said).alias("said"))

    slices = F.transform("starts", lambda s: read(F.col("w"), s))
    found = explode_once(met.select("key", "row", F.filter(slices, lambda s: F.xxhash64(s["said"]) == s["h"]).alias("f")), "f", "key", "row")
    found = found.select("key", "row", "s.start", "s.len", F.col("s.said").alias("phrase")).distinct()
    # Hashes agree; the words decide.
    return found.join(windows.select("phrase").distinct(), "phrase", "left_semi"), windows


def near(
    docs, items, key="doc_id", text="text", item_key="item_id", item_text="text", size=WINDOW, slop=3, share=0.8
) -> DataFrame:
    """``(key, row, item, start, terms)``: windows met within ``slop`` words, in any order.

    ``terms`` counts the window's distinct words between ``slop`` words before
    the place and ``slop`` behind; at least ``share`` of them have to be there.
    """
    windows, met = _places(docs, items, key, text, item_key, item_text, size, slop)

    def read(w: Column, s: Column) -> Column:
        first = F.greatest(s["start"] - slop, F.lit(0))
        words = F.slice(w, first + 1, s["start"] + s["len"] + slop - first)
        return F.struct(s["start"].alias("start"), s["h"].alias("h"), F.array_distinct(words).alias("around"))

    flat = explode_once(met.select("key", "row", F.transform("starts", lambda s: read(F.col("w"), s)).alias("f")), "f", "key", "row")
    flat = flat.select("key", "row", "s.start", "s.around", "s.h")
    wanted = windows.select("item", F.array_distinct("words").alias("words"), F.xxhash64("phrase").alias("h"))
    terms = F.size(F.array_intersect("words", "around"))
    met = flat.join(wanted, "h").withColumn("terms", terms).where(F.col("terms") >= share * F.size("words"))
    return met.select("key", "row", "item", "start", "terms").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = WINDOW
) -> DataFrame:
    """Per row: ``(key, n_words, n_hit, n_items, items_sha256, contaminated)``.

    A window is ``size`` words of an item in a row, all of a shorter one. Null,
    empty and wordless texts on either side hit nothing; null item keys are no
    items; equal texts under several items count for each. Rows that repeat one
    key are told apart by their text and come back as often as they are there.
    """
    found, windows = phrases(docs, items, key, text, item_key, item_text, size)
    found = stage(found, "hits")
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("len")).alias("b"))
    # Length of a union of intervals in order: what each adds beyond the reach so far.
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    grow = lambda t, s: F.struct(
        (t["n"] + F.greatest(s["b"] - F.greatest(s["a"], t["to"]), F.lit(0))).alias("n"),
        F.greatest(t["to"], s["b"]).alias("to"),
    )
    hit = found.groupBy("key", "row").agg(F.sort_array(F.collect_set(span)).alias("s"))
    hit = hit.select("key", "row", F.aggregate("s", zero, grow, lambda t: t["n"]).cast("long").alias("n_hit"))
    named = found.select("key", "row", "phrase").join(windows.select("phrase", "item"), "phrase")
    named = named.groupBy("key", "row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("i"))
    marks = hit.join(named.select(F.col("key").alias("k"), F.col("row").alias("r"), "i"), (F.col("row") == F.col("r")) & F.col("key").eqNullSafe(F.col("k")))
    rows = docs.select(
        F.col(key).alias("_key"),
        _row(key, text).alias("_row"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(_ANY_WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    rows = rows.join(marks, (F.col("row") == F.col("_row")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    items_found = F.coalesce("i", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        F.col("_key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
