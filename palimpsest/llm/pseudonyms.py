"""Format-preserving pseudonyms of personal numbers, dates and addresses.

Numbers and dates that pass their check (Luhn digit, octets, calendar, issued
areas) are permuted within their format by a keyed Feistel network: equal values
get equal pseudonyms in every text, different values different ones, and the
holder of the key can undo it. Everything is a projection of DataFrame
functions; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let, substr

ROUNDS = 8
# Steps of cycle walking: a step leaves the domain at most six times in seven.
WALK = 64
# For cards, a step leaves the domain about once in ten.
CARD_WALK = 16

# Tried once in each run of its characters: where the run begins, or behind the match before. A domain has 127 labels at most.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|(?<![0-9])[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Card layouts come first, each with a short number behind it (expiry, security code) that may be part of it;
# other separators follow, and none of them runs into a layout or into a value of another kind.
_OTHER = f"{IP}|{DATE}|{PHONE}|{SOCIAL}"
_GROUPED = "|".join(f"[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}" for s in " -")
_PLAIN = r"[0-9]{13,19}(?![0-9])"
_NEXT = rf"(?:{_GROUPED})(?![0-9])|{_PLAIN}|{_OTHER}"
_BEHIND = rf"(?:[ -](?!{_NEXT})[0-9]{{1,4}}(?![0-9]))?"
_FREE = rf"[0-9](?:(?:[ -](?!{_NEXT}))?[0-9]){{12,18}}(?![0-9])"
CARD = rf"(?<![0-9])(?:(?:{_GROUPED})(?![0-9]){_BEHIND}|{_PLAIN}|{_FREE})"
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "phone": PHONE, "social": SOCIAL, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
# What every match has; texts without it are not scanned.
GUARD = r"@|[0-9][. /-]?[0-9]|[0-9]\."

_FIRST, _DAYS = "1900-01-01", 73_049


def keyed(secret: str, label: str, value: Column, turn: Column, modulus: Column) -> Column:
    """A keyed number below ``modulus``: fifteen hex digits of a double hash."""
    inner = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(label), turn, value).cast("binary"), 256)
    outer = F.sha2(F.concat(F.lit(secret), inner).cast("binary"), 256)
    return F.conv(F.substring(outer, 1, 15), 16, 10).cast("bigint") % modulus


def feistel(value: Column, left: Column, right: Column, secret: str, label: str, undo: bool = False) -> Column:
    """A keyed permutation of the numbers below ``left * right``."""
    rounds = list(range(ROUNDS))
    if undo:
        rounds.reverse()
    sign = F.lit(-1 if undo else 1)
    start = F.struct(F.call_function("div", value, right).alias("u"), (value % right).alias("v"))

    def turn(t: Column, i: Column) -> Column:
        u = F.pmod(t["u"] + sign * keyed(secret, label, t["v"], i, left), left)
        v = F.pmod(t["v"] + sign * keyed(secret, label, t["u"], i, right), right)
        even = i % 2 == 0
        return F.struct(
            F.when(even, u).otherwise(t["u"]).alias("u"), F.when(even, t["v"]).otherwise(v).alias("v")
        )

    steps = F.array(*map(F.lit, rounds))
    return F.aggregate(steps, start, turn, lambda t: t["u"] * right + t["v"])


def walk(value: Column, inside, left, right, secret: str, label: str, undo: bool = False) -> Column:
    """Permute again until the number is ``inside``: a permutation of that set."""
    step = lambda x: feistel(x, F.lit(left), F.lit(right), secret, label, undo)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        step(value),
        lambda x, _: F.when(inside(x), x).otherwise(step(x)),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def _permute_digits(digits: Column, secret: str, label: str, undo: bool) -> Column:
    """Digit strings of up to 18 digits, permuted among those of their length."""
    n = F.length(digits)
    left, right = _power(F.call_function("div", n, F.lit(2)).cast("int")), _power((n - F.call_function("div", n, F.lit(2))).cast("int"))
    new = feistel(digits.try_cast("bigint"), left, right, secret, label, undo)
    return F.lpad(new.cast("string"), n, F.lit("0"))


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    letters = F.filter(F.split(shape, ""), lambda c: c != "")

    def put(c: Column, i: Column) -> Column:
        before = F.length(_digits(substr(shape, F.lit(1), i)))
        return F.when(c.between("0", "9"), substr(digits, before + 1, 1)).otherwise(c)

    return F.array_join(F.transform(letters, put), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one counting once."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(each, weigh), F.lit(0), lambda t, d: t + d)


def card(value: Column, secret: str, undo: bool = False) -> Column:
    """Luhn-valid card numbers: the payload is permuted, the check digit follows.

    A grouped number with more digits behind it is read as the layout alone, as
    the whole, or as its last sixteen digits: the first of these that is valid.
    Numbers are walked to one that is read alike, so that it can be undone.
    """

    def reads(d: Column) -> Column:
        n = F.length(d)
        base = F.when(F.rlike(value, F.lit("^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])")), 16).when(
            F.rlike(value, F.lit("^[0-9]{4}([ -])[0-9]{6}\\1[0-9]{5}(?![0-9])")), 15
        )
        one = lambda at, size: F.struct(at.cast("int").alias("at"), size.cast("int").alias("size"))
        zero = F.lit(0)
        all_of = F.array(
            one(zero, base), one(zero, F.when(n <= 19, n)), one(n - 16, F.when((base == 16) & (n == 20), F.lit(16)))
        )
        return F.array_distinct(F.filter(all_of, lambda c: c["size"].isNotNull()))

    def read(d: Column, ways: Column) -> Column:
        return F.get(F.filter(ways, lambda c: luhn_sum(substr(d, c["at"] + 1, c["size"])) % 10 == 0), F.lit(0))

    def put(d: Column, c: Column) -> Column:
        def close(p: Column) -> Column:
            check = F.pmod(F.lit(10) - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10))
            behind = substr(d, c["at"] + c["size"] + 1, F.length(d))
            return F.concat(substr(d, F.lit(1), c["at"]), p, check.cast("string"), behind)

        return let(_permute_digits(substr(d, c["at"] + 1, c["size"] - 1), secret, "card", undo), close)

    def swap(d: Column) -> Column:
        def choose(ways: Column) -> Column:
            def new(c: Column) -> Column:
                again = F.aggregate(
                    F.sequence(F.lit(1), F.lit(CARD_WALK)),
                    put(d, c),
                    lambda x, _: F.when(read(x, ways) == c, x).otherwise(put(x, c)),
                )
                moved = F.when(F.get(ways, F.lit(0)) == c, put(d, c)).otherwise(again)
                return F.when(c.isNull(), value).otherwise(_fill(value, moved))

            return let(read(d, ways), new)

        return let(reads(d), choose)

    return let(_digits(value), swap)


def phone(value: Column, secret: str, undo: bool = False) -> Column:
    """The last ten digits are permuted; a country code stays."""

    def swap(d: Column) -> Column:
        head = substr(d, F.lit(1), F.length(d) - 10)
        tail = F.substr(d, F.length(d) - 9)
        return _fill(value, F.concat(head, _permute_digits(tail, secret, "phone", undo)))

    return let(_digits(value), swap)


def social(value: Column, secret: str, undo: bool = False) -> Column:
    """Numbers with an area, group and serial that can be issued stay among those."""

    def issued(x: Column) -> Column:
        area = F.call_function("div", x, F.lit(1_000_000))
        group, serial = F.call_function("div", x, F.lit(10_000)) % 100, x % 10_000
        return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)

    def swap(x: Column) -> Column:
        new = walk(x, issued, 10_000, 100_000, secret, "social", undo)
        return F.when(issued(x), _fill(value, F.lpad(new.cast("string"), 9, "0"))).otherwise(value)

    return let(_digits(value).try_cast("bigint"), swap)


def ip(value: Column, secret: str, undo: bool = False) -> Column:
    """Addresses with four octets below 256 become other addresses."""

    def swap(o: Column) -> Column:
        whole = F.aggregate(o, F.lit(0).cast("bigint"), lambda t, x: t * 256 + x)
        new = feistel(whole, F.lit(65536), F.lit(65536), secret, "ip", undo)
        parts = let(new, lambda n: F.concat_ws(".", *[F.shiftrightunsigned(n, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]))
        return F.when(F.forall(o, lambda x: x < 256), parts).otherwise(value)

    return let(F.transform(F.split(value, r"\."), lambda x: x.try_cast("bigint")), swap)


def date(value: Column, secret: str, undo: bool = False) -> Column:
    """Calendar days of 1900 to 2099 become other such days in the same spelling."""
    spelling = F.when(F.contains(value, F.lit("-")), "yyyy-MM-dd").when(F.contains(value, F.lit("/")), "yyyy/MM/dd").otherwise("dd.MM.yyyy")
    plain = F.when(
        F.contains(value, F.lit(".")),
        F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)),
    ).otherwise(F.translate(value, "/", "-"))

    def swap(n: Column) -> Column:
        new = walk(n, lambda x: x < _DAYS, 270, 271, secret, "date", undo)
        day = F.date_add(F.lit(_FIRST).cast("date"), new.cast("int"))
        return F.coalesce(F.date_format(day, "yyyy-MM-dd"), value)

    def spell(iso: Column) -> Column:
        y, m, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
        return F.when(spelling == "dd.MM.yyyy", F.concat_ws(".", d, m, y)).when(
            spelling == "yyyy/MM/dd", F.concat_ws("/", y, m, d)
        ).otherwise(F.concat_ws("-", y, m, d))

    days = F.datediff(plain.try_cast("date"), F.lit(_FIRST).cast("date")).cast("bigint")
    return F.when(days.isNotNull(), let(let(days, swap), spell)).otherwise(value)


def email(value: Column, secret: str, undo: bool = False) -> Column:
    """The part before the @ becomes a keyed name; this one cannot be undone."""
    if undo:
        return value
    name = F.sha2(F.concat_ws("|", F.lit(secret), F.lit("email"), F.lower(value)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(name, 1, 12), F.lit("@"), F.substring_index(value, "@", -1))


SWAPS = {"email": email, "ip": ip, "date": date, "phone": phone, "social": social, "card": card}


def kind_of(value: Column) -> Column:
    """Which pattern a match of ``ANY`` came from."""
    found = F.when(F.contains(value, F.lit("@")), "email")
    for name, pattern in list(KINDS.items())[1:]:
        found = found.when(F.rlike(value, F.lit(f"^(?:{pattern})$")), name)
    return found


def swap_all(value: Column, secret: str, undo: bool) -> Column:
    def choose(kind: Column) -> Column:
        out = F.when(kind == "email", email(value, secret, undo))
        for name in list(SWAPS)[1:]:
            out = out.when(kind == name, SWAPS[name](value, secret, undo))
        return out.otherwise(value)

    return let(kind_of(value), choose)


def pseudonymize(
    docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", undo: bool = False
) -> DataFrame:
    """``(key, text, n_<kind>)`` for each row: the whole text with pseudonyms.

    ``n_<kind>`` counts the values that changed. Values that fail their check
    stay. Null texts stay null, with no values; repeated rows stay repeated.
    """
    t = F.col(text)
    shape = "array<struct<old:string,new:string,kind:string>>"

    def one(v: Column) -> Column:
        return F.struct(v.alias("old"), swap_all(v, secret, undo).alias("new"), kind_of(v).alias("kind"))

    found = F.when(F.rlike(t, F.lit(GUARD)), F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), one))
    rows = docs.select(F.col(key).alias("_key"), t.alias("_text"), F.coalesce(found, F.array()).cast(shape).alias("_f"))
    new = F.array_join(
        F.zip_with(F.split("_text", ANY, -1), "_f", lambda g, f: F.concat(g, F.coalesce(f["new"], F.lit("")))), ""
    )

    def changed(kind: str) -> Column:
        hit = F.filter("_f", lambda f: (f["kind"] == kind) & (f["old"] != f["new"]))
        return F.size(hit).cast("long").alias(f"n_{kind}")

    counts = [changed(k) for k in KINDS]
    return rows.select(
        F.col("_key").alias(key), F.when(F.size("_f") > 0, new).otherwise(F.col("_text")).alias(text), *counts
    )
