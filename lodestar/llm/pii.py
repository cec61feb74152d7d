"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers and dates that pass their format's checks (card: Luhn; IPv4: octets; date: calendar; social security number:
assigned ranges; phone: form) and the local part of e-mail addresses are permuted by a keyed Feistel network within
their format: a pseudonym passes the same checks, has the same punctuation, and equal values get equal pseudonyms in
all documents. The round function is SHA-256 over the key, the kind, the round and the other half. What fails its checks
stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
#: One pattern for each kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])",
}
OTHERS = "|".join(p for k, p in PATTERNS.items() if k != "card")
#: Fixed groupings of card numbers; those that pass their check are found beside any other digits.
GROUPED = (r"[0-9]{13,19}", r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{3}", r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}", r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")
#: Days are permuted within blocks of 250 * 292, about 200 years, counted from 1900-01-01.
DAY_HALVES = (250, 292)


def round_value(key: Column, kind: str, r: Column, half: Column) -> Column:
    """60 bits of SHA-256."""
    text = F.concat_ws("|", key, F.lit(kind), r.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column | int, right_size: Column | int, key: Column, kind: str) -> Column:
    """A struct (a, b): a keyed permutation of the pairs with a < left_size and b < right_size."""
    sizes = [F.lit(s).cast("long") if isinstance(s, int) else s.cast("long") for s in (left_size, right_size)]

    def step(acc: Column, r: Column) -> Column:
        even = (r % 2) == 0
        a = F.when(even, (acc["a"] + round_value(key, kind, r, acc["b"])) % sizes[0]).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise((acc["b"] + round_value(key, kind, r, acc["a"])) % sizes[1])
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the digit strings of one length (up to 36)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    pair = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), power(half), power(rest), key, kind)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["a"].cast("string"), half, "0"), F.lpad(p["b"].cast("string"), rest, "0")))[0]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit being the check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(((F.length(digits) - i) % 2) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x)


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def in_form(form: Column, digits: Column) -> Column:
    """form with its digits, from the first on, replaced by those of `digits`."""
    chars = F.split(form, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(acc: Column, ch: Column) -> Column:
        digit = ch.between("0", "9")
        return F.struct(
            F.concat(acc["out"], F.when(digit, F.substring(digits, acc["next"], F.lit(1))).otherwise(ch)).alias("out"),
            (acc["next"] + F.when(digit, 1).otherwise(0)).alias("next"),
        )

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def card(m: Column, key: Column) -> Column:
    """The card number's pseudonym, check digit included; null where the Luhn sum doesn't hold."""
    digits = only_digits(m)

    def rebuilt(body: Column) -> Column:
        check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        return in_form(m, F.concat(body, check.cast("string")))

    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return F.when(F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0), F.transform(F.array(body), rebuilt)[0])


def phone(m: Column, key: Column) -> Column:
    """Country code kept, the ten other digits permuted."""
    digits = only_digits(m)
    code = F.substring(digits, F.lit(1), F.length(digits) - 10)
    return in_form(m, F.concat(code, permuted_digits(F.right(digits, F.lit(10)), key, "phone")))


def ip(m: Column, key: Column) -> Column:
    """A permutation of all IPv4 addresses; null where an octet is over 255."""
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    shown = F.transform(F.array(pair), lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))[0]
    return F.when(F.forall(o, lambda x: x <= 255), shown)


def ssn(m: Column, key: Column) -> Column:
    """A permutation of the assignable numbers: area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def shown(p: Column) -> Column:
        a = p["a"] + 1 + F.when(p["a"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(good, F.transform(F.array(pair), shown)[0])


def date(m: Column, key: Column) -> Column:
    """Another day of the same 200 years in the same notation; null where the calendar has no such day.

    dd/mm/yyyy is read as such where that is a day, else as mm/dd/yyyy.
    """
    dots, slashes = m.contains("."), m.contains("/")
    european = F.try_to_timestamp(F.regexp_replace(m, r"[./]", "-"), F.lit("dd-MM-yyyy")).cast("date")
    american = F.try_to_timestamp(F.regexp_replace(m, r"[./]", "-"), F.lit("MM-dd-yyyy")).cast("date")
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    day = F.when(dots, european).when(slashes, F.coalesce(european, american)).otherwise(iso)
    n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    block = DAY_HALVES[0] * DAY_HALVES[1]
    start = F.floor(n / block) * block
    pair = feistel(F.floor((n - start) / DAY_HALVES[1]), (n - start) % DAY_HALVES[1], *DAY_HALVES, key, "date")

    def shown(p: Column) -> Column:
        new = F.date_add(F.lit("1900-01-01").cast("date"), (start + p["a"] * DAY_HALVES[1] + p["b"]).cast("int"))
        as_european = F.date_format(new, "dd-MM-yyyy")
        as_american = F.date_format(new, "MM-dd-yyyy")
        return F.when(dots, F.replace(as_european, F.lit("-"), F.lit("."))).when(slashes, F.replace(F.when(european.isNotNull(), as_european).otherwise(as_american), F.lit("-"), F.lit("/"))).otherwise(F.date_format(new, "yyyy-MM-dd"))

    return F.when(day.isNotNull(), F.transform(F.array(pair), shown)[0])


def email(m: Column, key: Column) -> Column:
    """The domain kept; letters and digits of the local part permuted within their class, the rest kept."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")

    def shifted(text: Column, other: Column, r: Column) -> Column:
        def one(ch: Column, i: Column) -> Column:
            move = round_value(key, "email", F.concat_ws(",", r.cast("string"), i.cast("string")), other)
            out = ch
            for c in classes:
                out = F.when((ch != "") & F.lit(c).contains(ch), F.substring(F.lit(c), ((F.instr(F.lit(c), ch) - 1 + move) % len(c) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def step(acc: Column, r: Column) -> Column:
        even = (r % 2) == 0
        return F.struct(F.when(even, shifted(acc["a"], acc["b"], r)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(shifted(acc["b"], acc["a"], r)).alias("b"))

    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))
    done = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, step, lambda acc: F.concat(acc["a"], acc["b"]))
    return F.concat(done, F.lit("@"), domain)


KINDS = {"email": email, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(m: Column, key: Column) -> Column:
    """A struct (kind, to) for one match of a text's pattern; kind null and to the match itself where it fails its checks."""
    out = named(F.lit(None).cast("string"), m, None)
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), named(KINDS[kind](m, key), m, kind)).otherwise(out)
    return out


def any_pattern(body: Column) -> Column:
    """A text's pattern: other kinds, the card numbers in it of a fixed grouping, and other digits that may be one.

    The last end where one of these numbers, a date or an address begins.
    """
    begin, end = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z-])"
    free = begin + r"[0-9](?:(?:[ -](?!{}" + PATTERNS["date"] + "|" + PATTERNS["ip"] + "))?[0-9]){12,18}" + end
    before, after = free.split("{}")
    found = F.concat(*[F.regexp_extract_all(body, F.lit(f"{begin}(?=({g}){end})"), F.lit(1)) for g in GROUPED])
    valid = F.array_distinct(F.filter(found, lambda c: luhn_sum(only_digits(c)) % 10 == 0))

    def with_cards(cards: Column) -> Column:
        own = F.concat(F.lit(f"{begin}(?:"), F.array_join(F.reverse(F.array_sort(cards)), "|"), F.lit(f"){end}"))
        return F.concat(F.lit(OTHERS + "|"), own, F.lit("|" + before), own, F.lit("|" + after))

    plain = F.lit(OTHERS + "|" + before + after)
    some = F.when(body.rlike(r"[0-9][0-9 -]{11,}[0-9]"), valid)
    return F.transform(F.array(some), lambda c: F.when(F.size(c) > 0, with_cards(c)).otherwise(plain))[0]


def named(to: Column, m: Column, kind: str | None) -> Column:
    return F.transform(F.array(to), lambda t: F.struct(F.when(t.isNotNull(), F.lit(kind)).cast("string").alias("kind"), F.coalesce(t, m).alias("to")))[0]


def pseudonymise(df: DataFrame, key: str, text: str = "text", counts: str = "pii") -> DataFrame:
    """df with pseudonyms in `text`, and a map `counts`: kind -> values replaced (empty for clean texts).

    Clean texts stay the same to the byte. A null text stays null with an empty map. Texts are handled whole. Where df
    has a column `counts`, the new one gets an underscore in front; other columns pass unchanged. Equal rows stay equal.
    An empty table gives an empty result. Phone numbers are those of ten digits in North American grouping, with any
    country code; kinds without a pattern of their own, such as bank accounts, stay as they are.
    """
    name, hidden, pattern, held = free_name(df, counts), free_name(df, "pii_matches"), free_name(df, "pii_pattern"), free_name(df, "pii_key")
    any_ = F.col(f"`{pattern}`")
    # The key comes as the one row of a table, so that no plan, log or page of the UI shows it.
    df = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(key,)], f"`{held}` string")))
    secret = F.col(f"`{held}`")
    body = F.col(f"`{text}`")
    none = F.array().cast("array<struct<kind:string,to:string>>")
    some = body.rlike("[0-9@]")
    found = df.withColumn(pattern, any_pattern(body)).withColumn(hidden, F.when(some, F.transform(F.regexp_extract_all(body, any_, F.lit(0)), lambda m: pseudonym(m, secret))).otherwise(none))
    kinds = F.filter(F.col(f"`{hidden}`.kind"), lambda k: k.isNotNull())
    tally = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    parts = F.zip_with(F.split(body, any_, -1), F.concat(F.array(F.lit("")), F.col(f"`{hidden}`.to")), lambda s, r: F.concat(r, s))
    rewritten = F.when(F.exists(F.col(f"`{hidden}`.kind"), lambda k: k.isNotNull()), F.array_join(parts, "")).otherwise(body)
    return found.withColumns({text: rewritten, name: tally}).drop(hidden, pattern, held)
