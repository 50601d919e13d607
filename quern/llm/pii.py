"""Format-preserving Feistel pseudonyms for personal data. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, unused

ROUNDS = 8
FIRST_DAY, DAYS = "1700-01-01", 146_097  # one whole cycle of the calendar, 189 * 773 days
IBAN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# What is looked for, in order of precedence at one place (Java regular expressions).
# Java matches a repeated group by recursion, so each has a bound; names and labels have those of mail and host names.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}+\.){1,126}[A-Za-z]{2,63}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ymd": r"(?<![0-9./-])[0-9]{4}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9]|[./-][0-9])",
    "dmy": r"(?<![0-9./-])(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|[12][0-9]|3[01])\2[0-9]{4}(?![0-9]|[./-][0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "intl": r"(?<![0-9+])\+[1-9](?:[ .-]?[0-9]){7,14}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _number(key: str, tag: str, round_: Column, half: Column) -> Column:
    """Round function: 60 bits of a keyed sha-256 of the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), round_.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def permuted(value: Column, high: int, low: int, key: str, tag: str) -> Column:
    """A keyed permutation of 0 ... high * low - 1: Feistel rounds over value / low and value % low."""
    # halves are below 2**31 each, so the division is exact in doubles
    start = F.struct(F.floor(value / F.lit(low)).cast("long").alias("a"), F.pmod(value, F.lit(low)).cast("long").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, r: F.when(r % 2 == 1, F.struct(F.pmod(s["a"] + _number(key, tag, r, s["b"]), F.lit(high)).cast("long").alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), F.pmod(s["b"] + _number(key, tag, r, s["a"]), F.lit(low)).cast("long").alias("b"))
        ),
        lambda s: s["a"] * F.lit(low) + s["b"],
    )


def _class(code: Column) -> tuple[Column, Column]:
    """The first of the characters that one of this code may become, and their number; 0 and 1 for others."""
    first = F.when(code.between(48, 57), 48).when(code.between(97, 122), 97).when(code.between(65, 90), 65).otherwise(0)
    return first, F.when(code.between(48, 57), 10).when(first > 0, 26).otherwise(1)


def _permuted_character(c: Column, key: str, tag: Column) -> Column:
    """A character alone has no other half to move by: its class is put in the order of keyed hashes."""

    def one(code: Column) -> Column:
        first, size = _class(code)
        order = F.array_sort(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.sha2(F.concat_ws(":", F.lit(key), tag, F.lit("one"), i.cast("string")), 256).alias("h"), i.alias("i"))))
        return F.when(first > 0, F.char(first + F.get(order, code - first)["i"])).otherwise(c)

    return let(F.ascii(c), one)


def permuted_text(text: Column, key: str, tag: str | Column) -> Column:
    """A keyed permutation of strings of one form: digits stay digits, letters keep their case, all else stays.

    Feistel rounds over the two halves; each character moves inside its class by a byte of the hash
    of the other half, of which bytes are reused after 32 characters. Case takes no part in the hash,
    so strings that differ in case alone become such strings.
    """
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def moved(half: Column, other: Column, r: Column) -> Column:
        def under(digest: Column) -> Column:
            def one(i: Column) -> Column:
                step = F.conv(F.substring(digest, F.lit(1) + F.lit(2) * F.pmod(i - 1, F.lit(32)), F.lit(2)), 16, 10).cast("int")

                def shift(code: Column) -> Column:
                    first, size = _class(code)
                    return F.when(first > 0, F.char(first + F.pmod(code - first + step, size)))

                return let(F.substring(half, i, F.lit(1)), lambda c: F.coalesce(let(F.ascii(c), shift), c))

            return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(half))), one), "")

        digest = F.sha2(F.concat_ws(":", F.lit(key), tag, r.cast("string"), F.lower(other)), 256)
        return F.when(F.length(half) > 0, let(digest, under)).otherwise(F.lit(""))

    cut = F.floor(F.length(text) / 2).cast("int")
    rounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b")),
        lambda s, r: F.when(r % 2 == 1, F.struct(moved(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), moved(s["b"], s["a"], r).alias("b"))
        ),
        lambda s: F.concat(s["a"], s["b"]),
    )
    return F.when(F.length(text) == 1, _permuted_character(text, key, tag)).otherwise(rounds)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refilled(form: Column, digits: Column, slots: str = "[0-9]") -> Column:
    """`form` with its characters of the class `slots` replaced in turn by those of `digits`."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(form)),
        F.struct(F.lit(0).alias("k"), F.lit("").alias("out")),
        lambda s, i: F.when(
            F.substring(form, i, F.lit(1)).rlike(slots),
            F.struct((s["k"] + 1).alias("k"), F.concat(s["out"], F.substring(digits, s["k"] + 1, F.lit(1))).alias("out")),
        ).otherwise(F.struct(s["k"].alias("k"), F.concat(s["out"], F.substring(form, i, F.lit(1))).alias("out"))),
        lambda s: s["out"],
    )


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10; zero for a valid number with its check digit."""

    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, x: a + x) % 10


def _valid_part(m: Column, plain: Callable[[Column], Column], least: int, valid: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """m with the longest part (of those the first) between blanks, dashes and ends that validates replaced.

    A match takes digits or capitals that only stand beside a number; `plain` is a part without its
    marks, `made` gets the part and that. Without a valid part m stays.
    """
    mark = lambda i: F.substring(m, i, F.lit(1)).isin(" ", "-")
    at = F.sequence(F.lit(1), F.length(m))
    starts = F.filter(at, lambda i: ~mark(i) & ((i == 1) | mark(i - 1)))
    ends = F.filter(at, lambda i: ~mark(i) & ((i == F.length(m)) | mark(i + 1)))

    def part(s: Column, e: Column) -> Column:
        return let(plain(F.substring(m, s, e - s + 1)), lambda x: F.struct((-F.length(x)).alias("n"), s.alias("s"), e.alias("e"), x.alias("x")))

    parts = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e - s >= least - 1), lambda e: part(s, e))))
    good = F.filter(F.filter(parts, lambda p: p["n"] <= -least), lambda p: valid(p["x"]))

    def replaced(p: Column) -> Column:
        new = made(F.substring(m, p["s"], p["e"] - p["s"] + 1), p["x"])
        return F.concat(F.substring(m, F.lit(1), p["s"] - 1), new, F.substring(m, p["e"] + 1, F.length(m)))

    return let(F.array_min(good), lambda p: F.when(p.isNotNull(), replaced(p)).otherwise(m))


def _card(m: Column, key: str) -> Column:
    """The first digit and the length stay, the check digit is made anew."""

    def made(form: Column, digits: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), permuted_text(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        full = let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return let(full, lambda f: _refilled(form, f))

    return _valid_part(m, _digits, 13, lambda x: (_luhn(x) == 0) & ~x.rlike("^(.)\\1*$"), made)


def _iban_rest(text: Column) -> Column:
    """The number of an IBAN (already turned) modulo 97."""

    def value(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(text)), value), F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97)


def _iban(m: Column, key: str) -> Column:
    """The country stays, the check digits are made anew."""

    def valid(plain: Column) -> Column:
        return plain.rlike("^[A-Z]{2}[0-9]{2}") & (_iban_rest(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)

    def made(form: Column, plain: Column) -> Column:
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        check = lambda new: F.lpad((F.lit(98) - _iban_rest(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        full = let(permuted_text(body, key, "iban"), lambda new: F.concat(country, check(new), new))
        return let(full, lambda f: _refilled(form, f, "[^ ]"))

    return _valid_part(m, lambda x: F.replace(x, F.lit(" "), F.lit("")), 15, valid, made)


def _ipv4(m: Column, key: str) -> Column:
    def made(part: Column) -> Column:
        new = permuted(((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3], 65536, 65536, key, "ipv4")
        return let(new, lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / F.lit(256**k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]))

    return let(F.transform(F.split(m, "\\."), lambda x: x.cast("long")), made)


def _ssn(m: Column, key: str) -> Column:
    """Area 001-899 but 666, group and serial not zero; other numbers of this form are none."""

    def text(new: Column) -> Column:
        a = F.floor(new / F.lit(99 * 9999))
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        g, s = F.pmod(F.floor(new / F.lit(9999)), F.lit(99)) + 1, F.pmod(new, F.lit(9999)) + 1
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))

    def made(part: Column) -> Column:
        area, group, serial = part[0], part[1], part[2]
        valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
        at = F.when(area > 666, area - 2).otherwise(area - 1)
        return F.when(valid, let(permuted((at * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn"), text)).otherwise(m)

    return let(F.transform(F.split(m, "-"), lambda x: x.cast("long")), made)


def _day(day: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    return let(
        F.datediff(day, first).cast("long"),
        lambda at: F.when(at.between(0, DAYS - 1), F.date_add(first, permuted(at, 189, 773, key, "date").cast("int"))),
    )


def _dates(m: Column, key: str, form: str) -> Column:
    """A date moves among the days of 1700 to 2099 in its own form, the same day alike in all forms.

    Day before month is tried first; a date that is only valid with the month first moves to a day
    that reads likewise: steps are repeated until the day is over 12.
    """
    sep = F.regexp_extract(m, "[-/.]", 0)
    shown = lambda d, order: F.coalesce(F.replace(F.date_format(d, order), F.lit("-"), sep), m)

    def made(part: Column) -> Column:
        day = lambda y, mm, dd: F.try_to_date(F.concat_ws("-", y, mm, dd), "yyyy-MM-dd")
        if form == "ymd":
            return let(_day(day(part[0], part[1], part[2]), key), lambda d: shown(d, "yyyy-MM-dd"))
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(64)),
            F.struct(F.lit(0).alias("k"), day(part[2], part[0], part[1]).alias("d")),
            lambda s, i: F.when((s["k"] > 0) & (F.dayofmonth(s["d"]) > 12), s).otherwise(F.struct((s["k"] + 1).alias("k"), _day(s["d"], key).alias("d"))),
            lambda s: s["d"],
        )
        return let(
            day(part[2], part[1], part[0]),
            lambda d: F.when(d.isNotNull(), let(_day(d, key), lambda x: shown(x, "dd-MM-yyyy"))).otherwise(let(walked, lambda x: shown(x, "MM-dd-yyyy"))),
        )

    return let(F.split(m, "[-/.]"), made)


def _email(m: Column, key: str) -> Column:
    """The name before the sign moves inside its form; the domain stays and takes part in the key."""
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(permuted_text(name, key, F.concat(F.lit("email "), F.lower(domain))), F.lit("@"), domain)


def _phone(m: Column, key: str) -> Column:
    """All digits move but the leading 1 of eleven and the first two of other international numbers; marks stay.

    Ten digits are a number of country 1, so all its written forms get one pseudonym.
    """

    def made(digits: Column) -> Column:
        n = F.length(digits)
        kept = F.when(~m.startswith("+"), n - 10).when((n == 11) & digits.startswith("1"), 1).otherwise(2)
        return let(kept, lambda k: F.concat(F.substring(digits, F.lit(1), k), permuted_text(F.substring(digits, k + 1, n - k), key, "phone")))

    return let(let(_digits(m), made), lambda x: _refilled(m, x))


KINDS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "iban": _iban,
    "ipv4": _ipv4,
    "ymd": lambda m, key: _dates(m, key, "ymd"),
    "dmy": lambda m, key: _dates(m, key, "dmy"),
    "phone": _phone,
    "intl": _phone,
    "ssn": _ssn,
    "card": _card,
}


def _whole(kind: str) -> str:
    """The pattern of a kind alone, for a match that was cut out of its text."""
    return "^(?:" + PATTERNS[kind].replace(r"\2", r"\1") + ")$"


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; a number that does not validate stays as it is."""
    out = m
    for kind, made in reversed(KINDS.items()):
        out = F.when(m.rlike(_whole(kind)), made(m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str = "quern") -> DataFrame:
    """docs with personal data in text replaced by pseudonyms of the same format; adds `pseudonyms`, their count.

    E-mail addresses, IBANs (valid check digits), IPv4 addresses, dates of 1700 to 2099, telephone
    numbers, social security numbers and card numbers (valid Luhn sum) are permuted under the key
    inside their format, so that equal values get equal pseudonyms in all documents, also if their
    blanks and dashes, the case of a mail name or the +1 of a telephone number differ. Equal mail
    names at two domains get two. Numbers that do not validate, and all other text, stay byte for
    byte: so do ten or nine digits without marks, dates with names of months, and mail names of over
    64 characters, which no address has. Digits after an international telephone number count as its own.
    Null text stays null with count 0; repeated rows come out alike; other columns pass through,
    whatever their names (`pseudonyms` is replaced, n_chars cannot change). The key is a secret of the caller.
    """
    columns = [c for c in docs.columns if c != "pseudonyms"]
    found, made = unused(docs, "found", "made")
    # each step once: a projection is not merged into the next if that would repeat its work
    out = docs.select(*columns, F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias(found))
    out = out.withColumn(made, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    pieces = F.zip_with(F.split("text", ANY, -1), F.col(made), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.aggregate(F.zip_with(found, made, lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    new = F.when(F.col(made).isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return out.select(*[new.alias(c) if c == "text" else F.col(c) for c in columns], F.coalesce(changed, F.lit(0)).alias("pseudonyms"))
