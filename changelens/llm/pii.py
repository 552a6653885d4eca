"""Format-preserving pseudonyms for personal data. DataFrame functions only.

Validated values are permuted by a keyed Feistel network within their format: card numbers (13 to 19 digits with Luhn's
check digit), telephone numbers (ten digits in groups of 3, 3 and 4,
with or without a country code, and 8 to 15 digits after a plus sign; the country code stays), IPv4 addresses, the local
part of e-mail addresses, and dates from 1900 to 2099. The permutation is a bijection that depends
on the key and the kind only, so equal values stay linked across documents; separators and lengths stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"

EMAIL = r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?!\d|[./-]\d)"
NATIONAL = r"(?<![\d+])(?:\+\d{1,3}[ .-]?|1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
FOREIGN = rf"(?<![\d+])\+[1-9](?:[ ./-]?(?!{ADDRESS}|{DATE})\(?\d\)?){{7,14}}(?!\d)"
PHONE = f"{NATIONAL}|{FOREIGN}"
#: Card numbers in one piece or in the usual groups, which no looser grouping may swallow.
WRITTEN = rf"(?<!\d)(?<!\d\.)(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}}(?:[ -](?!{PHONE})\d{{3}})?|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}|\d{{4}}[ -]\d{{5}}[ -]\d{{6}}|\d{{4}}(?:[ -]\d{{3}}){{3}})(?!\d|\.\d)"
LOOSE = rf"(?<!\d)(?<!\d\.)\d(?:[ -]?(?!{WRITTEN}|{ADDRESS}|{DATE}|{PHONE})\d){{12,18}}(?!\d|\.\d)"
CARD = f"{WRITTEN}|{LOOSE}"
ANY = "|".join((EMAIL, ADDRESS, DATE, PHONE, CARD))

#: The country code that international digits begin with.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Days from 1900-01-01 to 2099-12-31: 73049 = 17 * 4297.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)


def _round(key: str, tweak: str, i: Column, x: Column) -> Column:
    """A keyed hash of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _network(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: str) -> Column:
    """The struct (a, b) after an even number of rounds; a stays below size_a and b below size_b."""

    def step(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_a).otherwise(size_b)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _round(key, tweak, i, s["b"]) % size, size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permute(text: Column, alphabet: str, key: str, tweak: str) -> Column:
    """A text over the alphabet, permuted among those of its length; pieces of 18 are permuted one by one."""
    radix = len(alphabet)
    powers = F.array(*[F.lit(radix**k).cast("long") for k in range(10)])

    def number(s: Column) -> Column:
        return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * radix + F.position(c, F.lit(alphabet)) - 1)

    def letters(x: Column, n: Column) -> Column:
        return F.when(n < 1, "").otherwise(F.array_join(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda k: F.substring(F.lit(alphabet), (F.floor(x / F.element_at(powers, (k + 1).cast("int"))) % radix + 1).cast("int"), 1)), ""))

    def piece(s: Column) -> Column:
        n, u = F.length(s), F.floor(F.length(s) / 2).cast("int")
        v = n - u
        of = _network(number(F.substring(s, F.lit(1), u)), number(F.substring(s, u + 1, v)), F.element_at(powers, u + 1), F.element_at(powers, v + 1), key, tweak)
        return _bind(of, lambda r: F.concat(letters(r["a"], u), letters(r["b"], v)))

    count = F.ceil(F.length(text) / 18).cast("int")
    return F.when(F.length(text) < 1, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: piece(F.substring(text, i * 18 + 1, F.lit(18)))), ""))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits, in order, replaced by those given."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: _bind(F.substring(shape, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c))), "")


def _check_digit(payload: Column) -> Column:
    """Luhn's check digit of a payload."""
    n = F.length(payload)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: _bind(F.substring(payload, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)))
    return F.pmod(-F.aggregate(terms, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(value: Column, key: str) -> Column:
    """The longest run of the value's groups that has 13 to 19 digits and Luhn's check digit is permuted (of equal ones the
    first); without one the value stays."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")

    def valid(d: Column) -> Column:
        n = F.length(d)
        return F.when((n >= 13) & (n <= 19), F.substring(d, n, F.lit(1)).cast("int") == _check_digit(F.substring(d, F.lit(1), n - 1))).otherwise(False)

    def permuted(d: Column) -> Column:
        n = F.length(d)
        new = F.concat(F.substring(d, F.lit(1), F.lit(1)), _permute(F.substring(d, F.lit(2), n - 2), DIGITS, key, "card"))
        return _bind(new, lambda p: F.concat(p, _check_digit(p).cast("string")))

    def of(groups: Column) -> Column:
        n = F.size(groups)
        text = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")
        spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: _bind(digits(text(i, j)), lambda d: F.struct(F.when(valid(d), F.length(d)).alias("n"), (-i).alias("i"), j.alias("j"))))))
        best = F.array_max(F.filter(spans, lambda x: x["n"].isNotNull()))

        def put(x: Column) -> Column:
            i, j = -x["i"], x["j"]
            new = _bind(text(i, j), lambda t: _refill(t, _bind(digits(t), permuted)))
            return F.when(x.isNull(), value).otherwise(F.concat(text(F.lit(1), i - 1), new, text(j + 1, n)))

        return _bind(best, put)

    return _bind(F.regexp_extract_all(value, F.lit("[0-9]+[ -]?"), F.lit(0)), of)


def _phone(value: Column, key: str) -> Column:
    country = F.when(value.rlike(rf"^(?:{NATIONAL})$"), F.lit(None)).otherwise(F.length(F.regexp_extract(F.regexp_replace(value, "[^0-9]", ""), COUNTRY, 0)))

    def of(d: Column) -> Column:
        at = F.coalesce(country, F.length(d) - 10)  # digits of the country code, which stay
        return F.concat(F.substring(d, F.lit(1), at), _permute(F.substring(d, at + 1, F.length(d) - at), DIGITS, key, "phone"))

    return _refill(value, _bind(F.regexp_replace(value, "[^0-9]", ""), of))


def _address(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))

    def of(p: Column) -> Column:
        size = F.lit(65536).cast("long")
        new = _network(p[0] * 256 + p[1], p[2] * 256 + p[3], size, size, key, "address")
        return F.when(F.exists(p, lambda x: x > 255), value).otherwise(_bind(new, lambda r: F.concat_ws(".", F.floor(r["a"] / 256), r["a"] % 256, F.floor(r["b"] / 256), r["b"] % 256)))

    return _bind(parts, of)


def _date(value: Column, key: str) -> Column:
    def moving(style: str):
        def of(x: Column) -> Column:
            new = _network(F.floor(x / DAY_PARTS[1]), x % DAY_PARTS[1], F.lit(DAY_PARTS[0]).cast("long"), F.lit(DAY_PARTS[1]).cast("long"), key, "date")
            moved = _bind(new, lambda r: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (r["a"] * DAY_PARTS[1] + r["b"]).cast("int")), style))
            return F.when((x >= 0) & (x < DAY_PARTS[0] * DAY_PARTS[1]), moved).otherwise(value)

        return of

    out = value
    for shape, style in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}-", "dd-MM-yyyy")):
        day = F.to_date(F.try_to_timestamp(value, F.lit(style)))
        n = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        out = F.when(value.rlike(shape), _bind(n, moving(style))).otherwise(out)
    return out


def _email(value: Column, key: str) -> Column:
    local, rest = F.regexp_extract(value, "^[^@]+", 0), F.regexp_extract(value, "@.*$", 0)

    def of(own: Column) -> Column:
        words = _permute(F.regexp_replace(own, "[^a-z]", ""), LETTERS, key, "email")
        numbers = _permute(F.regexp_replace(own, "[^0-9]", ""), DIGITS, key, "email")

        def fill(pair: Column) -> Column:
            at = lambda keep, i: F.length(F.regexp_replace(F.substring(own, F.lit(1), i), keep, ""))
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: _bind(F.substring(own, i, F.lit(1)), lambda c: F.when(c.rlike("[a-z]"), F.substring(pair["w"], at("[^a-z]", i), F.lit(1))).when(c.rlike("[0-9]"), F.substring(pair["n"], at("[^0-9]", i), F.lit(1))).otherwise(c))), "")

        return _bind(F.struct(words.alias("w"), numbers.alias("n")), fill)

    return F.concat(_bind(F.lower(local), of), rest)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate; values that do not validate (octets over 255, days that do not exist, a
    wrong check digit) stay."""
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike(rf"^(?:{ADDRESS})$"), _address(value, key))
        .when(value.rlike(rf"^(?:{DATE})$"), _date(value, key))
        .when(value.rlike(rf"^(?:{PHONE})$"), _phone(value, key))
        .otherwise(_card(value, key))
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str = "set your own key") -> DataFrame:
    """docs with pseudonyms in the text column, and two more columns (replaced if they exist): found, the candidates in
    order, and given, what stands for each. Null and empty texts stay as they are, with empty lists. Whole texts are
    read at any length; repeated rows and ties need no rule, since each row is treated alone."""
    has = F.col(text).rlike("[0-9@]")
    none = F.array().cast("array<string>")
    out = docs.withColumn("found", F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    out = out.withColumn("given", F.when(F.size("found") > 0, F.transform("found", lambda v: pseudonym(v, key))).otherwise(none))
    gaps = F.split(F.col(text), ANY, -1)
    woven = F.array_join(F.zip_with(gaps, F.concat("given", F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    return out.withColumn(text, F.when(F.size("found") > 0, woven).otherwise(F.col(text)))
