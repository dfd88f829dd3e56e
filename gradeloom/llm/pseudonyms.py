"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Each value found is checked (Luhn digit, IBAN remainder, real calendar day, octets,
dialling rules), read as a vector of small numbers, and permuted within its format by ten
Feistel rounds: the elements at even and odd places shift each other by keyed hashes,
modulo each element's own range. The map is a permutation of all values of the format, so
equal values stay equal everywhere and different ones stay different; whoever holds the key
can turn it back. Check digits are computed anew.

Only Spark expressions are used: no value leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import whole_text

ROUNDS = 10
#: 400 Gregorian years always have this many days, which is 189 * 773.
CYCLE_DAYS, CYCLE_SHAPE = 146_097, (189, 773)
CYCLE_START = "1800-01-01"

# Every alternative starts where its kind can start and takes characters without giving
# them back, so that scanning stays linear in the text.
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
)
SECRET = (
    r"(?<![A-Za-z])(?i:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,4}[=:]\s{0,4}[\"']?"
    r"(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{8,}+"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\1\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w.+-])\d{3}([.-])\d{3}\2\d{4}(?![\w-])"
)
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
#: Groupings of card numbers that are tried within a run of digits, the usual ones first.
CARD_SHAPES = (
    r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}", r"\d{4}([ -])\d{6}\2\d{5}", r"\d{4}([ -])\d{6}\2\d{4}", r"\d{13,19}",
    r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{1,3}",
)
PATTERN = "|".join((EMAIL, SECRET, IBAN, DATE, SSN, ADDRESS, PHONE, CARD))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(
    values: Column, ranges: Column, tweak: str, key: str, backwards: bool = False
) -> Column:
    """The Feistel permutation of a vector; element i stays below ``ranges[i]``."""
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def one_round(now: Column, r: Column) -> Column:
        other = F.array_join(F.filter(now, lambda _, i: i % 2 != r % 2).cast("array<string>"), ",")

        def shifted(v: Column, i: Column) -> Column:
            seed = F.concat_ws("|", F.lit(key), F.lit(tweak), F.size(now), r, i, other)
            noise = F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("long")
            moved = v - noise if backwards else v + noise
            return F.when(i % 2 == r % 2, F.pmod(moved, F.element_at(ranges, i + 1))).otherwise(v)

        return F.transform(now, shifted)

    return F.aggregate(order, values, one_round)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def _refill(template: Column, places: str, letters: Column) -> Column:
    """``template`` with its characters in the class ``places`` replaced one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def put(so_far: Column, c: Column) -> Column:
        fits = c.rlike(places)
        return F.struct(
            F.concat(so_far["out"], F.when(fits, F.element_at(letters, so_far["used"] + 1)).otherwise(c)).alias("out"),
            (so_far["used"] + fits.cast("int")).alias("used"),
        )

    return F.aggregate(_chars(template), start, put, lambda done: done["out"])


def _low(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)


def _by_letter(text: Column, tweak: str, key: str, backwards: bool) -> Column:
    """Digits stay digits and letters letters of their case; the rest stays."""

    def work(found: Column) -> Column:
        values = F.transform(found, lambda c: (F.ascii(c) - _low(c)).cast("long"))
        ranges = F.transform(found, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26).cast("long"))
        new = permuted(values, ranges, tweak, key, backwards)
        letters = F.transform(new, lambda v, i: F.char(v + _low(F.element_at(found, i + 1))))
        return _refill(text, "[0-9A-Za-z]", letters)

    return _let(F.filter(_chars(text), lambda c: c.rlike("[0-9A-Za-z]")), work)


def _hexadecimal(text: Column, key: str, backwards: bool) -> Column:
    values = F.transform(_chars(text), lambda c: F.conv(c, 16, 10).cast("long"))
    ranges = F.transform(values, lambda _: F.lit(16).cast("long"))
    return F.array_join(
        F.transform(permuted(values, ranges, "hex", key, backwards), lambda v: F.lower(F.hex(v))), ""
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _numbers(digits: Column) -> Column:
    return F.transform(_chars(digits), lambda c: c.cast("long"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo ten; zero for a valid number."""
    doubled = F.transform(
        F.reverse(_numbers(digits)),
        lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, d: a + d) % 10


def _remainder97(text: Column) -> Column:
    """The IBAN remainder of a rearranged number, letters counting from ten."""
    return F.aggregate(
        _chars(text),
        F.lit(0).cast("long"),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("long")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ),
    )


def _card(text: Column, key: str, backwards: bool) -> Column:
    def work(digits: Column) -> Column:
        values = _numbers(F.substring(digits, F.lit(1), F.length(digits) - 1))
        new = permuted(values, F.transform(values, lambda _: F.lit(10).cast("long")), "card", key, backwards)
        body = F.array_join(new.cast("array<string>"), "")
        check = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10))
        return _refill(text, "[0-9]", _chars(F.concat(body, check.cast("string"))))

    return _let(_digits(text), work)


def _cards(run: Column, key: str, backwards: bool) -> Column:
    """``run`` with the first grouping in it that is a card number replaced, or itself.

    A number of other digits may stand before or behind a card with one space between.
    """
    tried = F.concat(
        *[F.regexp_extract_all(run, F.lit(rf"(?<![0-9])(?=({shape})(?![0-9]))"), F.lit(1)) for shape in CARD_SHAPES],
        F.array(run),
    )

    def put(card: Column) -> Column:
        at = F.instr(run, card)
        return F.when(card.isNull(), run).otherwise(
            F.concat(
                F.substring(run, F.lit(1), at - 1), _card(card, key, backwards),
                F.substring(run, at + F.length(card), F.length(run)),
            )
        )

    numbers = F.filter(tried, lambda c: F.length(_digits(c)).between(13, 19) & (_luhn(_digits(c)) == 0))
    return _let(F.get(numbers, F.lit(0)), put)


def _ibans(run: Column, key: str, backwards: bool) -> Column:
    """``run`` with its longest beginning of whole groups that is an IBAN replaced.

    A capital word may stand behind the IBAN, or a card number.
    """
    parts = F.split(run, " ")
    tried = F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), " ")
    )

    def good(text: Column) -> Column:
        plain = F.regexp_replace(text, " ", "")
        rearranged = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
        return (F.length(plain) >= 12) & (_remainder97(rearranged) == 1)

    def put(iban: Column) -> Column:
        rest = F.substring(run, F.length(iban) + 1, F.length(run))
        return F.when(iban.isNull(), run).otherwise(F.concat(_iban(iban, key, backwards), _cards(rest, key, backwards)))

    return _let(F.get(F.filter(tried, good), F.lit(0)), put)


def _iban(text: Column, key: str, backwards: bool) -> Column:
    def work(plain: Column) -> Column:
        body = _by_letter(F.substring(plain, F.lit(5), F.length(plain)), "iban", key, backwards)
        land = F.substring(plain, 1, 2)

        def checked(moved: Column) -> Column:
            rest = 98 - _remainder97(F.concat(moved, land, F.lit("00")))
            return _refill(
                text, "[0-9A-Z]", _chars(F.concat(land, F.lpad(rest.cast("string"), 2, "0"), moved))
            )

        return _let(body, checked)

    return _let(F.regexp_replace(text, " ", ""), work)


def _date(text: Column, key: str, backwards: bool) -> Column:
    """A real day becomes another day of the same 400 years, in the same notation.

    Days and months of one digit come out with two.
    """
    dashed = text.rlike("^[0-9]{4}-")
    turned = ~dashed & _day(text).isNull()

    def step(day: Column) -> Column:
        number = F.datediff(day, F.lit(CYCLE_START).cast("date")).cast("long")
        cycle = F.floor(number / CYCLE_DAYS)
        within = F.pmod(number, F.lit(CYCLE_DAYS))
        first, second = CYCLE_SHAPE
        new = permuted(
            F.array(F.floor(within / second), within % second),
            F.array(F.lit(first).cast("long"), F.lit(second).cast("long")), "date", key, backwards,
        )
        return F.date_add(
            F.lit(CYCLE_START).cast("date"),
            (cycle * CYCLE_DAYS + F.element_at(new, 1) * second + F.element_at(new, 2)).cast("int"),
        )

    def work(day: Column) -> Column:
        # Month before day is a format of its own, of days past the 12th: the permutation
        # is followed until it meets one (two of five days are none).
        again = F.sequence(F.lit(1), F.when(turned, 80).otherwise(1))
        moved = F.aggregate(again, day, lambda d, i: F.when((i == 1) | (F.dayofmonth(d) < 13), step(d)).otherwise(d))
        return _let(moved, show)

    def show(moved: Column) -> Column:
        mark = F.substring(F.regexp_replace(text, "[0-9]", ""), 1, 1)
        return F.when(dashed, F.date_format(moved, "yyyy-MM-dd")).when(
            turned, F.concat(F.date_format(moved, "MM"), mark, F.date_format(moved, "dd"), mark, F.date_format(moved, "yyyy"))
        ).otherwise(
            F.concat(F.date_format(moved, "dd"), mark, F.date_format(moved, "MM"), mark, F.date_format(moved, "yyyy"))
        )

    return _let(F.coalesce(_day(text), _day(text, month_first=True)), work)


def _day(text: Column, month_first: bool = False) -> Column:
    """The calendar day of a notation; null where there is none."""
    dashed = F.try_to_date(text, "yyyy-MM-dd")
    parts = F.split(text, "[/.]")
    other = F.concat_ws(
        "-", F.get(parts, F.lit(2)), *(F.lpad(F.get(parts, F.lit(i)), 2, "0") for i in ((0, 1) if month_first else (1, 0)))
    )
    return F.when(text.rlike("^[0-9]{4}-"), dashed).otherwise(F.try_to_date(other, "yyyy-MM-dd"))


def _ssn(text: Column, key: str, backwards: bool) -> Column:
    parts = F.transform(F.split(text, "-"), lambda p: p.cast("long"))
    area = F.element_at(parts, 1)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), F.element_at(parts, 2) - 1, F.element_at(parts, 3) - 1)
    ranges = F.array(*[F.lit(n).cast("long") for n in (898, 99, 9999)])

    def show(new: Column) -> Column:
        at = F.element_at(new, 1) + 1
        return F.format_string(
            "%03d-%02d-%04d", at + (at > 665).cast("long"), F.element_at(new, 2) + 1, F.element_at(new, 3) + 1
        )

    return _let(permuted(values, ranges, "ssn", key, backwards), show)


def _address(text: Column, key: str, backwards: bool) -> Column:
    values = F.transform(F.split(text, r"\."), lambda p: p.cast("long"))
    ranges = F.transform(values, lambda _: F.lit(256).cast("long"))
    return F.array_join(permuted(values, ranges, "address", key, backwards).cast("array<string>"), ".")


def _phone(text: Column, key: str, backwards: bool) -> Column:
    """Digits after the country code; leading digits from 2 to 9 of area and exchange stay so."""
    code = F.regexp_extract(text, r"^\+(?:1(?=\d{10}$)|\d{1,3}(?=\D)|\d{2})", 0)
    rest = F.substring(text, F.length(code) + 1, F.length(text))

    def work(numbers: Column) -> Column:
        def lead(i: Column) -> Column:
            return (F.size(numbers) == 10) & ((i == 0) | (i == 3))

        def low(i: Column) -> Column:
            return F.when(lead(i) & (F.element_at(numbers, i + 1) > 1), 2).otherwise(0).cast("long")

        values = F.transform(numbers, lambda v, i: v - low(i))
        # A leading digit stays in 2-9 or in 0-1, any other goes over all ten.
        ranges = F.transform(
            numbers, lambda v, i: F.when(~lead(i), 10).when(low(i) == 2, 8).otherwise(2).cast("long")
        )
        new = permuted(values, ranges, "phone", key, backwards)
        digits = F.transform(new, lambda v, i: (v + low(i)).cast("string"))
        return F.concat(code, _refill(rest, "[0-9]", digits))

    return _let(_numbers(_digits(rest)), work)


def _secret(text: Column, key: str, backwards: bool) -> Column:
    value = F.regexp_extract(text, r"([A-Za-z0-9+/_-]+)$", 1)
    name = F.substring(text, F.lit(1), F.length(text) - F.length(value))
    return F.concat(
        name,
        F.when(value.rlike("^[0-9a-f]+$"), _hexadecimal(value, key, backwards)).otherwise(
            _by_letter(value, "secret", key, backwards)
        ),
    )


def _email(text: Column, key: str, backwards: bool) -> Column:
    """Everything but the last label of the domain."""
    last = F.regexp_extract(text, r"\.[A-Za-z]+$", 0)
    return F.concat(
        _by_letter(F.substring(text, F.lit(1), F.length(text) - F.length(last)), "email", key, backwards), last
    )


def pseudonym(found: Column, key: str, backwards: bool = False) -> Column:
    """The pseudonym of a value that ``PATTERN`` found; itself, if it is not valid."""

    def whole(pattern: str) -> Column:
        return found.rlike(f"^(?:{pattern})$")

    octets = F.transform(F.split(found, r"\."), lambda p: p.cast("long"))
    good_ssn = found.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    # A match before anchors may end earlier than the whole value; kinds are told apart here.
    return (
        F.when(found.contains("@"), _email(found, key, backwards))
        .when(found.rlike("^[A-Za-z_-]+[\"']?\\s{0,4}[=:]"), _secret(found, key, backwards))
        .when(found.rlike("^[A-Z]{2}[0-9]{2}"), _ibans(found, key, backwards))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}"),
              F.when(F.coalesce(_day(found), _day(found, month_first=True)).isNotNull(), _date(found, key, backwards)).otherwise(found))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.when(good_ssn, _ssn(found, key, backwards)).otherwise(found))
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"),
              F.when(F.forall(octets, lambda o: o < 256), _address(found, key, backwards)).otherwise(found))
        .when(found.rlike(r"^[+(]") | whole(r"\d{3}([.-])\d{3}\1\d{4}"), _phone(found, key, backwards))
        .otherwise(_cards(found, key, backwards))
    )


def pseudonymised(docs: DataFrame, key: str, backwards: bool = False) -> DataFrame:
    """``docs`` with ``text`` and ``n_chars`` renewed, and ``n_replaced``.

    Values are e-mail addresses, secrets behind a name, IBANs, dates, social security
    numbers, network addresses, telephone and card numbers. A value that fails its check
    is left as it is, as is all other text. A null text stays null, an empty one empty;
    other columns, also those whose names clash with none of these, are kept; a column
    named ``n_replaced`` is replaced. Works row by row without a shuffle; rows with equal
    values get equal pseudonyms wherever they are. ``backwards`` restores texts.
    """
    text = F.col("text").cast("string")
    maybe = text.rlike("[0-9@]")
    found = F.when(maybe, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    split = docs.withColumn("__found", found)
    some = F.size("__found") > 0
    gaps = F.when(some, F.split(text, PATTERN, -1))
    named = split.withColumn("__new", F.when(some, F.transform("__found", lambda m: pseudonym(m, key, backwards))))
    pieces = F.zip_with(
        gaps, F.concat("__new", F.array(F.lit(""))), lambda gap, value: F.concat(gap, value)
    )
    changed = F.size(F.filter(F.arrays_zip("__found", "__new"), lambda p: p["__found"] != p["__new"]))
    out = named.withColumn("__text", F.when(some, F.array_join(pieces, "")).otherwise(text)).withColumn(
        "n_replaced", F.when(some, changed).otherwise(F.lit(0))
    )
    renewed = out.withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        renewed = renewed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return renewed.drop("__found", "__new", "__text")
