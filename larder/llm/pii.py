"""Pseudonyms for personal data: validated numbers, dates and addresses are permuted by a key within their format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import whole_text
from larder.llm.spans import rewritten

ROUNDS = 10
KEY = "larder"  #: only a default for tests and queries; whoever holds the key can undo the pseudonyms
FIRST_DAY, DAYS = "1900-01-01", (250, 292)  #: dates are permuted among 250 x 292 days from the first
AREAS, SERIALS = 898, 99 * 9999  #: valid first parts (001 to 899 without 666) and other parts of social security numbers


def _prf(key: str, kind: str, turn: Column, text: Column) -> Column:
    """64 hexadecimal digits that depend on key, kind, round and the other half."""
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), text), 256)


def _turns(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))


def permuted_pair(key: str, kind: str, left: Column, right: Column, a: int, b: int, inverse: bool = False) -> Column:
    """Feistel rounds over the pairs (left below a, right below b): a permutation of a * b values."""
    sign = -1 if inverse else 1

    def step(half: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        other = F.when(odd, half["right"]).otherwise(half["left"]).cast("string")
        noise = F.conv(F.substring(_prf(key, kind, turn, other), 1, 12), 16, 10).cast("long") * sign
        return F.struct(
            F.when(odd, F.pmod(half["left"] + noise, F.lit(a))).otherwise(half["left"]).alias("left"),
            F.when(odd, half["right"]).otherwise(F.pmod(half["right"] + noise, F.lit(b))).alias("right"),
        )

    return F.aggregate(_turns(inverse), F.struct(left.cast("long").alias("left"), right.cast("long").alias("right")), step)


def _shifted(text: Column, low: Column, noise: Column, sign: int) -> Column:
    """Each character moved by a noise byte inside its class: digits from `low` on, digits below it, small and capital letters."""
    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        code = F.ascii(c)
        move = F.conv(F.substring(noise, i * 2 - 1, F.lit(2)), 16, 10).cast("int") * sign
        base = F.substring(low, i, F.lit(1)).cast("int")

        def turn(first: Column | int, size: Column | int) -> Column:
            return F.char(F.pmod(code - first + move, F.lit(size) if isinstance(size, int) else size) + first)

        return (
            F.when(code.between(48, 57), F.when(code - 48 < base, turn(48, base)).otherwise(turn(base + 48, F.lit(10) - base)))
            .when(code.between(97, 122), turn(97, 26))
            .when(code.between(65, 90), turn(65, 26))
            .otherwise(c)
        )

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise("")


def permuted_text(key: str, kind: str, text: Column, low: Column | None = None, inverse: bool = False) -> Column:
    """Feistel rounds over the halves of a short text (64 characters at most): each character stays in its class.

    `low` gives a digit for each place, as text, 0 where it is not given: smaller ones stay below it, others do not get there.
    """
    sign, half = (-1 if inverse else 1), F.floor(F.length(text) / 2).cast("int")
    rest = F.length(text) - half
    low = F.repeat(F.lit("0"), F.length(text)) if low is None else low
    low_left, low_right = F.substring(low, F.lit(1), half), F.substring(low, half + 1, rest)

    def step(pair: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        return F.struct(
            F.when(odd, _shifted(pair["left"], low_left, _prf(key, kind, turn, pair["right"]), sign)).otherwise(pair["left"]).alias("left"),
            F.when(odd, pair["right"]).otherwise(_shifted(pair["right"], low_right, _prf(key, kind, turn, pair["left"]), sign)).alias("right"),
        )

    start = F.struct(F.substring(text, F.lit(1), half).alias("left"), F.substring(text, half + 1, rest).alias("right"))
    return F.aggregate(_turns(inverse), start, step, lambda p: F.concat(p["left"], p["right"]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _inserted(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, one after the other; separators stay."""
    def one(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        nth = F.length(_digits(F.substring(shape, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits that ends with its check digit."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((F.length(digits) - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda s, x: s + x) % 10


def _card(match: Column, key: str, inverse: bool) -> Column:
    def permute(digits: Column) -> Column:
        payload = permuted_text(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1), inverse=inverse)

        def checked(p: Column) -> Column:
            check = (F.lit(10) - _luhn(F.concat(p, F.lit("0")))) % 10
            return _inserted(match, F.concat(p, check.cast("string")))

        return F.when(_luhn(digits) == 0, _let(payload, checked)).otherwise(match)

    return _let(_digits(match), permute)


def _phone(match: Column, key: str, inverse: bool) -> Column:
    # valid area and exchange codes start with 2 or more: valid numbers stay valid, others are permuted among their like
    def permute(digits: Column) -> Column:
        new = permuted_text(key, "phone", F.substring(digits, F.lit(2), F.lit(10)), F.lit("2002000000"), inverse)
        return _inserted(match, F.concat(F.substring(digits, F.lit(1), F.lit(1)), new))

    return _let(_digits(match), permute)


def _address(match: Column, key: str, inverse: bool) -> Column:
    part = F.transform(F.split(match, r"\."), lambda x: x.cast("int"))
    pair = permuted_pair(
        key, "address", F.get(part, F.lit(0)) * 256 + F.get(part, F.lit(1)), F.get(part, F.lit(2)) * 256 + F.get(part, F.lit(3)),
        65536, 65536, inverse,
    )
    new = _let(pair, lambda p: F.concat_ws(
        ".",
        F.floor(p["left"] / 256).cast("string"), (p["left"] % 256).cast("string"),
        F.floor(p["right"] / 256).cast("string"), (p["right"] % 256).cast("string"),
    ))
    return F.when(F.array_max(part) <= 255, new).otherwise(match)


def _date(match: Column, key: str, inverse: bool) -> Column:
    year_first = match.rlike(r"^[0-9]{4}")
    sign = F.when(year_first, F.substring(match, 5, 1)).otherwise(F.substring(match, 3, 1))
    plain = F.when(year_first, F.regexp_replace(match, r"[./]", "-")).otherwise(
        F.concat_ws("-", F.substring(match, 7, 4), F.substring(match, 4, 2), F.substring(match, 1, 2))
    )
    a, b = DAYS

    def permute(day: Column) -> Column:
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))

        def shown(p: Column) -> Column:
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["left"] * b + p["right"]).cast("int"))
            text = F.date_format(new, "yyyy-MM-dd")
            return F.when(year_first, text).otherwise(
                F.concat(F.substring(text, 9, 2), sign, F.substring(text, 6, 2), sign, F.substring(text, 1, 4))
            )

        new = _let(permuted_pair(key, "date", F.floor(number / b), number % b, a, b, inverse), shown)
        new = F.when(year_first & (sign != "-"), F.regexp_replace(new, "-", sign)).otherwise(new)
        return F.when(number.between(0, a * b - 1), new).otherwise(match)

    return F.coalesce(_let(F.try_to_date(plain, "yyyy-MM-dd"), permute), match)


def _social(match: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substring(match, *p).cast("int") for p in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = permuted_pair(
        key, "social", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, AREAS, SERIALS, inverse
    )
    new = _let(pair, lambda p: F.concat_ws(
        "-",
        F.lpad((p["left"] + F.when(p["left"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(p["right"] / 9999) + 1).cast("string"), 2, "0"),
        F.lpad((p["right"] % 9999 + 1).cast("string"), 4, "0"),
    ))
    return F.when(valid, new).otherwise(match)


def _mod97(account: Column) -> Column:
    """Remainder of an account number's digits and letters (10 to 35), the first four moved to the end."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _account(match: Column, key: str, inverse: bool) -> Column:
    def permute(plain: Column) -> Column:
        body = permuted_text(key, "account", F.substring(plain, F.lit(5), F.length(plain)), inverse=inverse)
        country = F.substring(plain, F.lit(1), F.lit(2))

        def checked(new: Column) -> Column:
            check = F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0")
            return _let(F.concat(country, check, new), lambda whole: F.array_join(F.transform(
                F.sequence(F.lit(1), F.length(match)),
                lambda i: F.when(F.substring(match, i, F.lit(1)) == " ", F.lit(" ")).otherwise(
                    F.substring(whole, F.length(F.regexp_replace(F.substring(match, F.lit(1), i), " ", "")), F.lit(1))
                ),
            ), ""))

        return F.when(_mod97(plain) == 1, _let(body, checked)).otherwise(match)

    return _let(F.regexp_replace(match, " ", ""), permute)


def _email(match: Column, key: str, inverse: bool) -> Column:
    local = F.substring_index(match, "@", 1)
    return F.concat(permuted_text(key, "email", local, inverse=inverse), F.substring(match, F.length(local) + 1, F.length(match)))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    change: Callable[[Column, str, bool], Column]


# A card is a whole group of digits, whatever number stands beside it, or groups parted by a blank or hyphen. Which digits
# belong together follows from the lengths of the groups alone, which pseudonyms keep, so the key finds the same places.
_FOURS = r"[0-9]{4}(?:[ -][0-9]{4}){3}"
_LONG = r"(?<![0-9A-Za-z+])(?<!(?<![0-9])[.-])(?<!(?<![0-9])[0-9]{1,12}\.)[0-9]{13,19}(?![0-9A-Za-z])"
#: Behind groups: no further number, unless it is an expiry date (whose month is no group of the card) or a long group.
_BEHIND = r"(?![0-9A-Za-z]|(?<=[ -][0-9]{1,2})/[0-9]|[ .-](?![0-9]{1,2}/[0-9]|[0-9]{13})[0-9])"
_GROUPS = r"(?![0-9]{13})[0-9](?:[ -](?![0-9]{13})[0-9]|[0-9]){12,18}" + _BEHIND
_CARD = rf"(?:{_LONG}|(?<![0-9A-Za-z.+-])(?:{_FOURS}(?=(?:[ -]{_FOURS})+{_BEHIND})|{_GROUPS}))"

# The formats. No pattern matches what another kind writes, so the order does not matter.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])", _email),
    Kind("phone", r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", _phone),
    Kind("card", _CARD, _card),
    Kind("address", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _address),
    Kind("date", r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])", _date),
    Kind("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _social),
    Kind("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _account),
)


def pseudonymised(text: Column, key: str = KEY, inverse: bool = False) -> Column:
    """The text with all validated values replaced; with `inverse`, put back."""
    for kind in KINDS:
        text = rewritten(text, kind.pattern, lambda m, kind=kind: kind.change(m, key, inverse))
    return text


def pseudonyms(docs: DataFrame, key: str = KEY, inverse: bool = False) -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_<kind> (places in the kind's format).

    A value that fails validation (Luhn sum, modulus 97, calendar, ranges) stays; phone numbers have none, any ten digits count. Equal values get equal
    pseudonyms in all documents, whatever separators stand between their digits; the key undoes them.

    Null text counts as empty and stays without values. Repeated rows and ids give a row each. An empty
    table gives an empty result.
    """
    steps = docs.select("doc_id", whole_text().alias("text"))
    for kind in KINDS:
        new = rewritten(F.col("text"), kind.pattern, lambda m, kind=kind: kind.change(m, key, inverse))
        count = F.when(F.col("text").rlike(kind.pattern), F.regexp_count("text", F.lit(kind.pattern))).otherwise(0)
        done = [c for c in steps.columns if c.startswith("n_")]
        steps = steps.select("doc_id", new.alias("text"), *done, count.cast("long").alias(f"n_{kind.name}"))
    return steps
