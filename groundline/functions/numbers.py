"""Number parsing, tolerance matching and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.functions.text import NUMBER_MENTION, WS, collapse

# Currency codes and signs that may stand beside an amount.
CURRENCY_CODES = (
    "AED", "AUD", "CAD", "CHF", "CNY", "EUR", "GBP", "HKD", "INR", "JPY", "NZD", "SGD", "USD",
)
CURRENCY_SIGNS = "$€£¥₹"
TOLERANCE = 1e-9
# The characters of the white-space class, for translate.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# A mention whose codes are known and stand apart from the amount.
_CODES = "(?:" + "|".join(CURRENCY_CODES) + ")"
_WELL_FORMED = (
    rf"^(?:[{CURRENCY_SIGNS}](?:{WS}+|(?=[(+\-\d])))?(?:{_CODES}{WS}+)?"
    rf"(\(.*\)|[+-]?\d[\d,{WS[1:-1]}]*(?:\.\d+)?)(?:{WS}+{_CODES})?\z"
)


def strip_currency(text: Column) -> Column:
    codes = "|".join(CURRENCY_CODES)
    bare = F.regexp_replace(collapse(text), f"(?i)(?<![^ ])(?:{codes})(?![^ ])", "")
    return F.translate(collapse(bare), CURRENCY_SIGNS, "")


def canonicalize_number(text: Column) -> Column:
    """A finite double, or null where the text is not one plain amount."""
    stripped = strip_currency(text)
    digits = F.translate(stripped, "(), ", "")
    number = F.when(digits.rlike(r"^[+-]?\d+(?:\.\d+)?$"), digits.try_cast("double"))
    number = F.when(F.abs(number) < float("inf"), number)
    return F.when(stripped.rlike(r"^\(.*\)$"), -F.abs(number)).otherwise(number)


def extract_numbers(text: Column) -> Column:
    """The amounts of a text, in order.

    A mention either is well formed, and then its middle part is the amount, or
    :func:`canonicalize_number` would reject it; one pattern tells which.
    """
    mentions = F.regexp_extract_all(text, F.lit(NUMBER_MENTION), 0)
    bodies = F.transform(mentions, lambda m: F.regexp_extract(m, _WELL_FORMED, 1))
    return F.filter(F.transform(bodies, _amount), lambda n: n.isNotNull())


def _amount(body: Column) -> Column:
    number = F.translate(body, "()," + SPACES, "").try_cast("double")
    number = F.when(F.abs(number) < float("inf"), number)
    return F.when(body.startswith("("), -F.abs(number)).otherwise(number)


def numbers_match(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) <= F.greatest(F.lit(TOLERANCE), F.abs(expected) * TOLERANCE)


def tolerance_bucket(number: Column) -> Column:
    """A bucket such that matching numbers lie in the same or in adjacent buckets.

    Below one the tolerance is absolute and above it relative, so the scale is
    linear to one and logarithmic beyond. A bucket is two tolerances wide.
    """
    size = F.abs(number)
    scaled = F.when(size <= 1, size).otherwise(1 + F.log(size))
    return F.floor(F.signum(number) * scaled / (2 * TOLERANCE)).cast("bigint")


def round_two(number: Column) -> Column:
    return F.floor((number + F.lit(2.220446049250313e-16)) * 100 + 0.5) / 100


def plain_number(number: Column) -> Column:
    """A double as text without a trailing fraction when it is whole."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(number.cast("string"))


def parse_scalar_number(text: Column) -> Column:
    """The number a free-text entry denotes, or null: plain, exponent or hexadecimal form."""
    decimal = F.when(
        text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), text.try_cast("double")
    )
    hexadecimal = F.when(
        text.rlike(r"^0[xX][0-9A-Fa-f]{1,15}\z"),
        F.conv(F.substring(text, 3, 64), 16, 10).try_cast("double"),
    )
    number = F.coalesce(decimal, hexadecimal)
    return F.when(F.abs(number) < float("inf"), number)
