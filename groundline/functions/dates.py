"""ISO dates and their spellings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
ISO_DATE = (
    r"(?:(?:\d{2}(?:[2468][048]|[13579][26]|0[48])|(?:[02468][048]|[13579][26])00)-02-29"
    r"|\d{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|1\d|2[0-8])))"
)


def is_iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` naming a real calendar day."""
    return text.rlike("^" + ISO_DATE + r"\z")


def date_spellings(iso: Column) -> Column:
    """Spellings of an ISO day; numeric day/month orders only where the day exceeds 12.

    The year is spelt as a number, without leading zeros.
    """
    day = F.when(is_iso_date(iso), iso.try_cast("date"))
    # Arrays of one element, so that the day and its parts are worked out once and not in every spelling.
    parts = F.transform(F.array(day), _parts)
    return F.when(iso.isNotNull(), F.get(F.transform(parts, _spellings), F.lit(0)))


def _parts(day: Column) -> Column:
    number, month = F.day(day), F.month(day)
    teen = number.between(11, 13)
    suffix = (
        F.when((number % 10 == 1) & ~teen, "st")
        .when((number % 10 == 2) & ~teen, "nd")
        .when((number % 10 == 3) & ~teen, "rd")
        .otherwise("th")
    )
    d, full = number.cast("string"), F.get(F.array(*map(F.lit, MONTHS)), month - 1)
    return F.struct(
        F.year(day).cast("string").alias("y"), F.lpad(month.cast("string"), 2, "0").alias("mm"),
        F.lpad(d, 2, "0").alias("dd"), d.alias("d"), full.alias("full"), F.substring(full, 1, 3).alias("short"),
        F.concat(d, suffix).alias("nth"), (number > 12).alias("late"),
    )


def _spellings(part: Column) -> Column:
    y, mm, dd, d, full, nth = (part[name] for name in ("y", "mm", "dd", "d", "full", "nth"))

    def spelt(sign: str, *parts: Column) -> Column:
        return F.concat_ws(sign, *parts)

    # The accepted spellings.
    always = [spelt(sign, y, mm, dd) for sign in "-/."]
    for name in (full, part["short"]):
        always += [spelt(" ", d, name, y), spelt(" ", dd, name, y), spelt(" ", name, d, y), spelt(" ", name, dd, y)]
    always += [spelt(" ", full, nth, y), spelt(" ", nth, full, y)]
    numeric = [spelt(sign, *parts, y) for sign in "/-" for parts in ((dd, mm), (mm, dd))]
    late = F.when(part["late"], F.array(*numeric)).otherwise(F.array().cast("array<string>"))
    return F.when(y.isNotNull(), F.concat(F.array(*always), late))


def search_spellings(iso: Column) -> Column:
    """The distinct search forms of the spellings."""
    forms = F.transform(date_spellings(iso), lambda s: F.translate(F.lower(s), "-/.", "   "))
    return F.array_distinct(forms)


_FULL = "|".join(name.lower() for name in MONTHS)
_SHORT = "|".join(name[:3].lower() for name in MONTHS)
_NTH = "(?:[23]?1st|2?2nd|2?3rd|2?[4-9]th|1[0-9]th|[23]0th)"
_YEAR = r"[1-9]\d{3}"
_DAY_FIRST = rf"(?:\d{{1,2}} (?:{_FULL}|{_SHORT})|{_NTH} (?:{_FULL})) {_YEAR}"
_MONTH_FIRST = rf"(?:(?:{_FULL}|{_SHORT}) \d{{1,2}}|(?:{_FULL}) {_NTH}) {_YEAR}"


def day_mentions(search: Column) -> Column:
    """ISO days from the year 1000 on whose spelling occurs in a text in search form.

    The inverse of :func:`date_spellings`: every spelling is found at its own start,
    overlaps included, and turned back into the day it spells.
    """

    def spans(pattern: str) -> Column:
        return F.regexp_extract_all(search, F.lit(f"(?=({pattern}))"), 1)

    def iso(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    def worded(span: Column) -> Column:
        name = F.regexp_extract(span, "[a-z]{3}", 0)
        month = (F.instr(F.lit(_SHORT), name) + 3) / 4
        day = F.regexp_extract(span, "(?:^| )(\\d{1,2})(?:[a-z]{2})? ", 1)
        return iso(F.right(span, F.lit(4)), month.cast("int").cast("string"), day)

    def numeric(span: Column) -> Column:
        a, b = F.substring(span, 1, 2), F.substring(span, 4, 2)
        first_is_day = a > "12"
        month, day = F.when(first_is_day, b).otherwise(a), F.when(first_is_day, a).otherwise(b)
        # Both below thirteen is ambiguous, which the accepted spellings exclude.
        return F.when(first_is_day | (b > "12"), iso(F.right(span, F.lit(4)), month, day))

    found = F.concat(
        F.transform(spans(rf"{_YEAR} \d{{2}} \d{{2}}"), lambda s: F.translate(s, " ", "-")),
        F.transform(spans(_DAY_FIRST), worded),
        F.transform(spans(_MONTH_FIRST), worded),
        F.transform(spans(rf"\d{{2}} \d{{2}} {_YEAR}"), numeric),
    )
    days = F.array_distinct(F.filter(found, is_iso_date))
    return F.when(search.rlike(_YEAR), days).otherwise(F.array().cast("array<string>"))
