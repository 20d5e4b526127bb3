"""Text normal forms and mention extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.functions.unicode import nfkc, nfkd, nfkd_without_marks

# White space as the source contract counts it, and the shapes of
# e-mail spans, phone runs and numeric mentions.
WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# White space is never a printable ASCII character, which one comparison tells; possessive where nothing could be given back.
_RUN = f"(?:(?![!-~]){WS}++)?+"
EMAIL_SPAN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:RUN\.RUN[A-Za-z0-9_%+-]++)*RUN@RUN"
    r"[A-Za-z0-9-]+(?:RUN\.RUN[A-Za-z0-9-]+)+(?![A-Za-z0-9._%+-])"
).replace("RUN", _RUN)
PHONE_RUN = r"\+?\d[\d" + WS[1:-1] + r"().-]{5,}\d"
NUMBER_MENTION = (
    r"(?![a-z])(?:[$\x{20AC}\x{A3}\x{A5}\x{20B9}]WS*)?(?:[A-Z]{3}WS*)?"
    r"(?:\([+-]?\dNUM*(?:\.\d+)?\)|[+-]?\dNUM*(?:\.\d+)?)(?:WS*[A-Z]{3})?"
).replace("NUM", r"[\d," + WS[1:-1] + "]").replace("WS", WS)
EMAIL_SHAPE = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z0-9.-]+$"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    # A single space before a printable ASCII character stays as it is.
    return F.trim(F.regexp_replace(text, "(?![!-~]| [!-~])" + WS + "+", " "))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(WS.replace("[", "[^", 1))


def minimal_of_composed(composed: Column) -> Column:
    return collapse(F.lower(composed))


def search_of_folded(folded: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(folded), r"[\p{P}\p{S}]+", " "))


def normalize_minimal(text: Column, plain: bool = False) -> Column:
    return minimal_of_composed(nfkc(text, plain))


def normalize_search(text: Column, plain: bool = False) -> Column:
    return search_of_folded(nfkd_without_marks(text, plain))


def search_tokens(search: Column) -> Column:
    """Tokens of a text that is already in search form."""
    return F.filter(F.split(search, " "), lambda token: token != "")


def normalize_email(text: Column, plain: bool = False) -> Column:
    return F.regexp_replace(F.lower(nfkc(text, plain)), WS, "")


def extract_emails(text: Column) -> Column:
    spans = F.regexp_extract_all(text, F.lit(EMAIL_SPAN), 0)
    # A span holds ASCII and white space only, so the composed form is the text itself.
    canonical = F.transform(spans, lambda span: F.regexp_replace(F.lower(span), WS, ""))
    return F.when(text.contains("@"), F.array_distinct(canonical)).otherwise(
        F.array().cast("array<string>")
    )


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def extract_phones(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PHONE_RUN), 0), digits_only)


def clean_text(text: Column) -> Column:
    """Page text without control characters or runs of blank lines."""
    text = F.regexp_replace(text, r"\x00", "")
    text = F.regexp_replace(text, r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, WS + r"+\z", "")


def path_only(url: Column) -> Column:
    return F.coalesce(F.substring_index(url, "?", 1), F.lit(""))


def request_id(raw: Column) -> Column:
    return F.when(raw.rlike(r"^[A-Za-z0-9._-]{1,128}\z"), raw).otherwise(F.expr("uuid()"))


def is_email(text: Column) -> Column:
    """The public form-validation shape of an address."""
    return text.rlike(
        r"^(?!\.)(?!.*\.\.)[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@"
        r"(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}\z"
    )


def safe_stem(title: Column, default: str = "document-extraction") -> Column:
    """A file stem: compatibility form, one dash per run of other characters, 80 characters.

    A longer stem ends in a digest of the whole title, so that no two titles share a name.
    """
    # Marks are outside the allowed set, so each becomes part of a dash run.
    stem = F.regexp_replace(nfkd(title), "[^A-Za-z0-9._-]+", "-")
    stem = F.regexp_replace(stem, "^-+|-+$", "")
    cut = F.concat(F.substring(stem, 1, 71), F.lit("-"), F.left(F.md5(title), F.lit(8)))
    stem = F.when(F.length(stem) > 80, cut).otherwise(stem)
    return F.when(F.length(stem) == 0, F.lit(default)).otherwise(stem)


REDACTIONS = (
    # Pattern and tag, applied in this order.
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[redacted-email]"),
    (r"\b(?:gsk_|sk-)[A-Za-z0-9_-]{8,}\b", "[redacted-secret]"),
    (r"\b(?:\+?\d[\d(). -]{8,}\d)\b", "[redacted-phone]"),
)


def redact(text: Column, cap: int | None = None) -> Column:
    """Tag addresses, secrets and phone runs; the cap applies to log messages only."""
    for pattern, tag in REDACTIONS:
        text = F.regexp_replace(text, pattern, tag)
    text = collapse(text)
    return text if cap is None else F.substring(text, 1, cap)
