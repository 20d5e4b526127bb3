"""Unicode normal forms.

Spark has no built-in NFKC/NFKD. Most text needs none: a text whose characters
are all unchanged by the normal form is passed through inside the JVM, and Latin
letters with diacritics are folded by ``translate``. Only texts that hold some
other character are sent to a vectorised Python function.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no copy of this package: its vectorised functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Blocks examined for characters that are safe to leave to the JVM.
_BLOCKS = (
    (0x00, 0x24F),  # Latin
    (0x370, 0x52F),  # Greek, Cyrillic
    (0x2010, 0x205E),  # punctuation
    (0x20A0, 0x20BF),  # currency signs
    (0x3041, 0x30FF),  # kana
    (0x4E00, 0x9FFF),  # Han
)


def _strip_marks(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(ch for ch in decomposed if not unicodedata.category(ch).startswith("M"))


def _char_class(code_points: list[int]) -> str:
    """A negated regular-expression class over the given sorted code points."""
    parts: list[str] = []
    start = previous = code_points[0]
    for point in [*code_points[1:], None]:
        if point is not None and point == previous + 1:
            previous = point
            continue
        parts.append(f"\\x{{{start:X}}}-\\x{{{previous:X}}}")
        start = previous = point
    return "[^" + "".join(parts) + "]"


def _safe_points(unchanged) -> list[int]:
    return [
        point
        for low, high in _BLOCKS
        for point in range(low, high + 1)
        if unicodedata.combining(chr(point)) == 0 and unchanged(chr(point))
    ]


@lru_cache(maxsize=None)
def composed_escape_class() -> str:
    """Characters that NFKC may change."""
    return _char_class(_safe_points(lambda ch: unicodedata.normalize("NFKC", ch) == ch))


@lru_cache(maxsize=None)
def fold_table() -> tuple[str, str]:
    """Letters whose NFKD form without marks is one character, and that character."""
    pairs = [
        (chr(point), _strip_marks(chr(point)))
        for low, high in _BLOCKS[:2]
        for point in range(max(low, 0x80), high + 1)
    ]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=None)
def folded_escape_class() -> str:
    """Characters that neither stay as they are nor fold to one character."""
    foldable = set(fold_table()[0])
    return _char_class(_safe_points(lambda ch: ch in foldable or _strip_marks(ch) == ch))


@F.pandas_udf(T.StringType())
def _compose_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_strip_marks, na_action="ignore")


def _holding(text: Column, escape_class: str) -> Column:
    """The text where some character is in the class, else null.

    The class has many ranges, so it only scans what is left without ASCII.
    """
    others = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]") & others.rlike(escape_class), text)


def strange(text: Column) -> Column:
    """Whether only the Python functions bring the text into its normal forms; false for null."""
    held = [_holding(text, escape_class).isNotNull() for escape_class in (composed_escape_class(), folded_escape_class())]
    return F.coalesce(held[0] | held[1], F.lit(False))


def nfkc(text: Column, plain: bool = False) -> Column:
    """``plain`` says that the text is not :func:`strange`: the plan has no Python step, so rows stay where they were dealt to."""
    if plain:
        return text
    rest = _holding(text, composed_escape_class())
    return F.coalesce(_compose_batch(rest), text)


def nfkd_without_marks(text: Column, plain: bool = False) -> Column:
    source, target = fold_table()
    # Translation looks up every character; a text of ASCII only has none to fold.
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, source, target)).otherwise(text)
    return folded if plain else F.coalesce(_fold_batch(_holding(text, folded_escape_class())), folded)


@F.pandas_udf(T.StringType())
def _decompose_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKD", text), na_action="ignore")


def nfkd(text: Column) -> Column:
    rest = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_decompose_batch(rest), text)
