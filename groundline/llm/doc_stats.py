"""Statistics of a text's words, lines and characters, computed for a slice of documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundline.llm.batches import distinct_per_document, lines, slices, sums, utf8, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

FEATURES = (
    "log_words", "mean_word", "spread_word", "long_word_share", "short_word_share", "distinct_share", "top_word_share",
    "adjacent_repeat_share", "repeat_share", "dup_line_share", "symbol_share", "symbol_word_share", "marked_end_share",
    "bang_share", "bare_mark_share", "upper_word_share", "capital_word_share", "digit_share", "upper_char_share",
    "stop_end_share", "comma_end_share", "mean_line", "other_char_share", "wide_char_share", "word_entropy",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(characters)] = 1
    return table


_SYMBOL, _DIGIT = _table(SYMBOLS), _table(b"0123456789")
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_HEAD = _table(bytes([*range(0, 128), *range(192, 256)]))
_SPACE = _table(b" \t\n\x0b\x0c\r")


class Stats(NamedTuple):
    features: np.ndarray
    counts: dict[str, np.ndarray]


def repeated_words(codes: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document: words inside windows of consecutive words that occur twice or more in it."""
    size = len(codes)
    inside = np.zeros(size + 1, np.int64)
    if size >= window:
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        starts = np.flatnonzero(owner[: size - window + 1] == owner[window - 1 :])
        # an exact number for each distinct run of words, one word longer in each round
        run = np.unique(owner[starts] * (codes.max() + 1) + codes[starts], return_inverse=True)[1]
        for step in range(1, window):
            run = np.unique(run * (codes.max() + 1) + codes[starts + step], return_inverse=True)[1]
        twice = starts[np.bincount(run)[run] > 1] if len(run) else starts
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + window, -1)
    return sums((np.cumsum(inside[:-1]) > 0).astype(np.int64), bounds)


def stats(texts: pa.Array) -> Stats:
    """Features and exact counts of each text; a null text counts as empty."""
    data, bytes_at = utf8(texts)
    w = words(texts)
    n = np.diff(w.bounds)
    safe = np.maximum(n, 1).astype(float)
    length_of = pc.utf8_length(w.known).to_numpy(zero_copy_only=False).astype(np.int64)
    length = length_of[w.codes] if len(w.codes) else np.zeros(0, np.int64)
    word_chars = sums(length, w.bounds)
    mean = word_chars / safe
    spread = np.sqrt(np.maximum(sums(length.astype(float) ** 2, w.bounds) / safe - mean**2, 0))

    def share(flag: pa.Array) -> np.ndarray:
        marks = flag.to_numpy(zero_copy_only=False).astype(np.int8)
        return sums(marks[w.codes] if len(w.codes) else np.zeros(0, np.int8), w.bounds) / safe

    owners = w.owners
    pair_owner, _, pair_count = distinct_per_document(owners, w.codes, len(w.known))
    edges = np.searchsorted(pair_owner, np.arange(len(n) + 1))
    distinct = np.diff(edges)
    top = np.zeros(len(n))
    np.maximum.at(top, pair_owner, pair_count)
    entropy = np.log(safe) - sums(pair_count * np.log(np.maximum(pair_count, 1)), edges) / safe
    beside = np.zeros(len(w.codes), np.int64)
    beside[1:] = (w.codes[1:] == w.codes[:-1]) & (owners[1:] == owners[:-1])
    repeats = repeated_words(w.codes, w.bounds)
    ln = lines(texts)
    worded = pc.match_substring_regex(ln.known, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[ln.codes]
    line_owner = ln.owners[worded]
    n_lines = np.bincount(line_owner, minlength=len(n))
    first_lines = distinct_per_document(line_owner, ln.codes[worded], len(ln.known))[0]
    dup_lines = n_lines - np.bincount(first_lines, minlength=len(n))
    chars = np.maximum(sums(_HEAD[data], bytes_at), 1)
    symbols = sums(_SYMBOL[data], bytes_at)
    known = w.known
    lower, upper = pc.utf8_lower(known), pc.utf8_upper(known)
    spaces = sums(_SPACE[data], bytes_at)
    letters = sums(_LETTER[data], bytes_at)
    digits = sums(_DIGIT[data], bytes_at)
    wide = chars - (sums((data < 128).astype(np.int8), bytes_at))
    features = np.column_stack(
        [
            np.log1p(n), mean, spread, sums((length > 12).astype(np.int8), w.bounds) / safe, sums((length < 3).astype(np.int8), w.bounds) / safe,
            distinct / safe, top / safe, sums(beside, w.bounds) / safe, repeats / safe, dup_lines / np.maximum(n_lines, 1), symbols / chars,
            share(pc.match_substring_regex(known, r"[#*$%&|<>]")), share(pc.match_substring_regex(known, r"[#*$%&<>]{2,}$")),
            share(pc.match_substring(known, "!!")), share(pc.match_substring_regex(known, r"^[^\pL\pN]+$")),
            share(pc.and_(pc.equal(known, upper), pc.not_equal(known, lower))),
            share(pc.match_substring_regex(known, r"^\p{Lu}\p{Ll}")), digits / chars, sums(_UPPER[data], bytes_at) / np.maximum(letters, 1),
            share(pc.match_substring_regex(known, r"\.$")), share(pc.match_substring_regex(known, r",$")), n / np.maximum(n_lines, 1),
            np.maximum(chars - spaces - letters - digits - wide, 0) / chars, wide / chars, entropy,
        ]
    )
    return Stats(features, {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats})


def feature_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and an array ``features`` of each row."""
    chosen = docs.select(*keep, "text")
    schema = T.StructType([*chosen.drop("text").schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = stats(batch.column("text")).features
            offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            arrays = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))], names=schema.names)

    return chosen.mapInArrow(measure, schema)
