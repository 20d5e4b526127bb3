"""Arrow helpers shared by the text operators: bounded slices, words, and sums per document.

Spark hands Arrow batches to the tasks; every helper works on a slice of a few megabytes of text,
so memory in a task does not depend on the number of rows in a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(start, end - start)


def filled(texts: pa.Array) -> pa.Array:
    """Texts with null as the empty text."""
    return pc.fill_null(texts, "") if texts.null_count else texts


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 bounds of the texts in them."""
    wide = filled(texts).cast(pa.large_binary())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Words(NamedTuple):
    codes: np.ndarray  # of each word, into known
    bounds: np.ndarray  # of the documents in codes
    known: pa.Array  # distinct words of the slice

    @property
    def owners(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def coded(lists: pa.ListArray, keep: np.ndarray | None = None) -> Words:
    """Dictionary codes of the flattened lists; ``keep`` marks the entries that count."""
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if keep is not None:
        flat = flat.filter(pa.array(keep))
        bounds = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[bounds]
    encoded = flat.dictionary_encode()
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, encoded.dictionary)


def words(texts: pa.Array) -> Words:
    """Runs of other characters than the six of ASCII white space."""
    lists = pc.ascii_split_whitespace(filled(texts))
    return coded(lists, pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False) > 0)


def lines(texts: pa.Array) -> Words:
    """Lines between newline characters, as they are."""
    return coded(pc.split_pattern(filled(texts), "\n"))


def distinct_per_document(owners: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, code and count of each distinct pair."""
    pairs, counts = np.unique(owners * max(size, 1) + codes, return_counts=True)
    return pairs // max(size, 1), pairs % max(size, 1), counts
