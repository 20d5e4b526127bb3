"""Packing of documents into fixed token windows by best-fit decreasing.

Documents become token ids, overlong ones are cut into full windows first, and every rest goes to
the open window it fills best. Placement runs per shard: pieces are dealt by a hash into shards of
bounded size, so no task sees more than a shard and the work grows with the number of documents.
A shard leaves at most a few windows partly filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.batches import slices
from groundline.llm.tokens import SLICE_BYTES, encoder

WINDOW = 4096
SHARD_DOCUMENTS = 4096
_SHARD = "_llm_shard"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Windows of token ids: ``doc_id, start, length, ids, doc_tokens``.

    ``ids`` holds little-endian unsigned 32-bit ids. ``end_id`` follows the ids of every text, so a
    null or empty text is one piece of one id. Every piece but a document's last is full. Repeated
    rows and null ids are kept; other columns of ``docs`` are not read.
    """
    chosen = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", chosen.schema["doc_id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, bounds = encode.of_texts(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            pieces = -(-sizes // window)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, sizes[owner] - start)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(length), data, pa.array(sizes[owner])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chosen.mapInArrow(cut, schema)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the tightest that still fits."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stacks: dict[int, list[int]] = {}

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += change
            node >>= 1

    def add(self, room: int, window_id: int) -> None:
        self.stacks.setdefault(room, []).append(window_id)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of at least ``size``."""
        tree, node = self.tree, size + self.leaves
        if not tree[node]:
            # climb until a subtree to the right holds a window, then go down its left edge
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` come in decreasing order."""
    windows: list[int] = []
    offsets: list[int] = []
    opened, free = 0, OpenWindows(window)
    for size in lengths:
        found = free.take(size) if size < window else None
        if found is None:
            room, chosen = window, opened
            opened += 1
        else:
            room, chosen = found
        windows.append(chosen)
        offsets.append(window - room)
        if room > size:
            free.add(room - size, chosen)
    return windows, offsets


def pack(pieces: DataFrame, shards: int, key: list[str], window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``window``.

    ``key`` names the columns that deal pieces to shards and break ties of equal length. Pieces of
    one sequence follow each other without gaps from offset 0. All other columns are carried, so
    drop wide ones first. Lengths outside the range are an error. Columns named ``sequence_id`` or
    ``offset`` are replaced.
    """
    kept = pieces.drop("sequence_id", "offset")
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = kept.columns

    def place(group: pa.Table) -> pa.Table:
        shard = group.column(_SHARD)[0].as_py()
        table = group.select(names).sort_by([("length", "descending"), *((k, "ascending") for k in key)])
        lengths = table.column("length").to_pylist()
        if lengths and not (1 <= lengths[-1] and lengths[0] <= window):
            raise ValueError(f"piece lengths must be 1 to {window}")
        windows, offsets = best_fit_decreasing(lengths, window)
        sequence = np.array(windows, np.int64) + (shard << 32)
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = kept.withColumn(_SHARD, F.pmod(F.xxhash64(*key), F.lit(shards)))
    return dealt.groupBy(_SHARD).applyInArrow(place, schema)


def shards_for(docs: DataFrame, per_shard: int = SHARD_DOCUMENTS) -> int:
    """Shards for a table of documents; counts it (an action that reads no text)."""
    return max(1, -(-docs.count() // per_shard))


def sequences(placed: DataFrame) -> DataFrame:
    """Token ids of every sequence from placed pieces that still carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")
    )
