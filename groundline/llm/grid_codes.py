"""Codes of vectors by parts, with nearest entries looked up through memoised grid cells.

A vector's integer components are cut into equal parts, and each part is coded by its nearest entry
in the codebook of its position. For the lookup a part falls into a cell of a coarse grid. The first
part of a cell bounds the distance of every entry to the cell's box: an entry whose least distance
exceeds another's greatest one can be nearest to no point of the box. The entries that are left are
remembered under the cell, and only they are measured exactly, in whole numbers.

Codebooks are bounded by their parameters (parts x entries), as is what a task returns for a round:
one sum and count an entry. Each round is one scan of the table without a shuffle of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.shared import cut_lineage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
CELL = 32
LARGEST = 1 << 26  # of a component; distances then fit a long
CELLS_HELD = 1 << 16  # of a part position, in a task
LABELS_BROADCAST = 100_000
_SLICE = 2048
_CHUNK = 64


class Cells:
    """The entries of one codebook that can be nearest to some point of a grid cell, by cell."""

    def __init__(self, entries: np.ndarray, width: int, held: int = CELLS_HELD) -> None:
        self.entries, self.width, self.held = entries, width, held
        self.places: dict[bytes, int] = {}
        self.masks: list[np.ndarray] = []
        self.measured = 0

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        low = cells[:, None, :] * self.width
        below, above = low - self.entries, self.entries - (low + self.width - 1)
        least = np.maximum(np.maximum(below, above), 0)
        greatest = np.maximum(np.abs(below), np.abs(above))
        least, greatest = (np.einsum("ijk,ijk->ij", x, x) for x in (least, greatest))
        return least <= greatest.min(axis=1, keepdims=True)

    def masks_of(self, cells: np.ndarray) -> np.ndarray:
        """Which entries are left for each of some distinct cells."""
        if len(self.masks) + len(cells) > self.held:
            self.places.clear()
            self.masks.clear()
        names = [c.tobytes() for c in np.ascontiguousarray(cells)]
        new = [n for n, name in enumerate(names) if name not in self.places]
        for start in range(0, len(new), _CHUNK):
            at = new[start : start + _CHUNK]
            for n, mask in zip(at, self._undominated(cells[at]), strict=True):
                self.places[names[n]] = len(self.masks)
                self.masks.append(mask)
        return np.stack([self.masks[self.places[name]] for name in names])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part; ties to the lower entry."""
        cells, which = np.unique(parts // self.width, axis=0, return_inverse=True)
        mask = self.masks_of(cells)[which.ravel()]
        row, entry = np.nonzero(mask)
        self.measured += len(row)
        distance = np.square(parts[row] - self.entries[entry]).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[row])
        first = hit[np.searchsorted(row[hit], np.arange(len(parts)))]
        return entry[first], best


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, others: list[str]) -> DataFrame:
    """``vec_id, v`` and other columns of the rows whose vector holds no null and only finite numbers."""
    vector = F.col(vector_column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_column).alias("vec_id"), vector.alias("v"), *others).filter(F.col("v").isNotNull() & finite)


def _integers(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(-1, size)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Parts x entries x components of the smallest ids (equal ids by their vectors, nulls last).

    The length of the very first vector decides; vectors of another length are passed over.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = vectors.filter(F.size("v") > 0).orderBy(*order).select(F.size("v")).first()
    if first is None:
        return None
    size = first[0]
    if size % parts:
        raise ValueError(f"vectors of {size} components do not make {parts} equal parts")
    rows = vectors.filter(F.size("v") == size).orderBy(*order).limit(entries).select("v").collect()
    whole = _integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), size)
    return np.ascontiguousarray(whole.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def _coded(batch: pa.RecordBatch, cells: list[Cells], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    for start in range(0, batch.num_rows, _SLICE):
        part = batch.slice(start, _SLICE)
        pieces = _integers(part.column("v"), size).reshape(part.num_rows, len(cells), -1)
        yield part, pieces, [c.nearest(pieces[:, p]) for p, c in enumerate(cells)]


def moved(vectors: DataFrame, codebooks: np.ndarray, cell: int = CELL) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of the parts nearest to it."""
    parts, entries, width = codebooks.shape
    known = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        cells = [Cells(book, cell) for book in known.value]
        for batch in batches:
            for _, pieces, found in _coded(batch, cells, parts * width):
                for p, (entry, _) in enumerate(found):
                    np.add.at(total[p], entry, pieces[:, p])
                    count[p] += np.bincount(entry, minlength=entries)
        part, entry = np.nonzero(count)
        sums = [pa.array(total[part, entry, d]) for d in range(width)]
        names = ["part", "entry", "n", *(f"s{d}" for d in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *sums], names=names)

    fields = ", ".join(["part long", "entry long", "n long", *(f"s{d} long" for d in range(width))])
    same = vectors.filter(F.size("v") == parts * width).select("v").mapInArrow(add, fields)
    added = same.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in same.columns[2:]))
    new = codebooks.copy()
    for row in added.toLocalIterator():
        new[row.part, row.entry] = [total // row.n for total in row[3:]]
    return new


def digest(codebooks: np.ndarray | None) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    values = [] if codebooks is None else codebooks.ravel().tolist()
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def compress(
    rows: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    cell: int = CELL,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id, code, error, label_error`` of every kept row, and the final codebooks.

    Rows whose vector is null or holds null or non-finite components are dropped. Components beyond
    65,536 on either side count as that. With fewer kept rows than ``entries`` there are fewer
    entries. Rows without an id are coded and come last in the order that starts the codebooks;
    repeated rows count each. The vector of the smallest id sets the length: vectors of another
    length (empty ones too) keep a row with null ``code`` and ``error``; a length that does not
    divide into ``parts`` is an error. Labels are only summed over, nulls together; a label whose
    rows have no error has a null sum. An empty table gives no rows. Other columns are not read.
    """
    vectors = whole_vectors(rows, id_column, vector_column, [F.col(label_column).alias("label")])
    codebooks = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if codebooks is not None else 0):
        codebooks = moved(vectors, codebooks, cell)
    size = 0 if codebooks is None else codebooks.shape[0] * codebooks.shape[2]
    known = rows.sparkSession.sparkContext.broadcast(codebooks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, cell) for book in known.value]
        for batch in batches:
            for part, _, found in _coded(batch, cells, size):
                codes = np.stack([entry for entry, _ in found], axis=1)
                names = [bytes(c).hex() if entries <= 256 else ",".join(map(str, c)) for c in codes.astype(np.uint8 if entries <= 256 else np.int64).tolist()]
                error = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(names), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([*vectors.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = vectors.filter(F.size("v") == size).mapInArrow(code, schema) if size else vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    other = vectors.filter(F.size("v") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut_lineage(coded.unionByName(other))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    few = sums.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error"), codebooks
