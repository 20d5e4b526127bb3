"""SimHash near-duplicates: fingerprints that differ in few bits, linked and grouped.

Candidates come from the generalised pigeonhole principle. The 64 bits are grouped into eight atoms
of correlated bits, using the correlation of bits over all fingerprints. A dynamic program splits
the atoms into parts and gives each part its own threshold, so that thresholds plus one add up to
one more than the allowed distance; its cost is the number of keys plus the number of candidate
pairs, estimated from the distances of random pairs within each atom. Two fingerprints within the
distance agree in some part up to its threshold: they meet in that part's bucket and are verified.
A bucket returns links that span its groups, not all its pairs. Large buckets are split on their
other bits by the same principle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.batches import filled, slices
from groundline.llm.components import components
from groundline.llm.shared import cut_lineage, free_name, row_key

DISTANCE = 3
SHINGLE = 3
SEED = 42
ATOMS = 8
LARGE_BUCKET = 4096
KEY_COST = 200.0  # of shuffling a key, in verified pairs
_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """Hashes of all word shingles of a text, repeats included."""
    words = text.lower().translate(_WHITE).split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)]


def fingerprint_of(hashes: list[int], block: int = 1 << 16) -> int:
    """Bits that are set in over half the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), block):
        part = np.array(hashes[start : start + block], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes)).tolist()
    return sum(1 << b for b in bits)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, fp`` of every row; ``fp`` is the unsigned fingerprint as a long.

    Texts without a word, null ones too, have fingerprint zero.
    """
    chosen = docs.select("doc_id", row_key().alias("row_key"), "text")
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("row_key", T.LongType()), T.StructField("fp", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = filled(batch.column("text")).cast(pa.binary()).to_pylist()
            prints = np.fromiter((fingerprint_of(shingle_hashes(t)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(prints.view(np.int64))], names=schema.names)

    return chosen.mapInArrow(apply, schema)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(prints: DataFrame) -> list[list[int]]:
    """Eight groups of eight correlated bits, from the co-occurrence of bits over all fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = _bits(_numbers(batch, "fp")).astype(np.float32)
            for start in range(0, len(bits), 1 << 16):
                part = bits[start : start + (1 << 16)]
                total += np.rint(part.T @ part).astype(np.int64)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": total[i, j]})

    rows = prints.select("fp").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((64, 64))
    for i, j, n in rows:
        together[i, j] = together[j, i] = n
    ones, total = np.diag(together).copy(), max(1.0, float(together.max()))
    share = ones / total
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    relation = np.abs((together / total - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(relation, 0)
    left, groups = set(range(64)), []
    while left:
        pool = sorted(left)
        group = [max(pool, key=lambda b: relation[b, pool].max())]
        while len(group) < 64 // ATOMS:
            rest = [b for b in pool if b not in group]
            group.append(max(rest, key=lambda b: relation[b, group].sum()))
        groups.append(group)
        left -= set(group)
    return groups


def atom_distances(prints: DataFrame, groups: list[list[int]], most: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and per atom the share of random pairs at each distance up to ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ATOMS, 256), np.int64)
        for batch in batches:
            values = _regrouped(_numbers(batch, "fp"), groups).view(np.uint8).reshape(-1, 8)
            for a in range(ATOMS):
                total[a] += np.bincount(values[:, a], minlength=256)
        atom, value = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"atom": atom, "value": value, "n": total[atom, value]})

    rows = prints.select("fp").mapInArrow(count, "atom long, value long, n long").groupBy("atom", "value").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((ATOMS, 256))
    for atom, value, n in rows:
        seen[atom, value] = n
    total = int(seen[0].sum())
    values = np.arange(256)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    share = seen / max(total, 1)
    return total, np.array([[(np.outer(s, s)[apart == d]).sum() for d in range(most + 1)] for s in share])


def _regrouped(prints: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Fingerprints with their bits in the order of the groups."""
    order = [bit for group in groups for bit in group]
    return np.packbits(_bits(prints)[:, order], axis=1, bitorder="little").reshape(-1).view(np.uint64)


@dataclass(frozen=True)
class Part:
    low: int  # first bit, after regrouping
    width: int
    threshold: int


def allocate(total: int, distances: np.ndarray, most: int) -> list[Part]:
    """Parts and thresholds of least estimated cost; thresholds plus one add up to ``most`` + 1."""
    step = 64 // ATOMS

    def cost(start: int, end: int, budget: int) -> float:
        near = np.array([1.0])
        for atom in range(start, end):
            near = np.convolve(near, distances[atom])[: most + 1]
        width, pairs = step * (end - start), total * total / 2 * near[:budget].sum()
        keys = sum(comb(width, d) for d in range(budget))
        return total * (1 + keys / 2) * KEY_COST + pairs

    best = {(0, 0): (0.0, [])}
    for end in range(1, ATOMS + 1):
        for budget in range(most + 2):
            options = []
            for start in range(end):
                for own in range(1, budget + 1):
                    if (start, budget - own) in best:
                        spent, parts = best[start, budget - own]
                        options.append((spent + cost(start, end, own), [*parts, Part(step * start, step * (end - start), own - 1)]))
            if options:
                best[end, budget] = min(options, key=lambda o: o[0])
    return best[ATOMS, most + 1][1]


def _values(prints: np.ndarray, part: Part) -> np.ndarray:
    mask = np.uint64((1 << part.width) - 1)
    return (prints >> np.uint64(part.low)) & mask


def bucket_keys(prints: DataFrame, groups: list[list[int]], parts: list[Part]) -> DataFrame:
    """``part, value, probe, fp``: each fingerprint's own buckets and those of smaller near values."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _numbers(batch, "fp")
            for start in range(0, len(whole), 1 << 14):
                fp = whole[start : start + (1 << 14)]
                turned = _regrouped(fp, groups)
                for index, part in enumerate(parts):
                    own = _values(turned, part)
                    yield _keys(index, own, fp, False)
                    for flips in range(1, part.threshold + 1):
                        for chosen in combinations(range(part.width), flips):
                            near = own ^ np.uint64(sum(1 << c for c in chosen))
                            smaller = near < own
                            yield _keys(index, near[smaller], fp[smaller], True)

    return prints.select("fp").mapInArrow(emit, "part int, value long, probe boolean, fp long")


def _keys(part: int, values: np.ndarray, fp: np.ndarray, probe: bool) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(np.full(n, part, np.int32)), "value": values.view(np.int64), "probe": np.full(n, probe), "fp": fp}
    )


def _other_bits(fp: Column, part: Column, groups: list[list[int]], parts: list[Part], pieces: int) -> Column:
    """Array of the pieces of the bits outside a part; two fingerprints within the distance share one."""
    whole = F.lit(None).cast("array<long>")
    order = [bit for group in groups for bit in group]
    for index, p in enumerate(parts):
        outside = order[: p.low] + order[p.low + p.width :]
        cut = [sum(1 << b for b in outside[i::pieces]) for i in range(pieces)]
        masks = [F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in cut]
        whole = F.when(part == index, F.array(*(fp.bitwiseAND(m) for m in masks))).otherwise(whole)
    return whole


def links_in_buckets(keys: DataFrame, groups: list[list[int]], parts: list[Part], distance: int, large: int = LARGE_BUCKET) -> DataFrame:
    """Links ``a, b`` that connect whatever within a bucket is connected by the distance."""
    counts = keys.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("part", "value", F.lit(True).alias("large"))
    marked = keys.join(counts, ["part", "value"], "left")
    pieces = _other_bits(F.col("fp"), F.col("part"), groups, parts, distance + 1)
    nothing = F.array(F.lit(0).cast("long"))
    split = marked.select("part", "value", "probe", "fp", F.posexplode(F.when(F.col("large"), pieces).otherwise(nothing)).alias("piece", "rest"))
    key = ["part", "value", "piece", "rest"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([_numbers(batch, c).astype(np.int64) for c in (*key, "probe", "fp")])
            rows = np.concatenate([*held, rows]) if held else rows
            last = rows[-1, :4]
            # the last bucket may go on in the next batch
            cut = len(rows)
            while cut and (rows[max(0, cut - 4096) : cut, :4] == last).all():
                cut = max(0, cut - 4096)
            if cut:
                low = max(0, cut - 4096)
                cut = low + int(np.flatnonzero((rows[low:cut, :4] != last).any(axis=1))[-1]) + 1
            held = [rows[cut:]]
            yield from _spanning(rows[:cut], distance)
        if held:
            yield from _spanning(held[0], distance)

    return split.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "a long, b long")


def _spanning(rows: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Links from each fingerprint to the smallest it is connected with inside whole buckets."""
    if len(rows) < 2:
        return
    new = np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(rows)))
    bucket = np.repeat(np.arange(len(start)), sizes)
    shared = sizes[bucket] > 1
    bucket, size = bucket[shared], sizes[bucket][shared]
    names, fp = np.unique(rows[shared, 5].view(np.uint64), return_inverse=True)
    prints, probe = names[fp], rows[shared, 4].astype(bool)
    root = np.arange(len(names))
    small = size <= 256
    at = np.flatnonzero(small)
    for shift in range(1, int(size[at].max()) if len(at) else 0):
        a, b = at[:-shift], at[shift:]
        near = bucket[a] == bucket[b]
        a, b = a[near], b[near]
        near = (np.bitwise_count(prints[a] ^ prints[b]) <= distance) & ~(probe[a] & probe[b])
        _join(root, fp[a[near]], fp[b[near]])
        if shift > 8:
            at = at[size[at] > shift]
    at = np.flatnonzero(~small)
    for one in np.unique(bucket[at]):
        member = at[bucket[at] == one]
        for first in range(0, len(member), 256):
            a = member[first : first + 256]
            for second in range(first, len(member), 1 << 15):
                b = member[second : second + (1 << 15)]
                near = (np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= distance) & ~(probe[a][:, None] & probe[b][None, :])
                i, j = np.nonzero(near)
                _join(root, fp[a[i]], fp[b[j]])
    moved = root != np.arange(len(names))
    if moved.any():
        yield pa.RecordBatch.from_pydict({"a": names[root[moved]].view(np.int64), "b": names[moved].view(np.int64)})


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of each pair; every node's root stays the smallest of its group."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, row_key, fp, group_fp, component_id`` of every row.

    ``group_fp`` names the component by its smallest fingerprint, ``component_id`` is its smallest
    id (null ids do not count; null if all are). Rows with equal texts, repeated rows and all rows
    without a word share a fingerprint. An empty table gives no rows. Writes fingerprints and links
    to the shared folder.
    """
    rows = cut_lineage(fingerprints(docs))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = bit_groups(prints)
    total, distances = atom_distances(prints, groups, distance)
    parts = allocate(total, distances, distance)
    roots = components(links_in_buckets(bucket_keys(prints, groups, parts), groups, parts, distance))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group_fp", F.coalesce("root", "fp"))
    least = named.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    known = named.select("fp", "group_fp").join(least, "group_fp")
    return rows.join(known, "fp").select("doc_id", "row_key", "fp", "group_fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the row with its smallest id.

    A repeated row, or a component without ids, still leaves exactly one row.
    """
    found = near_duplicates(docs, distance)
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    key = free_name(docs, "_llm_row")
    kept = found.groupBy("group_fp").agg(F.min(best)["row_key"].alias(key))
    keyed = docs.withColumn(key, row_key()).join(kept.select(key).distinct(), key, "left_semi")
    return keyed.dropDuplicates([key]).select(*docs.columns)
