"""Removal of lines that many documents share.

Hashes of lines are dealt by range, and a Bloom filter a range tells those seen once from those that
may have been seen before; it grows with what it holds. The latter, and these alone, make a second
filter, of hashes seen twice, which every task has while it is small; beyond that, hashes are joined.
Only lines in the second filter are shuffled, counted exactly by their text, and joined back to their
documents. A filter can only suspect a line too many, which never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.batches import slices
from groundline.llm.shared import cut_lineage, free_name, row_key

STRIPPED = b" \t\n\x0b\x0c\r"
BITS_PER_LINE = 16
LARGEST_FILTER_BITS = 1 << 29  # of the broadcast filter: 64 MB, for 30 million repeated lines
LAYER_BITS = 1 << 24
CHUNK_BITS = 1 << 17
HASHES = 4
RANGE_BYTES = 256 << 20
HELD_HASHES = 1 << 20


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(STRIPPED).lower()


def document_keys(text: bytes | None, shortest: int) -> list[bytes]:
    """Distinct keys of a text with at least ``shortest`` code points, in order."""
    keys = dict.fromkeys(line_key(line) for line in (text or b"").split(b"\n"))
    return [k for k in keys if len(k) >= shortest and (len(k) >= 4 * shortest or len(k.decode("utf-8", "replace")) >= shortest)]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of each hash in a filter of a power of two bits, one row a hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def _test(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bitmap, flat >> np.uint64(3), np.left_shift(np.uint8(1), (flat & np.uint64(7)).astype(np.uint8)))


class Once:
    """A Bloom filter of hashes that grows by layers, so that it is never full."""

    def __init__(self, bits: int = LAYER_BITS) -> None:
        self.bits, self.room, self.layers = bits, 0, []

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        """Which of some distinct hashes may have been seen before; from now on all have."""
        places = _places(hashes, self.bits)
        known = np.zeros(len(hashes), bool)
        for layer in self.layers:
            known |= _test(layer, places)
        new = places[~known]
        while len(new):
            if self.room <= 0:
                self.layers.append(np.zeros(self.bits // 8, np.uint8))
                self.room = self.bits // BITS_PER_LINE
            _set(self.layers[-1], new[: self.room])
            new, self.room = new[self.room :], self.room - len(new)
        return known


def seen_again(docs: DataFrame, shortest: int) -> DataFrame:
    """``h``: hashes of keys that two documents may share, each once.

    A task emits its distinct hashes, marked where two of its documents hold one, so that a very
    common line costs a row a task. They are dealt by hash; each range passes a filter of those seen
    once, and what it may have seen before is kept. The number of ranges follows the bytes of text.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(batches, "text"):
            held.append(_hashes([k for text in batch.column("text").cast(pa.binary()).to_pylist() for k in document_keys(text, shortest)]))
            if sum(map(len, held)) >= HELD_HASHES:
                yield _marked(held)
                held = []
        yield _marked(held)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        for batch in batches:
            # one task's share holds a hash once, the next one's may again: a batch may hold both
            hashes, at, count = np.unique(batch.column("h").to_numpy().view(np.uint64), return_index=True, return_counts=True)
            marked = np.zeros(len(hashes), bool)
            np.logical_or.at(marked, np.searchsorted(hashes, batch.column("h").to_numpy().view(np.uint64)), batch.column("again").to_numpy(zero_copy_only=False))
            hit = once.seen(hashes) | marked | (count > 1)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[hit].view(np.int64))], names=["h"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    dealt = docs.select("text").mapInArrow(distinct, "h long, again boolean").repartition(ranges, "h")
    return cut_lineage(dealt.mapInArrow(repeated, "h long").distinct())


def _marked(held: list[np.ndarray]) -> pa.RecordBatch:
    hashes, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(count > 1)], names=["h", "again"])


def twice_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the hashes, a row of bytes a chunk; ``bits / 8`` bytes reach the driver.

    The upper bits of a hash name its chunk, so each chunk is filled in one place.
    """
    chunks = max(1, bits // CHUNK_BITS)
    upper = F.shiftrightunsigned("h", 64 - 20) % chunks

    def fill(table: pa.Table) -> pa.Table:
        bitmap = np.zeros(CHUNK_BITS // 8, np.uint8)
        _set(bitmap, _places(table.column("h").to_numpy().view(np.uint64), CHUNK_BITS))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bitmap": [bitmap.tobytes()]})

    filled = np.zeros((chunks, CHUNK_BITS // 8), np.uint8)
    for row in hashes.withColumn("chunk", upper).groupBy("chunk").applyInArrow(fill, "chunk long, bitmap binary").toLocalIterator():
        filled[row["chunk"]] = np.frombuffer(row["bitmap"], np.uint8)
    return filled


def _may_hold(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _places(hashes, CHUNK_BITS) + ((hashes >> np.uint64(44)) % np.uint64(len(filled)))[:, None] * np.uint64(CHUNK_BITS)
    return _test(filled.ravel(), places)


def suspected_lines(docs: DataFrame, shortest: int, key: str, largest_bits: int = LARGEST_FILTER_BITS) -> DataFrame:
    """``key, doc_id, line`` of the lines whose hash may stand in two documents; written out.

    As long as the filter of repeated hashes takes at most ``largest_bits``, it is broadcast. Beyond
    that, hashes meet the repeated ones in a join, and each document gets the list of its own.
    """
    again = seen_again(docs, shortest)
    bits = max(CHUNK_BITS, 1 << int(again.count() * BITS_PER_LINE).bit_length())
    schema = T.StructType([T.StructField(key, T.LongType()), docs.schema["doc_id"], T.StructField("line", T.BinaryType())])
    texts = docs.select(key, "doc_id", "text")
    small = bits <= largest_bits
    known = docs.sparkSession.sparkContext.broadcast(twice_filter(again, bits) if small else None)

    def own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [document_keys(text, shortest) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            owners = pa.array(np.repeat(np.arange(len(found)), [len(row) for row in found]))
            hashes = _hashes([k for row in found for k in row])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(owners), pa.array(hashes.view(np.int64))], names=[key, "h"])

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [document_keys(text, shortest) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            keys = [k for row in found for k in row]
            if not keys:
                continue
            owner, hashes = np.repeat(np.arange(len(found)), [len(row) for row in found]), _hashes(keys)
            if small:
                hit = _may_hold(known.value, hashes)
            else:
                lists = [set(row or ()) for row in batch.column("_hashes").to_pylist()]
                hit = np.fromiter((h in lists[o] for h, o in zip(hashes.view(np.int64).tolist(), owner.tolist(), strict=True)), bool, len(keys))
            owners = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(owners), batch.column("doc_id").take(owners), pa.array(keys, pa.binary()).filter(pa.array(hit))],
                names=[key, "doc_id", "line"],
            )

    if not small:
        lists = texts.select(key, "text").mapInArrow(own_hashes, f"{key} long, h long").join(again, "h").groupBy(key).agg(F.collect_set("h").alias("_hashes"))
        texts = texts.join(lists, key)
    return cut_lineage(texts.mapInArrow(suspect, schema))


def drop_shared_lines(docs: DataFrame, min_documents: int = 10, shortest: int = 1, keep_first: bool = False, largest_bits: int = LARGEST_FILTER_BITS) -> DataFrame:
    """``docs`` without the lines whose key stands in ``min_documents`` rows or more.

    All columns stay, ``text`` is replaced (null and empty texts are one empty line and become the
    empty text), and ``n_lines`` (before) and ``n_dropped`` are added, replacing columns of these
    names. Each row is a document, also when ids are null or repeated. With ``keep_first`` the first
    line of a key stays in the row with the smallest id (nulls last); rows that equal it in id and
    text keep theirs too. Writes narrow tables of suspected and of shared lines to the shared folder.
    """
    key = free_name(docs, "_llm_row")
    keyed = docs.drop("n_lines", "n_dropped").withColumn(key, row_key())
    suspects = suspected_lines(keyed, shortest, key, largest_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(key).alias("c")))["c"]
    shared = suspects.groupBy("line").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter(F.col("n") >= min_documents)
    # written out, so that the join deals both sides itself and may split a very common line
    shared = cut_lineage(shared.select("line", "first"))
    drops_name = free_name(docs, "_llm_drops")
    drops = (
        suspects.join(shared, "line")
        .groupBy(key)
        .agg(F.collect_set(F.struct("line", (F.col("first") == F.col(key)).alias("first"))).alias(drops_name))
    )
    columns = [c for c in keyed.columns if c != key]
    out = T.StructType([*keyed.select(*columns).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, before, dropped = [], [], []
            lists = batch.column(drops_name).to_pylist()
            for text, drop in zip(pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist(), lists, strict=True):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    gone = {d["line"] for d in drop}
                    spared = {d["line"] for d in drop if d["first"]} if keep_first else set()
                    kept = []
                    for line in lines:
                        key = line_key(line)
                        if key not in gone:
                            kept.append(line)
                        elif key in spared:
                            spared.discard(key)
                            kept.append(line)
                texts.append(b"\n".join(kept))
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in out.names], names=out.names)

    return keyed.join(drops, key, "left").drop(key).mapInArrow(rewrite, out)
