"""Importance resampling towards a target distribution over hashed n-grams.

Texts are lower-cased and their separators collapsed to single blanks; one overlapped regular
expression per length, with boundaries looked at on both sides, then emits the n-grams as spans of
that text, and each span's CRC-32 names its bucket. Bucket counts of the documents and of the target
texts give every bucket a gain. A document's score is the sum of its gains plus Gumbel noise from
its id, so that taking the highest scores draws documents without replacement, in proportion to
their importance.

What leaves a task is one count a bucket. Scores are written out narrow and dealt by range; ranks
follow from the sizes of the ranges, so no task sorts more than a range.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.batches import slices
from groundline.llm.shared import cut_lineage

LONGEST = 1
BUCKETS = 10_000
SALT = "2024"
SHARE = (10, 100)
FEWEST_WORDS = 20
ROWS_PER_RANGE = 100_000
_HELD = 1 << 18  # features whose gain a task remembers
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def collapsed(text: bytes | None) -> bytes:
    """Lower-cased A-Z, with one blank between words and none at the ends."""
    return b" ".join((text or b"").translate(_FOLD).split())


def runs(longest: int) -> list[regex.Pattern]:
    """One pattern a length: so many words between blanks or ends, to be searched overlapped."""
    return [regex.compile(rb"(?<![^ ])[^ ]+" + rb" [^ ]+" * more + rb"(?![^ ])") for more in range(longest)]


def features(text: bytes, patterns: list[regex.Pattern]) -> Iterator[bytes]:
    """Every n-gram of a collapsed text, repeats included."""
    for pattern in patterns:
        yield from map(regex.Match.group, pattern.finditer(text, overlapped=True))


def bucket_counts(rows: DataFrame, column: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all n-grams of all rows; buckets without any have no row, null texts none."""
    patterns = runs(longest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, column):
            seen: Counter[bytes] = Counter()
            for text in batch.column(column).cast(pa.binary()).to_pylist():
                seen.update(features(collapsed(text), patterns))
            places = np.fromiter((crc32(f) % buckets for f in seen), np.int64, len(seen))
            np.add.at(total, places, np.fromiter(seen.values(), np.int64, len(seen)))
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    return rows.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: a thousandth of the log of smoothed target over corpus frequency, floored.

    Two counts a bucket reach the driver. Both tables are counted whole; ``text`` is their column.
    """

    def counted(rows: DataFrame) -> list[int]:
        found = {r.bucket: r.n for r in bucket_counts(rows, "text", longest, buckets).toLocalIterator()}
        return [found.get(b, 0) for b in range(buckets)]

    s, t = counted(docs), counted(target)
    whole_s, whole_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * whole_s / ((a + 1) * whole_t))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """Gumbel noise of an id in thousandths, floored; null ids share one draw."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, salt: str = SALT) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score`` of every row."""
    patterns, buckets = runs(longest), len(gain)
    known = docs.sparkSession.sparkContext.broadcast(gain.tolist())

    class Gains(dict):
        def __missing__(self, feature: bytes) -> int:
            if len(self) >= _HELD:
                self.clear()
            self[feature] = value = known.value[crc32(feature) % buckets]
            return value

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gains()
        for batch in slices(batches, "text"):
            n, words, weight = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                text = collapsed(text)
                values = [held[f] for f in features(text, patterns)]
                n.append(len(values))
                words.append(text.count(b" ") + 1 if text else 0)
                weight.append(sum(values))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, words, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "n_words", "weight"])

    longs = [T.StructField(name, T.LongType()) for name in ("n_features", "n_words", "weight")]
    found = docs.select("doc_id", "text").mapInArrow(weigh, T.StructType([docs.select("doc_id").schema[0], *longs]))
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt))


def ranked(scored: DataFrame, ranges: int) -> DataFrame:
    """``scored`` and ``place``: 1, 2, 3... from the highest score, ties to smaller ids, nulls last.

    Rows are dealt by range of score, id and a row number that is written out first, so equal rows
    are split as well; the ranges' sizes, one number a range, give the places before each.
    """
    numbered = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    dealt = cut_lineage(numbered.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("_range"), (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    # one row a range
    placed = placed.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_at"))
    return placed.drop("_row", "_range", "_before", "_at")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    salt: str = SALT,
    share: tuple[int, int] = SHARE,
    fewest_words: int = FEWEST_WORDS,
) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, rank`` of every row of ``docs``.

    Of the N rows with ``fewest_words`` words or more, the highest ``floor(N * share)`` scores are
    drawn and ranked from 1; other rows have a null rank. Null and empty texts have no features and
    weight 0. Rows without an id share one draw of noise and come last among equal scores; rows that
    repeat an id are drawn each on its own. Empty tables give no rows; an empty target only smooths.
    Other columns are not read. Counts run over all rows of both tables; scores are written to the
    shared folder.
    """
    scored = cut_lineage(weighed(docs, gains(docs, target, longest, buckets), longest, salt))
    eligible = F.col("n_words") >= fewest_words
    rows = scored.filter(eligible).count()
    drawn = share[0] * rows // share[1]
    places = ranked(scored.filter(eligible), max(1, -(-rows // ROWS_PER_RANGE)))
    chosen = places.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("place")
    return chosen.unionByName(scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long")))
