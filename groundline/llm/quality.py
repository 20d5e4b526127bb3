"""Quality scores by boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.batches import slices
from groundline.llm.doc_stats import FEATURES, feature_table, stats
from groundline.llm.gbt import Forest, fit

# Labelled rows that a classifier is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 20_000


def remainder(number: int) -> Column:
    """CRC-32 of the id as text, modulo ``number``; 0 where the id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % number, F.lit(0))


def labelled(labels: DataFrame, label: str, usable: Column | None = None, limit: int = FIT_ROWS) -> DataFrame:
    """``doc_id, label`` of a bounded choice of labelled ids; an id with several labels gets the largest."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    if usable is not None:
        rows = rows.filter(usable)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def with_labels(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen ids; the ids are a bounded number of narrow rows, so they are broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_on(docs: DataFrame, chosen: DataFrame, monotone: dict[str, int] | None = None, **options) -> Forest:
    """Fit a forest on the statistics of the chosen labelled documents (at most one row an id)."""
    table = feature_table(with_labels(docs, chosen), ["doc_id", "label"])
    rows = table.groupBy("doc_id", "label").agg(F.min("features").alias("features")).orderBy("doc_id").toArrow()
    values = rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    signs = {FEATURES.index(name): sign for name, sign in (monotone or {}).items()}
    return fit(values, rows.column("label").to_numpy().astype(float), monotone=signs, **options)


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` of every row: the probability of the good label, from the text alone.

    A null text counts as empty and is scored like any other; repeated rows and null ids are kept.
    """
    chosen = docs.select("doc_id", "text")
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = forest.score(stats(batch.column("text")).features)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1))], names=schema.names)

    return chosen.mapInArrow(apply, schema)
