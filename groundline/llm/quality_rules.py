"""Quality rules: two fixed rules, then boosted trees whose outcome may only fall with bad signs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundline.llm.batches import slices
from groundline.llm.doc_stats import COUNTS, stats
from groundline.llm.gbt import Forest
from groundline.llm.quality import FIT_ROWS, fit_on, labelled

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
# Documents that the trees find good with less than this probability are rejected.
KEEP_FROM = 0.15
# More of these can only lower a document's score.
MONOTONE = dict.fromkeys(
    ("adjacent_repeat_share", "repeat_share", "dup_line_share", "symbol_share", "symbol_word_share", "marked_end_share", "bang_share", "bare_mark_share", "upper_word_share", "top_word_share"), -1
)


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Forest:
    """Trees with the monotonic constraints, fitted on a bounded choice of labelled documents."""
    return fit_on(docs, labelled(labels, "quality", limit=limit), MONOTONE)


def judge(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of ``docs`` with the counts, ``base_failed``, ``rule_score`` and ``kept``.

    Columns of these names are replaced. A null text has no words and fails like an empty one.
    Repeated rows and null ids are judged row by row.
    """
    added = [*((name, T.LongType(), pa.int64()) for name in COUNTS), ("base_failed", T.BooleanType(), pa.bool_()), ("rule_score", T.DoubleType(), pa.float64()), ("kept", T.BooleanType(), pa.bool_())]
    rows = docs.drop(*(name for name, _, _ in added))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, kind) for name, kind, _ in added)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = stats(batch.column("text"))
            n_words, repeated = found.counts["n_words"], found.counts["n_repeat_words"]
            failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
            score = forest.score(found.features)
            new = {**found.counts, "base_failed": failed, "rule_score": score, "kept": ~failed & (score >= keep_from)}
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(new[n], kind) for n, _, kind in added)], names=schema.names)

    return rows.mapInArrow(apply, schema)
