"""Documents scored by the difference of two language models' losses.

A target and a background bigram model share one vocabulary (the ids of a public tokenizer), one
order, one smoothing and one size: background counts are scaled to the target's number of tokens.
Counts are taken over all documents and are exact: single tokens reach the driver, pairs of tokens
are a table in the shared folder that grows with the corpus. For scoring, the most frequent pairs
are broadcast up to a bound; the others are joined to the documents that hold them. What is
joined is rare by that choice, so no pair makes a large group.
A bigram's probability is smoothed towards its second token's, and that towards uniform.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.batches import slices, sums
from groundline.llm.shared import prepare_folder, row_key
from groundline.llm.tokens import SLICE_BYTES, encoder

VOCABULARY = 49_408
BIGRAM_CELLS = (VOCABULARY + 1) * VOCABULARY  # one for each pair that can be
HELD_PAIRS = 1 << 21  # broadcast for scoring; the others are joined
PART_PAIRS = 1 << 20  # a task passes its counts on when it holds more
BIGRAM_WEIGHT = 64.0  # tokens of the single-token model mixed into each context
TOKEN_WEIGHT = 0.5  # added to every token's count
_KEY = "_llm_row"


class Models(NamedTuple):
    target: np.ndarray  # count of each token
    background: np.ndarray
    pairs: DataFrame  # cell, background, target: each pair that occurs


def cells(previous: np.ndarray, token: np.ndarray, size: int) -> np.ndarray:
    """Number of each pair of tokens, its own below ``size`` (vocabulary + 1 times vocabulary)."""
    return previous.astype(np.int64) * isqrt(size) + token.astype(np.int64)


def _pairs(ids: np.ndarray, bounds: np.ndarray, start_id: int) -> np.ndarray:
    """The token before each token; a document begins after ``start_id``."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = start_id
    return before


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sum of the counts of each."""
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts


def gather(docs: DataFrame, in_target: Column, tokenizer: str, vocabulary: int = VOCABULARY, part: int = PART_PAIRS) -> Models:
    """Counts over all documents (background) and over those where ``in_target`` holds (target).

    Each task adds up its own counts and passes them on whenever it holds more than ``part`` pairs.
    The sums of the pairs are written to the shared folder; those of single tokens, at most
    ``vocabulary`` rows, reach the driver. Null texts count as empty.
    """
    rows = docs.select("text", F.coalesce(in_target, F.lit(False)).alias("chosen"))
    size = (vocabulary + 1) * vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, singles, held = encoder(tokenizer), np.zeros(2 * vocabulary, np.int64), []

        def out(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            # a code is twice the cell, and one more in the target
            cell, background = _added(codes >> 1, counts)
            target = _added(codes >> 1, counts * (codes & 1))[1]
            for start in range(0, len(cell), 1 << 16):
                yield pa.RecordBatch.from_pydict({"cell": cell[start : start + (1 << 16)], "background": background[start : start + (1 << 16)], "target": target[start : start + (1 << 16)]})

        for batch in slices(batches, "text", SLICE_BYTES):
            ids, bounds = encode.of_texts(batch.column("text"))
            ids = ids.astype(np.int64)
            before = _pairs(ids, bounds, vocabulary)
            chosen = np.repeat(batch.column("chosen").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
            singles += np.bincount(2 * ids + chosen, minlength=len(singles))
            inner = before < vocabulary
            held.append(np.unique(2 * (vocabulary + cells(before[inner], ids[inner], size)) + chosen[inner], return_counts=True))
            if sum(len(h[0]) for h in held) > 2 * part:
                held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > part:
                    yield from out(*held[0])
                    held = []
        found = np.flatnonzero(singles)
        yield from out(found, singles[found])
        if held:
            yield from out(*_added(*map(np.concatenate, zip(*held, strict=True))))

    parts = rows.mapInArrow(count, "cell long, background long, target long")
    prepare_folder(docs.sparkSession)
    path = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/lm-{uuid.uuid4().hex}"
    parts.groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).write.parquet(path)
    table = docs.sparkSession.read.parquet(path)
    single = table.filter(F.col("cell") < vocabulary).toArrow()

    def tokens(name: str) -> np.ndarray:
        whole = np.zeros(vocabulary)
        whole[single.column("cell").to_numpy()] = single.column(name).to_numpy()
        return whole

    pairs = table.filter(F.col("cell") >= vocabulary).withColumn("cell", F.col("cell") - vocabulary)
    return Models(tokens("target"), tokens("background"), pairs)


def match(models: Models) -> list[tuple[np.ndarray, float, float]]:
    """Token counts (the background's scaled to the target's number of tokens), their sum, and the scale of pairs."""
    total, all_tokens = float(models.target.sum()), float(models.background.sum())
    scale = total / all_tokens if all_tokens else 0.0
    return [(models.target, total, 1.0), (models.background * scale, total, scale)]


def losses(model: tuple[np.ndarray, float, float], ids: np.ndarray, before: np.ndarray, pair: np.ndarray | float) -> np.ndarray:
    """Loss of each token in nats. A document's first token has no context and is scored on its own."""
    tokens, total, scale = model
    single = (tokens[ids] + TOKEN_WEIGHT) / (total + TOKEN_WEIGHT * len(tokens))
    context = np.append(tokens, 0.0)[before]
    return -np.log((scale * pair + BIGRAM_WEIGHT * single) / (context + BIGRAM_WEIGHT))


def _split(pairs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, at most ``limit``, and the others (none if all pairs are held)."""
    step = F.floor(F.log2("background") * 8)
    counted = sorted(pairs.groupBy(step.alias("step")).count().collect(), reverse=True)
    fits = np.cumsum([r["count"] for r in counted]) <= limit
    if fits.all():
        return pairs, None
    least = counted[int(fits.sum())]["step"]
    return pairs.filter(step > least), pairs.filter(step <= least)


def score_difference(docs: DataFrame, models: Models, tokenizer: str, limit: int = HELD_PAIRS) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score``: mean losses a token, and their difference.

    A low score is like the target. Texts without a token, null ones too, have losses and score 0.
    Repeated rows and null ids are scored row by row. At most ``limit`` pairs are broadcast; the
    documents' other pairs are scored as if they had not occurred, and a join adds what is missing.
    """
    chosen = docs.select("doc_id", "text")
    names = ("target_loss", "background_loss")
    frequent, others = _split(models.pairs, limit)
    table = frequent.toArrow().sort_by("cell")
    small = lambda x: x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x
    known = (table.column("cell").to_numpy(), small(table.column("target").to_numpy()), small(table.column("background").to_numpy()))
    del table
    vocabulary = len(models.target)
    size = (vocabulary + 1) * vocabulary
    held = docs.sparkSession.sparkContext.broadcast((match(models), known))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of each slice: its rows, ids, tokens before, bounds, cells, place of each cell and whether it is known."""
        encode, (cell_of, _, _) = encoder(tokenizer), held.value[1]
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, bounds = encode.of_texts(batch.column("text"))
            before = _pairs(ids, bounds, vocabulary)
            cell = cells(before, ids, size)
            at = np.minimum(np.searchsorted(cell_of, cell), max(len(cell_of) - 1, 0))
            yield batch, ids, before, bounds, cell, at, cell_of[at] == cell if len(cell_of) else np.zeros(len(cell), bool)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, (_, *counts) = held.value
        for batch, ids, before, bounds, _, at, found in read(batches):
            total = [sums(losses(m, ids, before, np.where(found, c[at], 0) if len(c) else 0.0), bounds) for m, c in zip(fitted, counts, strict=True)]
            joined = sums(~found & (before < vocabulary), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(_KEY), batch.column("doc_id"), *map(pa.array, (np.diff(bounds), joined, *total))], names=begun.names)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, before, bounds, cell, _, found in read(batches):
            left = ~found & (before < vocabulary)
            owner, cell = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[left], cell[left]
            order = np.lexsort((cell, owner))
            owner, cell = owner[order], cell[order]
            first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
            n = np.diff(np.append(first, len(cell)))
            keys = batch.column(_KEY).to_numpy()
            for start in range(0, len(first), 1 << 16):
                part = first[start : start + (1 << 16)]
                yield pa.RecordBatch.from_pydict({_KEY: keys[owner[part]], "cell": cell[part], "n": n[start : start + (1 << 16)].astype(np.int32)})

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the counts of each pair add to its losses."""
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            before, ids = cell // vocabulary, cell % vocabulary
            more = [losses(m, ids, before, batch.column(name).to_numpy()) - losses(m, ids, before, 0.0) for m, name in zip(held.value[0], ("target", "background"), strict=True)]
            yield pa.RecordBatch.from_pydict({"cell": cell, names[0]: more[0], names[1]: more[1]})

    begun = T.StructType([T.StructField(_KEY, T.LongType()), chosen.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("joined", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    keyed = chosen.withColumn(_KEY, row_key())
    scored = keyed.mapInArrow(apply, begun)
    loss = {n: F.col(n) for n in names}
    if others is not None:
        added = others.mapInArrow(missing, "cell long, target_loss double, background_loss double")
        rows = keyed.mapInArrow(rare, f"{_KEY} long, cell long, n int").join(added.hint("merge"), "cell", "left")
        more = rows.groupBy(_KEY).agg(F.sum("n").alias("all"), *(F.sum(F.coalesce(n, F.lit(0.0)) * F.col("n")).alias(f"more_{n}") for n in names))
        scored = scored.join(more, _KEY, "left")
        # rows with the same key are repeats: their sums are as many times too large as their pairs
        loss = {n: F.col(n) + F.coalesce(F.col(f"more_{n}") * F.col("joined") / F.col("all"), F.lit(0.0)) for n in names}
    mean = [(loss[n] / F.greatest("n_tokens", F.lit(1))).alias(n) for n in names]
    return scored.select("doc_id", "n_tokens", *mean).withColumn("score", F.col(names[0]) - F.col(names[1]))
