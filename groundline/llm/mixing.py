"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is its weight's share of the whole, at most a number of epochs of the source; what
it cannot take is shared again by weight. Complete epochs come first. For the rest, every document
draws an exponential key divided by its quality weight (Efraimidis and Spirakis), and documents are
taken in the order of their keys until the budget is reached. The order is found without sorting
a source in one task: sizes are summed per range of keys, the ranges are summed up in order, and
only the range in which the budget ends is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.llm.shared import cut_lineage, free_name, row_key

WEIGHTS = (5.0, 2.0, 1.0)
WHOLE = 1.5
MOST_EPOCHS = 2.0
DOCUMENTS_PER_RANGE = 2048
# Quality weights for which ranges of keys hold about as many documents (within a small factor).
SPREAD_WEIGHTS = (0.1, 0.18, 0.32, 0.56, 1.0)
SALT = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of a text's characters that are letters, blanks or plain stops.

    Null and empty texts have 1; they hold no words.
    """
    odd = F.length(F.translate(text, "abcdefghijklmnopqrstuvwxyz .,\n", ""))
    return F.greatest(F.lit(0.1), 1 - F.coalesce(odd / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def uniform(doc_id: Column, salt: str = SALT) -> Column:
    """A number in (0, 1) from the id alone, the same in every run; null ids share one."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def key_range(key: Column, ranges: int) -> Column:
    """Range of a key, 0 to ``ranges - 1``, never smaller for a larger key.

    Keys of one weight are exponential. The mean of the distribution functions of several weights
    grows wherever one of them does, so the documents of no weight between 0.1 and 1 pile up in a
    range: each holds at most some ten times its even share.
    """
    spread = sum((1 - F.exp(-w * key) for w in SPREAD_WEIGHTS), F.lit(0.0)) / len(SPREAD_WEIGHTS)
    return F.least(F.lit(ranges - 1), F.floor(spread * ranges)).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, whole: float = WHOLE, most: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row a source).

    Sources are ordered by code point, null last, and take the weights in turn. With the level L at
    which the targets min(cap, L * weight) add up to the whole, sources in the order of cap / weight
    are at their cap up to the first whose cap is not reached.
    """
    ranked = sizes.withColumn("_ix", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    shared = ranked.withColumn("_w", F.element_at(cycle, (F.col("_ix") % len(weights) + 1).cast("int"))).withColumn("_cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_ix")
    everything = Window.partitionBy()
    running = (
        shared.withColumn("_before", F.sum("_cap").over(order) - F.col("_cap"))
        .withColumn("_weight", F.sum("_w").over(everything) - F.sum("_w").over(order) + F.col("_w"))
        .withColumn("_total", whole * F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_weight"))
    )
    first_open = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_ix", "_level"))).over(everything)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(first_open * F.col("_w"), F.col("_cap")))
    return running.withColumn("target", target).select("source", "source_size", "target")


def _in_order(rows: DataFrame, per_range: int = DOCUMENTS_PER_RANGE) -> DataFrame:
    """``rows`` and ``_within``: the sizes before each in its source and range, by key, id, size and text.

    Rows are dealt by range of that whole order, so that very many rows of one id, or equal rows, are
    split as well; sums of the parts, one number each, come before the order within a part.
    """
    order = [F.col("_key"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("row_key"), F.col("_row")]
    parts = max(1, -(-rows.count() // per_range))
    dealt = cut_lineage(rows.repartitionByRange(parts, "source", "_range", *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("source", "_range", "_part").agg(F.sum("size").alias("_sum_of_part"))
    earlier = F.sum("_sum_of_part").over(Window.partitionBy("source", "_range").orderBy("_part")) - F.col("_sum_of_part")
    sums = sums.select(F.col("source").alias("_s2"), F.col("_range").alias("_r2"), F.col("_part").alias("_p2"), earlier.alias("_earlier"))
    same = F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_range") == F.col("_r2")) & (F.col("_part") == F.col("_p2"))
    within = Window.partitionBy("source", "_range", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in_part", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return summed.join(sums, same).withColumn("_within", F.col("_earlier") + F.col("_in_part")).drop("_s2", "_r2", "_p2", "_part", "_earlier", "_in_part")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    whole: float = WHOLE,
    most: float = MOST_EPOCHS,
    weight_of: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """``doc_id, row_key, source, size, source_size, target, copies, taken`` of every row.

    ``copies`` is how often the mix takes the document, ``taken`` is ``copies * size``. A source's
    taken words differ from its target by at most half the size of the document at which it is
    reached. Null texts have size 0; a null source is a source of its own. Documents without words
    are taken in complete epochs only. Rows with the same id share a key and are told apart by size and
    text, so reruns agree; equal rows are interchangeable. Counts the rows (an action) and writes sizes and keys to the shared folder.
    """
    ranges = ranges or max(1, -(-docs.count() // DOCUMENTS_PER_RANGE))
    quality = weight_of if weight_of is not None else quality_weight(F.col("text"))
    key = -F.log(uniform(F.col("doc_id"))) / quality
    rows = docs.select("doc_id", "source", row_key().alias("row_key"), word_count(F.col("text")).alias("size"), key.alias("_key"))
    # rows that equal each other in all else get an order of their own by a number that is written out
    rows = cut_lineage(rows.withColumn("_range", key_range(F.col("_key"), ranges)).withColumn("_row", F.monotonically_increasing_id()))
    summed = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    targets = source_targets(summed.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, whole, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum")
    placed = summed.withColumn("_before", before).withColumnRenamed("source", "_s")
    budgeted = targets.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = placed.join(budgeted, F.col("_s").eqNullSafe(F.col("source"))).drop("_s").withColumnRenamed("_range", "_r").withColumnRenamed("source", "_s")
    ends_here = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest"))
    plan = plan.withColumn("_state", F.when(ends_here, 1).when(F.col("_before") + F.col("_sum") <= F.col("_rest"), 2).otherwise(0))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    sure = joined.filter("_state <> 1").withColumn("_extra", F.when((F.col("_state") == 2) & (F.col("size") > 0), 1).otherwise(0))
    edge = _in_order(joined.filter("_state = 1"))
    so_far = F.col("_before") + F.col("_within")
    edge = edge.withColumn("_extra", F.when((F.col("size") > 0) & (so_far + F.col("size") / 2 <= F.col("_rest")), 1).otherwise(0)).drop("_within")
    both = sure.unionByName(edge)
    return both.withColumn("copies", F.col("_epochs") + F.col("_extra")).select(
        "doc_id", "row_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every document as often as it is taken, with the columns of ``docs``.

    Rows that agree in id, text and source are interchangeable: one of them stands for all their copies.
    """
    key, times, copy = (free_name(docs, n) for n in ("_llm_row", "_llm_copies", "_llm_copy"))
    copies = mix(docs, **options).groupBy("row_key", "source").agg(F.sum("copies").alias(times)).filter(F.col(times) > 0)
    own = lambda row: F.xxhash64(row, F.col("source"), F.col("source").isNull())
    # one key for the join and for the copies, so that texts are dealt once
    copies = copies.select(own(F.col("row_key")).alias(key), times)
    one = docs.withColumn(key, own(row_key())).join(copies, key).dropDuplicates([key])
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
