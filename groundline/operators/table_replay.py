"""Replay of the edits of review tables, whose rows are addressed by their place at the time of the edit.

Every row a table ever has gets a slot: its own rows first, added ones behind them. Which slot is at
a place is answered by a tree of counts over the slots, so an edit costs the logarithm of the rows.
Only the edits of a table meet in one task, which walks through its sorted tables as a stream; the cells stay in Spark
and are matched by slot.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Executors need no copy of this package: its vectorised functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["doc_id", "table_id"]
VALUE = ["v_str", "v_num", "v_bool"]


def typed(rows: DataFrame) -> Column:
    """The value of a row; kinds of value that a table has no column for are null."""
    return F.struct(
        *(
            F.col(name).cast(kind).alias(name) if name in rows.columns else F.lit(None).cast(kind).alias(name)
            for name, kind in (("v_str", "string"), ("v_num", "double"), ("v_bool", "boolean"))
        )
    )


class PlaceTree:
    """Counts of present slots, by powers of two, to find the slot at a place, to empty it and to add one."""

    def __init__(self, rows: int) -> None:
        at = np.arange(1, rows + 1)
        self.counts = [0, *(at & -at).tolist()]
        self.present = self.size = rows

    def add(self) -> int:
        """A present slot behind the others."""
        self.size += 1
        at, count, step = self.size, 1, 1
        while step < at & -at:
            count += self.counts[at - step]
            step <<= 1
        self.counts.append(count)
        self.present += 1
        return at - 1

    def slot_at(self, place: int) -> int:
        at, left, step = 0, place, 1 << self.size.bit_length() >> 1
        while step:
            ahead = at + step
            if ahead <= self.size and self.counts[ahead] <= left:
                at, left = ahead, left - self.counts[ahead]
            step >>= 1
        return at

    def remove(self, slot: int) -> None:
        at = slot + 1
        while at <= self.size:
            self.counts[at] -= 1
            at += at & -at
        self.present -= 1


def _slot(tree: PlaceTree, op: str, place: int | None) -> int:
    """The slot an edit touches, which it also adds or empties; -1 where there is no row at its place."""
    if op == "add_row":
        return tree.add()
    if place is None or not 0 <= place < tree.present:
        return -1
    slot = tree.slot_at(place)
    if op == "remove_row":
        tree.remove(slot)
    return slot


def replay(ops: list[str], places: list[int | None], rows: int) -> list[int]:
    """The slot each edit touches, in order; -1 where there is no row at its place."""
    tree = PlaceTree(rows)
    return [_slot(tree, op, place) for op, place in zip(ops, places)]


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots and turns of sorted edits, table by table; a row without ``op`` opens a table and tells its rows and columns."""
    table, tree, turn, columns = None, PlaceTree(0), 0, []
    for edits in batches:
        slots, turns, blanks = [], [], []
        keys = zip(*(edits[name].to_pylist() for name in KEY))
        for key, op, place, blank in zip(keys, *(edits[name].to_pylist() for name in ("op", "row_ix", "blank"))):
            if key != table:
                table, tree, turn, columns = key, PlaceTree(place if op is None else 0), 0, blank or []
            slots.append(-1 if op is None else _slot(tree, op, place))
            turns.append(turn)
            blanks.append(columns if op == "add_row" else None)
            turn += op is not None
        out = edits.select([*KEY, "op", "column_id", *VALUE])
        out = out.append_column("slot", pa.array(slots, pa.int64()))
        out = out.append_column("turn", pa.array(turns, pa.int64()))
        out = out.append_column("blank", pa.array(blanks, pa.list_(pa.string())))
        yield out.filter(pc.greater_equal(out["slot"], 0))


def apply_table_edits(cells: DataFrame, edits: DataFrame, columns: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cell, add-row and remove-row edits of every table, in the order of ``seq``.

    ``cells`` has ``doc_id, table_id, row_ix, column_id`` and values, ``edits`` ``doc_id, target_id, seq, op,
    row_ix, column_id`` and values, ``columns`` the column ids an added row is blank in. Returns
    ``doc_id, table_id, row_ix, column_id, v_str, v_num, v_bool``; rows are numbered from 0 without gaps, those of
    tables without edits too. Edits at places without a row, or with a null place, change nothing; a cell set
    without a column id is left out. Of edits with one ``seq`` the smaller operation, place and value come first;
    of repeated cells the largest value stays. Null ids form a table of their own. All three may have been dealt over
    ``tasks`` by document; then cells stay where they are, and only the edits that took effect are shuffled.
    """
    # Bare of the name of its table, the key of a first part tells Spark that a union leaves rows where they were dealt to.
    cells = cells.withColumn("doc_id", F.col("doc_id").alias("doc_id"))
    value = [F.col("v")[name].alias(name) for name in VALUE]
    rank = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("row_ix")).cast("bigint") - 1
    base = cells.select(*KEY, "row_ix", "column_id", typed(cells).alias("v")).select(
        *KEY, rank.alias("slot"), "column_id", *value, F.lit(-1).cast("bigint").alias("turn"), F.lit(False).alias("gone")
    )
    given = cells.select(*KEY, "row_ix", F.col("row_ix").isNull().alias("unnumbered"), F.lit(None).cast("string").alias("column_id"))
    rows = given.unionByName(columns.select(
        *KEY, F.lit(None).cast(cells.schema["row_ix"].dataType).alias("row_ix"), F.lit(False).alias("unnumbered"), "column_id"
    )).groupBy(*KEY).agg(
        (F.count_distinct("row_ix") + F.max(F.col("unnumbered").cast("int"))).alias("row_ix"), F.collect_set("column_id").alias("blank")
    )
    steps = edits.filter(F.col("op").isin("set_cell", "add_row", "remove_row")).select(
        "doc_id", F.col("target_id").alias("table_id"), "seq", "op", F.col("row_ix").cast("bigint").alias("row_ix"),
        "column_id", typed(edits).alias("v"),
    ).select(*KEY, "seq", "op", "row_ix", "column_id", *value)
    # The rows a table has come first, then its edits; NaN before other numbers.
    number = [F.col("v_num").isNotNull(), ~F.isnan("v_num"), "v_num"]
    order = [F.col("op").isNotNull(), "seq", "op", "row_ix", "column_id", "v_str", *number, "v_bool"]
    # The number brings the rows of a table together, unless they were dealt so, and sorts them.
    numbered = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    sized = rows.unionByName(steps, allowMissingColumns=True).withColumn("number", numbered).sortWithinPartitions(*KEY, *order)
    kinds = {field.name: field.dataType.simpleString() for field in sized.schema.fields}
    schema = ", ".join(f"{name} {kinds[name]}" for name in (*KEY, "op", "column_id", *VALUE)) + ", slot long, turn long, blank array<string>"
    touched = sized.mapInArrow(_replayed, schema)
    touched = touched.repartition(tasks, "doc_id") if tasks else touched
    adds, sets = F.col("op") == "add_row", F.col("op") == "set_cell"
    # An added row is one marker without a column and a blank cell in each column.
    own = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("blank", F.array().cast("array<string>")))
    met = touched.select("*", F.explode(
        F.when(adds, own).when(sets, F.array("column_id")).otherwise(F.array(F.lit(None).cast("string")))
    ).alias("column")).filter(~sets | F.col("column").isNotNull())
    changes = met.select(
        *KEY, "slot", F.col("column").alias("column_id"), *[F.when(sets, F.col(name)).alias(name) for name in VALUE],
        F.when(sets, F.col("turn")).otherwise(-1).alias("turn"), (F.col("op") == "remove_row").alias("gone"),
    )
    every = base.unionByName(changes)
    # By table at once, as its places are told in one task in the end.
    every = every if tasks else every.repartition(*KEY)
    latest = every.groupBy(*KEY, "slot", "column_id").agg(
        F.max(F.struct("turn", *VALUE)).alias("latest"), F.max("gone").alias("gone")
    )
    removed = F.max("gone").over(Window.partitionBy(*KEY, "slot"))
    place = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("slot")) - 1
    kept = latest.withColumn("removed", removed).filter(~F.col("removed"))
    return kept.withColumn("place", place).filter(F.col("column_id").isNotNull()).select(
        *KEY, F.col("place").cast("int").alias("row_ix"), "column_id", *[F.col("latest")[name].alias(name) for name in VALUE]
    )
