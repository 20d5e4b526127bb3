"""Edits of review tables against a plain replay of each table as a list of rows."""

import random
import time

from pyspark import cloudpickle

from groundline.operators import table_replay
from groundline.operators.table_replay import apply_table_edits, replay

CELLS = "doc_id int, table_id string, row_ix int, column_id string, v_str string"
EDITS = "doc_id int, target_id string, seq long, op string, row_ix int, column_id string, v_str string"
COLUMNS = "doc_id int, table_id string, column_id string"


def by_hand(rows, edits, columns):
    for _, op, place, column, value in sorted(edits):
        if op == "add_row":
            rows.append(dict.fromkeys(columns))
        elif place is not None and 0 <= place < len(rows):
            if op == "remove_row":
                del rows[place]
            else:
                rows[place][column] = value
    return {(place, column, value) for place, row in enumerate(rows) for column, value in row.items()}


def test_random_edits_equal_the_plain_replay(spark):
    pick = random.Random(3)
    cells, edits, columns, want = [], [], [], set()
    for doc in range(12):
        # Row numbers with gaps; one table has no rows, one no edits, one no columns.
        numbers = sorted(pick.sample(range(40), 0 if doc == 3 else 9))
        rows = [{c: f"{n}{c}" for c in "ab" if pick.random() < 0.8 or c == "a"} for n in numbers]
        own = [] if doc == 5 else ["a", "b", "c"]
        steps = []
        for seq in range(0 if doc == 4 else 60):
            op = pick.choice(["add_row", "remove_row", "set_cell", "set_cell"])
            steps.append((seq, op, pick.choice([*range(-1, 14), None]), pick.choice("abc"), f"e{seq}"))
        cells += [(doc, "t", n, c, v) for n, row in zip(numbers, rows) for c, v in row.items()]
        edits += [(doc, "t", *step) for step in pick.sample(steps, len(steps))]
        columns += [(doc, "t", c) for c in own]
        want |= {(doc, *found) for found in by_hand([dict(row) for row in rows], steps, own)}
    got = apply_table_edits(
        spark.createDataFrame(cells, CELLS), spark.createDataFrame(edits, EDITS), spark.createDataFrame(columns, COLUMNS)
    ).select("doc_id", "row_ix", "column_id", "v_str").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_null_ids_and_rows_and_empty_tables(spark):
    cells = spark.createDataFrame([(None, "t", None, "a", "x"), (None, "t", 4, "a", "y")], CELLS)
    edits = spark.createDataFrame([(None, "t", 1, "remove_row", 0, None, None), (None, "t", 2, "set_cell", 0, None, "z")], EDITS)
    columns = spark.createDataFrame([], COLUMNS)
    got = apply_table_edits(cells, edits, columns).select("doc_id", "row_ix", "column_id", "v_str").collect()
    assert [tuple(r) for r in got] == [(None, 0, "a", "y")]
    assert apply_table_edits(cells.limit(0), edits.limit(0), columns).count() == 0
    assert apply_table_edits(cells, edits.limit(0), columns).count() == 2


def test_a_hundred_thousand_edits_of_one_table():
    pick = random.Random(4)
    ops = pick.choices(["add_row", "remove_row", "set_cell"], [3, 2, 5], k=100_000)
    places = [pick.randrange(5_000) for _ in ops]
    start = time.perf_counter()
    slots = replay(ops, places, 5_000)
    assert time.perf_counter() - start < 20
    rows, added, want = list(range(5_000)), 5_000, []
    for op, place in zip(ops, places):
        if op == "add_row":
            rows.append(added)
            want.append(added)
            added += 1
        elif place < len(rows):
            want.append(rows.pop(place) if op == "remove_row" else rows[place])
        else:
            want.append(-1)
    assert slots == want


def test_many_small_tables_share_a_task_without_a_group_each(spark):
    """Tables are walked as a stream of sorted rows that crosses batches; the function needs no copy of the package."""
    tables = 3_000
    cells = spark.range(tables).selectExpr("cast(id as int) doc_id", "'t' table_id", "explode(array(0, 1)) row_ix", "'a' column_id", "'x' v_str")
    edits = spark.range(tables).selectExpr("cast(id as int) doc_id", "'t' target_id", "explode(array(1L, 2L, 3L)) seq").selectExpr(
        "*", "element_at(array('add_row', 'remove_row', 'set_cell'), cast(seq as int)) op",
        "if(seq = 2, doc_id % 3, 1) row_ix", "'a' column_id", "'e' v_str",
    )
    columns = spark.range(tables).selectExpr("cast(id as int) doc_id", "'t' table_id", "'a' column_id")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = apply_table_edits(cells, edits, columns)
        assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().executedPlan().toString()
        rows = {(r.doc_id, r.row_ix): r.v_str for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert rows == {(doc, place): ("x", "e")[place] for doc in range(tables) for place in (0, 1)}
    assert table_replay.__name__ in cloudpickle.list_registry_pickle_by_value()
