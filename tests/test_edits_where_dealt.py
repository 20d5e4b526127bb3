"""Edits are replayed where orders are dealt to: cells stay, only edits that took effect are shuffled."""

from groundline.operators.table_replay import apply_table_edits
from groundline.plans import inputs
from groundline.plans import review_queries as r
from groundline.plans.registry import Tables

DATA = "/root/testdata/sf0.001"
CELLS = "doc_id long, table_id string, row_ix int, column_id string, v_str string"
EDITS = "doc_id long, target_id string, seq long, op string, row_ix int, column_id string, v_str string"


def test_cells_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TEXTS_PER_TASK", 300)
    edited = r.table_edits(Tables(spark, DATA))
    plan = edited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 5 and "ENSURE_REQUIREMENTS" not in plan
    assert "Join" not in plan.replace("BroadcastHashJoin [o_custkey", "")
    monkeypatch.setattr(inputs, "TEXTS_PER_TASK", 1 << 40)
    alone = r.table_edits(Tables(spark, DATA))
    assert edited.count() > 0 and edited.exceptAll(alone).isEmpty() and alone.exceptAll(edited).isEmpty()


def test_cells_are_shuffled_once_where_they_were_not_dealt(spark):
    cells = spark.createDataFrame([(1, "t", 0, "a", "x"), (1, "t", 1, "a", "y"), (None, "t", 0, "a", "z")], CELLS)
    edits = spark.createDataFrame(
        [(1, "t", 1, "add_row", None, None, None), (1, "t", 2, "remove_row", 0, None, None), (1, "t", 3, "set_cell", 0, "a", "new"),
         (None, "t", 1, "add_row", None, None, None), (2, "t", 1, "add_row", None, None, None)], EDITS)
    columns = spark.createDataFrame([(1, "t", "a"), (1, "t", "b"), (None, "t", "c"), (3, "t", "d")], "doc_id long, table_id string, column_id string")
    edited = apply_table_edits(cells, edits, columns)
    plan = edited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    after = plan[: plan.index("REPARTITION_BY_COL")]
    assert after.count("Exchange") == 1
    assert {(x.doc_id, x.row_ix, x.column_id, x.v_str) for x in edited.collect()} == {
        (1, 0, "a", "new"), (1, 1, "a", None), (1, 1, "b", None), (None, 0, "a", "z"), (None, 1, "c", None)
    }
