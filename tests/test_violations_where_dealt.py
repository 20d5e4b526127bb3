"""Values of discovered schemas are checked and exported where orders are dealt to."""

import pytest

from groundline.operators.review import export_reviewed
from groundline.operators.validate import validate_discovered
from groundline.plans import catalog_queries as c
from groundline.plans import inputs
from groundline.plans import review_queries as r
from groundline.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    """Shuffles of what orders and lines were dealt as."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in "".join(line for line in plan.splitlines() if "schema_id" in line)
    return plan.count("Exchange hashpartitioning") - plan.count("REPARTITION_BY_NUM")


def broken(t: Tables, submission: bool):
    return validate_discovered(
        t.notice_docs, t.notice_fields, t.notice_options, t.notice_columns, t.raw_field_values, t.raw_cell_values, submission
    )


@pytest.mark.parametrize("submission", [False, True])
def test_values_are_checked_where_orders_are(spark, monkeypatch, submission):
    monkeypatch.setattr(inputs, "TEXTS_PER_TASK", 300)
    found = (c.discovered_submission_violations if submission else c.discovered_violations)(Tables(spark, DATA))
    assert shuffles(found) == 0
    elsewhere = broken(Tables(spark, DATA), submission).select(*found.columns)
    assert found.count() > 0 and found.exceptAll(elsewhere).isEmpty() and elsewhere.exceptAll(found).isEmpty()


def test_documents_are_exported_where_orders_are(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TEXTS_PER_TASK", 300)
    found = r.exported_values(Tables(spark, DATA))
    assert shuffles(found) == 1  # of the issues, few of which there are
    t = Tables(spark, DATA)
    elsewhere = export_reviewed(t.notice_docs, broken(t, True), t.raw_field_values, t.raw_cell_values).select(*found.columns)
    assert found.count() > 0 and found.exceptAll(elsewhere).isEmpty() and elsewhere.exceptAll(found).isEmpty()
