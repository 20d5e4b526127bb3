"""Schemas made of orders are made where their order is dealt to: nothing of them is shuffled, none is broadcast."""

from groundline.plans import catalog_queries as q
from groundline.plans import inputs
from groundline.plans.registry import Tables

DATA = "/root/testdata/sf0.01"


def test_fingerprints_are_made_where_orders_are(spark, monkeypatch):
    monkeypatch.setattr(inputs, "ORDERS_PER_TASK", 1_000)
    tables = Tables(spark, DATA)
    orders = tables.given("orders").count()
    prints = q.schema_fingerprint(tables)
    plan = prints._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 4 == plan.count("Exchange hashpartitioning")
    assert plan.count("SortMergeJoin") == 3
    assert f", {-(-orders // 1_000)}), REPARTITION_BY_NUM" in plan
    assert prints.count() == orders


def test_results_are_audited_where_orders_are(spark, monkeypatch):
    monkeypatch.setattr(inputs, "ORDERS_PER_TASK", 1_000)
    audited = q.extraction_result_audit(Tables(spark, DATA))
    plan = audited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    shared = Tables(spark, DATA)
    names = ("order_docs", "order_schema", "order_values", "claimed_reviews", "claimed_meta", "claimed_warning_keys")
    elsewhere = q.audit_extraction_result(*[getattr(shared, name) for name in names])
    assert audited.count() > 0 and audited.exceptAll(elsewhere).isEmpty() and elsewhere.exceptAll(audited).isEmpty()


def test_discovered_results_meet_their_schemas_where_orders_are(spark, monkeypatch):
    monkeypatch.setattr(inputs, "ORDERS_PER_TASK", 1_000)
    shared = Tables(spark, "/root/testdata/sf0.001")
    names = ("notice_docs", "notice_fields", "notice_columns", "notice_field_values", "notice_cell_values",
             "claimed_value_reviews", "claimed_table_reviews", "claimed_results", "claimed_warning_ids")
    elsewhere = q.audit_discovered_result(*[getattr(shared, name) for name in names])
    shuffles = elsewhere._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")
    audited = q.discovered_result_audit(Tables(spark, "/root/testdata/sf0.001"))
    plan = audited._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Exchange hashpartitioning(l_orderkey" in plan
    assert plan.count("Exchange hashpartitioning") - plan.count("REPARTITION_BY_NUM") < shuffles
    assert audited.count() > 0 and audited.exceptAll(elsewhere).isEmpty() and elsewhere.exceptAll(audited).isEmpty()
