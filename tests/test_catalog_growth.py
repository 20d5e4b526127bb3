"""Catalogs of many rows: none is broadcast on an estimate, and one file's rows are dealt over tasks."""

import pytest

from groundline.plans import catalog_queries as q
from groundline.plans import inputs
from groundline.plans.registry import Tables

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query", [q.batch_packing, q.template_mapping_audit, q.contract_json, q.public_catalog], ids=lambda f: f.__name__)
def test_catalogs_are_joined_without_broadcast(spark, query):
    plan = query(Tables(spark, DATA))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_customers_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 100)
    customers = Tables(spark, DATA).given("customer")
    tables = Tables(spark, DATA)
    fields = tables.wide_fields
    assert fields.rdd.getNumPartitions() == -(-customers.count() // 100)
    assert fields.count() == 52 * customers.count()
