"""Rows that are generated from small ones are never sent whole through the driver."""

import pytest

from groundline.plans import catalog_queries as q
from groundline.plans import discovered_queries as d
from groundline.plans.registry import Tables

DATA = "/root/testdata/sf0.01"


def largest_broadcast(df) -> int:
    """Bytes of the largest broadcast that adaptive execution came to."""
    df._jdf.queryExecution().toRdd().count()
    found, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(node.plan())
        elif name == "BroadcastExchange":
            found.append(node.metrics().apply("dataSize").value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_schemas_made_of_orders_are_not_broadcast(spark):
    # The map of customers that orders meet begins with a page of 1 MB.
    assert largest_broadcast(q.discovered_result_audit(Tables(spark, DATA))) < 4_000_000


@pytest.mark.parametrize("name", ["discovered_summary", "discovered_warning_rows", "evidence_anchors", "table_reviews", "value_reviews"])
def test_evidence_is_reviewed_without_broadcasts(spark, name):
    assert largest_broadcast(getattr(d, name)(Tables(spark, DATA))) < 4_000_000
