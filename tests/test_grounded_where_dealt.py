"""Registered values meet their documents where orders are dealt to; only odd texts go to Python and are shuffled."""

import pytest
from pyspark.sql import functions as F

from groundline.functions.text import normalize_minimal, normalize_search
from groundline.functions.unicode import strange
from groundline.operators import ground_fixed as g
from groundline.plans import fixed_queries as q
from groundline.plans import inputs
from groundline.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


def test_nothing_but_orders_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TEXTS_PER_TASK", 300)
    reviewed = q.ground_fields(Tables(spark, DATA))
    plan = reviewed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 3
    t = Tables(spark, DATA)
    elsewhere = g.ground_fields(t.order_docs, t.order_schema, t.order_options, t.order_values).select(*reviewed.columns)
    assert reviewed.count() > 0 and reviewed.exceptAll(elsewhere).isEmpty() and elsewhere.exceptAll(reviewed).isEmpty()


def test_tables_derived_before_are_dealt_too(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TEXTS_PER_TASK", 300)
    t = Tables(spark, DATA)
    assert t.order_docs.count() > 300
    plan = q.reviews(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 3


def test_strange_texts_are_told(spark):
    texts = ["plain", "café Øre", "ﬁne", "fullＡ", "x́", "中", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    told = {r.t: r.odd for r in rows.select("t", strange(F.col("t")).alias("odd")).collect()}
    assert told == {t: t in ("ﬁne", "fullＡ", "x́") for t in texts}
    same = rows.filter(~strange(F.col("t"))).select(
        (normalize_minimal(F.col("t")) == normalize_minimal(F.col("t"), plain=True)).alias("m"),
        (normalize_search(F.col("t")) == normalize_search(F.col("t"), plain=True)).alias("s"),
    )
    assert {tuple(r) for r in same.collect()} == {(True, True), (None, None)}


@pytest.mark.parametrize("label", ["Open", "Ｏpen"])
def test_documents_with_odd_texts_keep_their_reviews(spark, label):
    make = spark.createDataFrame
    texts = ["ﬁne print", "fine print", "café desk", "state Open", "nothing"]
    documents = make([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, schema_id string, content string")
    fields = make([("s", 1, "a", "text", True), ("s", 2, "c", "select", False)],
                  "schema_id string, ordinal int, field_key string, kind string, required boolean")
    options = make([("s", "c", "O", label)], "schema_id string, field_key string, value string, label string")
    values = make([(0, "s", "a", "fine print", None), (1, "s", "a", "ｆine print", None), (2, "s", "a", "CAFE desk", None),
                   (3, "s", "c", "O", None)], "doc_id long, schema_id string, field_key string, v_str string, v_num double")
    tables = (documents, fields, options, values)
    found = {(r.doc_id, r.field_key): r.match_type for r in g.ground_fields(*tables, dealt=True).collect()}
    assert found == {(r.doc_id, r.field_key): r.match_type for r in g.ground_fields(*tables).collect()}
    assert len(found) == 10 and found[0, "a"] == found[1, "a"] == found[3, "c"] == "exact" and found[2, "a"] == "normalized"
