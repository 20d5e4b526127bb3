"""Audits read every input once and report what the rules say, also for repeated and null rows."""

import os

import pytest
from pyspark.sql import functions as F

from groundline.operators.audit_results import audit_discovered_result, audit_extraction_result
from groundline.operators.catalog import audit_discovered, audit_registered
from groundline.operators.rules import at_most, breach, child, claims, parent, repeat_rows, settle
from groundline.plans.registry import Tables

DATA = "/root/testdata/sf0.001"
AUDITS = {
    audit_registered: ("forms", "form_fields", "form_options", "form_templates"),
    audit_discovered: (
        "rough_schemas", "rough_sections", "rough_fields", "rough_options", "rough_tables", "rough_columns",
    ),
    audit_extraction_result: (
        "order_docs", "order_schema", "order_values", "claimed_reviews", "claimed_meta", "claimed_warning_keys",
    ),
    audit_discovered_result: (
        "notice_docs", "notice_fields", "notice_columns", "notice_field_values", "notice_cell_values",
        "claimed_value_reviews", "claimed_table_reviews", "claimed_results", "claimed_warning_ids",
    ),
}


@pytest.mark.parametrize("audit", AUDITS, ids=lambda a: a.__name__)
def test_one_scan_per_input(spark, tmp_path, audit):
    tables, stored = Tables(spark, DATA), []
    for name in AUDITS[audit]:
        frame = getattr(tables, name)
        frame.limit(5).write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    audited = audit(*stored)
    assert audited._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == len(stored)
    assert {os.path.basename(os.path.dirname(file)) for file in audited.inputFiles()} == set(AUDITS[audit])


def test_parents_limits_and_repeats(spark):
    shelves = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (None, "a")], "schema_id int, shelf string")
    books = spark.createDataFrame(
        [(1, None, "x"), (2, "b", "x"), (2, "b", "x"), (2, "b", ""), (None, "a", "x")],
        "schema_id int, shelf string, title string",
    )
    shelf, title = F.col("shelf"), F.col("title")
    reported = settle([
        claims(shelves, parent("bare", shelf, shelf)),
        claims(
            books,
            breach("untitled", shelf, title == ""),
            at_most("crowded", shelf, 2, shelf),
            at_most("twice", shelf, 1, shelf, title),
            child("bare", shelf, shelf),
        ),
    ])
    assert sorted(map(tuple, reported.collect()), key=str) == sorted([
        (1, "a", "bare"), (1, "a", "bare"), (1, None, "bare"), (None, "a", "bare"),
        (2, "b", "untitled"), (2, "b", "crowded"), (2, "b", "twice"),
    ], key=str)


def test_rows_are_repeated_without_long_arrays(spark):
    rows = spark.createDataFrame([("a", 25_001), ("b", 1), ("c", 0), ("d", None)], "name string, n long")
    counted = repeat_rows(rows, F.col("n")).groupBy("name").count()
    assert dict(map(tuple, counted.collect())) == {"a": 25_001, "b": 1}


def test_stored_results_with_repeated_and_null_rows(spark):
    documents = spark.createDataFrame([(1, "s"), (1, "s"), (2, None), (3, "s")], "doc_id int, schema_id string")
    fields = spark.createDataFrame([("s", 1, "f", "text", True)], "schema_id string, ordinal int, field_key string, kind string, required boolean")
    values = spark.createDataFrame(
        [(1, "s", "f", "v", None), (1, "s", "f", None, None)],
        "doc_id int, schema_id string, field_key string, v_str string, v_num double",
    )
    reviews = spark.createDataFrame(
        [(1, "s", "f", "verified", "exact", 1.0), (9, "s", "f", "verified", "none", 1.0), (None, None, None, None, None, None)],
        "doc_id int, schema_id string, field_key string, status string, match_type string, confidence double",
    )
    meta = spark.createDataFrame(
        [(1, 4, 0, 0, 0, 0.5, False), (3, 0, 0, 0, 0, 0.0, None)],
        "doc_id int, verified_fields long, needs_review_fields long, missing_fields long, required_missing_fields long,"
        " confidence double, review_required boolean",
    )
    keys = spark.createDataFrame([(1, "f"), (1, "g"), (2, "f"), (3, None), (8, "g")], "doc_id int, field_key string")
    reported = audit_extraction_result(documents, fields, values, reviews, meta, keys)
    assert sorted(map(tuple, reported.collect()), key=str) == sorted([
        (9, "review_state", "f"), (None, "review_state", None),
        # two document rows, one value that is present and one that is not
        (1, "null_not_missing", "f"), (1, "null_not_missing", "f"),
        (1, "warning_key", "g"), (1, "warning_key", "g"), (2, "warning_key", "f"), (3, "warning_key", None),
        # four verified rows, half of them with a value: confidence 0.5, below what passes unseen
        (3, "review_absent", "f"), (1, "meta_mismatch", "review_required"),
    ], key=str)


def test_empty_tables_break_no_rule(spark):
    tables = Tables(spark, DATA)
    for audit, names in AUDITS.items():
        assert audit(*[getattr(tables, name).limit(0) for name in names]).count() == 0


def test_claims_are_hashed_and_shuffled_once(spark):
    tables = Tables(spark, DATA)
    plan = audit_registered(*[getattr(tables, name) for name in AUDITS[audit_registered]])._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2
    plan = audit_discovered(*[getattr(tables, name) for name in AUDITS[audit_discovered]])._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan
