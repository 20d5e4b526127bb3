"""What keeps the cost of grounding in proportion: dealt documents, parts worked out once."""

from pyspark.sql import functions as F

from groundline.functions.dates import search_spellings
from groundline.functions.text import EMAIL_SPAN
from groundline.operators.ground_fixed import ground_fields, grounding_warnings

FIELDS = "schema_id string, ordinal int, field_key string, kind string, required boolean"


def test_documents_are_dealt_before_their_forms_are_made(spark):
    documents = spark.createDataFrame([(1, "s", "Paid on 3 March 2021 by a@b.no, late fee 12.50")], "doc_id int, schema_id string, content string")
    fields = spark.createDataFrame([("s", 1, "day", "date", True), ("s", 2, "who", "email", True), ("s", 3, "fee", "text", True)], FIELDS)
    options = spark.createDataFrame([], "schema_id string, field_key string, value string, label string")
    values = spark.createDataFrame(
        [(1, "s", "day", "2021-03-03", None), (1, "s", "who", "A@b.no", None), (1, "s", "fee", "paid late on 3 march by", None)],
        "doc_id int, schema_id string, field_key string, v_str string, v_num double",
    )
    got = ground_fields(documents, fields, options, values)
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.field_key: r.match_type for r in got.collect()} == {"day": "normalized", "who": "normalized", "fee": "none"}


def test_a_day_is_parsed_once_and_not_in_each_of_its_spellings(spark):
    day = spark.createDataFrame([("2021-03-13",), ("0000-01-06",), ("2021-02-30",), (None,)], "t string").select(search_spellings(F.col("t")).alias("s"))
    assert day._jdf.queryExecution().optimizedPlan().toString().count("02-29") <= 1
    listed = [r.s for r in day.collect()]
    assert {"2021 03 13", "13 march 2021", "mar 13 2021", "march 13th 2021", "13 03 2021", "03 13 2021"} <= set(listed[0])
    assert "january 6th 0" in listed[1] and listed[2:] == [None, None]


def test_addresses_are_found_without_giving_back_characters(spark):
    text = spark.createDataFrame([("x" * 200_000 + " desk1 @ north . example . com, a.b@c.d.e",)], "t string")
    found = text.select(F.regexp_extract_all("t", F.lit(EMAIL_SPAN), 0).alias("m")).first().m
    assert found == ["desk1 @ north . example . com", "a.b@c.d.e"]


def test_warnings_make_the_reviews_once(spark):
    rows = [
        (1, "s", 2, "b", "missing", True, False, 0.0), (1, "s", 1, "a", "missing", True, False, 0.0),
        (1, "r", 1, "c", "needs_review", True, True, 0.25), (2, "s", 1, "a", "verified", True, True, 1.0),
    ]
    reviews = spark.createDataFrame(
        rows, "doc_id int, schema_id string, ordinal int, field_key string, status string, required boolean, present boolean, confidence double"
    )
    warnings = grounding_warnings(reviews.filter("ordinal > 0"))
    assert warnings._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    got = {(r.doc_id, r.seq, r.code): list(r.field_keys) for r in warnings.collect()}
    assert got[1, 1, "REQUIRED_FIELDS_MISSING"] == ["a", "b"] and all(doc == 1 for doc, _, _ in got)
    assert {tuple(keys) for (_, _, code), keys in got.items() if code == "FIELDS_REQUIRE_REVIEW"} == {("c",)}
