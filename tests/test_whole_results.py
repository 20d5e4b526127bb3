"""Cases in which rows, pages or kinds of value once went missing, with results written by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from groundline.functions.text import safe_stem
from groundline.operators import catalog, responses, review, validate
from groundline.operators.evidence import match_evidence
from groundline.operators.requests import safe_schema_name
from groundline.session import ensure_checkpoint_dir
from groundline.sources import html, layout
from groundline.sources.registered import load_fields


def test_pages_with_high_and_repeated_numbers_stay(spark):
    rows = [(1, n, f"text of page {n} is long enough") for n in (49, 50, 51)] + [(2, 3, "one page that is twice here"), (2, 3, "one page that is twice here")]
    rows += [(3, n, "x" * 30) for n in range(1, 60)] + [(4, 1, "y" * 200)]
    got = {r.doc_id: r for r in layout.assemble_pages(spark.createDataFrame(rows, "doc_id long, page int, text string"), max_chars=5000).collect()}
    assert got[1].reason is None and all(f"text of page {n}" in got[1].content for n in (49, 50, 51))
    assert got[2].reason is None and got[2].content.count("twice") == 2
    assert got[3].reason == "too_many_pages" and got[3].content is None
    assert layout.assemble_pages(spark.createDataFrame([(4, 1, "y" * 200)], "doc_id long, page int, text string"), max_chars=100).first().reason == "text_limit"


def test_responses_that_are_left_out_have_a_reason(spark):
    many = json.dumps({"content": "x", "tables": [{"cells": []}] * 101})
    rows = [(1, "pdf", "no json"), (2, "pdf", '{"content": "  "}'), (3, "pdf", json.dumps({"content": "x" * 100_001})), (4, "pdf", many), (5, "pdf", '{"content": "fine"}')]
    got = layout.rejected_analysis(spark.createDataFrame(rows, "doc_id long, source_format string, body string"))
    assert {r.doc_id: r.reason for r in got.collect()} == {1: "unreadable", 2: "blank_content", 3: "content_too_long", 4: "too_many_tables"}


def test_items_keep_all_regions_and_say_what_is_lost(spark):
    square = [0, 0, 1, 0, 1, 1, 0, 1]
    body = {
        "content": "x", "pages": [{"pageNumber": 1, "width": 2, "height": 4}, {"pageNumber": 3, "width": 5, "height": 1}],
        "paragraphs": [
            {"content": "a", "boundingRegions": [{"pageNumber": 1, "polygon": square}, {"pageNumber": 3, "polygon": square}, {"pageNumber": 9, "polygon": [1, 2]}],
             "spans": [{"offset": 0, "length": 1}, {"offset": 0.5, "length": 1}, {"offset": 4, "length": -1}, {"offset": 7, "length": 0}]},
            {"content": "b", "boundingRegions": [{"pageNumber": 1}] * 101}, {"content": " "}, None, {"content": "y" * 100_001},
        ],
        "tables": [
            {"rowCount": 1, "columnCount": 1, "boundingRegions": [{"pageNumber": 3}], "cells": [{"content": "z" * 10_001}, {}, None]},
            {"rowCount": 0, "columnCount": 1, "cells": [{"content": "lost"}]},
        ],
    }
    rows = [(1, "pdf", json.dumps(body)), (2, "pdf", '{"content": "only"}'), (3, "pdf", None), (4, None, '{"content": " "}')]
    got = {(r.part, r.table_ix, r.ix): r for r in layout.read_items(spark.createDataFrame(rows, "doc_id long, source_format string, body string")).collect()}
    first = got["block", None, 0]
    assert [r.location.page_number for r in first.regions] == [1, 3, 9] and [tuple(s) for s in first.spans] == [(0, 1), (7, 0)]
    assert [tuple(r.polygon[1]) if r.polygon else None for r in first.regions] == [(0.5, 0.0), (0.2, 0.0), None] and first.loss is None
    losses = {k: (r.loss, r.kept) for k, r in got.items() if r.loss}
    assert losses == {
        ("block", None, 1): ("regions_cut", True), ("block", None, 2): ("blank", False), ("block", None, 3): ("malformed", False),
        ("block", None, 4): ("too_long", False), ("cell", 0, 0): ("content_cut", True), ("cell", 0, 2): ("malformed", False),
        ("table", 1, 1): ("no_size", False), ("cell", 1, 0): ("table_dropped", False),
    }
    assert len(got["block", None, 1].regions) == 100 and len(got["cell", 0, 0].content) == 10_000 and got["cell", 0, 1].content == ""


def test_edits_of_numbers_and_truth_values(spark):
    before = spark.createDataFrame([(1, "a", None, 1.0, None), (1, "b", None, None, True), (1, "c", "x", None, None)], "doc_id long, field_id string, v_str string, v_num double, v_bool boolean")
    edits = spark.createDataFrame([(1, 1, "set_field", "a", None, None, None, 2.0, None), (1, 2, "set_field", "b", None, None, None, None, False)], "doc_id long, seq long, op string, target_id string, row_ix int, column_id string, v_str string, v_num double, v_bool boolean")
    after = review.apply_field_edits(before, edits)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "a", None, 2.0, None), (1, "b", None, None, False), (1, "c", "x", None, None)]
    flags = {r.field_id: r.edited for r in review.edited_flags(before, after, ["doc_id", "field_id"]).collect()}
    assert flags == {"a": True, "b": True, "c": False}
    cells = spark.createDataFrame([(1, "t", 0, "n", None, 5.0), (1, "t", 0, "s", "q", None)], "doc_id long, table_id string, row_ix int, column_id string, v_str string, v_num double")
    columns = spark.createDataFrame([(1, "t", "n"), (1, "t", "s")], "doc_id long, table_id string, column_id string")
    steps = spark.createDataFrame([(1, 1, "set_cell", "t", 0, "s", "r")], "doc_id long, seq long, op string, target_id string, row_ix int, column_id string, v_str string")
    got = {(r.column_id): (r.v_str, r.v_num) for r in review.apply_table_edits(cells, steps, columns).collect()}
    assert got == {"n": (None, 5.0), "s": ("r", None)}


def test_an_unknown_template_is_reported(spark):
    docs = spark.createDataFrame([(1, "s", "known"), (2, "s", "other"), (3, None, "known")], "doc_id long, schema_id string, template_id string")
    templates = spark.createDataFrame([("s", "known")], "schema_id string, template_id string")
    got = review.unknown_templates(docs, templates).collect()
    assert sorted((r.doc_id, r.rule) for r in got) == [(2, "unknown_template"), (3, "unknown_template")]


def test_registered_fields_keep_their_fixed_columns(spark):
    fields = load_fields(spark)
    assert fields.count() == 25
    row = fields.filter("field_key = 'invoiceNumber'").first()
    assert (row.ordinal, row.label, row.kind, row.required, row.pdf_field) == (5, "Invoice number", "text", True, "invoice.invoice_number")


def test_a_cluster_session_must_name_its_folder():
    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(Session())


def test_chunks_stay_bounded_with_many_owners(spark, monkeypatch):
    monkeypatch.setattr("groundline.operators.evidence.CHUNK_ITEMS", 50)
    items = spark.range(2000).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit("field").alias("owner_kind"), F.concat(F.lit("f"), "id").alias("owner_id"), F.lit(0).cast("long").alias("item_ord"),
        F.lit("text").alias("value_type"), F.concat(F.lit("word"), "id").alias("v_str"), F.lit(None).cast("double").alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"),
    )
    blocks = spark.sql("SELECT 1L AS doc_id, 0L AS cand_pos, 'word7 and word1999' AS content, 1D AS confidence, 1 AS page_number, CAST(NULL AS STRING) AS polygon")
    found = {r.owner_id for r in match_evidence(items, blocks).collect()}
    assert {"f7", "f1999"} <= found


def test_text_behind_closing_tags_and_outside_blocks_stays(spark):
    page = "lead<div>intro <p>x &#233;&#x263A; &#xD800; &amp;#65;</p> outro</div><table><td>cell</td></table><h4>four</h4>"
    got = html.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("block_ix").collect()
    assert [(r.element, r.content) for r in got] == [
        ("body", "lead"), ("div", "intro"), ("p", "x é☺ &#xD800; &#65;"), ("div", "outro"), ("body", "cell four"),
    ]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div><p>a<p>b</div>tail", [("p", "a"), ("p", "b"), ("body", "tail")]),
        ("<ul><li>one<li>two<ul><li>in</ul>more</ul>after", [("li", "one"), ("li", "two"), ("li", "in"), ("li", "more"), ("body", "after")]),
        ("<p>a<table><tr><td><p>in<td>next</table>out", [("p", "a"), ("p", "in"), ("body", "next out")]),
        ("<div>a<br>b<img src='x'>c</p>d</div>e", [("div", "a b c"), ("div", "d"), ("body", "e")]),
        ("<h1>a<h2>b</h1>c", [("h1", "a"), ("h2", "b"), ("body", "c")]),
        ("<div><h4>a<p>b</div></div>c</p>d", [("div", "a"), ("p", "b"), ("body", "c"), ("body", "d")]),
        ("<p>a<div>b</p>c</div>d", [("p", "a"), ("div", "b"), ("div", "c"), ("body", "d")]),
        ("1 < 2 <p>x<!-- <p>no --> y<script>if (a<b) '<p>'</script>z<P CLASS=q>w", [("body", "1 < 2"), ("p", "x y z"), ("p", "w")]),
        ("a<p>b<!-- open <p>c", [("body", "a"), ("p", "b")]),
        ("a<p>b<script>open <p>c", [("body", "a"), ("p", "b")]),
        ("<!doctype html><html><head><title>T</title></head><body>b<footer>f</footer></body></html>", [("title", "T"), ("body", "b"), ("footer", "f")]),
        ("<div>a<section>b<p>c</section>d</div>", [("div", "a b"), ("p", "c"), ("div", "d")]),
        (None, []), ("", []), ("<<<<<", [("body", "<<<<<")]),
    ],
)
def test_pages_as_trees(spark, page, want):
    got = html.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("block_ix").collect()
    assert [(r.element, r.content) for r in got] == want


def test_deep_and_broken_pages_end(spark):
    pages = ["<div>" * 20_000 + "x" + "</div>" * 20_000, "<a " * 100_000, "<!--" * 50_000, "<" * 200_000, "<p>" * 50_000 + "x", "<script" * 30_000]
    rows = html.html_blocks(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()
    assert {(r.doc_id, r.element) for r in rows} == {(0, "div"), (3, "body"), (4, "p")}


def test_blocks_of_pages_are_not_shuffled(spark):
    plan = html.html_blocks(spark.createDataFrame([(1, "x")], "page_id long, html string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_reviews_evaluate_evidence_once(spark):
    from __spark_entry__ import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("given tables are not here")

    def evaluations(name):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("MapInArrow")

    once = evaluations("evidence_matches")
    assert once >= 1
    for name in ("discovered_summary", "discovered_warning_rows", "value_reviews", "table_reviews"):
        assert evaluations(name) == once


def test_nested_bodies_become_value_rows(spark):
    body = {
        "fields": {"a.b": "x", "many": ["p", 2, None], "none": [], "gone": None, "deep": {"k": 1}},
        "tables": {"items": [{"part": "P", "n": 1.5, "paid": True}, {}], "fees": [], "odd": 7},
    }
    rows = [(1, json.dumps(body)), (2, "{}"), (3, '{"fields": 1, "tables": [2]}'), (4, "[]"), (5, None)]
    parsed = responses.parse_responses(spark.createDataFrame(rows, "doc_id long, body string"))
    fields = [tuple(r) for r in responses.response_field_values(parsed).drop("v_bool").collect()]
    assert sorted(fields, key=str) == sorted([
        (1, "a.b", None, "x", None, "STRING"), (1, "many", 0, "p", None, "STRING"), (1, "many", 1, None, 2.0, "BIGINT"),
        (1, "many", 2, None, None, "VOID"), (1, "none", -1, None, None, None), (1, "gone", None, None, None, "VOID"),
        (1, "deep", None, None, None, "OBJECT<k: BIGINT>"),
    ], key=str)
    cells = [tuple(r) for r in responses.response_cell_values(parsed).drop("value_kind").collect()]
    assert sorted(cells, key=str) == sorted([
        (1, "items", 0, "part", "P", None, None), (1, "items", 0, "n", None, 1.5, None), (1, "items", 0, "paid", None, None, True),
        (1, "items", 1, None, None, None, None), (1, "fees", -1, None, None, None, None), (1, "odd", None, None, None, None, None),
    ], key=str)
    flat = responses.parse_responses(spark.createDataFrame([(1, '{"a.b": "dotted", "it\'s": 2}')], "doc_id long, body string"))
    assert {r.field_id: (r.v_str, r.v_num) for r in responses.response_values(flat).collect()} == {"a.b": ("dotted", None), "it's": (None, 2.0)}


def test_export_holds_lists_and_tables(spark):
    docs = spark.createDataFrame([(1, "notice", "A title"), (2, "notice", None), (3, "notice", "bad")], "doc_id long, document_type string, title string")
    bad = spark.createDataFrame([(3,)], "doc_id long")
    kind = "v_str string, v_num double, v_bool boolean"
    fields = [(1, "b", 1, "second", None, None), (1, "b", 0, 'first "one"', None, None), (1, "a", None, None, 2.0, None), (1, "e", -1, None, None, None), (1, "n", None, None, None, None), (3, "a", None, "x", None, None)]
    cells = [(1, "t", 10, "c", "eleventh", None, None), (1, "t", 2, "c", None, None, True), (1, "t", 2, "a", None, 1.5, None), (1, "u", -1, None, None, None, None)]
    got = review.export_reviewed(
        docs, bad, spark.createDataFrame(fields, f"doc_id long, field_id string, item_ix int, {kind}"),
        spark.createDataFrame(cells, f"doc_id long, table_id string, row_ix int, column_id string, {kind}"),
    )
    values = {r.doc_id: json.loads(r.payload)["values"] for r in got.collect()}
    assert values == {
        1: {"fields": {"a": 2, "b": ['first "one"', "second"], "e": [], "n": None}, "tables": {"t": [{"a": 1.5, "c": True}, {"c": "eleventh"}], "u": []}},
        2: {"fields": {}, "tables": {}},
    }


def test_schemas_that_differ_in_one_label_or_option_differ(spark):
    def print_of(section="S", option="O", kind="Notice", table="T"):
        schemas = spark.createDataFrame([(1, "n", kind, "en", "t")], "schema_id long, document_type string, document_type_label string, language string, title string")
        fields = spark.createDataFrame([(1, 0, 0, "s", section, "f", "F", "", "select", False, True)], "schema_id long, section_ix int, ordinal int, section_id string, section_label string, field_id string, label string, description string, value_type string, repeatable boolean, required boolean")
        columns = spark.createDataFrame([(1, 0, 0, "t", table, "c", "C", "", "text", True)], "schema_id long, table_ix int, ordinal int, table_id string, table_label string, column_id string, label string, description string, value_type string, required boolean")
        options = spark.createDataFrame([(1, "f", 0, "v", option)], "schema_id long, field_id string, option_ix int, value string, label string")
        return catalog.schema_fingerprint(schemas, fields, columns, options).first().fingerprint

    assert len({print_of(), print_of(section="X"), print_of(option="X"), print_of(kind="X"), print_of(table="X")}) == 5
    assert print_of() == print_of()


def test_long_names_that_share_a_prefix_differ(spark):
    rows = spark.createDataFrame([("x" * 100 + end,) for end in "ab"] + [("short",)], "name string")
    stems = [r[0] for r in rows.select(safe_stem(F.col("name"))).collect()]
    names = [r[0] for r in rows.select(safe_schema_name(F.col("name"))).collect()]
    assert len(set(stems)) == 3 and [len(s) for s in stems] == [80, 80, 5]
    assert len(set(names)) == 3 and [len(n) for n in names] == [56, 56, 13] and names[2] == "extract_short"


def test_merged_batches_and_schemas_without_fields(spark):
    values = spark.createDataFrame(
        [(1, "f", 0, "old", 1), (1, "f", 0, "new", 2), (1, "f", 1, "new too", 2), (1, "g", None, "only", 1), (None, "f", 0, "no id", 1)],
        "doc_id long, field_id string, item_ix int, v_str string, batch_ix int",
    )
    assert {r.v_str for r in validate.merge_batches(values).collect()} == {"new", "new too", "only", "no id"}
    given = spark.createDataFrame([(1, 1, "list", -1, None), (1, 1, "ghost", None, "x"), (2, 2, "ghost", None, "y")], "doc_id long, schema_id long, field_id string, item_ix int, v_str string")
    fields = spark.createDataFrame([(1, "list", True)], "schema_id long, field_id string, repeatable boolean")
    assert sorted((r.doc_id, r.field_id, r.item_ix) for r in validate.normalize_values(given, fields).collect()) == [(1, "ghost", None), (1, "list", None)]


def test_characters_are_decoded_once_by_name_or_number(spark):
    page = "<p>caf&eacute; &lt;b&gt; &amp;lt; &#38;gt; &#x41;&#66; it&apos;s&nbsp;5&euro; &unknown; &#0; A&B &; x&amp</p>"
    got = html.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).first().content
    assert got == "caf\u00e9 <b> &lt; &gt; AB it's 5\u20ac &unknown; &#0; A&B &; x&amp"


def test_confidence_percentiles_of_groups_and_subtotals(spark):
    rows = [("s", "pdf", "a", n / 100) for n in range(1, 101)] + [("s", "pdf", None, 0.5), ("s", None, "a", None), ("u", "pdf", "a", 1.0)]
    results = spark.createDataFrame(rows, "schema_id string, source_format string, source string, confidence double")
    got = {tuple(r) for r in review.confidence_percentiles(results, (1, 50, 95)).collect()}
    assert got == {
        ("s", "pdf", "a", 100, 1, 50, 95), ("s", "pdf", None, 1, 50, 50, 50), ("u", "pdf", "a", 1, 100, 100, 100),
        ("s", "pdf", None, 101, 2, 50, 95), ("u", "pdf", None, 1, 100, 100, 100),
        ("s", None, None, 101, 2, 50, 95), ("u", None, None, 1, 100, 100, 100), (None, None, None, 102, 2, 50, 96),
    }
    assert review.confidence_percentiles(results.limit(0)).count() == 0


def test_layout_failures_have_codes(spark):
    rows = [
        (1, 200, None, None, "succeeded"), (2, 200, None, None, "RUNNING"), (3, 202, False, False, "failed"), (4, 200, None, None, None),
        (5, 429, None, None, None), (6, 500, None, None, None), (7, 404, None, None, None), (8, None, None, None, None),
        (9, 200, True, True, "succeeded"), (10, 200, None, True, "running"), (11, 302, None, None, "succeeded"),
    ]
    log = spark.createDataFrame(rows, "request_id long, http_status int, timed_out boolean, cancelled boolean, operation_status string")
    got = {r.request_id: (r.mapped_code.removeprefix("LAYOUT_"), r.answer_status) for r in responses.classify_layout_failures(log).collect()}
    assert got == {
        3: ("FAILED", 422), 4: ("INVALID_RESPONSE", 502), 5: ("RATE_LIMITED", 503), 6: ("UNAVAILABLE", 503), 7: ("UNAVAILABLE", 502),
        8: ("UNAVAILABLE", 503), 9: ("TIMEOUT", 503), 10: ("FAILED", 499), 11: ("UNAVAILABLE", 502),
    }
