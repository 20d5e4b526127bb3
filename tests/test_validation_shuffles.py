"""Checks of discovered values: options meet their fields before documents do, only list items are counted."""

from groundline.operators.validate import validate_discovered, violation_summary


def test_options_are_not_joined_beside_the_values(spark):
    make = spark.createDataFrame
    documents = make([(d, 7) for d in (1, 2)], "doc_id int, schema_id int")
    fields = make([(7, "pick", "select", False, True), (7, "many", "text", True, False)],
                  "schema_id int, field_id string, value_type string, repeatable boolean, required boolean")
    options = make([(7, "pick", "a"), (7, "pick", "b")], "schema_id int, field_id string, value string")
    columns = make([], "schema_id int, table_id string, column_id string, value_type string, required boolean")
    values = make(
        [(1, 7, "pick", None, "a"), (2, 7, "pick", None, "c"), (2, 7, "other", None, "x"), (1, 7, "many", -1, None)]
        + [(2, 7, "many", i, "v") for i in range(101)],
        "doc_id int, schema_id int, field_id string, item_ix int, v_str string",
    ).selectExpr("*", "cast(null as double) v_num", "cast(null as boolean) v_bool")
    cells = make([], "doc_id int, schema_id int, table_id string, row_ix int, column_id string, v_str string, v_num double, v_bool boolean")
    broken = validate_discovered(documents, fields, options, columns, values, cells, True)
    plan = broken._jdf.queryExecution().optimizedPlan().toString()
    # The full join of fields and values is the last one: nothing is joined to its rows.
    depth = {kind: min(line.index("Join") for line in plan.splitlines() if f"Join {kind}" in line) for kind in ("FullOuter", "LeftOuter")}
    assert depth["FullOuter"] < depth["LeftOuter"] and "(item_ix" in plan
    assert {tuple(r) for r in broken.collect()} == {
        (1, "fields.many", "too_small"), (2, "fields.pick", "invalid_value"), (2, "fields.other", "unrecognized_keys"), (2, "fields.many", "too_big")
    }


def test_digest_reads_its_issues_once(spark):
    rows = [(1, f"f{i:04d}", i % 40, "custom") for i in range(300)] + [(2, "a b", 1, "x"), (2, "c", 2, "y"), (2, "c", 2, "y")]
    issues = spark.createDataFrame(rows, "doc_id int, path string, place int, code string")
    digest = violation_summary(issues)
    plan = digest._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ") == 1 and "Join" not in plan
    first = [p for _, p in sorted((place, path) for d, path, place, _ in rows if d == 1)][:8]
    assert {r.doc_id: tuple(r)[1:] for r in digest.collect()} == {
        1: (300, ",".join(["custom"] * 8), "|".join(first), first[0], "custom"),
        2: (3, "x,y,y", "c|c", "a b", "x"),
    }
