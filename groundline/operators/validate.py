"""Closed-world validation of value tables against their schemas.

A validator returns one row per violation: the document, the path and the issue
code. A document with no row is valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.dates import is_iso_date
from groundline.functions.text import is_blank, is_email, trim_all

# Bounds of a discovered value set.
MAX_VALUE_CHARS = {"identifier": 500, "phone": 100, "email": 254}
MAX_TEXT_CHARS = 10_000
MAX_REPEATS = 100
MAX_ROWS = 500
MAX_ISSUES = 8
MAX_PATH = 160
# Groups that a document's issues are first cut in.
ISSUE_GROUPS = 16


def _finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def _option_sets(options: DataFrame, key: str) -> DataFrame:
    """Each field's allowed values; a field has at most a hundred options."""
    return options.groupBy("schema_id", key).agg(F.collect_set("value").alias("allowed"))


def _keyed(
    documents: DataFrame, fields: DataFrame, options: DataFrame, values: DataFrame
) -> DataFrame:
    """Fields and values side by side, with what only one of the two sides has."""
    catalog = fields.select("schema_id", "ordinal", "field_key", "kind", "required").join(
        _option_sets(options, "field_key"), ["schema_id", "field_key"], "left"
    )
    asked = documents.select("doc_id", "schema_id").join(catalog, "schema_id")
    given = values.select(
        "doc_id", "schema_id", "field_key", "v_str", "v_num", F.lit(True).alias("given")
    )
    return asked.join(given, ["doc_id", "schema_id", "field_key"], "full")


def _typed_issue(kind: Column, missing_blank: Column | None = None) -> Column:
    """The issue of a non-null value under its field kind, or null."""
    text, number = F.col("v_str"), F.col("v_num")
    numeric = kind.isin("number", "currency")
    return (
        F.when(numeric & ~_finite(number), "invalid_type")
        .when(~numeric & text.isNull(), "invalid_type")
        .when((kind == "email") & ~is_email(text), "invalid_format")
        .when((kind == "date") & ~is_iso_date(text), "invalid_format")
        .when((kind == "select") & ~F.array_contains(F.coalesce("allowed", F.array().cast("array<string>")), text), "invalid_value")
    )


def validate_extraction(
    documents: DataFrame, fields: DataFrame, options: DataFrame, values: DataFrame
) -> DataFrame:
    """Registered schemas: every key present, none extra, null allowed, otherwise typed."""
    null_value = F.col("v_str").isNull() & F.col("v_num").isNull()
    issue = (
        F.when(F.col("kind").isNull(), "unrecognized_keys")
        .when(F.col("given").isNull(), "invalid_type")
        .when(null_value, None)
        .otherwise(_typed_issue(F.col("kind")))
    )
    rows = _keyed(documents, fields, options, values).withColumn("code", issue)
    return rows.filter(F.col("code").isNotNull()).select(
        "doc_id", F.col("field_key").alias("path"), F.coalesce("ordinal", F.lit(10_000)).alias("place"),
        "code",
    )


def validate_submission(
    documents: DataFrame, fields: DataFrame, options: DataFrame, values: DataFrame
) -> DataFrame:
    """Reviewed values: required ones present and non-blank, optional ones may be left out."""
    kind, text, number = F.col("kind"), F.col("v_str"), F.col("v_num")
    plain = kind.isin("text", "textarea", "phone")
    absent = text.isNull() & number.isNull()
    typed = _typed_issue(kind)
    # An optional address, day or choice may also be empty; other failures are of the union.
    optional_typed = (
        F.when(plain | kind.isin("number", "currency"), typed)
        .when(text == "", None)
        .when(typed.isNotNull(), "invalid_union")
    )
    issue = (
        F.when(kind.isNull(), "unrecognized_keys")
        .when(F.col("required") & absent, "invalid_type")
        .when(absent, None)
        .when(F.col("required") & plain & text.isNotNull() & is_blank(text), "custom")
        .when(F.col("required"), typed)
        .otherwise(optional_typed)
    )
    rows = _keyed(documents, fields, options, values).withColumn("code", issue)
    return rows.filter(F.col("code").isNotNull()).select(
        "doc_id", F.col("field_key").alias("path"), F.coalesce("ordinal", F.lit(10_000)).alias("place"),
        "code",
    )


def validate_envelope(
    submissions: DataFrame, definitions: DataFrame, templates: DataFrame
) -> DataFrame:
    """Submissions whose schema or template name is malformed or not registered."""
    schema, template = trim_all(F.col("schema_id")), trim_all(F.col("template_id"))
    known = definitions.select(F.col("schema_id").alias("known_schema"))
    mapped = templates.select(
            F.col("schema_id").alias("of_schema"), F.col("template_id").alias("known_template")
        )
    rows = submissions.select("doc_id", schema.alias("s"), template.alias("t"))
    rows = rows.join(known, F.col("s") == F.col("known_schema"), "left").join(
        mapped, (F.col("s") == F.col("of_schema")) & (F.col("t") == F.col("known_template")), "left"
    )
    issue = (
        F.when(F.least(F.length("s"), F.length("t")) < 1, "too_small")
        .when(F.greatest(F.length("s"), F.length("t")) > 100, "too_big")
        .when(F.col("known_schema").isNull(), "unknown_schema")
        .when(F.col("known_template").isNull(), "unknown_template")
    )
    return rows.select("doc_id", issue.alias("code")).filter(F.col("code").isNotNull())


def _scalar_issue() -> Column:
    """The issue of one non-null discovered value under its type, or null."""
    kind, text = F.col("value_type"), F.col("v_str")
    numeric, boolean = kind.isin("number", "currency"), kind == "boolean"
    plain = kind.isin("text", "long_text", "address", "identifier", "phone")
    limit = F.lit(MAX_TEXT_CHARS)
    for name, chars in MAX_VALUE_CHARS.items():
        limit = F.when(kind == name, chars).otherwise(limit)
    trimmed = F.when(plain, trim_all(text)).otherwise(text)
    return (
        F.when(numeric & ~_finite(F.col("v_num")), "invalid_type")
        .when(boolean & F.col("v_bool").isNull(), "invalid_type")
        .when(~numeric & ~boolean & text.isNull(), "invalid_type")
        .when((kind == "email") & ~is_email(text), "invalid_format")
        .when((kind == "date") & ~is_iso_date(text), "invalid_format")
        .when((kind == "select") & ~F.array_contains(F.coalesce("allowed", F.array().cast("array<string>")), text), "invalid_value")
        .when(plain & (trimmed == ""), "too_small")
        .when((plain | (kind == "email")) & (F.length(trimmed) > limit), "too_big")
    )


def _is_null() -> Column:
    return F.coalesce("v_str", F.col("v_num").cast("string"), F.col("v_bool").cast("string")).isNull()


def drop_undeclared(values: DataFrame, declared: DataFrame) -> DataFrame:
    """Value rows whose schema declares any field (or, for cells, any column) at all."""
    return values.join(declared.select("schema_id").distinct(), "schema_id", "left_semi").select(*values.columns)


def normalize_values(values: DataFrame, fields: DataFrame) -> DataFrame:
    """An empty list becomes null. A list is a row per ``item_ix``, an empty one has -1.

    A schema without fields has no values, whatever was given; :func:`drop_undeclared` does the
    same for the cells of a schema without tables.
    """
    values = drop_undeclared(values, fields)
    repeatable = fields.select("schema_id", "field_id", "repeatable")
    rows = values.join(repeatable, ["schema_id", "field_id"], "left")
    empty = F.coalesce(F.col("repeatable"), F.lit(False)) & (F.col("item_ix") == -1)
    return rows.withColumn(
        "item_ix", F.when(empty, None).otherwise(F.col("item_ix"))
    ).select(*values.columns)


def validate_discovered(
    documents: DataFrame,
    fields: DataFrame,
    options: DataFrame,
    columns: DataFrame,
    field_values: DataFrame,
    cell_values: DataFrame,
    submission: bool = False,
) -> DataFrame:
    """Discovered schemas: closed keys, bounded lists and rows, typed and bounded scalars.

    With ``submission`` required fields and cells must also be present.
    """
    schemas = documents.select("doc_id", "schema_id")
    # --- fields
    allowed = _option_sets(options, "field_id")
    catalog = fields.select("schema_id", "field_id", "value_type", "repeatable", "required")
    # Options are a matter of the schema; beside the values they would be joined once more for each document.
    # Schemas grow with the documents and look as small as what they are made of; without the hints they are sent whole through the driver.
    catalog_options = catalog.join(allowed.hint("merge"), ["schema_id", "field_id"], "left")
    asked = schemas.join(catalog_options.hint("merge"), "schema_id")
    given = field_values.select(
        "doc_id", "schema_id", "field_id", "item_ix", "v_str", "v_num", "v_bool",
        F.lit(True).alias("given"),
    )
    rows = asked.join(given, ["doc_id", "schema_id", "field_id"], "full")
    is_list = F.col("item_ix").isNotNull()
    required = F.col("required") if submission else F.lit(False)
    issue = (
        F.when(F.col("value_type").isNull(), "unrecognized_keys")
        .when(F.col("given").isNull(), "invalid_type")
        .when(~is_list & _is_null(), F.when(required, "invalid_type"))
        .when(F.col("repeatable") != is_list, "invalid_type")
        .when(F.col("item_ix") == -1, "too_small")
        .when(_is_null(), "invalid_type")
        .otherwise(_scalar_issue())
    )
    in_known_list = F.col("repeatable") & (F.col("item_ix") >= 0)
    path = F.concat_ws(
        ".", F.lit("fields"), "field_id", F.when(in_known_list, F.col("item_ix").cast("string"))
    )
    field_issues = rows.select("doc_id", path.alias("path"), issue.alias("code"))
    long_lists = (
        field_values.filter(F.col("item_ix") >= 0).groupBy("doc_id", "schema_id", "field_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > MAX_REPEATS)
        .join(catalog.filter("repeatable").hint("merge"), ["schema_id", "field_id"], "left_semi")
        .select("doc_id", F.concat(F.lit("fields."), "field_id").alias("path"), F.lit("too_big").alias("code"))
    )
    # --- table cells
    cells = columns.select("schema_id", "table_id", "column_id", "value_type", "required")
    present = cell_values.select("doc_id", "schema_id", "table_id", "row_ix").distinct()
    expected = present.join(cells.hint("merge"), ["schema_id", "table_id"])
    given_cells = cell_values.select(
        "doc_id", "schema_id", "table_id", "row_ix", "column_id", "v_str", "v_num", "v_bool",
        F.lit(True).alias("given"),
    )
    cell_rows = expected.join(
        given_cells, ["doc_id", "schema_id", "table_id", "row_ix", "column_id"], "full"
    ).withColumn("allowed", F.array().cast("array<string>"))
    cell_issue = (
        F.when(F.col("value_type").isNull(), "unrecognized_keys")
        .when(F.col("given").isNull(), "invalid_type")
        .when(_is_null(), F.when(required, "invalid_type"))
        .otherwise(_scalar_issue())
    )
    cell_path = F.concat_ws(
        ".", F.lit("tables"), "table_id", F.col("row_ix").cast("string"), "column_id"
    )
    cell_issues = cell_rows.select("doc_id", cell_path.alias("path"), cell_issue.alias("code"))
    long_tables = (
        present.groupBy("doc_id", "table_id").agg(F.count("*").alias("n"))
        .filter(F.col("n") > MAX_ROWS)
        .select("doc_id", F.concat(F.lit("tables."), "table_id").alias("path"), F.lit("too_big").alias("code"))
    )
    found = field_issues.unionByName(cell_issues).filter(F.col("code").isNotNull())
    return found.unionByName(long_lists).unionByName(long_tables)


def merge_batches(values: DataFrame, owner: str = "field_id") -> DataFrame:
    """A field given by several batches keeps all its items from the last of them.

    With ``owner="table_id"`` the same holds for the rows and cells of a table. The last batch is
    found by a pre-aggregated maximum, so no field with many items is gathered.
    """
    last = values.groupBy(F.col("doc_id").alias("d"), F.col(owner).alias("o")).agg(F.max("batch_ix").alias("last"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col(owner).eqNullSafe(F.col("o")) & (F.col("batch_ix") == F.col("last"))
    return values.join(last, same, "left_semi").drop("batch_ix")


def violation_summary(violations: DataFrame) -> DataFrame:
    """Per document: how many issues, the first few codes and safe paths, the first field.

    Issues are ordered by place, then path, and read once: counted and cut by rank in a few groups
    of a document, so that one with many issues is spread over tasks, then once more over the groups.
    """
    issue = F.struct("place", "path", "code")
    order = Window.partitionBy("doc_id", "issue_group").orderBy("place", "path", "code")
    grouped = violations.withColumn("issue_group", F.pmod(F.xxhash64("path", "code"), F.lit(ISSUE_GROUPS)))
    parts = grouped.withColumn("rank", F.row_number().over(order)).groupBy("doc_id", "issue_group").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("rank") <= MAX_ISSUES, issue)).alias("issues")
    )
    first = parts.groupBy("doc_id").agg(
        F.sum("n").alias("issue_count"),
        F.slice(F.array_sort(F.flatten(F.collect_list("issues"))), 1, MAX_ISSUES).alias("first"),
    )

    def safe(path: Column) -> Column:
        return path.rlike(r"^[A-Za-z0-9_.-]+\z") & ~F.exists(
            F.split(path, r"\."), lambda s: (F.length(s) == 0) | (F.length(s) > 80)
        )

    shown = F.transform("first", lambda i: F.when(safe(i["path"]), F.substring(i["path"], 1, MAX_PATH)))
    return first.select(
        "doc_id", "issue_count",
        F.array_join(F.col("first.code"), ",").alias("codes"),
        F.array_join(shown, "|").alias("paths"),
        F.col("first")[0]["path"].alias("first_field"),
        F.col("first")[0]["code"].alias("first_reason"),
    )
