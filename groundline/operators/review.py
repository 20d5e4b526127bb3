"""Reviewer edits, form values, fill plans, exports and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.numbers import parse_scalar_number, plain_number
from groundline.functions.text import collapse, safe_stem, trim_all
from groundline.operators.table_replay import apply_table_edits, typed  # noqa: F401  (part of this module's interface)


def default_values(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """The empty form of each document's schema: null for amounts, blank otherwise."""
    catalog = fields.select("schema_id", "ordinal", "field_key", "kind")
    blank = F.when(~F.col("kind").isin("number", "currency"), "")
    return documents.select("doc_id", "schema_id").join(catalog, "schema_id").withColumn(
        "default_str", blank
    )


def initial_review_values(documents: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    """What the review form starts with: the extracted value, else the default."""
    found = values.select("doc_id", "schema_id", "field_key", "v_str", "v_num")
    rows = default_values(documents, fields).join(
        found, ["doc_id", "schema_id", "field_key"], "left"
    )
    text = F.when(F.col("v_num").isNull(), F.coalesce("v_str", "default_str")).otherwise(F.col("v_str"))
    return rows.select("doc_id", "schema_id", "ordinal", "field_key", text.alias("v_str"), "v_num")


def apply_field_edits(values: DataFrame, edits: DataFrame) -> DataFrame:
    """The last edit of a field replaces its value: text, number and truth value together."""
    edited = edits.filter(F.col("op") == "set_field").groupBy(
        "doc_id", F.col("target_id").alias("field_id")
    ).agg(F.max_by(typed(edits), "seq").alias("edit"))
    rows = values.select("doc_id", "field_id", typed(values).alias("value")).join(edited, ["doc_id", "field_id"], "full")
    return rows.select("doc_id", "field_id", F.when(F.col("edit").isNotNull(), F.col("edit")).otherwise(F.col("value")).alias("v")).select(
        "doc_id", "field_id", "v.*"
    )


def edited_flags(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, whether text, number or truth value changed. Review states are left as they were."""
    left = before.select(*keys, typed(before).alias("before"))
    right = after.select(*keys, typed(after).alias("after"))
    return left.join(right, keys, "full").select(
        *keys, (~F.col("before").eqNullSafe(F.col("after"))).alias("edited")
    )


def parse_repeatable_item(value_type: Column, text: Column) -> Column:
    """One entry of a list field: a number or a truth value where it reads as one, else text."""
    lowered = F.lower(text)
    number = F.when(value_type.isin("number", "currency"), parse_scalar_number(text))
    truth = F.when(
        value_type == "boolean",
        F.when(lowered.isin("true", "yes", "1"), True).when(lowered.isin("false", "no", "0"), False),
    )
    kept = F.when(number.isNull() & truth.isNull(), text)
    return F.struct(kept.alias("v_str"), number.alias("v_num"), truth.alias("v_bool"))


def split_repeatable(entries: DataFrame) -> DataFrame:
    """Items of newline-separated entries (``doc_id, field_id, value_type, entry``)."""
    lines = F.filter(F.transform(F.split("entry", "\n"), trim_all), lambda line: line != "")
    items = entries.select("doc_id", "field_id", "value_type", F.posexplode(lines).alias("item_ix", "line"))
    parsed = items.withColumn("item", parse_repeatable_item(F.col("value_type"), F.col("line")))
    return parsed.select("doc_id", "field_id", "item_ix", "item.v_str", "item.v_num", "item.v_bool")


def review_dashboard(results: DataFrame) -> DataFrame:
    """Corpus totals by schema and source, with subtotals."""
    return (
        results.rollup("schema_id", "source")
        .agg(
            F.count("*").alias("documents"),
            F.sum("page_count").alias("pages"),
            F.sum("verified_fields").alias("verified"),
            F.sum("needs_review_fields").alias("needs_review"),
            F.sum("missing_fields").alias("missing"),
            F.sum("required_missing_fields").alias("required_missing"),
            F.count_if("review_required").alias("review_required"),
            # Percent per document as shown to a reviewer; whole numbers sum exactly.
            F.sum(F.floor(F.col("confidence") * 100 + 0.5)).alias("confidence_percent_sum"),
        )
    )


def confidence_percentiles(results: DataFrame, shares: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Confidence percentiles by schema, format and source, with subtotals as :func:`review_dashboard` has them.

    ``results`` has ``schema_id, source_format, source, confidence``. Documents are first counted per whole percent,
    as a reviewer sees it, and those counts are added up for the subtotals: a group is a hundred and one
    rows at most, however many documents it has, and its percentiles are exact. ``pN`` is the smallest percent that
    at least N of 100 documents of the group do not exceed; documents without a confidence are not counted.
    """
    levels = ["schema_id", "source_format", "source"]
    percent = F.floor(F.col("confidence") * 100 + 0.5).alias("percent")
    counts = results.select(*levels, percent).filter(F.col("percent").isNotNull()).groupBy(*levels, "percent").count()
    sets = [[*levels[:size], "percent"] for size in range(len(levels), -1, -1)]
    summed = counts.groupingSets(sets, *levels, "percent").agg(
        F.grouping_id().alias("level"), F.sum("count").alias("n")
    )
    group = Window.partitionBy("level", *levels)
    upto = F.sum("n").over(group.orderBy("percent"))
    ranked = summed.withColumn("upto", upto).withColumn("total", F.sum("n").over(group))
    reached = [
        F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("percent"))).alias(f"p{share}") for share in shares
    ]
    return ranked.groupBy("level", *levels).agg(F.sum("n").alias("documents"), *reached).drop("level")


def warning_labels(warnings: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """The field labels of each warning in key order; unknown keys are left out."""
    labels = fields.select("schema_id", F.col("field_key").alias("key"), "label")
    keyed = warnings.filter(F.size("field_keys") > 0).select(
        "doc_id", "seq", "code", F.posexplode("field_keys").alias("pos", "key")
    )
    named = keyed.join(documents.select("doc_id", "schema_id"), "doc_id").join(
        labels, ["schema_id", "key"]
    )
    pairs = F.array_sort(F.collect_list(F.struct("pos", "label")))
    return named.groupBy("doc_id", "seq", "code").agg(
        F.array_join(F.transform(pairs, lambda p: p["label"]), ", ").alias("labels")
    )


def font_size(kind: Column, text: Column) -> Column:
    """Sizes by the length of the text without repeated white space."""
    chars = F.length(collapse(text))
    area = F.when(chars > 280, 7.5).when(chars > 160, 8.0).otherwise(9.0)
    line = F.when(chars > 70, 8.0).when(chars > 50, 9.0).otherwise(10.0)
    return F.when(kind == "textarea", area).otherwise(line)


def unknown_templates(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """``doc_id, template_id, rule`` of documents whose template their schema does not have."""
    missing = documents.join(templates.select("schema_id", "template_id"), ["schema_id", "template_id"], "left_anti")
    return missing.select("doc_id", "template_id", F.lit("unknown_template").alias("rule"))


def fill_plan(
    documents: DataFrame, fields: DataFrame, options: DataFrame, templates: DataFrame, values: DataFrame
) -> DataFrame:
    """What is written into each form field of a document's template, and how.

    ``documents`` has ``doc_id, schema_id, template_id, flatten``. A value that cannot be
    written is marked unsupported; a document with an unknown template has no rows here and is
    listed by :func:`unknown_templates`.
    """
    catalog = fields.select("schema_id", "ordinal", "field_key", "kind", "pdf_field")
    choices = options.select("schema_id", "field_key", F.col("value").alias("v_str"), F.col("label").alias("choice"))
    forms = templates.select("schema_id", "template_id", "flatten_by_default")
    rows = (
        documents.join(forms, ["schema_id", "template_id"])
        .join(catalog, "schema_id")
        .join(
            values.select("doc_id", "schema_id", "field_key", "v_str", "v_num"),
            ["doc_id", "schema_id", "field_key"], "left",
        )
        .join(choices, ["schema_id", "field_key", "v_str"], "left")
    )
    kind, text, number = F.col("kind"), F.col("v_str"), F.col("v_num")
    empty = number.isNull() & F.coalesce(text == "", F.lit(True))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    numeric = kind.isin("number", "currency")
    written = (
        F.when(empty, "")
        .when(numeric, F.when(finite, plain_number(number)))
        .when(kind == "select", F.col("choice"))
        .otherwise(text)
    )
    stem = F.regexp_replace(
        F.concat_ws("-", F.lit("document"), "schema_id", "template_id"), "[^A-Za-z0-9._-]", "-"
    )
    return rows.withColumn("text", written).select(
        "doc_id", "template_id", "ordinal", "pdf_field", "text",
        F.col("text").isNull().alias("unsupported"),
        font_size(kind, F.coalesce("text", F.lit(""))).alias("font_size"),
        F.coalesce("flatten", "flatten_by_default").alias("flattened"),
        F.concat(stem, F.lit(".pdf")).alias("file_name"),
    )


def _json_scalar() -> Column:
    """The JSON text of a value row; a row without a value is ``null``."""
    text = F.regexp_replace(F.to_json(F.array("v_str")), r"^\[|\]\z", "")
    return F.coalesce(plain_number(F.col("v_num")), F.col("v_bool").cast("string"), F.when(F.col("v_str").isNotNull(), text), F.lit("null"))


def _json_object(key: str, value: str) -> Column:
    """The JSON text of one object from the rows of a group, its keys in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])), ","), F.lit("}"))


def _json_list(place: str, value: str) -> Column:
    """The JSON text of a list from the rows of a group; place -1 marks an empty list."""
    items = F.array_sort(F.collect_list(F.when(F.col(place) >= 0, F.struct(F.col(place).alias("k"), F.col(value).alias("v")))))
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda e: e["v"]), ","), F.lit("]"))


def export_reviewed(
    documents: DataFrame,
    violations: DataFrame,
    field_values: DataFrame,
    cell_values: DataFrame,
    schema_version: int = 1,
) -> DataFrame:
    """One JSON text per valid document with all its fields and tables, and its file stem.

    Field rows with an ``item_ix`` are items of a list; the place -1 stands for an empty list, and
    a ``row_ix`` of -1 for an empty table. Lists are as long as a contract lets one document be.
    Texts are built before they are gathered: items to fields, cells to rows, rows to tables.
    """
    # Issues and texts look as small as what they are made of; without the hints they are sent whole through the driver.
    valid = documents.join(violations.select("doc_id").hint("merge"), "doc_id", "left_anti")
    listed = F.max("item_ix").isNotNull()
    fields = (
        field_values.withColumn("json", _json_scalar())
        .groupBy("doc_id", "field_id")
        .agg(F.when(listed, _json_list("item_ix", "json")).otherwise(F.first("json")).alias("json"))
        .groupBy("doc_id")
        .agg(_json_object("field_id", "json").alias("fields"))
    )
    tables = (
        cell_values.withColumn("json", _json_scalar())
        .groupBy("doc_id", "table_id", "row_ix")
        .agg(_json_object("column_id", "json").alias("json"))
        .groupBy("doc_id", "table_id")
        .agg(_json_list("row_ix", "json").alias("json"))
        .groupBy("doc_id")
        .agg(_json_object("table_id", "json").alias("tables"))
    )
    nothing = F.lit("{}")
    return valid.join(fields.hint("merge"), "doc_id", "left").join(tables.hint("merge"), "doc_id", "left").select(
        "doc_id",
        F.concat(
            F.lit('{"documentType":"'), "document_type", F.lit(f'","schemaVersion":{schema_version},"values":{{"fields":'),
            F.coalesce("fields", nothing), F.lit(',"tables":'), F.coalesce("tables", nothing), F.lit("}}"),
        ).alias("payload"),
        F.concat(safe_stem(F.coalesce("title", "document_type")), F.lit(".json")).alias("file_name"),
    )
