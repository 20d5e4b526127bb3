"""Schema catalogs: audits, projections, contracts and batch packing.

A discovered catalog has one schema per document, so it grows with the corpus and
is joined on its keys like any other table. Such joins ask for a merge: a plan's estimate
does not know how many rows a generator makes, and would broadcast what is large. Only
registered definitions, which are a handful of rows written in code, are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import is_blank, trim_all
from groundline.operators.rules import at_most, bars, bounded, breach, child, claims, needs, parent, settle, unique

# Identifier shapes and bounds.
REGISTERED_ID = r"^[A-Za-z][A-Za-z0-9-]*\z"
DISCOVERED_ID = r"^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*\z"
LANGUAGE_TAG = r"^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*\z"
MAX_ID, MAX_LABEL, MAX_DESCRIPTION, MAX_TITLE = 100, 120, 500, 200
MAX_SECTIONS, MAX_SECTION_FIELDS, MAX_FIELDS = 20, 50, 200
MAX_TABLES, MAX_COLUMNS, MAX_OPTIONS = 20, 30, 100
FIELDS_PER_BATCH = 25
CONTRACT_CHARS = 12_000
FIELD_TYPES = (
    "text", "long_text", "number", "currency", "date", "boolean", "email", "phone", "address",
    "identifier", "select",
)
CELL_TYPES = tuple(t for t in FIELD_TYPES if t not in ("long_text", "select"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_registered(
    definitions: DataFrame, fields: DataFrame, options: DataFrame, templates: DataFrame
) -> DataFrame:
    """Definitions that break a registration rule (``schema_id, path, rule``); every table is read once."""
    whole, field, value, template = F.lit(""), F.col("field_key"), F.col("value"), F.col("template_id")
    option_path = F.concat_ws(".", field, value)
    return settle([
        claims(
            definitions,
            breach("id_pattern", whole, ~F.col("schema_id").rlike(REGISTERED_ID)),
            breach("version", whole, F.col("version") < 1),
            breach("label_blank", whole, is_blank(F.col("label"))),
            breach("description_blank", whole, is_blank(F.col("description"))),
            unique("duplicate_definition", whole),
            parent("no_fields", whole),
            parent("no_templates", whole),
        ),
        claims(
            fields,
            breach("key_pattern", field, ~field.rlike(REGISTERED_ID)),
            breach("label_blank", field, is_blank(F.col("label"))),
            breach("description_blank", field, is_blank(F.col("description"))),
            breach("pdf_field_blank", field, is_blank(F.col("pdf_field"))),
            unique("duplicate_key", field, field),
            unique("duplicate_pdf_field", F.col("pdf_field"), F.col("pdf_field")),
            parent("no_options", field, field, condition=F.col("kind") == "select"),
            child("no_fields", whole),
        ),
        claims(
            options,
            breach("option_blank", option_path, is_blank(F.col("label")) | is_blank(value)),
            unique("duplicate_option", option_path, field, value),
            child("no_options", field, field),
        ),
        claims(
            templates,
            breach("template_pattern", template, ~template.rlike(REGISTERED_ID)),
            breach("label_blank", template, is_blank(F.col("label"))),
            breach("asset_blank", template, is_blank(F.col("asset_path"))),
            unique("duplicate_template", template, template),
            child("no_templates", whole),
        ),
    ])


def normalize_discovered(fields: DataFrame) -> DataFrame:
    """Options only on choice fields (``options`` as an array column)."""
    kept = F.when(F.col("value_type") == "select", F.col("options"))
    return fields.withColumn("options", kept)


def _labelled(text: Column, limit: int) -> Column:
    return ~F.length(trim_all(text)).between(1, limit)


def _bad_id(text: Column) -> Column:
    trimmed = trim_all(text)
    return ~trimmed.rlike(DISCOVERED_ID) | (F.length(trimmed) > MAX_ID)


def audit_discovered(
    schemas: DataFrame,
    sections: DataFrame,
    fields: DataFrame,
    options: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
) -> DataFrame:
    """Discovered schemas that break a rule (``schema_id, path, rule``); every table is read once."""
    whole, section, field, table = F.lit(""), F.col("section_id"), F.col("field_id"), F.col("table_id")
    column, kind, value = F.col("column_id"), F.col("value_type"), F.col("value")
    column_path = F.concat_ws(".", table, column)
    option_path = F.concat_ws(".", field, F.col("option_ix").cast("string"))
    long_text = F.length(trim_all(F.col("description"))) > MAX_DESCRIPTION
    label = _labelled(F.col("label"), MAX_LABEL)
    is_choice = kind == "select"
    return settle([
        claims(
            schemas,
            breach("document_type", whole, _bad_id(F.col("document_type"))),
            breach("type_label", whole, _labelled(F.col("document_type_label"), MAX_LABEL)),
            breach("language", whole, ~trim_all(F.col("language")).rlike(LANGUAGE_TAG)),
            breach("title", whole, _labelled(F.col("title"), MAX_TITLE)),
            breach("schema_version", whole, F.col("schema_version") != 1),
            parent("no_fields_or_columns", whole),
        ),
        claims(
            sections,
            breach("section_id", section, _bad_id(section)),
            breach("section_label", section, label),
            breach("description", section, long_text),
            unique("duplicate_section", section, section),
            at_most("many_sections", whole, MAX_SECTIONS),
            parent("empty_section", section, section),
        ),
        claims(
            fields,
            breach("field_id", field, _bad_id(field)),
            breach("field_label", field, label),
            breach("description", field, long_text),
            breach("value_type", field, ~kind.isin(*FIELD_TYPES)),
            unique("duplicate_field", field, field),
            at_most("many_section_fields", section, MAX_SECTION_FIELDS, section),
            at_most("many_fields", whole, MAX_FIELDS),
            needs("options_missing", field, field, condition=is_choice),
            bounded("options_many", field, MAX_OPTIONS, field, condition=is_choice),
            bars("options_unexpected", field, kind, field, condition=~is_choice),
            child("empty_section", section, section),
            child("no_fields_or_columns", whole),
        ),
        claims(
            options,
            breach("option_text", option_path, label | _labelled(value, MAX_LABEL)),
            unique("duplicate_option_value", field, field, value),
            unique("duplicate_option_label", field, field, F.lower("label")),
            child("options_missing", field, field),
            child("options_many", field, field),
            child("options_unexpected", field, field),
        ),
        claims(
            tables,
            breach("table_id", table, _bad_id(table)),
            breach("table_label", table, label),
            breach("description", table, long_text),
            unique("duplicate_table", table, table),
            at_most("many_tables", whole, MAX_TABLES),
            parent("empty_table", table, table),
        ),
        claims(
            columns,
            breach("column_id", column_path, _bad_id(column)),
            breach("column_label", column_path, label),
            breach("description", column_path, long_text),
            breach("value_type", column_path, ~kind.isin(*CELL_TYPES)),
            unique("duplicate_column", column_path, table, column),
            at_most("many_columns", table, MAX_COLUMNS, table),
            child("empty_table", table, table),
            child("no_fields_or_columns", whole),
        ),
    ], details=True)


def public_catalog(definitions: DataFrame, fields: DataFrame, templates: DataFrame) -> DataFrame:
    """Definitions as shown outside: no form-field names and no asset paths.

    The nested lists hold one definition's fields and templates.
    """
    shown = fields.groupBy("schema_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("ordinal", F.col("field_key").alias("key"), "label", "description", "kind", "required")
            )
        ).alias("fields")
    )
    forms = templates.groupBy("schema_id").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("template_id").alias("id"), "label", "flatten_by_default"))
        ).alias("templates")
    )
    return definitions.select("schema_id", "version", "label", "description").join(
        shown.hint("merge"), "schema_id", "left"
    ).join(forms.hint("merge"), "schema_id", "left")


def public_summary(definitions: DataFrame, templates: DataFrame) -> DataFrame:
    forms = templates.groupBy("schema_id").agg(
        F.array_sort(F.collect_set("template_id")).alias("templates")
    )
    return definitions.select("schema_id", "version", "label", "description").join(
        forms, "schema_id", "left"
    )


def required_counts(fields: DataFrame) -> DataFrame:
    return fields.groupBy("schema_id").agg(
        F.count("*").alias("fields"),
        F.count_if("required").alias("required_fields"),
        F.count_if(~F.col("required")).alias("optional_fields"),
    )


def _json_text(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]\z", "")


def _enum(values: Column) -> Column:
    return F.array_join(F.transform(values, _json_text), ",")


def _leaf_json(value_type: Column, repeatable: Column, options: Column) -> Column:
    """The contract of one value: nullable where single, an array where repeatable."""
    base = (
        F.when(value_type.isin("number", "currency"), "number")
        .when(value_type == "boolean", "boolean")
        .otherwise("string")
    )
    choice = value_type == "select"
    item = F.when(
        choice, F.concat(F.lit('{"enum":['), _enum(options), F.lit('],"type":"string"}'))
    ).otherwise(F.concat(F.lit('{"type":"'), base, F.lit('"}')))
    single = F.when(
        choice, F.concat(F.lit('{"enum":['), _enum(options), F.lit(',null],"type":["string","null"]}'))
    ).otherwise(F.concat(F.lit('{"type":["'), base, F.lit('","null"]}')))
    many = F.concat(F.lit('{"items":'), item, F.lit(',"type":"array"}'))
    return F.when(repeatable, many).otherwise(single)


def _closed(properties: Column, names: Column) -> Column:
    """A closed object over ordered name and contract pairs that are already joined."""
    return F.concat(
        F.lit('{"additionalProperties":false,"properties":{'), properties,
        F.lit('},"required":['), names, F.lit('],"type":"object"}'),
    )


def field_contracts(fields: DataFrame, options: DataFrame) -> DataFrame:
    """Fields with the contract of each."""
    listed = options.groupBy("schema_id", "field_id").agg(
        F.array_sort(F.collect_list(F.struct("option_ix", "value"))).alias("listed")
    )
    rows = fields.join(listed.hint("merge"), ["schema_id", "field_id"], "left")
    values = F.transform(F.coalesce("listed", F.array()), lambda o: o["value"])
    return rows.withColumn(
        "contract", _leaf_json(F.col("value_type"), F.col("repeatable"), values)
    ).drop("listed")


def _object_of(df: DataFrame, keys: list[str], name: str, place: list[str], out: str) -> DataFrame:
    """Closed objects from child rows; a schema has at most a few hundred children."""
    sorted_children = F.array_sort(F.collect_list(F.struct(*place, F.col(name).alias("n"), "contract")))
    grouped = df.groupBy(*keys).agg(sorted_children.alias("children"))
    properties = F.transform("children", lambda c: F.concat(F.lit('"'), c["n"], F.lit('":'), c["contract"]))
    names = F.transform("children", lambda c: F.concat(F.lit('"'), c["n"], F.lit('"')))
    return grouped.select(
        *keys, _closed(F.array_join(properties, ","), F.array_join(names, ",")).alias(out)
    )


def contract_json(schemas: DataFrame, fields: DataFrame, options: DataFrame, columns: DataFrame) -> DataFrame:
    """The closed JSON contract of each schema; null where it has no field and no table."""
    of_fields = _object_of(
        field_contracts(fields, options), ["schema_id"], "field_id", ["section_ix", "ordinal"], "fields_json"
    )
    leaves = columns.withColumn(
        "contract", _leaf_json(F.col("value_type"), F.lit(False), F.array().cast("array<string>"))
    )
    rows = _object_of(leaves, ["schema_id", "table_id", "table_ix"], "column_id", ["ordinal"], "row_json")
    tables = rows.withColumn(
        "contract", F.concat(F.lit('{"items":'), "row_json", F.lit(',"type":"array"}'))
    )
    of_tables = _object_of(tables, ["schema_id"], "table_id", ["table_ix"], "tables_json")
    joined = schemas.select("schema_id").join(of_fields.hint("merge"), "schema_id", "left").join(
        of_tables.hint("merge"), "schema_id", "left"
    )
    properties = F.concat_ws(
        ",", F.concat(F.lit('"fields":'), "fields_json"), F.concat(F.lit('"tables":'), "tables_json")
    )
    names = F.concat_ws(
        ",", F.when(F.col("fields_json").isNotNull(), '"fields"'),
        F.when(F.col("tables_json").isNotNull(), '"tables"'),
    )
    return joined.select(
        "schema_id", F.when(names != "", _closed(properties, names)).alias("contract")
    )


def registered_contract(fields: DataFrame, options: DataFrame) -> DataFrame:
    """The minimal contract of each registered definition."""
    listed = options.groupBy("schema_id", "field_key").agg(
        F.array_sort(F.collect_list(F.struct("option_ix", "value"))).alias("listed")
    )
    values = F.transform(F.coalesce("listed", F.array()), lambda o: o["value"])
    rows = fields.join(listed, ["schema_id", "field_key"], "left").withColumn(
        "contract", _leaf_json(F.col("kind"), F.lit(False), values)
    )
    return _object_of(rows, ["schema_id"], "field_key", ["ordinal"], "contract")


# Characters of a contract that holds one section's fields and none of them yet.
_EMPTY_FIELDS = len(
    '{"additionalProperties":false,"properties":{"fields":{"additionalProperties":false,'
    '"properties":{},"required":[],"type":"object"}},"required":["fields"],"type":"object"}'
)


def pack_batches(
    fields: DataFrame,
    options: DataFrame,
    columns: DataFrame,
    max_fields: int = FIELDS_PER_BATCH,
    max_chars: int = CONTRACT_CHARS,
) -> DataFrame:
    """The batch of each field and table: in order, closed when a field would not fit.

    The contract of a batch is as long as its parts, so its length is a running sum and
    the packing one fold over a section's fields, of which there are at most fifty.
    """
    sized = field_contracts(fields, options).withColumn(
        # The name stands before its contract and again in the list of required names.
        "chars", 2 * F.length("field_id") + 5 + F.length("contract")
    )
    sections = sized.groupBy("schema_id", "section_ix").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "field_id", "chars"))).alias("listed")
    )

    def add(state: Column, item: Column) -> Column:
        # A further field also brings a comma in each of the two lists.
        grown = state["chars"] + item["chars"] + F.when(state["n"] > 0, 2).otherwise(0)
        full = (state["n"] > 0) & ((state["n"] + 1 > max_fields) | (grown > max_chars))
        batch = state["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(
            batch.alias("batch"),
            F.when(full, 1).otherwise(state["n"] + 1).alias("n"),
            F.when(full, F.lit(_EMPTY_FIELDS) + item["chars"]).otherwise(grown).alias("chars"),
            F.concat(state["placed"], F.array(batch)).alias("placed"),
        )

    start = F.struct(
        F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(_EMPTY_FIELDS).alias("chars"),
        F.array().cast("array<int>").alias("placed"),
    )
    placed = sections.withColumn("placed", F.reduce("listed", start, add)["placed"]).select(
        "schema_id", "section_ix",
        F.explode(F.arrays_zip("listed", "placed")).alias("z"),
    )
    order = Window.partitionBy("schema_id")
    of_fields = placed.select(
        "schema_id",
        F.concat(
            F.lit("fields_"),
            F.dense_rank().over(order.orderBy("section_ix", "z.placed")).cast("string"),
        ).alias("batch_id"),
        F.lit("field").alias("kind"), F.col("z.listed.field_id").alias("item_id"),
    )
    tables = columns.select("schema_id", "table_id", "table_ix").distinct()
    of_tables = tables.select(
        "schema_id",
        F.concat(
            F.lit("table_"), F.dense_rank().over(order.orderBy("table_ix")).cast("string")
        ).alias("batch_id"),
        F.lit("table").alias("kind"), F.col("table_id").alias("item_id"),
    )
    return of_fields.unionByName(of_tables)


def schema_fingerprint(
    schemas: DataFrame, fields: DataFrame, columns: DataFrame, options: DataFrame | None = None
) -> DataFrame:
    """A digest of all there is to a schema: header, fields, columns and options, in order.

    The labels ``document_type_label``, ``section_label`` and ``table_label`` count where a table
    has them, with the description of sections and tables if given beside them.
    """

    def listed(df: DataFrame, parts: list[str]) -> Column:
        return F.to_json(F.array(*[F.col(p).cast("string") for p in parts if p in df.columns]))

    def digest(df: DataFrame, place: list[str], parts: list[str], out: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*place, listed(df, parts).alias("row"))))
        return df.groupBy("schema_id").agg(F.array_join(F.transform(rows, lambda r: r["row"]), "\n").alias(out))

    field_parts = [
        "section_id", "section_label", "section_description", "field_id", "label", "description", "value_type",
        "repeatable", "required",
    ]
    column_parts = [
        "table_id", "table_label", "table_description", "column_id", "label", "description", "value_type", "required",
    ]
    head = listed(schemas, ["document_type", "document_type_label", "language", "title"])
    rows = (
        schemas.select("schema_id", head.alias("head"))
        .join(digest(fields, ["section_ix", "ordinal"], field_parts, "f").hint("merge"), "schema_id", "left")
        .join(digest(columns, ["table_ix", "ordinal"], column_parts, "c").hint("merge"), "schema_id", "left")
    )
    if options is None:
        rows = rows.withColumn("o", F.lit(""))
    else:
        of_options = digest(options, ["field_id", "option_ix"], ["field_id", "value", "label"], "o")
        rows = rows.join(of_options.hint("merge"), "schema_id", "left")
    # An empty part is told from a missing line: each part follows a line of its own.
    text = F.concat_ws("\n", "head", *(F.concat(F.lit(f"{p}:\n"), F.coalesce(p, F.lit(""))) for p in "fco"))
    return rows.select("schema_id", F.sha2(text, 256).alias("fingerprint"))


def assert_same_schema(results: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Results (``doc_id, schema_id, fingerprint``) whose schema is not the expected one."""
    expected = fingerprints.select("schema_id", F.col("fingerprint").alias("expected"))
    rows = results.join(expected, "schema_id", "left")
    return rows.filter(~F.col("fingerprint").eqNullSafe(F.col("expected"))).select("doc_id", "schema_id")


def audit_template_mapping(fields: DataFrame, template_fields: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates whose form fields do not match the mapped ones.

    ``template_fields`` has ``schema_id, template_id, pdf_field``.
    """
    key = ["schema_id", "template_id"]
    expected = templates.select(*key).join(fields.select("schema_id", "pdf_field").hint("merge"), "schema_id")
    actual = template_fields.select(*key, "pdf_field")

    def rule(df: DataFrame, name: str, path: Column) -> DataFrame:
        return df.select(*key, path.alias("path"), F.lit(name).alias("rule"))

    field = F.col("pdf_field")
    bare = templates.select(*key).join(actual.hint("merge"), key, "left_anti")
    twice = actual.groupBy(*key, "pdf_field").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    missing = expected.join(actual.hint("merge"), [*key, "pdf_field"], "left_anti")
    extra = actual.join(expected.hint("merge"), [*key, "pdf_field"], "left_anti").distinct()
    return _union([
        rule(bare, "no_fields", F.lit("")), rule(twice, "duplicate", field),
        rule(missing, "missing", field), rule(extra, "unexpected", field),
    ])
