"""Registered queries over schema catalogs and value sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import groundline.plans.form_inputs  # noqa: F401  (adds derived inputs)
from groundline.operators import catalog as c
from groundline.operators.audit_results import audit_discovered_result, audit_extraction_result
from groundline.operators.validate import merge_batches, normalize_values, validate_discovered
from groundline.plans import inputs
from groundline.plans import oracle_forms as o
from groundline.plans.registry import Tables, query

ID = "'[A-Za-z][A-Za-z0-9-]*'"


def _blank(x: str) -> str:
    return f"trim({x}) = ''"


REGISTERED_RULES = f"""
SELECT schema_id, '' AS path, 'id_pattern' AS rule FROM forms WHERE NOT regexp_full_match(schema_id, {ID})
UNION ALL SELECT schema_id, '', 'version' FROM forms WHERE version < 1
UNION ALL SELECT schema_id, '', 'label_blank' FROM forms WHERE {_blank('label')}
UNION ALL SELECT schema_id, '', 'description_blank' FROM forms WHERE {_blank('description')}
UNION ALL SELECT schema_id, '', 'no_fields' FROM forms WHERE schema_id NOT IN (SELECT schema_id FROM form_fields)
UNION ALL SELECT schema_id, '', 'no_templates' FROM forms WHERE schema_id NOT IN (SELECT schema_id FROM form_templates)
UNION ALL SELECT schema_id, field_key, 'key_pattern' FROM form_fields WHERE NOT regexp_full_match(field_key, {ID})
UNION ALL SELECT schema_id, field_key, 'label_blank' FROM form_fields WHERE {_blank('label')}
UNION ALL SELECT schema_id, field_key, 'description_blank' FROM form_fields WHERE {_blank('description')}
UNION ALL SELECT schema_id, field_key, 'pdf_field_blank' FROM form_fields WHERE {_blank('pdf_field')}
UNION ALL SELECT schema_id, field_key, 'no_options' FROM form_fields f WHERE kind = 'select' AND NOT EXISTS
  (SELECT 1 FROM form_options p WHERE p.schema_id = f.schema_id AND p.field_key = f.field_key)
UNION ALL SELECT schema_id, field_key || '.' || value, 'option_blank' FROM form_options WHERE {_blank('label')} OR {_blank('value')}
UNION ALL SELECT schema_id, template_id, 'template_pattern' FROM form_templates WHERE NOT regexp_full_match(template_id, {ID})
UNION ALL SELECT schema_id, template_id, 'label_blank' FROM form_templates WHERE {_blank('label')}
UNION ALL SELECT schema_id, template_id, 'asset_blank' FROM form_templates WHERE {_blank('asset_path')}
UNION ALL SELECT schema_id, field_key || '.' || value, 'duplicate_option' FROM form_options GROUP BY schema_id, field_key, value HAVING count(*) > 1
UNION ALL SELECT schema_id, field_key, 'duplicate_key' FROM form_fields GROUP BY schema_id, field_key HAVING count(*) > 1
UNION ALL SELECT schema_id, pdf_field, 'duplicate_pdf_field' FROM form_fields GROUP BY schema_id, pdf_field HAVING count(*) > 1
UNION ALL SELECT schema_id, template_id, 'duplicate_template' FROM form_templates GROUP BY schema_id, template_id HAVING count(*) > 1
UNION ALL SELECT schema_id, '', 'duplicate_definition' FROM forms GROUP BY schema_id HAVING count(*) > 1"""


@query(REGISTERED_RULES)
def registered_audit(t: Tables) -> DataFrame:
    return c.audit_registered(t.forms, t.form_fields, t.form_options, t.form_templates)


DID = "'[a-z][a-z0-9]*([._-][a-z0-9]+)*'"
FIELD_KINDS = "'text','long_text','number','currency','date','boolean','email','phone','address','identifier','select'"
CELL_KINDS = "'text','number','currency','date','boolean','email','phone','address','identifier'"


def _label(x: str, limit: int) -> str:
    return f"length(trim({x})) NOT BETWEEN 1 AND {limit}"


def _rows(table: str, path: str, rules: list[tuple[str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT schema_id, {path} AS path, '{rule}' AS rule FROM {table} WHERE {condition}" for rule, condition in rules
    )


def _twice(table: str, keys: str, path: str, rule: str) -> str:
    return f"SELECT schema_id, {path}, '{rule}' FROM {table} GROUP BY schema_id, {keys} HAVING count(*) > 1"


DISCOVERED_RULES = "\nUNION ALL ".join([
    _rows("rough_schemas", "''", [
        ("document_type", f"NOT regexp_full_match(document_type, {DID})"), ("type_label", _label("document_type_label", 120)),
        ("language", "NOT regexp_full_match(language, '[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*')"),
        ("title", _label("title", 200)), ("schema_version", "schema_version <> 1")]),
    _rows("rough_sections", "section_id", [
        ("section_id", f"NOT regexp_full_match(section_id, {DID})"), ("section_label", _label("label", 120)),
        ("description", "length(description) > 500")]),
    _rows("rough_fields", "field_id", [
        ("field_id", f"NOT regexp_full_match(field_id, {DID})"), ("field_label", _label("label", 120)),
        ("description", "length(description) > 500"), ("value_type", f"value_type NOT IN ({FIELD_KINDS})")]),
    _rows("rough_tables", "table_id", [("table_id", f"NOT regexp_full_match(table_id, {DID})")]),
    _rows("rough_columns", "table_id || '.' || column_id", [
        ("column_id", f"NOT regexp_full_match(column_id, {DID})"), ("value_type", f"value_type NOT IN ({CELL_KINDS})")]),
    _rows("choices", "field_id", [("options_missing", "value_type = 'select' AND n = 0"),
        ("options_many", "value_type = 'select' AND n > 100"), ("options_unexpected", "value_type <> 'select' AND n > 0")]),
    _twice("rough_options", "field_id, value", "field_id", "duplicate_option_value"),
    _twice("rough_options", "field_id, lower(label)", "field_id", "duplicate_option_label"),
    _twice("rough_sections", "section_id", "section_id", "duplicate_section"),
    _twice("rough_fields", "field_id", "field_id", "duplicate_field"),
    _twice("rough_tables", "table_id", "table_id", "duplicate_table"),
    _twice("rough_columns", "table_id, column_id", "table_id || '.' || column_id", "duplicate_column"),
    """SELECT schema_id, section_id, 'empty_section' FROM rough_sections s WHERE NOT EXISTS (SELECT 1 FROM rough_fields f
       WHERE f.schema_id = s.schema_id AND f.section_id = s.section_id)""",
    """SELECT schema_id, table_id, 'empty_table' FROM rough_tables s WHERE NOT EXISTS (SELECT 1 FROM rough_columns f
       WHERE f.schema_id = s.schema_id AND f.table_id = s.table_id)""",
])


@query(f"""WITH choices AS (SELECT f.schema_id, f.field_id, f.value_type, coalesce(p.n, 0) AS n
  FROM (SELECT DISTINCT schema_id, field_id, value_type FROM rough_fields) f
  LEFT JOIN (SELECT schema_id, field_id, count(*) AS n FROM rough_options GROUP BY ALL) p USING (schema_id, field_id))
{DISCOVERED_RULES}""")
def discovered_audit(t: Tables) -> DataFrame:
    return c.audit_discovered(
        t.rough_schemas, t.rough_sections, t.rough_fields, t.rough_options, t.rough_tables, t.rough_columns
    )


@query("""SELECT f.schema_id, f.field_id, f.ordinal, coalesce(string_agg(p.value, '|' ORDER BY p.option_ix)
  FILTER (f.value_type = 'select'), '') AS options
FROM rough_fields f LEFT JOIN rough_options p ON p.schema_id = f.schema_id AND p.field_id = f.field_id
GROUP BY f.schema_id, f.field_id, f.ordinal""")
def normalized_schema(t: Tables) -> DataFrame:
    listed = t.rough_options.groupBy("schema_id", "field_id").agg(
        F.array_sort(F.collect_list(F.struct("option_ix", "value"))).alias("options")
    )
    rows = c.normalize_discovered(t.rough_fields.join(listed, ["schema_id", "field_id"], "left"))
    return rows.select(
        "schema_id", "field_id", "ordinal",
        F.coalesce(F.array_join(F.transform("options", lambda p: p["value"]), "|"), F.lit("")).alias("options"),
    )


@query("""WITH one AS (SELECT concat('form-', k) AS schema_id, version, label, description, k FROM forms),
f AS (SELECT k, string_agg(field_key || ':' || kind || ':' || CAST(required AS VARCHAR), ',' ORDER BY ordinal) AS fields
  FROM form_fields GROUP BY k),
p AS (SELECT k, string_agg(template_id, ',' ORDER BY template_id) AS templates FROM form_templates GROUP BY k)
SELECT schema_id, version, label, description, coalesce(fields, '') AS fields, coalesce(templates, '') AS templates
FROM one LEFT JOIN f USING (k) LEFT JOIN p USING (k)""")
def public_catalog(t: Tables) -> DataFrame:
    own = F.concat(F.lit("form-"), F.col("k").cast("string"))
    shown = c.public_catalog(
        t.forms.withColumn("schema_id", own), t.form_fields.withColumn("schema_id", own),
        t.form_templates.withColumn("schema_id", own),
    )
    field = lambda f: F.concat_ws(":", f["key"], f["kind"], f["required"].cast("string"))
    return shown.select(
        "schema_id", "version", "label", "description",
        F.coalesce(F.array_join(F.transform("fields", field), ","), F.lit("")).alias("fields"),
        F.coalesce(F.array_join(F.transform("templates", lambda x: x["id"]), ","), F.lit("")).alias("templates"),
    )


@query("""SELECT schema_id, count(*) AS fields, count(*) FILTER (required) AS required_fields,
  count(*) FILTER (NOT required) AS optional_fields FROM rough_fields GROUP BY schema_id""")
def required_counts(t: Tables) -> DataFrame:
    return c.required_counts(t.rough_fields)


@query("""WITH e AS (SELECT schema_id, template_id, pdf_field FROM clean_forms JOIN clean_fields USING (schema_id))
SELECT schema_id, template_id, '' AS path, 'no_fields' AS rule FROM clean_forms ANTI JOIN template_fields USING (schema_id, template_id)
UNION ALL SELECT schema_id, template_id, pdf_field, 'duplicate' FROM template_fields GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT schema_id, template_id, pdf_field, 'missing' FROM e ANTI JOIN template_fields USING (schema_id, template_id, pdf_field)
UNION ALL SELECT DISTINCT schema_id, template_id, pdf_field, 'unexpected' FROM template_fields ANTI JOIN e USING (schema_id, template_id, pdf_field)""")
def template_mapping_audit(t: Tables) -> DataFrame:
    return c.audit_template_mapping(t.clean_fields, t.template_fields, t.clean_forms)


_LEAF = """CASE WHEN value_type = 'select' THEN CASE WHEN repeatable THEN '{"items":{"enum":[' || opts || '],"type":"string"},"type":"array"}'
    ELSE '{"enum":[' || opts || ',null],"type":["string","null"]}' END
  ELSE CASE WHEN repeatable THEN '{"items":{"type":"' || base || '"},"type":"array"}' ELSE '{"type":["' || base || '","null"]}' END END"""
_BASE = """CASE WHEN value_type IN ('number','currency') THEN 'number' WHEN value_type = 'boolean' THEN 'boolean' ELSE 'string' END"""
_CLOSED = """'{"additionalProperties":false,"properties":{' || %s || '},"required":[' || %s || '],"type":"object"}'"""


@query(f"""WITH opt AS (SELECT schema_id, field_id, string_agg(CAST(to_json(value) AS VARCHAR), ',' ORDER BY option_ix) AS opts
  FROM rough_options GROUP BY ALL),
leaf AS (SELECT f.schema_id, f.section_ix, f.ordinal, f.field_id, {_LEAF} AS j FROM (SELECT f.*, {_BASE} AS base,
  coalesce(opts, '') AS opts FROM rough_fields f LEFT JOIN opt USING (schema_id, field_id)) f),
fj AS (SELECT schema_id, {_CLOSED % ("string_agg('\"' || field_id || '\":' || j, ',' ORDER BY section_ix, ordinal)", "string_agg('\"' || field_id || '\"', ',' ORDER BY section_ix, ordinal)")} AS j
  FROM leaf GROUP BY schema_id),
cl AS (SELECT schema_id, table_id, table_ix, ordinal, column_id, '{{"type":["' || {_BASE} || '","null"]}}' AS j FROM rough_columns),
tj AS (SELECT schema_id, table_id, table_ix, {_CLOSED % ("string_agg('\"' || column_id || '\":' || j, ',' ORDER BY ordinal)", "string_agg('\"' || column_id || '\"', ',' ORDER BY ordinal)")} AS j
  FROM cl GROUP BY ALL),
ts AS (SELECT schema_id, {_CLOSED % ("string_agg('\"' || table_id || '\":{\"items\":' || j || ',\"type\":\"array\"}', ',' ORDER BY table_ix)", "string_agg('\"' || table_id || '\"', ',' ORDER BY table_ix)")} AS j
  FROM tj GROUP BY schema_id)
SELECT s.schema_id, CASE WHEN fj.j IS NOT NULL OR ts.j IS NOT NULL THEN {_CLOSED % ("concat_ws(',', '\"fields\":' || fj.j, '\"tables\":' || ts.j)", "concat_ws(',', CASE WHEN fj.j IS NOT NULL THEN '\"fields\"' END, CASE WHEN ts.j IS NOT NULL THEN '\"tables\"' END)")} END AS contract
FROM rough_schemas s LEFT JOIN fj USING (schema_id) LEFT JOIN ts USING (schema_id)""")
def contract_json(t: Tables) -> DataFrame:
    return c.contract_json(t.rough_schemas, t.rough_fields, t.rough_options, t.rough_columns)


@query(f"""WITH RECURSIVE opt AS (SELECT schema_id, field_id, string_agg(CAST(to_json(value) AS VARCHAR), ',' ORDER BY option_ix) AS opts
  FROM wide_options GROUP BY ALL),
sized AS (SELECT schema_id, section_ix, field_id, row_number() OVER (PARTITION BY schema_id, section_ix ORDER BY ordinal) AS pos,
  length('"' || field_id || '":' || {_LEAF}) + length('"' || field_id || '"') AS chars FROM (SELECT f.*, {_BASE} AS base,
  coalesce(opts, '') AS opts FROM wide_fields f LEFT JOIN opt USING (schema_id, field_id)) f),
fold AS (
  SELECT schema_id, section_ix, field_id, pos, 1 AS batch, 1 AS n, chars + 169 AS total FROM sized WHERE pos = 1
  UNION ALL
  SELECT s.schema_id, s.section_ix, s.field_id, s.pos,
    CASE WHEN f.n + 1 > 25 OR f.total + s.chars + 2 > 12000 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.n + 1 > 25 OR f.total + s.chars + 2 > 12000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n + 1 > 25 OR f.total + s.chars + 2 > 12000 THEN s.chars + 169 ELSE f.total + s.chars + 2 END
  FROM fold f JOIN sized s ON s.schema_id = f.schema_id AND s.section_ix = f.section_ix AND s.pos = f.pos + 1)
SELECT schema_id, 'fields_' || dense_rank() OVER (PARTITION BY schema_id ORDER BY section_ix, batch) AS batch_id, 'field' AS kind,
  field_id AS item_id FROM fold
UNION ALL SELECT DISTINCT schema_id, 'table_' || dense_rank() OVER (PARTITION BY schema_id ORDER BY table_ix), 'table', table_id
FROM rough_columns""")
def batch_packing(t: Tables) -> DataFrame:
    return c.pack_batches(t.wide_fields, t.wide_options, t.rough_columns)


@query("""WITH f AS (SELECT schema_id, string_agg(CAST(to_json([section_id, 'Part ' || section_id, field_id, label, description, value_type,
    CAST(repeatable AS VARCHAR), CAST(required AS VARCHAR)]) AS VARCHAR), chr(10) ORDER BY section_ix, ordinal) AS f FROM notice_fields GROUP BY ALL),
c AS (SELECT schema_id, string_agg(CAST(to_json([table_id, 'List of ' || table_id, column_id, label, description, value_type, CAST(required AS VARCHAR)])
    AS VARCHAR), chr(10) ORDER BY table_ix, ordinal) AS c FROM notice_columns GROUP BY ALL),
o AS (SELECT schema_id, string_agg(CAST(to_json([field_id, value, label]) AS VARCHAR), chr(10) ORDER BY field_id, option_ix) AS o
  FROM notice_options GROUP BY ALL)
SELECT schema_id, sha256(concat_ws(chr(10), CAST(to_json([document_type, 'Order notice', language, title]) AS VARCHAR), 'f:', f, 'c:', c, 'o:', o)) AS fingerprint
FROM notice_docs JOIN f USING (schema_id) JOIN c USING (schema_id) JOIN o USING (schema_id)""")
def schema_fingerprint(t: Tables) -> DataFrame:
    t = t.by_order()
    return c.schema_fingerprint(
        t.notice_docs.withColumn("document_type_label", F.lit("Order notice")),
        t.notice_fields.withColumn("section_label", F.concat(F.lit("Part "), "section_id")),
        t.notice_columns.withColumn("table_label", F.concat(F.lit("List of "), "table_id")),
        t.notice_options,
    )


def _discovered_issue(kind: str, text: str = "v_str") -> str:
    return f"""CASE
  WHEN {kind} IN ('number','currency') THEN CASE WHEN v_num IS NULL OR isnan(v_num) OR isinf(v_num) THEN 'invalid_type' END
  WHEN {kind} = 'boolean' THEN CASE WHEN v_bool IS NULL THEN 'invalid_type' END
  WHEN {text} IS NULL THEN 'invalid_type'
  WHEN {kind} = 'email' THEN CASE WHEN NOT regexp_full_match({text}, '[A-Za-z0-9_''+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\\.)+[A-Za-z]{{2,}}')
    THEN 'invalid_format' WHEN length({text}) > 254 THEN 'too_big' END
  WHEN {kind} = 'date' THEN CASE WHEN NOT {o.iso_date(text)} THEN 'invalid_format' END
  WHEN {kind} = 'select' THEN CASE WHEN {text} NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW') THEN 'invalid_value' END
  WHEN trim({text}) = '' THEN 'too_small'
  WHEN length(trim({text})) > CASE {kind} WHEN 'identifier' THEN 500 WHEN 'phone' THEN 100 ELSE 10000 END THEN 'too_big' END"""


def _discovered_sql(submission: bool) -> str:
    null_code = "CASE WHEN required THEN 'invalid_type' END" if submission else "NULL"
    empty = "v_str IS NULL AND v_num IS NULL AND v_bool IS NULL"
    return f"""WITH f AS (SELECT d.doc_id, n.field_id, n.value_type, n.repeatable, n.required FROM notice_docs d
  JOIN notice_fields n ON n.schema_id = d.schema_id),
fs AS (SELECT coalesce(f.doc_id, v.doc_id) AS doc_id, coalesce(f.field_id, v.field_id) AS field_id, value_type, repeatable, required,
  item_ix, v_str, v_num, v_bool, v.doc_id IS NOT NULL AS given
  FROM f FULL JOIN raw_field_values v ON v.doc_id = f.doc_id AND v.field_id = f.field_id),
fi AS (SELECT doc_id, 'fields.' || field_id || CASE WHEN repeatable AND item_ix >= 0 THEN '.' || item_ix ELSE '' END AS path,
  CASE WHEN value_type IS NULL THEN 'unrecognized_keys' WHEN NOT given THEN 'invalid_type'
    WHEN item_ix IS NULL AND {empty} THEN {null_code} WHEN repeatable <> (item_ix IS NOT NULL) THEN 'invalid_type'
    WHEN item_ix = -1 THEN 'too_small' WHEN {empty} THEN 'invalid_type' ELSE {_discovered_issue('value_type')} END AS code FROM fs),
c AS (SELECT DISTINCT v.doc_id, v.table_id, v.row_ix, n.column_id, n.value_type, n.required FROM raw_cell_values v
  JOIN notice_columns n ON n.schema_id = v.schema_id AND n.table_id = v.table_id),
cs AS (SELECT coalesce(c.doc_id, v.doc_id) AS doc_id, coalesce(c.table_id, v.table_id) AS table_id, coalesce(c.row_ix, v.row_ix) AS row_ix,
  coalesce(c.column_id, v.column_id) AS column_id, value_type, required, v_str, v_num, v_bool, v.doc_id IS NOT NULL AS given
  FROM c FULL JOIN raw_cell_values v ON v.doc_id = c.doc_id AND v.table_id = c.table_id AND v.row_ix = c.row_ix AND v.column_id = c.column_id),
ci AS (SELECT doc_id, 'tables.' || table_id || '.' || row_ix || '.' || column_id AS path,
  CASE WHEN value_type IS NULL THEN 'unrecognized_keys' WHEN NOT given THEN 'invalid_type' WHEN {empty} THEN {null_code}
    ELSE {_discovered_issue('value_type')} END AS code FROM cs)
SELECT doc_id, path, code FROM (SELECT * FROM fi UNION ALL SELECT * FROM ci) x WHERE code IS NOT NULL"""


def _discovered_values(t: Tables, submission: bool) -> DataFrame:
    t = t.by_order(lines=True, at_once=inputs.TEXTS_PER_TASK)
    return validate_discovered(
        t.notice_docs, t.notice_fields, t.notice_options, t.notice_columns, t.raw_field_values, t.raw_cell_values, submission
    )


@query(_discovered_sql(False))
def discovered_violations(t: Tables) -> DataFrame:
    return _discovered_values(t, False)


@query(_discovered_sql(True))
def discovered_submission_violations(t: Tables) -> DataFrame:
    return _discovered_values(t, True)


@query("""SELECT v.doc_id, v.field_id, CASE WHEN f.repeatable AND item_ix = -1 THEN NULL ELSE item_ix END AS item_ix, v_str, v_num, v_bool
FROM raw_field_values v LEFT JOIN notice_fields f ON f.schema_id = v.schema_id AND f.field_id = v.field_id""")
def normalized_values(t: Tables) -> DataFrame:
    return normalize_values(t.raw_field_values, t.notice_fields).drop("schema_id")


@query("""SELECT l_orderkey AS doc_id, 'flag_' || l_linestatus AS field_id, l_partkey AS item_ix, l_returnflag AS v_str
FROM @lineitem l QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey, l_linestatus)""")
def merged_batches(t: Tables) -> DataFrame:
    lines = t.given("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("flag_"), "l_linestatus").alias("field_id"),
        F.col("l_partkey").alias("item_ix"), F.col("l_returnflag").alias("v_str"), F.col("l_linenumber").alias("batch_ix"),
    )
    return merge_batches(lines)


@query("""SELECT l_orderkey AS doc_id, 'flag_' || l_linestatus AS table_id, l_partkey AS row_ix, unnest(['quantity', 'tax']) AS column_id,
  unnest([CAST(l_quantity AS DOUBLE), CAST(l_tax AS DOUBLE)]) AS v_num
FROM (SELECT * FROM @lineitem QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey, l_linestatus)) x""")
def merged_tables(t: Tables) -> DataFrame:
    cells = F.create_map(F.lit("quantity"), F.col("l_quantity").cast("double"), F.lit("tax"), F.col("l_tax").cast("double"))
    lines = t.given("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("flag_"), "l_linestatus").alias("table_id"),
        F.col("l_partkey").alias("row_ix"), F.col("l_linenumber").alias("batch_ix"), F.explode(cells).alias("column_id", "v_num"),
    )
    return merge_batches(lines, "table_id")


@query(f"""WITH e AS (SELECT d.doc_id, d.schema_id, f.field_key, f.required, v.v_str IS NOT NULL OR v.v_num IS NOT NULL AS present,
    r.status, r.confidence FROM order_docs d JOIN order_schema f ON f.schema_id = d.schema_id
  LEFT JOIN order_values v ON v.doc_id = d.doc_id AND v.schema_id = f.schema_id AND v.field_key = f.field_key
  LEFT JOIN claimed_reviews r ON r.doc_id = d.doc_id AND r.field_key = f.field_key),
i AS (SELECT *, nr > 0 OR rm > 0 OR conf < 0.75 AS rr FROM (SELECT doc_id, count(*) FILTER (status = 'verified') AS vf,
  count(*) FILTER (status = 'needs_review') AS nr, count(*) FILTER (status = 'missing') AS mf,
  count(*) FILTER (status = 'missing' AND required) AS rm,
  CASE WHEN count(*) FILTER (status IS NOT NULL AND (present OR required)) = 0 THEN 0.0 ELSE
  {o.round_two("coalesce(sum(CAST(round(confidence * 100) AS BIGINT)) FILTER (present), 0)::DOUBLE / 100 / count(*) FILTER (status IS NOT NULL AND (present OR required))")}
  END AS conf FROM e GROUP BY doc_id) x),
m AS (SELECT c.*, i.* EXCLUDE (doc_id) FROM claimed_meta c JOIN i USING (doc_id))
SELECT doc_id, 'review_state' AS rule, field_key AS path FROM claimed_reviews WHERE (status, match_type, confidence) NOT IN
  (VALUES ('verified','exact',1.0::DOUBLE), ('verified','normalized',0.9::DOUBLE), ('needs_review','fuzzy',0.6::DOUBLE),
   ('needs_review','none',0.25::DOUBLE), ('missing','none',0.0::DOUBLE))
UNION ALL SELECT doc_id, 'review_absent', field_key FROM e WHERE status IS NULL
UNION ALL SELECT doc_id, 'null_not_missing', field_key FROM e WHERE NOT present AND status <> 'missing'
UNION ALL SELECT doc_id, 'present_but_missing', field_key FROM e WHERE present AND status = 'missing'
UNION ALL SELECT doc_id, 'meta_mismatch', 'verified_fields' FROM m WHERE verified_fields <> vf
UNION ALL SELECT doc_id, 'meta_mismatch', 'needs_review_fields' FROM m WHERE needs_review_fields <> nr
UNION ALL SELECT doc_id, 'meta_mismatch', 'missing_fields' FROM m WHERE missing_fields <> mf
UNION ALL SELECT doc_id, 'meta_mismatch', 'required_missing_fields' FROM m WHERE required_missing_fields <> rm
UNION ALL SELECT doc_id, 'meta_mismatch', 'confidence' FROM m WHERE confidence <> conf
UNION ALL SELECT doc_id, 'meta_mismatch', 'review_required' FROM m WHERE review_required <> rr
UNION ALL SELECT w.doc_id, 'warning_key', w.field_key FROM claimed_warning_keys w JOIN order_docs d USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM order_schema s WHERE s.schema_id = d.schema_id AND s.field_key = w.field_key)""")
def extraction_result_audit(t: Tables) -> DataFrame:
    t = t.by_order("order_docs", "order_schema", "order_values", hashed="order_values")
    return audit_extraction_result(
        t.order_docs, t.order_schema, t.order_values, t.claimed_reviews, t.claimed_meta, t.claimed_warning_keys
    )


@query("""WITH st AS (SELECT doc_id, field_id AS path, status, confidence, evidence_count FROM claimed_value_reviews
  UNION ALL SELECT doc_id, table_id, status, confidence, evidence_count FROM claimed_table_reviews),
p AS (SELECT r.doc_id, r.field_id, r.status, EXISTS (SELECT 1 FROM notice_field_values v WHERE v.doc_id = r.doc_id AND v.field_id = r.field_id)
  AS present FROM claimed_value_reviews r),
n AS (SELECT doc_id, table_id, count(DISTINCT row_ix) AS rows FROM notice_cell_values GROUP BY ALL)
SELECT doc_id, 'detected_type' AS rule, detected_type AS path FROM claimed_results WHERE detected_type <> 'order_notice'
UNION ALL SELECT doc_id, 'missing_scored', path FROM st WHERE status = 'missing' AND confidence <> 0
UNION ALL SELECT doc_id, 'no_evidence', path FROM st WHERE status = 'verified' AND evidence_count = 0
UNION ALL SELECT doc_id, 'null_not_missing', field_id FROM p WHERE NOT present AND status <> 'missing'
UNION ALL SELECT doc_id, 'present_but_missing', field_id FROM p WHERE present AND status = 'missing'
UNION ALL SELECT r.doc_id, 'row_count', r.table_id FROM claimed_table_reviews r LEFT JOIN n USING (doc_id, table_id) WHERE coalesce(rows, 0) <> row_count
UNION ALL SELECT doc_id, 'warning_id', id FROM claimed_warning_ids WHERE id = 'ghost'
UNION ALL SELECT doc_id, 'review_flag', 'review_required' FROM claimed_results r WHERE NOT review_required AND
  (confidence < 0.75 OR EXISTS (SELECT 1 FROM st WHERE st.doc_id = r.doc_id AND status <> 'verified'))""")
def discovered_result_audit(t: Tables) -> DataFrame:
    t = t.by_order("notice_fields", "notice_columns", lines=True)
    return audit_discovered_result(
        t.notice_docs, t.notice_fields, t.notice_columns, t.notice_field_values, t.notice_cell_values,
        t.claimed_value_reviews, t.claimed_table_reviews, t.claimed_results, t.claimed_warning_ids,
    )
