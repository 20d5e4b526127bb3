"""Registered queries over edits, form values, fill plans, dashboards and the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import groundline.plans.form_inputs  # noqa: F401  (adds derived inputs)
from groundline.operators import review as rv
from groundline.operators.ground_fixed import extraction_result, grounding_warnings, summarize_grounding
from groundline.operators.validate import validate_discovered
from groundline.plans.catalog_queries import _discovered_sql
from groundline.plans.fixed_queries import REVIEWS, reviews
from groundline.plans import inputs
from groundline.plans.inputs import INPUTS
from groundline.plans.registry import Tables, query
from groundline.streaming import jobs

INPUTS["entries"] = """
SELECT event_id AS doc_id, event_type AS field_id,
  CASE event_id % 3 WHEN 0 THEN 'currency' WHEN 1 THEN 'boolean' ELSE 'text' END AS value_type,
  concat(CAST(value AS STRING), chr(10), '  ', CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '1e3' WHEN 2 THEN '0' ELSE 'n/a' END,
    '  ', chr(10), chr(10), event_type) AS entry
FROM (SELECT event_id, event_type, CAST(floor(value) AS INT) AS value FROM @events) AS e
"""


@query("""SELECT d.doc_id, d.schema_id, f.ordinal, f.field_key, CASE WHEN f.kind IN ('number', 'currency') THEN NULL ELSE '' END AS default_str
FROM order_docs d JOIN order_schema f ON f.schema_id = d.schema_id""")
def default_values(t: Tables) -> DataFrame:
    return rv.default_values(t.order_docs, t.order_schema).drop("kind")


@query("""SELECT d.doc_id, d.schema_id, f.ordinal, f.field_key,
  CASE WHEN v.v_num IS NOT NULL THEN v.v_str ELSE coalesce(v.v_str, CASE WHEN f.kind IN ('number', 'currency') THEN NULL ELSE '' END) END AS v_str, v.v_num
FROM order_docs d JOIN order_schema f ON f.schema_id = d.schema_id
LEFT JOIN order_values v ON v.doc_id = d.doc_id AND v.schema_id = f.schema_id AND v.field_key = f.field_key""")
def initial_review_values(t: Tables) -> DataFrame:
    return rv.initial_review_values(t.order_docs, t.order_schema, t.order_values)


def _field_texts(t: Tables) -> DataFrame:
    return t.order_values.select("doc_id", F.col("field_key").alias("field_id"), "v_str", "v_num")


FIELD_EDITS = """last AS (SELECT doc_id, target_id AS field_id, v_str AS new FROM edits WHERE op = 'set_field'
  QUALIFY row_number() OVER (PARTITION BY doc_id, target_id ORDER BY seq DESC) = 1),
edited AS (SELECT coalesce(v.doc_id, l.doc_id) AS doc_id, coalesce(v.field_key, l.field_id) AS field_id,
  CASE WHEN l.doc_id IS NOT NULL THEN l.new ELSE v.v_str END AS v_str, CASE WHEN l.doc_id IS NULL THEN v.v_num END AS v_num,
  v.v_str AS old, v.v_num AS old_num, v.doc_id IS NOT NULL AS had
  FROM order_values v FULL JOIN last l ON l.doc_id = v.doc_id AND l.field_id = v.field_key)"""


@query(f"WITH {FIELD_EDITS} SELECT doc_id, field_id, v_str, v_num, CAST(NULL AS BOOLEAN) AS v_bool FROM edited")
def field_edits(t: Tables) -> DataFrame:
    return rv.apply_field_edits(_field_texts(t), t.edits)


@query(f"WITH {FIELD_EDITS} SELECT doc_id, field_id, NOT had OR v_str IS DISTINCT FROM old OR v_num IS DISTINCT FROM old_num AS edited FROM edited")
def edited_fields(t: Tables) -> DataFrame:
    before = _field_texts(t)
    return rv.edited_flags(before, rv.apply_field_edits(before, t.edits), ["doc_id", "field_id"])


# Every order is edited alike: a row is added at the end, one removed by position, then two cells set.
@query("""WITH base AS (SELECT doc_id, row_ix, column_id, v_str, v_num FROM notice_cell_values),
n AS (SELECT k AS doc_id, coalesce((SELECT max(row_ix) + 1 FROM base b WHERE b.doc_id = k), 0) AS rows FROM order_facts),
added AS (SELECT doc_id, row_ix, column_id, v_str, v_num FROM base UNION ALL
  SELECT n.doc_id, n.rows, c.column_id, NULL, NULL FROM n JOIN notice_columns c ON c.schema_id = n.doc_id AND c.table_id = 'items'),
gone AS (SELECT a.doc_id, row_ix - CASE WHEN row_ix > doc_id % 3 THEN 1 ELSE 0 END AS row_ix, column_id, v_str, v_num FROM added a
  WHERE row_ix <> doc_id % 3)
SELECT doc_id, 'items' AS table_id, CAST(row_ix AS INT) AS row_ix, column_id,
  CASE WHEN column_id = 'part' AND row_ix = 1 THEN 'cell 5' WHEN column_id = 'part' AND row_ix = 0 THEN 'cell 6' ELSE v_str END AS v_str,
  CASE WHEN column_id = 'part' AND row_ix IN (0, 1) THEN NULL ELSE v_num END AS v_num, CAST(NULL AS BOOLEAN) AS v_bool
FROM gone WHERE doc_id IN (SELECT k FROM order_facts)""")
def table_edits(t: Tables) -> DataFrame:
    t = t.by_order(lines=True, at_once=inputs.TEXTS_PER_TASK)
    cells = t.notice_cell_values.select("doc_id", "table_id", "row_ix", "column_id", "v_str", "v_num")
    columns = t.notice_columns.filter(F.col("table_id") == "items").select(
        F.col("schema_id").alias("doc_id"), "table_id", "column_id"
    )
    return rv.apply_table_edits(cells, t.edits, columns, t.tasks)


@query(r"""WITH l AS (SELECT doc_id, field_id, value_type, list_filter(list_transform(string_split(entry, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM entries),
i AS (SELECT doc_id, field_id, value_type, CAST(unnest(range(len(ls))) AS INT) AS item_ix, unnest(ls) AS line FROM l),
p AS (SELECT *, CASE WHEN value_type = 'currency' AND regexp_full_match(line, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN CAST(line AS DOUBLE) END AS v_num,
  CASE WHEN value_type = 'boolean' THEN CASE WHEN lower(line) IN ('true','yes','1') THEN true WHEN lower(line) IN ('false','no','0') THEN false END END AS v_bool FROM i)
SELECT doc_id, field_id, item_ix, CASE WHEN v_num IS NULL AND v_bool IS NULL THEN line END AS v_str, v_num, v_bool FROM p""")
def split_entries(t: Tables) -> DataFrame:
    return rv.split_repeatable(t.entries)


@query(f"""WITH {REVIEWS},
r AS (SELECT s.*, d.page_count, o.o_orderpriority AS source FROM summary s JOIN order_docs d USING (doc_id) JOIN @orders o ON o.o_orderkey = s.doc_id)
SELECT schema_id, source, count(*) AS documents, sum(page_count) AS pages, sum(verified_fields) AS verified, sum(needs_review_fields) AS needs_review,
  sum(missing_fields) AS missing, sum(required_missing_fields) AS required_missing, count(*) FILTER (review_required) AS review_required,
  CAST(sum(floor(confidence * 100 + 0.5)) AS BIGINT) AS confidence_percent_sum FROM r GROUP BY ROLLUP (schema_id, source)""")
def review_dashboard(t: Tables) -> DataFrame:
    definitions = t.order_schema.select("schema_id").distinct().withColumn("version", F.lit(1))
    results = extraction_result(t.order_docs, definitions, summarize_grounding(reviews(t)))
    source = t.given("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source"))
    return rv.review_dashboard(results.join(source, "doc_id"))


@query(f"""WITH {REVIEWS},
r AS (SELECT schema_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END AS source_format, o.o_orderpriority AS source,
  CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS percent FROM summary s JOIN @orders o ON o.o_orderkey = s.doc_id)
SELECT schema_id, source_format, source, count(*) AS documents, quantile_disc(percent, 0.5) AS p50, quantile_disc(percent, 0.95) AS p95
FROM r GROUP BY ROLLUP (schema_id, source_format, source)""")
def confidence_percentiles(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    source = t.given("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source"))
    source_format = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "docx")
    results = summarize_grounding(reviews(t)).join(source, "doc_id").withColumn("source_format", source_format)
    return rv.confidence_percentiles(results)


@query(f"""WITH {REVIEWS},
k AS (SELECT doc_id, schema_id, ordinal, field_key, CASE WHEN status = 'missing' AND required THEN 1 WHEN status = 'needs_review' THEN 2 END AS w FROM reviews)
SELECT doc_id, CASE w WHEN 1 THEN 'REQUIRED_FIELDS_MISSING' ELSE 'FIELDS_REQUIRE_REVIEW' END AS code, string_agg(f.label, ', ' ORDER BY k.ordinal) AS labels
FROM k JOIN order_schema f ON f.schema_id = k.schema_id AND f.field_key = k.field_key WHERE w IS NOT NULL GROUP BY doc_id, w""")
def labelled_warnings(t: Tables) -> DataFrame:
    return rv.warning_labels(grounding_warnings(reviews(t)), t.order_docs, t.order_schema).drop("seq")


@query("""WITH x AS (SELECT d.doc_id, f.ordinal, f.field_key, f.kind, v.v_str, v.v_num, p.label AS choice, d.doc_id % 3 AS m
  FROM order_docs d JOIN order_schema f ON f.schema_id = d.schema_id
  LEFT JOIN order_values v ON v.doc_id = d.doc_id AND v.schema_id = f.schema_id AND v.field_key = f.field_key
  LEFT JOIN order_options p ON p.schema_id = f.schema_id AND p.field_key = f.field_key AND p.value = v.v_str WHERE d.doc_id % 5 <> 4),
w AS (SELECT *, CASE WHEN v_num IS NULL AND coalesce(v_str, '') = '' THEN '' WHEN kind IN ('number', 'currency') THEN
  CASE WHEN v_num IS NOT NULL THEN CASE WHEN v_num = floor(v_num) THEN CAST(CAST(v_num AS BIGINT) AS VARCHAR) ELSE CAST(v_num AS VARCHAR) END END
  WHEN kind = 'select' THEN choice ELSE v_str END AS text FROM x)
SELECT doc_id, 'plain' AS template_id, ordinal, 'form.' || field_key AS pdf_field, text, text IS NULL AS unsupported,
  CASE WHEN kind = 'textarea' THEN CASE WHEN length(coalesce(text, '')) > 280 THEN 7.5 WHEN length(coalesce(text, '')) > 160 THEN 8 ELSE 9 END
    ELSE CASE WHEN length(coalesce(text, '')) > 70 THEN 8 WHEN length(coalesce(text, '')) > 50 THEN 9 ELSE 10 END END::DOUBLE AS font_size,
  CASE m WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS flattened FROM w""")
def fill_plan(t: Tables) -> DataFrame:
    documents, templates = _filled_documents(t)
    fields = t.order_schema.withColumn("pdf_field", F.concat(F.lit("form."), "field_key"))
    return rv.fill_plan(documents, fields, t.order_options, templates, t.order_values).drop("file_name")


def _filled_documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents with the template they ask for, which not every schema has, and the templates."""
    k = F.col("doc_id")
    documents = t.order_docs.select(
        "doc_id", "schema_id", F.when(k % 5 == 4, "gone").otherwise("plain").alias("template_id"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("flatten"),
    )
    templates = t.order_schema.select("schema_id").distinct().select(
        "schema_id", F.lit("plain").alias("template_id"), F.lit(True).alias("flatten_by_default")
    )
    return documents, templates


@query("SELECT doc_id, 'gone' AS template_id, 'unknown_template' AS rule FROM order_docs WHERE doc_id % 5 = 4")
def unknown_template_documents(t: Tables) -> DataFrame:
    return rv.unknown_templates(*_filled_documents(t))


_SCALAR = """CASE WHEN v_num IS NOT NULL THEN CASE WHEN v_num = floor(v_num) THEN CAST(CAST(v_num AS BIGINT) AS VARCHAR)
  ELSE CAST(v_num AS VARCHAR) END WHEN v_bool IS NOT NULL THEN CAST(v_bool AS VARCHAR) WHEN v_str IS NOT NULL THEN CAST(to_json(v_str) AS VARCHAR) ELSE 'null' END"""


@query(f"""WITH bad AS ({_discovered_sql(True)}),
i AS (SELECT doc_id, field_id, CASE WHEN max(item_ix) IS NULL THEN min({_SCALAR})
    ELSE '[' || coalesce(string_agg({_SCALAR}, ',' ORDER BY item_ix) FILTER (item_ix >= 0), '') || ']' END AS x FROM raw_field_values GROUP BY ALL),
j AS (SELECT doc_id, string_agg('"' || field_id || '":' || x, ',' ORDER BY field_id) AS body FROM i GROUP BY ALL),
l AS (SELECT doc_id, table_id, row_ix, '{{' || string_agg('"' || column_id || '":' || {_SCALAR}, ',' ORDER BY column_id) || '}}' AS x
  FROM raw_cell_values GROUP BY ALL),
m AS (SELECT doc_id, table_id, '[' || string_agg(x, ',' ORDER BY row_ix) || ']' AS x FROM l GROUP BY ALL),
n AS (SELECT doc_id, string_agg('"' || table_id || '":' || x, ',' ORDER BY table_id) AS cells FROM m GROUP BY ALL)
SELECT d.doc_id, '{{"documentType":"order_notice","schemaVersion":1,"values":{{"fields":{{' || body || '}},"tables":{{' || coalesce(cells, '') || '}}}}}}' AS payload,
  CASE WHEN title IS NULL THEN 'order_notice' ELSE 'Order-notice-' || d.doc_id END || '.json' AS file_name
FROM notice_docs d JOIN j USING (doc_id) LEFT JOIN n USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM bad)""")
def exported_values(t: Tables) -> DataFrame:
    t = t.by_order(lines=True, at_once=inputs.TEXTS_PER_TASK)
    broken = validate_discovered(
        t.notice_docs, t.notice_fields, t.notice_options, t.notice_columns, t.raw_field_values, t.raw_cell_values, True
    )
    return rv.export_reviewed(t.notice_docs, broken, t.raw_field_values, t.raw_cell_values)


@query("""SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS window_start, user_id AS client, count(*) AS requests, count(*) > 2 AS over_limit
FROM @events GROUP BY ALL""")
def quota_windows(t: Tables) -> DataFrame:
    return jobs.quota_windows(t.given("events"), "user_id", limit=2, window="1 day")


# A recursive walk over each client's moments: the next window starts at the first request after the last one's end.
@query("""WITH RECURSIVE e AS (SELECT user_id AS client, CAST(ts AS TIMESTAMP) AS m, count(*) AS n FROM @events WHERE ts IS NOT NULL GROUP BY ALL),
s AS (SELECT a.client, a.m, min(b.m) AS later FROM e a LEFT JOIN e b ON b.client = a.client AND b.m >= a.m + INTERVAL 1 DAY GROUP BY ALL),
w AS (SELECT client, min(m) AS m FROM e GROUP BY client UNION ALL SELECT s.client, s.later FROM w JOIN s ON s.client = w.client AND s.m = w.m WHERE s.later IS NOT NULL)
SELECT w.client, w.m AS window_start, CAST(sum(n) AS BIGINT) AS requests, CAST(greatest(0, sum(n) - 2) AS BIGINT) AS refused
FROM w JOIN e ON e.client = w.client AND e.m >= w.m AND e.m < w.m + INTERVAL 1 DAY GROUP BY ALL""")
def client_quota_windows(t: Tables) -> DataFrame:
    return jobs.client_windows(t.given("events"), "user_id", limit=2, seconds=86_400)


@query("""SELECT request, count(*) AS n FROM (SELECT DISTINCT 'req-' || user_id || '-' || event_type AS request FROM @events) x GROUP BY request""")
def deduplicated_requests(t: Tables) -> DataFrame:
    key = F.concat_ws("-", F.lit("req"), "user_id", "event_type")
    kept = jobs.dedup_requests(t.given("events").withColumn("request", key), "request")
    return kept.groupBy("request").agg(F.count("*").alias("n"))
