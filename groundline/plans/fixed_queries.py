"""Registered queries over documents with a registered schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.operators.corpus_search import ground_in_corpus
from groundline.operators.fixed_matching import mention_index as mentions
from groundline.operators.fixed_matching import source_forms
from groundline.operators.ground_fixed import (
    extraction_result as result_of,
)
from groundline.operators.ground_fixed import (
    ground_fields as ground,
)
from groundline.operators.ground_fixed import (
    grounding_warnings as warnings_of,
)
from groundline.operators.ground_fixed import (
    summarize_grounding as summarize,
)
from groundline.operators.validate import (
    validate_envelope,
    validate_extraction,
    validate_submission,
    violation_summary,
)
from groundline.plans import inputs
from groundline.plans import oracle_forms as o
from groundline.plans.registry import Tables, query
from groundline.sources.registered import load_definitions, load_templates
from groundline.session import ensure_checkpoint_dir
from groundline.streaming.jobs import ground_stream

SOURCES = f"""
src AS (SELECT doc_id, schema_id, {o.minimal('content')} AS smin, {o.search('content')} AS ssea,
  {o.emails('content')} AS mails, {o.phones('content')} AS runs, {o.numbers('content')} AS nums
  FROM order_docs)"""

REVIEWS = f"""{SOURCES},
expected AS (
  SELECT d.doc_id, d.schema_id, f.ordinal, f.field_key, f.kind, f.required, v.v_str, v.v_num,
         (v.v_str IS NOT NULL OR v.v_num IS NOT NULL) AS present, p.label
  FROM order_docs d JOIN order_schema f ON f.schema_id = d.schema_id
  LEFT JOIN order_values v ON v.doc_id = d.doc_id AND v.schema_id = d.schema_id AND v.field_key = f.field_key
  LEFT JOIN order_options p ON p.schema_id = f.schema_id AND p.field_key = f.field_key AND p.value = v.v_str),
tried AS (
  SELECT doc_id, field_key, v_str AS c FROM expected WHERE kind IN ('text','textarea','select') AND v_str IS NOT NULL
  UNION ALL SELECT doc_id, field_key, label FROM expected WHERE kind = 'select' AND label IS NOT NULL),
formed AS (SELECT doc_id, field_key, {o.minimal('c')} AS cmin, {o.search('c')} AS csea FROM tried),
laddered AS (
  SELECT t.doc_id, field_key, csea, ssea,
    CASE WHEN cmin = '' THEN 1 WHEN contains(smin, cmin) THEN 4
      WHEN csea <> '' AND contains(ssea, csea) THEN 3 ELSE 0 END AS r
  FROM formed t JOIN src USING (doc_id)),
{o.fuzzy_tables("SELECT * FROM laddered WHERE r = 0 AND csea <> ''", 'doc_id, field_key').strip()},
ranked AS (
  SELECT doc_id, field_key, max(CASE WHEN r > 0 THEN r WHEN fz.csea IS NOT NULL THEN 2 ELSE 1 END) AS r
  FROM laddered LEFT JOIN fz USING (doc_id, field_key, csea) GROUP BY ALL),
matched AS (
  SELECT e.*, CASE WHEN NOT present THEN 'none'
    WHEN kind IN ('text','textarea','select') THEN
      CASE r.r WHEN 4 THEN 'exact' WHEN 3 THEN 'normalized' WHEN 2 THEN 'fuzzy' ELSE 'none' END
    WHEN kind = 'email' THEN CASE WHEN regexp_full_match(lower(v_str), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z0-9.-]+')
      AND list_contains(mails, lower(v_str)) THEN 'normalized' ELSE 'none' END
    WHEN kind = 'phone' THEN CASE WHEN length(regexp_replace(v_str, '[^0-9]', '', 'g')) BETWEEN 7 AND 15
      AND list_contains(runs, regexp_replace(v_str, '[^0-9]', '', 'g')) THEN 'normalized' ELSE 'none' END
    WHEN kind = 'date' THEN CASE WHEN {o.iso_date('v_str')} AND len(list_filter(
      {o.spellings('try_cast(v_str AS DATE)')}, lambda c: contains(' ' || ssea || ' ', ' ' || c || ' '))) > 0
      THEN 'normalized' ELSE 'none' END
    ELSE CASE WHEN len(list_filter(nums, lambda a: abs(a - coalesce(v_num, {o.canonical_number('v_str')}))
      <= greatest(1e-9, abs(coalesce(v_num, {o.canonical_number('v_str')})) * 1e-9))) > 0
      THEN 'normalized' ELSE 'none' END END AS match_type
  FROM expected e JOIN src s USING (doc_id) LEFT JOIN ranked r USING (doc_id, field_key)),
reviews AS (
  SELECT doc_id, matched.schema_id, ordinal, field_key, required, present, match_type,
    CASE WHEN NOT present THEN 'missing' WHEN match_type IN ('exact','normalized') THEN 'verified'
      ELSE 'needs_review' END AS status,
    CASE WHEN NOT present THEN 0.0 ELSE CASE match_type WHEN 'exact' THEN 1.0 WHEN 'normalized' THEN 0.9
      WHEN 'fuzzy' THEN 0.6 ELSE 0.25 END END::DOUBLE AS confidence
  FROM matched),
summary AS (
  SELECT *, needs_review_fields > 0 OR required_missing_fields > 0 OR confidence < 0.75 AS review_required
  FROM (SELECT doc_id, schema_id, count(*) FILTER (status = 'verified') AS verified_fields,
    count(*) FILTER (status = 'needs_review') AS needs_review_fields,
    count(*) FILTER (status = 'missing') AS missing_fields,
    count(*) FILTER (status = 'missing' AND required) AS required_missing_fields,
    count(*) FILTER (present) AS present_fields,
    CASE WHEN count(*) FILTER (present OR required) = 0 THEN 0.0 ELSE
      {o.round_two("coalesce(sum(CAST(round(confidence * 100) AS BIGINT)) FILTER (present), 0)::DOUBLE / 100 / count(*) FILTER (present OR required)")}
      END AS confidence
    FROM reviews GROUP BY doc_id, schema_id) t)"""


def reviews(t: Tables) -> DataFrame:
    t = t.by_order(at_once=inputs.TEXTS_PER_TASK)
    return ground(t.order_docs, t.order_schema, t.order_options, t.order_values, dealt=True)


@query(f"WITH {REVIEWS} SELECT doc_id, schema_id, field_key, match_type, status, confidence FROM reviews")
def ground_fields(t: Tables) -> DataFrame:
    return reviews(t).select("doc_id", "schema_id", "field_key", "match_type", "status", "confidence")


@query(f"WITH {REVIEWS} SELECT doc_id, schema_id, field_key, match_type, status, confidence FROM reviews")
def ground_arrivals(t: Tables) -> DataFrame:
    """The reviews of orders that arrive as a stream of files; the stream ends with what is there now."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/arrivals-{uuid.uuid4().hex}"
    # As a pattern, which a stream takes for one file and for a folder of files alike.
    source = f"{t.sf_dir}/orders.parque[t]"
    arrivals = t.spark.readStream.schema(t.given("orders").schema).option("maxFilesPerTrigger", 64).parquet(source)

    def ground_batch(batch: DataFrame) -> DataFrame:
        return ground_fields(Tables(batch.sparkSession, t.sf_dir, orders=batch))

    writer = ground_stream(arrivals, ground_batch, f"{folder}/reviews", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/reviews").drop("batch")


@query(f"WITH {REVIEWS} SELECT * FROM summary")
def grounding_summary(t: Tables) -> DataFrame:
    return summarize(reviews(t))


@query(f"""WITH {REVIEWS},
keyed AS (SELECT doc_id,
  coalesce(string_agg(field_key, ',' ORDER BY ordinal) FILTER (status = 'missing' AND required), '') AS mk,
  coalesce(string_agg(field_key, ',' ORDER BY ordinal) FILTER (status = 'needs_review'), '') AS rk
  FROM reviews GROUP BY doc_id),
listed AS (
  SELECT doc_id, 0 AS o, 'NO_VALUES_EXTRACTED' AS code, '' AS field_keys FROM summary WHERE present_fields = 0
  UNION ALL SELECT doc_id, 1, 'REQUIRED_FIELDS_MISSING', mk FROM keyed WHERE mk <> ''
  UNION ALL SELECT doc_id, 2, 'FIELDS_REQUIRE_REVIEW', rk FROM keyed WHERE rk <> ''
  UNION ALL SELECT doc_id, 3, 'LOW_CONFIDENCE', '' FROM summary WHERE confidence < 0.75)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS seq, code, field_keys
FROM listed""")
def grounding_warnings(t: Tables) -> DataFrame:
    rows = warnings_of(reviews(t))
    return rows.select("doc_id", "seq", "code", F.array_join("field_keys", ",").alias("field_keys"))


@query(f"""WITH {REVIEWS}
SELECT s.*, d.page_count, length(d.content) AS extracted_characters, 1 AS version
FROM summary s JOIN order_docs d USING (doc_id)""")
def extraction_result(t: Tables) -> DataFrame:
    definitions = t.order_schema.select("schema_id").distinct().withColumn("version", F.lit(1))
    return result_of(t.order_docs, definitions, summarize(reviews(t)))


def _documents(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", F.col("text").alias("content"))


@query(f"""SELECT doc_id, md5({o.minimal('text')}) AS minimal_md5, md5({o.search('text')}) AS search_md5,
  array_to_string(list_distinct({o.emails('text')}), ',') AS emails,
  array_to_string({o.phones('text')}, ',') AS phones, len({o.numbers('text')}) AS numbers FROM @documents""")
def source_representations(t: Tables) -> DataFrame:
    return source_forms(_documents(t)).select(
        "doc_id", F.md5("src_minimal").alias("minimal_md5"), F.md5("src_search").alias("search_md5"),
        F.array_join("src_emails", ",").alias("emails"), F.array_join("src_phones", ",").alias("phones"),
        F.size("src_numbers").alias("numbers"),
    )


@query(f"""WITH found AS (
  SELECT doc_id, 'email' AS kind, list_distinct({o.emails('text')}) AS m FROM @documents
  UNION ALL SELECT doc_id, 'phone', {o.phones('text')} FROM @documents
  UNION ALL SELECT doc_id, 'number', list_transform({o.numbers('text')}, lambda n: CASE WHEN abs(n) < 1e15 THEN printf('%.4f', n) ELSE printf('%.9e', n) END) FROM @documents)
SELECT doc_id, kind, CAST(unnest(range(len(m))) AS INT) AS pos, unnest(m) AS canonical FROM found""")
def mention_index(t: Tables) -> DataFrame:
    return mentions(_documents(t))


@query(f"""WITH v AS (SELECT item_id AS value_id, {o.minimal('text')} AS vm, {o.search('text')} AS vs FROM @benchmark),
d AS (SELECT doc_id, {o.minimal('text')} AS dm, {o.search('text')} AS ds FROM @documents)
SELECT value_id, doc_id, CASE WHEN contains(dm, vm) THEN 'exact' ELSE 'normalized' END AS match_type
FROM v JOIN d ON vm <> '' AND (contains(dm, vm) OR (vs <> '' AND contains(ds, vs)))""")
def corpus_containment(t: Tables) -> DataFrame:
    return ground_in_corpus(_benchmark(t), t.given("documents"), fuzzy=False)


def _benchmark(t: Tables) -> DataFrame:
    return t.given("benchmark").select(F.col("item_id").alias("value_id"), "text")


# A window of w of n tokens with overlap ov has F1 = 2 ov / (w + n) and w >= n - 2, so ov >= 0.85 (n - 1): a document
# without that many of the value's token occurrences is out.
@query(f"""WITH v AS (SELECT value_id, {o.minimal('text')} AS vm, {o.search('text')} AS vs FROM passage_values),
d AS (SELECT doc_id, {o.minimal('text')} AS dm, {o.search('text')} AS ds FROM @documents),
c AS (SELECT value_id, doc_id, CASE WHEN contains(dm, vm) THEN 'exact' ELSE 'normalized' END AS match_type
  FROM v JOIN d ON vm <> '' AND (contains(dm, vm) OR (vs <> '' AND contains(ds, vs)))),
vt AS (SELECT value_id, t, count(*) AS need FROM (SELECT value_id, unnest(string_split(vs, ' ')) AS t FROM v) x GROUP BY ALL),
dt AS (SELECT DISTINCT doc_id, unnest(string_split(ds, ' ')) AS t FROM d),
near AS (SELECT value_id, doc_id, sum(need) AS shared FROM vt JOIN dt USING (t) GROUP BY ALL),
opened AS (SELECT value_id || '/' || doc_id AS pair, value_id, doc_id, vs AS csea, ds AS ssea FROM near JOIN v USING (value_id) JOIN d USING (doc_id)
  ANTI JOIN c USING (value_id, doc_id) WHERE shared + 1e-6 >= 0.85 * (len(string_split(vs, ' ')) - 1)),
{o.fuzzy_tables('SELECT pair, csea, ssea FROM opened', 'pair')}
SELECT value_id, doc_id, match_type FROM c
UNION ALL SELECT value_id, doc_id, 'fuzzy' FROM fz JOIN opened USING (pair)""")
def corpus_grounding(t: Tables) -> DataFrame:
    """With the fuzzy rung."""
    return ground_in_corpus(t.passage_values, t.given("documents"))


ISSUE_TYPED = f"""CASE
  WHEN kind IN ('number','currency') THEN CASE WHEN v_num IS NULL OR isnan(v_num) OR isinf(v_num) THEN 'invalid_type' END
  WHEN v_str IS NULL THEN 'invalid_type'
  WHEN kind = 'email' AND (NOT regexp_full_match(v_str, '[A-Za-z0-9_''+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\\.)+[A-Za-z]{{2,}}')
    OR v_str LIKE '.%' OR contains(v_str, '..')) THEN 'invalid_format'
  WHEN kind = 'date' AND NOT {o.iso_date('v_str')} THEN 'invalid_format'
  WHEN kind = 'select' AND v_str NOT IN ('O','F','P') THEN 'invalid_value' END"""

KEYED = """
f AS (SELECT d.doc_id, d.schema_id, s.ordinal, s.field_key, s.kind, s.required
      FROM order_docs d JOIN order_schema s ON s.schema_id = d.schema_id),
sides AS (SELECT coalesce(f.doc_id, v.doc_id) AS doc_id, coalesce(f.field_key, v.field_key) AS path,
  coalesce(f.ordinal, 10000) AS place, f.kind, f.required, v.v_str, v.v_num, v.doc_id IS NOT NULL AS given
  FROM f FULL JOIN order_values v ON v.doc_id = f.doc_id AND v.schema_id = f.schema_id AND v.field_key = f.field_key)"""

EXTRACTION_ISSUES = f"""{KEYED},
issues AS (SELECT doc_id, path, place, CASE WHEN kind IS NULL THEN 'unrecognized_keys' WHEN NOT given THEN 'invalid_type'
  WHEN v_str IS NULL AND v_num IS NULL THEN NULL ELSE {ISSUE_TYPED} END AS code FROM sides)"""

SUBMISSION_ISSUES = f"""{KEYED},
issues AS (SELECT doc_id, path, place, CASE WHEN kind IS NULL THEN 'unrecognized_keys'
  WHEN v_str IS NULL AND v_num IS NULL THEN CASE WHEN required THEN 'invalid_type' END
  WHEN required AND kind IN ('text','textarea','phone') AND trim(v_str) = '' THEN 'custom'
  WHEN required OR kind IN ('text','textarea','phone','number','currency') THEN {ISSUE_TYPED}
  WHEN v_str = '' THEN NULL WHEN {ISSUE_TYPED} IS NOT NULL THEN 'invalid_union' END AS code FROM sides)"""


def _order_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return t.order_docs, t.order_schema, t.order_options, t.order_values


@query(f"WITH {EXTRACTION_ISSUES} SELECT doc_id, path, place, code FROM issues WHERE code IS NOT NULL")
def extraction_violations(t: Tables) -> DataFrame:
    return validate_extraction(*_order_tables(t))


@query(f"WITH {SUBMISSION_ISSUES} SELECT doc_id, path, place, code FROM issues WHERE code IS NOT NULL")
def submission_violations(t: Tables) -> DataFrame:
    return validate_submission(*_order_tables(t))


@query(f"""WITH {SUBMISSION_ISSUES},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, path, code) AS rank FROM issues WHERE code IS NOT NULL)
SELECT doc_id, count(*) AS issue_count, string_agg(code, ',' ORDER BY rank) FILTER (rank <= 8) AS codes,
  string_agg(path, '|' ORDER BY rank) FILTER (rank <= 8) AS paths,
  min_by(path, rank) AS first_field, min_by(code, rank) AS first_reason FROM r GROUP BY doc_id""")
def violation_digest(t: Tables) -> DataFrame:
    return violation_summary(validate_submission(*_order_tables(t)))


@query("""WITH sent AS (SELECT k AS doc_id,
  CASE k % 6 WHEN 0 THEN ' basic-invoice ' WHEN 1 THEN '  ' WHEN 2 THEN repeat('x', 101) WHEN 3 THEN 'receipt'
    ELSE 'basic-invoice' END AS s,
  CASE k % 4 WHEN 0 THEN 'basic-invoice-default' WHEN 1 THEN 'other' ELSE 'basic-invoice-default' END AS t FROM order_facts),
u AS (SELECT doc_id, trim(s) AS s, trim(t) AS t FROM sent)
SELECT doc_id, CASE WHEN s = '' THEN 'too_small' WHEN length(s) > 100 THEN 'too_big'
  WHEN s NOT IN ('basic-invoice', 'job-application') THEN 'unknown_schema' ELSE 'unknown_template' END AS code
FROM u WHERE s <> 'basic-invoice' OR t <> 'basic-invoice-default'""")
def envelope_violations(t: Tables) -> DataFrame:
    k = F.col("k")
    schema = (
        F.when(k % 6 == 0, " basic-invoice ").when(k % 6 == 1, "  ").when(k % 6 == 2, F.lit("x" * 101))
        .when(k % 6 == 3, "receipt").otherwise("basic-invoice")
    )
    template = F.when(k % 4 == 1, "other").otherwise("basic-invoice-default")
    sent = t.order_facts.select(k.alias("doc_id"), schema.alias("schema_id"), template.alias("template_id"))
    return validate_envelope(sent, load_definitions(t.spark), load_templates(t.spark))
