"""Derived inputs for schema audits, responses, edits and stored results.

Rows vary with their key so that each rule is broken by some of them.
"""

from __future__ import annotations

from groundline.plans.inputs import INPUTS

# --- one registered form per customer -------------------------------------------------
INPUTS["forms"] = """
SELECT CASE c_custkey % 40 WHEN 1 THEN concat('9form-', CAST(c_custkey AS STRING))
         WHEN 2 THEN 'form-shared' ELSE concat('form-', CAST(c_custkey AS STRING)) END AS schema_id,
       CAST(c_custkey % 30 AS INT) AS version,
       CASE c_custkey % 50 WHEN 3 THEN '  ' ELSE c_name END AS label,
       CASE c_custkey % 60 WHEN 4 THEN '' ELSE concat('Form of the ', c_mktsegment, ' desk.') END AS description,
       c_custkey AS k
FROM @customer
"""
INPUTS["form_fields"] = """
SELECT schema_id, k, ordinal, CASE WHEN k % 21 = 5 AND ordinal = 2 THEN 'fullName'
         WHEN k % 22 = 6 AND ordinal = 3 THEN 'start date' ELSE field_key END AS field_key,
       CASE WHEN k % 23 = 7 AND ordinal = 1 THEN ' ' ELSE label END AS label,
       CASE WHEN k % 25 = 8 AND ordinal = 4 THEN '' ELSE concat(label, ' of the applicant.') END AS description,
       kind, required,
       CASE WHEN k % 26 = 9 AND ordinal = 4 THEN 'form.full_name' WHEN k % 27 = 10 AND ordinal = 5 THEN ' '
         ELSE pdf_field END AS pdf_field
FROM (SELECT schema_id, k FROM forms) AS d CROSS JOIN (VALUES
  (1, 'fullName', 'Full name', 'text', true, 'form.full_name'),
  (2, 'email', 'Email', 'email', true, 'form.email'),
  (3, 'startDate', 'Start date', 'date', false, 'form.start_date'),
  (4, 'salary', 'Salary', 'currency', false, 'form.salary'),
  (5, 'level', 'Level', 'select', true, 'form.level'))
  AS f(ordinal, field_key, label, kind, required, pdf_field)
"""
INPUTS["form_options"] = """
SELECT schema_id, k, 'level' AS field_key, option_ix,
       CASE WHEN k % 17 = 3 AND option_ix = 1 THEN 'junior' ELSE value END AS value,
       CASE WHEN k % 18 = 4 AND option_ix = 0 THEN ' ' ELSE label END AS label
FROM (SELECT schema_id, k FROM forms) AS d CROSS JOIN (VALUES (0, 'junior', 'Junior'), (1, 'senior', 'Senior'), (2, 'lead', 'Lead "A"'))
  AS o(option_ix, value, label) WHERE k % 35 <> 11
"""
INPUTS["form_templates"] = """
SELECT schema_id, k, CASE WHEN k % 19 = 2 THEN 'plain form' WHEN k % 20 = 3 THEN 'form-default' ELSE template_id END
         AS template_id,
       CASE WHEN k % 31 = 4 THEN '' ELSE label END AS label,
       CASE WHEN k % 32 = 5 THEN ' ' ELSE concat('templates/', template_id, '.pdf') END AS asset_path,
       flatten_by_default
FROM (SELECT schema_id, k FROM forms) AS d CROSS JOIN (VALUES ('form-default', 'Default', true), ('form-wide', 'Wide', false))
  AS t(template_id, label, flatten_by_default) WHERE k % 37 <> 12
"""
INPUTS["template_fields"] = """
SELECT schema_id, template_id, CASE WHEN k % 7 = 2 AND pdf_field = 'form.email' THEN 'form.mail'
         WHEN k % 7 = 4 AND pdf_field = 'form.email' THEN 'form.full_name' ELSE pdf_field END AS pdf_field
FROM (SELECT k, schema_id, template_id FROM clean_forms) AS c CROSS JOIN (VALUES ('form.full_name'), ('form.email'),
  ('form.start_date'), ('form.salary'), ('form.level')) AS p(pdf_field)
WHERE k % 11 <> 6
"""
INPUTS["clean_forms"] = """
SELECT k, concat('form-', CAST(k AS STRING)) AS schema_id, 'form-default' AS template_id FROM forms
"""
INPUTS["clean_fields"] = """
SELECT concat('form-', CAST(k AS STRING)) AS schema_id, pdf_field
FROM (SELECT k FROM forms) AS d CROSS JOIN (VALUES ('form.full_name'), ('form.email'), ('form.start_date'), ('form.salary'), ('form.level'))
  AS p(pdf_field)
"""

# --- one rough discovered schema per customer -----------------------------------------
INPUTS["rough_schemas"] = """
SELECT c_custkey AS schema_id, CASE c_custkey % 13 WHEN 1 THEN 'Invoice' WHEN 2 THEN 'purchase_order' ELSE 'invoice' END
         AS document_type,
       CASE c_custkey % 14 WHEN 2 THEN '' ELSE 'Invoice' END AS document_type_label,
       CASE c_custkey % 15 WHEN 3 THEN 'english_GB' WHEN 4 THEN NULL WHEN 5 THEN 'en-GB' ELSE 'no' END AS language,
       CASE c_custkey % 16 WHEN 4 THEN repeat('t', 201) WHEN 5 THEN NULL ELSE c_name END AS title,
       CASE c_custkey % 17 WHEN 6 THEN 2 ELSE 1 END AS schema_version
FROM @customer
"""
INPUTS["rough_sections"] = """
SELECT schema_id, CASE WHEN schema_id % 19 = 3 THEN 'main' ELSE section_id END AS section_id, section_ix,
       CASE WHEN schema_id % 20 = 4 THEN repeat('l', 121) ELSE label END AS label,
       CASE WHEN schema_id % 21 = 5 AND section_ix = 1 THEN repeat('d', 501) ELSE '' END AS description
FROM rough_schemas CROSS JOIN (VALUES ('main', 0, 'Main'), ('parties', 1, 'Parties')) AS s(section_id, section_ix, label)
"""
INPUTS["rough_fields"] = """
SELECT schema_id, CASE WHEN schema_id % 22 = 1 THEN 'main' ELSE section_id END AS section_id, section_ix,
       section_ix * 10 + ordinal AS ordinal,
       CASE WHEN schema_id % 23 = 2 AND ordinal = 1 THEN 'number' WHEN schema_id % 24 = 3 AND ordinal = 2 THEN 'Total Due'
         ELSE field_id END AS field_id,
       CASE WHEN schema_id % 25 = 4 AND ordinal = 0 THEN ' ' ELSE label END AS label, '' AS description,
       CASE WHEN schema_id % 26 = 5 AND ordinal = 1 THEN 'money' ELSE value_type END AS value_type, repeatable, required
FROM rough_schemas CROSS JOIN (VALUES
  ('main', 0, 0, 'number', 'Number', 'identifier', false, true), ('main', 0, 1, 'issued', 'Issued', 'date', false, true),
  ('main', 0, 2, 'total', 'Total', 'currency', false, true), ('main', 0, 3, 'status', 'Status', 'select', false, false),
  ('parties', 1, 0, 'names', 'Names', 'text', true, false), ('parties', 1, 1, 'kinds', 'Kinds', 'select', true, false),
  ('parties', 1, 2, 'settled', 'Settled', 'boolean', false, false))
  AS f(section_id, section_ix, ordinal, field_id, label, value_type, repeatable, required)
WHERE NOT (schema_id % 27 = 6 AND section_ix = 1)
"""
INPUTS["rough_options"] = """
SELECT schema_id, CASE WHEN schema_id % 28 = 7 AND field_id = 'kinds' THEN 'total' ELSE field_id END AS field_id, option_ix,
       CASE WHEN schema_id % 29 = 8 THEN 'open' ELSE value END AS value,
       CASE WHEN schema_id % 30 = 9 AND option_ix = 1 THEN 'OPEN' ELSE label END AS label
FROM rough_schemas CROSS JOIN (VALUES ('status', 0, 'open', 'Open'), ('status', 1, 'paid "net"', 'Paid'),
  ('kinds', 0, 'buyer', 'Buyer'), ('kinds', 1, 'seller', 'Seller')) AS o(field_id, option_ix, value, label)
"""
INPUTS["rough_tables"] = """
SELECT schema_id, CASE WHEN schema_id % 31 = 1 THEN 'lines' ELSE table_id END AS table_id, table_ix, label, '' AS description
FROM rough_schemas CROSS JOIN (VALUES ('lines', 0, 'Lines'), ('fees', 1, 'Fees')) AS t(table_id, table_ix, label)
"""
INPUTS["rough_columns"] = """
SELECT schema_id, table_id, table_ix, ordinal,
       CASE WHEN schema_id % 32 = 2 AND ordinal = 1 THEN 'item' ELSE column_id END AS column_id, label, '' AS description,
       CASE WHEN schema_id % 33 = 3 AND ordinal = 0 THEN 'long_text' ELSE value_type END AS value_type, required
FROM rough_schemas CROSS JOIN (VALUES ('lines', 0, 0, 'item', 'Item', 'text', true),
  ('lines', 0, 1, 'amount', 'Amount', 'currency', true), ('fees', 1, 0, 'fee', 'Fee', 'text', false))
  AS c(table_id, table_ix, ordinal, column_id, label, value_type, required)
WHERE NOT (schema_id % 34 = 4 AND table_id = 'fees')
"""

# --- a wide schema per customer for batch packing -------------------------------------
INPUTS["wide_fields"] = """
SELECT c_custkey AS schema_id, CAST(floor(n / 50) AS INT) AS section_ix, CAST(n % 50 AS INT) AS ordinal,
       concat('field_', CASE WHEN c_custkey % 3 = 0 THEN repeat('x', 60) ELSE '' END,
              CAST(CAST(n AS INT) AS STRING)) AS field_id,
       CASE n % 5 WHEN 0 THEN 'currency' WHEN 1 THEN 'select' ELSE 'text' END AS value_type, n % 7 = 0 AS repeatable
FROM (SELECT c_custkey, CAST(floor(tens * 10 + ones) AS INT) AS n FROM @customer
  CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS a(tens)
  CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS b(ones)) AS w
WHERE n < 52
"""
INPUTS["wide_options"] = """
SELECT schema_id, field_id, option_ix, concat(CASE WHEN schema_id % 5 = 0 THEN repeat('long value ', 90) ELSE 'value "' END,
       CAST(option_ix AS STRING)) AS value
FROM wide_fields CROSS JOIN (VALUES (0), (1), (2)) AS o(option_ix)
WHERE value_type = 'select'
"""

# --- raw value rows of the orders' discovered schemas, with every kind of fault -------
INPUTS["raw_field_values"] = """
SELECT k AS doc_id, k AS schema_id,
       CASE WHEN k % 41 = 1 AND field_id = 'remark' THEN 'surprise' ELSE field_id END AS field_id,
       CASE WHEN field_id = 'parties' THEN CASE WHEN k % 29 = 2 THEN NULL WHEN k % 31 = 3 THEN -1 ELSE 0 END
         WHEN field_id = 'remark' AND k % 37 = 5 THEN 0 ELSE NULL END AS item_ix,
       CASE field_id WHEN 'invoice_number' THEN CASE k % 43 WHEN 1 THEN '   ' WHEN 2 THEN repeat('9', 501) ELSE 'INV-1' END
         WHEN 'order_date' THEN CASE k % 47 WHEN 3 THEN '2024-02-30' ELSE iso_day END
         WHEN 'contact_email' THEN CASE k % 11 WHEN 4 THEN 'not an address' ELSE 'desk@north.example.com' END
         WHEN 'contact_phone' THEN CASE k % 13 WHEN 5 THEN NULL ELSE '555 1000000' END
         WHEN 'parties' THEN CASE WHEN k % 31 = 3 THEN NULL WHEN k % 23 = 4 THEN NULL ELSE party END
         WHEN 'priority' THEN CASE k % 17 WHEN 6 THEN '9-NEVER' WHEN 7 THEN NULL ELSE priority END
         WHEN 'paid' THEN CASE k % 19 WHEN 8 THEN 'yes' ELSE NULL END
         WHEN 'remark' THEN CASE k % 2 WHEN 0 THEN 'seen' ELSE NULL END ELSE NULL END AS v_str,
       CASE field_id WHEN 'total' THEN CASE k % 53 WHEN 9 THEN NULL ELSE CAST(price AS DOUBLE) END ELSE NULL END AS v_num,
       CASE field_id WHEN 'paid' THEN CASE k % 19 WHEN 8 THEN NULL ELSE k % 2 = 0 END ELSE NULL END AS v_bool
FROM order_facts CROSS JOIN (VALUES ('invoice_number'), ('order_date'), ('total'), ('contact_email'), ('contact_phone'),
  ('parties'), ('paid'), ('priority'), ('remark')) AS f(field_id)
WHERE NOT (k % 59 = 10 AND field_id = 'total')
"""
INPUTS["raw_cell_values"] = """
SELECT doc_id, schema_id, table_id, row_ix,
       CASE WHEN doc_id % 61 = 1 AND column_id = 'ship_date' THEN 'eta' ELSE column_id END AS column_id,
       CASE WHEN doc_id % 67 = 2 AND column_id = 'quantity' THEN 'many' ELSE v_str END AS v_str,
       CASE WHEN doc_id % 67 = 2 AND column_id = 'quantity' THEN NULL ELSE v_num END AS v_num, v_bool
FROM notice_cell_values
"""

# --- stored results with faults -------------------------------------------------------
INPUTS["claimed_reviews"] = """
SELECT doc_id, schema_id, field_key,
       CASE WHEN (doc_id + ordinal) % 29 = 1 THEN 'verified' WHEN (doc_id + ordinal) % 31 = 2 THEN 'missing'
         WHEN found THEN 'verified' ELSE 'missing' END AS status,
       CASE WHEN (doc_id + ordinal) % 29 = 1 THEN 'fuzzy' WHEN found THEN 'exact' ELSE 'none' END AS match_type,
       CASE WHEN (doc_id + ordinal) % 31 = 2 OR NOT found THEN 0.0E0 ELSE 1.0E0 END AS confidence
FROM (SELECT d.doc_id, d.schema_id, f.field_key, f.ordinal, v.v_str IS NOT NULL OR v.v_num IS NOT NULL AS found
  FROM order_docs d JOIN order_schema f ON f.schema_id = d.schema_id
  LEFT JOIN order_values v ON v.doc_id = d.doc_id AND v.schema_id = f.schema_id AND v.field_key = f.field_key) AS x
WHERE NOT ((doc_id + ordinal) % 101 = 3)
"""
INPUTS["claimed_meta"] = """
SELECT k AS doc_id, CAST(k % 9 AS BIGINT) AS verified_fields, CAST(k % 2 AS BIGINT) AS needs_review_fields,
       CAST(k % 6 AS BIGINT) AS missing_fields, CAST(k % 3 AS BIGINT) AS required_missing_fields,
       CASE k % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.9E0 ELSE 0.5E0 END AS confidence, k % 5 <> 0 AS review_required
FROM order_facts
"""
INPUTS["claimed_warning_keys"] = """
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'notes' WHEN 1 THEN 'total' ELSE 'salary' END AS field_key FROM order_facts
"""
INPUTS["claimed_value_reviews"] = """
SELECT schema_id AS doc_id, field_id,
       CASE (schema_id + ordinal) % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'needs_review' ELSE 'verified' END AS status,
       CASE (schema_id + ordinal) % 14 WHEN 0 THEN 0.25E0 WHEN 7 THEN 0.0E0 ELSE 0.95E0 END AS confidence,
       CAST((schema_id + ordinal) % 5 AS INT) AS evidence_count
FROM notice_fields
"""
INPUTS["claimed_table_reviews"] = """
SELECT schema_id AS doc_id, table_id, CASE (schema_id + table_ix) % 3 WHEN 0 THEN 'missing' ELSE 'verified' END AS status,
       CASE (schema_id + table_ix) % 3 WHEN 0 THEN 0.0E0 ELSE 0.95E0 END AS confidence,
       CAST((schema_id + table_ix) % 4 AS INT) AS evidence_count, CAST((schema_id + table_ix) % 3 AS BIGINT) AS row_count
FROM (SELECT DISTINCT schema_id, table_id, table_ix FROM notice_columns) AS t
"""
INPUTS["claimed_results"] = """
SELECT k AS doc_id, CASE k % 10 WHEN 3 THEN 'receipt' ELSE 'order_notice' END AS detected_type,
       CASE k % 4 WHEN 0 THEN 0.6E0 ELSE 0.9E0 END AS confidence, k % 3 = 0 AS review_required
FROM order_facts
"""
INPUTS["claimed_warning_ids"] = """
SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN 'total' WHEN 1 THEN 'items' WHEN 2 THEN 'fees' ELSE 'ghost' END AS id FROM order_facts
"""

# --- responses, attempts and failures from the event log ------------------------------
INPUTS["responses"] = """
SELECT event_id AS doc_id, CASE event_id % 9 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN concat(props, '}')
         WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{"k": "seven"}' WHEN 5 THEN '{"k": null, "x": true}'
         WHEN 6 THEN concat('{"fields": {"a.b": "dotted", "parties": ["one", null, "two"], "none": [], "paid": ', CASE user_id % 2 WHEN 0 THEN 'true' ELSE 'null' END,
           ', "total": ', CAST(user_id AS STRING), '.5}, "tables": {"items": [{"part": "P-', CAST(event_id AS STRING), '", "quantity": ', CAST(user_id AS STRING),
           '}, {"part": null, "paid": false}], "fees": []}}')
         ELSE props END AS body
FROM @events
"""
INPUTS["attempt_log"] = """
SELECT user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'discovery' WHEN 'error' THEN 'discovery' ELSE 'extraction' END AS stage,
       event_type AS batch_id,
       CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INT) AS attempt,
       event_id % 3 = 1 AS correction,
       CASE event_id % 4 WHEN 0 THEN 'strict_schema' WHEN 1 THEN 'best_effort_schema' WHEN 2 THEN 'json_object'
         ELSE 'strict_schema' END AS mode,
       CASE event_id % 3 WHEN 0 THEN 12000 WHEN 1 THEN 6000 ELSE 3000 END AS budget,
       CASE event_id % 7 WHEN 0 THEN 400 WHEN 1 THEN 413 WHEN 2 THEN 500 ELSE 200 END AS http_status,
       event_id % 14 = 0 AS generated_mismatch, event_id % 11 = 5 AND event_id % 7 > 2 AS valid,
       CAST(1000 + event_id % 16000 AS INT) AS content_chars
FROM @events
"""
INPUTS["failure_log"] = """
SELECT event_id AS request_id,
       CASE event_id % 9 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 413 WHEN 4 THEN 429 WHEN 5 THEN 503
         WHEN 6 THEN 404 WHEN 7 THEN 200 ELSE NULL END AS http_status,
       CASE event_id % 4 WHEN 0 THEN 'invalid_request_error' WHEN 1 THEN NULL ELSE event_type END AS error_type,
       CASE event_id % 10 WHEN 3 THEN 'blocked_api_access' WHEN 6 THEN 'context_length_exceeded' ELSE NULL END AS error_code,
       CASE event_id % 8 WHEN 0 THEN 'The response_format was refused' WHEN 1 THEN 'Invalid JSON Schema near total'
         WHEN 2 THEN concat('The model m', CAST(user_id AS STRING), ' was not found')
         WHEN 3 THEN concat('Write to desk', CAST(user_id AS STRING), '@north.example.com  or call +47 555 1000', CAST(100 + user_id % 900 AS STRING))
         WHEN 4 THEN concat('Bad key gsk_abcdefgh', CAST(user_id AS STRING), '   was sent')
         ELSE NULL END AS message,
       event_id % 5 = 2 AS timed_out
FROM @events
"""

# --- passages as they are, and once more with their last word changed -----------------
INPUTS["passage_values"] = """
SELECT concat('P', CAST(item_id AS STRING)) AS value_id, text FROM @benchmark
UNION ALL SELECT concat('Q', CAST(item_id AS STRING)), regexp_replace(text, '[^ ]+$', 'otherwise') FROM @benchmark
"""

# --- reviewer edits -------------------------------------------------------------------
INPUTS["edits"] = """
SELECT k AS doc_id, CAST(seq AS BIGINT) AS seq,
       CASE WHEN seq < 3 THEN 'set_field' WHEN seq = 3 THEN 'add_row' WHEN seq = 4 THEN 'remove_row' ELSE 'set_cell' END AS op,
       CASE WHEN seq < 3 THEN CASE k % 2 WHEN 0 THEN 'company' ELSE 'customerName' END ELSE 'items' END AS target_id,
       CAST(CASE seq WHEN 4 THEN k % 3 WHEN 5 THEN 1 ELSE 0 END AS INT) AS row_ix,
       CASE WHEN seq > 4 THEN 'part' ELSE NULL END AS column_id,
       CASE WHEN seq < 3 THEN CASE (k + seq) % 4 WHEN 0 THEN NULL ELSE concat('edited ', CAST(seq AS STRING)) END
         WHEN seq > 4 THEN concat('cell ', CAST(seq AS STRING)) ELSE NULL END AS v_str
FROM order_facts CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS s(seq)
"""
