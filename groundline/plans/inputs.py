"""Input tables that the registered queries derive from the given tables.

Each entry is one SELECT in SQL that Spark and a reference SQL engine both run,
so the derivation of inputs is shared while the operators themselves are not.
``@name`` is a given table; a bare name listed here is another derived input.
Keys (``k % n``) only vary the content of a row; every row of the given tables
is used.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession


GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

GIVEN_MARK = re.compile(r"@(" + "|".join(GIVEN) + r")\b")

INPUTS: dict[str, str] = {}

# Customers whose catalogs one task makes, orders whose schemas one task makes, and orders whose text one task looks into.
ROWS_PER_TASK = 1 << 14
ORDERS_PER_TASK = 1 << 16
TEXTS_PER_TASK = 1 << 13

# --- orders as notices and invoices -------------------------------------------------

INPUTS["order_facts"] = """
SELECT o_orderkey AS k, c_custkey AS cust, o_orderstatus AS status, o_orderpriority AS priority,
       CAST(o_totalprice AS DECIMAL(18,2)) AS price,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price_text,
       substr(CAST(o_orderdate AS STRING), 1, 10) AS iso_day,
       year(o_orderdate) AS yy, month(o_orderdate) AS mm, day(o_orderdate) AS dd,
       concat(c_mktsegment, ' Trading House number ', CAST(c_custkey AS STRING),
              ' of district ', CAST(c_nationkey AS STRING)) AS party,
       CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March'
         WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July'
         WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October'
         WHEN 11 THEN 'November' ELSE 'December' END AS month_name,
       CASE o_orderstatus WHEN 'O' THEN 'Open order' WHEN 'F' THEN 'Filled order'
         ELSE 'Part shipped' END AS status_label
FROM @orders JOIN @customer ON o_custkey = c_custkey
"""

INPUTS["order_docs"] = """
SELECT k AS doc_id,
       CASE WHEN k % 2 = 0 THEN 'order-notice' ELSE 'basic-invoice' END AS schema_id,
       CAST(1 + k % 4 AS INT) AS page_count,
       concat_ws(chr(10),
         'ORDER NOTICE', concat('Number: INV-', CAST(k AS STRING)),
         'Issued by: Northgate Paper & Supply Co.', 'Address: 12 Quay Road, Bergen',
         concat('Bill to: ', party),
         concat('Contact: desk', CAST(cust AS STRING),
                CASE k % 3 WHEN 0 THEN '@north.example.com' WHEN 1 THEN ' @ north . example . com'
                  ELSE '@North.Example.COM' END),
         concat('Phone: +47 ', CASE k % 2 WHEN 0 THEN '(' ELSE '' END, '555', CASE k % 2 WHEN 0
                THEN ') ' ELSE '-' END, CAST(1000000 + cust AS STRING)),
         concat('Date: ', CASE k % 5
           WHEN 0 THEN iso_day
           WHEN 1 THEN concat(month_name, ' ', CAST(dd AS STRING), ', ', CAST(yy AS STRING))
           WHEN 2 THEN concat(CAST(dd AS STRING), ' ', substr(month_name, 1, 3), ' ', CAST(yy AS STRING))
           WHEN 3 THEN concat(substr(iso_day, 9, 2), '/', substr(iso_day, 6, 2), '/', CAST(yy AS STRING))
           ELSE concat(CAST(dd AS STRING),
                CASE WHEN dd IN (1, 21, 31) THEN 'st' WHEN dd IN (2, 22) THEN 'nd'
                  WHEN dd IN (3, 23) THEN 'rd' ELSE 'th' END,
                ' of ', month_name, ' ', CAST(yy AS STRING)) END),
         concat('Status: ', status_label),
         concat(CASE k % 4 WHEN 0 THEN 'TOTAL ' WHEN 1 THEN 'Total due: USD ' WHEN 2 THEN 'Total: $'
                  ELSE 'Balance: ' END,
                CASE WHEN k % 4 = 3 THEN concat('(', price_text, ') EUR')
                  WHEN length(price_text) > 6 THEN concat(substr(price_text, 1, length(price_text) - 6),
                    ',', substr(price_text, length(price_text) - 5)) ELSE price_text END),
         'Terms: Net 30',
         concat('Note: Deliver to caf', chr(233), ' gate ', CAST(k % 17 AS STRING),
                ', ask for the shift lead before unloading.')) AS content
FROM order_facts
"""

INPUTS["order_schema"] = """
SELECT * FROM (VALUES
  ('order-notice', 1, 'name', 'Name', 'text', true),
  ('order-notice', 2, 'company', 'Company', 'text', false),
  ('order-notice', 3, 'notes', 'Notes', 'textarea', false),
  ('order-notice', 4, 'email', 'Email', 'email', true),
  ('order-notice', 5, 'phone', 'Phone', 'phone', false),
  ('order-notice', 6, 'date', 'Date', 'date', true),
  ('order-notice', 7, 'amount', 'Amount', 'currency', true),
  ('order-notice', 8, 'status', 'Status', 'select', false),
  ('basic-invoice', 1, 'issuerName', 'Issuer name', 'text', true),
  ('basic-invoice', 2, 'issuerAddress', 'Issuer address', 'textarea', true),
  ('basic-invoice', 3, 'customerName', 'Customer name', 'text', true),
  ('basic-invoice', 4, 'customerAddress', 'Customer address', 'textarea', false),
  ('basic-invoice', 5, 'invoiceNumber', 'Invoice number', 'text', true),
  ('basic-invoice', 6, 'issueDate', 'Issue date', 'date', true),
  ('basic-invoice', 7, 'dueDate', 'Due date', 'date', false),
  ('basic-invoice', 8, 'currency', 'Currency', 'text', true),
  ('basic-invoice', 9, 'subtotal', 'Subtotal', 'currency', true),
  ('basic-invoice', 10, 'tax', 'Tax', 'currency', false),
  ('basic-invoice', 11, 'total', 'Total', 'currency', true),
  ('basic-invoice', 12, 'paymentTerms', 'Payment terms', 'text', false),
  ('basic-invoice', 13, 'notes', 'Notes', 'textarea', false))
  AS t(schema_id, ordinal, field_key, label, kind, required)
"""

INPUTS["order_options"] = """
SELECT * FROM (VALUES
  ('order-notice', 'status', 1, 'O', 'Open order'),
  ('order-notice', 'status', 2, 'F', 'Filled order'),
  ('order-notice', 'status', 3, 'P', 'Part shipped'))
  AS t(schema_id, field_key, option_ix, value, label)
"""

INPUTS["order_values"] = """
SELECT k AS doc_id, schema_id,
       CASE WHEN field_key = 'notes' AND k % 11 = 0 THEN 'remark' ELSE field_key END AS field_key,
       CASE WHEN k % 13 = 5 AND field_key IN ('email', 'total', 'issueDate') THEN NULL
       ELSE CASE field_key
         WHEN 'name' THEN concat('inv-', CAST(k AS STRING))
         WHEN 'company' THEN CASE k % 7 WHEN 1 THEN upper(party)
           WHEN 2 THEN concat('House Trading ', party) WHEN 3 THEN 'Unlisted Vendor of Nowhere'
           WHEN 4 THEN NULL WHEN 5 THEN replace(party, ' ', '-') WHEN 6 THEN '' ELSE party END
         WHEN 'notes' THEN CASE k % 3
           WHEN 0 THEN 'ask for the shift lead before unloading'
           WHEN 1 THEN concat('Deliver to cafe gate ', CAST(k % 17 AS STRING))
           ELSE 'ask before unloading the shift lead for' END
         WHEN 'email' THEN concat('desk', CAST(cust AS STRING), CASE k % 7 WHEN 3
           THEN '@south.example.com' WHEN 4 THEN '-at-north' ELSE '@north.example.com' END)
         WHEN 'phone' THEN CASE k % 6 WHEN 0 THEN '12345' ELSE
           concat('+47 555 ', CAST(1000000 + cust + CASE k % 9 WHEN 1 THEN 1 ELSE 0 END AS STRING)) END
         WHEN 'date' THEN CASE k % 10 WHEN 9 THEN '2021-02-30' ELSE iso_day END
         WHEN 'status' THEN CASE k % 8 WHEN 6 THEN 'X' ELSE status END
         WHEN 'issuerName' THEN 'Northgate Paper & Supply Co'
         WHEN 'issuerAddress' THEN '12 Quay Road Bergen'
         WHEN 'customerName' THEN CASE k % 5 WHEN 0 THEN lower(party) WHEN 1
           THEN concat('District ', party) ELSE party END
         WHEN 'invoiceNumber' THEN concat('INV-', CAST(k + k % 2 - 1 AS STRING))
         WHEN 'issueDate' THEN CASE k % 10 WHEN 7 THEN concat(substr(iso_day, 1, 8), '31') ELSE iso_day END
         WHEN 'currency' THEN CASE k % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'usd' END
         WHEN 'paymentTerms' THEN 'Net 30'
         WHEN 'subtotal' THEN CASE k % 6 WHEN 1 THEN price_text ELSE NULL END
         ELSE NULL END END AS v_str,
       CASE WHEN k % 13 = 5 THEN NULL ELSE CASE field_key
         WHEN 'amount' THEN CAST(price AS DOUBLE)
         WHEN 'subtotal' THEN CASE k % 6 WHEN 1 THEN NULL ELSE CAST(price AS DOUBLE) END
         WHEN 'total' THEN CASE k % 4 WHEN 3 THEN -CAST(price AS DOUBLE)
           ELSE CAST(price AS DOUBLE) + CASE k % 7 WHEN 0 THEN 0.01 ELSE 0 END END
         WHEN 'tax' THEN CASE k % 2 WHEN 0 THEN 0.0 ELSE NULL END
         ELSE NULL END END AS v_num
FROM (SELECT f.*, CASE WHEN f.k % 2 = 0 THEN 'order-notice' ELSE 'basic-invoice' END AS schema_id
      FROM order_facts f) AS facts
JOIN (SELECT schema_id AS field_schema, field_key FROM order_schema) AS fields
  ON schema_id = field_schema
"""

# --- the same orders as documents with their own discovered schema ------------------

INPUTS["notice_docs"] = """
SELECT k AS doc_id, k AS schema_id, 'pdf' AS source_format, 'page' AS content_unit,
       CAST(1 + k % 3 AS INT) AS content_unit_count, 'order_notice' AS document_type,
       CASE k % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'en-GB' ELSE NULL END AS language,
       CASE k % 4 WHEN 0 THEN NULL ELSE concat('Order notice / ', CAST(k AS STRING)) END AS title,
       k % 19 = 0 AS input_truncated
FROM order_facts
"""

INPUTS["notice_blocks"] = """
SELECT k AS doc_id, block_ix, CASE block_ix
         WHEN 0 THEN concat('  Notice INV-', CAST(k AS STRING), ' issued ', CASE k % 3
           WHEN 0 THEN iso_day
           WHEN 1 THEN concat(month_name, ' ', CAST(dd AS STRING), ', ', CAST(yy AS STRING))
           ELSE concat(substr(iso_day, 9, 2), '.', substr(iso_day, 6, 2), '.', CAST(yy AS STRING)) END)
         WHEN 1 THEN concat('Bill to: ', party)
         WHEN 2 THEN concat('Reach us: desk', CAST(cust AS STRING), ' @ north.example.com, tel. (555) ',
                            CAST(1000000 + cust AS STRING))
         WHEN 3 THEN concat('Total due: USD ', price_text)
         WHEN 4 THEN concat('Paid: ', CASE k % 2 WHEN 0 THEN 'yes' ELSE 'no' END, ' / checked by desk')
         WHEN 5 THEN concat('Priority ', priority)
         ELSE concat('Bill to: ', party) END AS content,
       CAST(1 + block_ix % 2 AS INT) AS page_number
FROM order_facts CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS b(block_ix)
"""

INPUTS["notice_lines"] = """
SELECT l_orderkey AS k, l_partkey AS part, l_quantity AS qty,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price_text,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
       substr(CAST(l_shipdate AS STRING), 1, 10) AS ship_day, l_returnflag AS flag,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS INT) AS row_ix
FROM @lineitem
"""

INPUTS["notice_cells"] = """
SELECT k AS doc_id, 0 AS table_ix, CAST(row_ix * 4 + column_index AS INT) AS cell_ix,
       row_ix AS row_index, column_index,
       CASE column_index WHEN 0 THEN concat('P-', CAST(part AS STRING))
         WHEN 1 THEN CAST(CAST(qty AS INT) AS STRING) WHEN 2 THEN concat('$', price_text)
         ELSE ship_day END AS content,
       CASE (part + column_index) % 9 WHEN 0 THEN 0.4 WHEN 1 THEN NULL ELSE 0.98 END AS confidence
FROM notice_lines CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(column_index)
"""

INPUTS["notice_fields"] = """
SELECT k AS schema_id, section_id, section_ix, ordinal, field_id, label, description, value_type,
       repeatable, required
FROM order_facts CROSS JOIN (VALUES
  ('header', 0, 0, 'invoice_number', 'Invoice number', 'Notice number.', 'identifier', false, true),
  ('header', 0, 1, 'order_date', 'Order date', 'Day of issue.', 'date', false, true),
  ('header', 0, 2, 'total', 'Total', 'Amount due.', 'currency', false, true),
  ('contact', 1, 3, 'contact_email', 'Contact email', '', 'email', false, false),
  ('contact', 1, 4, 'contact_phone', 'Contact phone', '', 'phone', false, false),
  ('contact', 1, 5, 'parties', 'Parties', 'Names on the notice.', 'text', true, false),
  ('state', 2, 6, 'paid', 'Paid', 'Whether settled.', 'boolean', false, false),
  ('state', 2, 7, 'priority', 'Priority', 'Handling class.', 'select', false, true),
  ('state', 2, 8, 'remark', 'Remark', 'Free text.', 'long_text', false, false))
  AS f(section_id, section_ix, ordinal, field_id, label, description, value_type, repeatable, required)
"""

INPUTS["notice_columns"] = """
SELECT k AS schema_id, table_id, table_ix, ordinal, column_id, label, description, value_type, required
FROM order_facts CROSS JOIN (VALUES
  ('items', 0, 0, 'part', 'Part', 'Part number.', 'identifier', true),
  ('items', 0, 1, 'quantity', 'Quantity', '', 'number', false),
  ('items', 0, 2, 'amount', 'Amount', 'Line amount.', 'currency', true),
  ('items', 0, 3, 'ship_date', 'Ship date', '', 'date', false),
  ('fees', 1, 0, 'fee', 'Fee', '', 'text', false))
  AS c(table_id, table_ix, ordinal, column_id, label, description, value_type, required)
"""

INPUTS["notice_options"] = """
SELECT k AS schema_id, 'priority' AS field_id, option_ix, value, label
FROM order_facts CROSS JOIN (VALUES (0, '1-URGENT', 'Urgent'), (1, '2-HIGH', 'High'),
  (2, '3-MEDIUM', 'Medium'), (3, '4-NOT SPECIFIED', 'Open'), (4, '5-LOW', 'Low'))
  AS p(option_ix, value, label)
"""

INPUTS["notice_field_values"] = """
SELECT doc_id, schema_id, field_id, item_ix, v_str, v_num, v_bool FROM (
SELECT k AS doc_id, k AS schema_id, field_id, item_ix,
       CASE field_id
         WHEN 'invoice_number' THEN concat('inv ', CAST(k AS STRING))
         WHEN 'order_date' THEN CASE k % 8 WHEN 3 THEN '1990-01-01' ELSE iso_day END
         WHEN 'contact_email' THEN concat('desk', CAST(cust AS STRING), CASE k % 5 WHEN 2
           THEN '@south.example.com' ELSE '@north.example.com' END)
         WHEN 'contact_phone' THEN CASE k % 6 WHEN 1 THEN '555-12' ELSE
           concat('555 ', CAST(1000000 + cust AS STRING)) END
         WHEN 'parties' THEN CASE item_ix WHEN 0 THEN upper(party) ELSE
           CASE k % 3 WHEN 0 THEN concat('House number ', CAST(cust AS STRING))
             ELSE 'Absent Partner' END END
         WHEN 'priority' THEN priority
         WHEN 'remark' THEN CASE k % 9 WHEN 0 THEN 'checked by desk' ELSE NULL END
         ELSE NULL END AS v_str,
       CASE field_id WHEN 'total' THEN CAST(price AS DOUBLE) + CASE k % 12 WHEN 5 THEN 1 ELSE 0 END
         ELSE NULL END AS v_num,
       CASE field_id WHEN 'paid' THEN k % 4 < 2 ELSE NULL END AS v_bool
FROM order_facts CROSS JOIN (VALUES
  ('invoice_number', 0), ('order_date', 0), ('total', 0), ('contact_email', 0),
  ('contact_phone', 0), ('parties', 0), ('parties', 1), ('paid', 0), ('priority', 0),
  ('remark', 0)) AS f(field_id, item_ix)) AS v
WHERE v_str IS NOT NULL OR v_num IS NOT NULL OR v_bool IS NOT NULL
"""

INPUTS["notice_cell_values"] = """
SELECT k AS doc_id, k AS schema_id, 'items' AS table_id, row_ix, column_id,
       CASE column_id WHEN 'part' THEN concat('p-', CAST(part AS STRING))
         WHEN 'ship_date' THEN CASE part % 7 WHEN 0 THEN NULL ELSE ship_day END ELSE NULL END AS v_str,
       CASE column_id WHEN 'quantity' THEN qty
         WHEN 'amount' THEN price + CASE part % 23 WHEN 4 THEN 5 ELSE 0 END ELSE NULL END AS v_num,
       CAST(NULL AS BOOLEAN) AS v_bool
FROM notice_lines CROSS JOIN (VALUES ('part'), ('quantity'), ('amount'), ('ship_date')) AS c(column_id)
"""


def dependencies(name: str, known: Collection[str] = ()) -> list[str]:
    """The derived inputs a derived input needs, itself last, without ``known`` ones."""
    ordered: list[str] = []

    def visit(current: str) -> None:
        for other in INPUTS:
            if other != current and other not in known and re.search(rf"\b{other}\b", INPUTS[current]):
                visit(other)
        if current not in ordered:
            ordered.append(current)

    visit(name)
    return ordered


def with_clause(names: list[str], known: Collection[str] = ()) -> str:
    """The common table expressions that define the named inputs, without ``known`` ones."""
    needed: list[str] = []
    for name in names:
        needed += [n for n in dependencies(name, known) if n not in needed]
    return ",\n".join(f"{n} AS ({INPUTS[n]})" for n in needed)


_PER_ROW = re.compile(r"CROSS JOIN \(VALUES\s+(.*?)\)\s+AS (\w+)\(([^)]*)\)", re.DOTALL)


def _spark_text(sql: str) -> str:
    """Constant rows beside every row are generated in place on Spark, not joined."""

    def generated(match: re.Match) -> str:
        rows = re.sub(r"\(([^()]*)\)", r"struct(\1)", match[1])
        return f"LATERAL VIEW inline(array({rows})) {match[2]} AS {match[3]}"

    plain = _PER_ROW.sub(generated, sql).replace("{", "{{").replace("}", "}}")
    return GIVEN_MARK.sub(r"{\1}", plain)


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over tasks by their key, as many tasks as their number asks for (counts them, an action).

    One row of a catalog becomes hundreds, so what a file holds together may be too much for a task.
    """
    tasks = -(-rows.count() // ROWS_PER_TASK)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def given_tables(name: str, known: Collection[str] = ()) -> set[str]:
    """The given tables that a derived input reads, other than through ``known`` ones."""
    return {mark for n in dependencies(name, known) for mark in GIVEN_MARK.findall(INPUTS[n])}


def derive(
    spark: SparkSession, name: str, table: Callable[[str], DataFrame], known: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A derived input as a DataFrame; ``table`` gives the given tables, ``known`` stand in for derived ones."""
    known = known or {}
    # One that needs no other stands by itself: a shared common table expression may not be inlined twice.
    alone = dependencies(name, known) == [name]
    text = _spark_text(INPUTS[name] if alone else f"WITH {with_clause([name], known)} SELECT * FROM {name}")
    frames = {mark: table(mark) for mark in sorted(given_tables(name, known))}
    for other, frame in known.items():
        text, found = re.subn(rf"\b{other}\b", f"{{{other}}}", text)
        if found:
            frames[other] = frame
    return spark.sql(text, **frames)


def oracle_text(sql: str, names: list[str] = ()) -> str:
    """A complete reference query: the inputs it names, then its own text."""
    used = list(names) or [n for n in INPUTS if re.search(rf"\b{n}\b", sql)]
    head = with_clause(used)
    body = sql.strip()
    opening = re.match(r"(WITH(?: RECURSIVE)?) ", body)
    if opening:
        body = body[opening.end():]
        text = f"{opening[1]} {head},\n{body}" if head else f"{opening[1]} {body}"
    else:
        text = f"WITH {head}\n{body}" if head else body
    return GIVEN_MARK.sub(r"\1", text)
