"""Model responses: parsing, attempt resolution and failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.text import is_blank, redact

SENSITIVE_HEADERS = ("authorization", "cookie", "x-api-key", "set-cookie")
MESSAGE_CAP = 320


def _is_one_document(body: Column) -> Column:
    """Whether a text is one JSON document and nothing else.

    The parsers stop after the first document. Put between two keys of an object, a body
    with anything after it closes that object early or adds keys to it.
    """
    framed = F.concat(F.lit('{"body":'), body, F.lit(',"end":0}'))
    keys = F.json_object_keys(framed)
    return F.try_parse_json(framed).isNotNull() & (keys == F.array(F.lit("body"), F.lit("end")))


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row per key of each JSON object body; a body that is none has its failure instead."""
    body = F.col("body")
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(parsed)
    failure = (
        F.when(body.isNull() | is_blank(body), "missing_content")
        .when(~F.coalesce(_is_one_document(body), F.lit(False)), "invalid_json")
        .when(~kind.startswith("OBJECT"), "schema_validation")
    )
    rows = responses.withColumn("failure", failure)
    return rows.select("*", F.when(F.col("failure").isNull(), parsed).alias("parsed"))


def _entries(value: Column) -> Column:
    """An object's keys and values; keys are taken as they are, whatever signs they hold."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _scalars(value: str) -> list[Column]:
    """Text, number, truth value and kind of a variant; lists and objects only have a kind."""
    whole, kind = F.col(value), F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return [
        F.when(kind == "STRING", F.try_variant_get(whole, "$", "string")).alias("v_str"),
        F.when(number, F.try_variant_get(whole, "$", "double")).alias("v_num"),
        F.when(kind == "BOOLEAN", F.try_variant_get(whole, "$", "boolean")).alias("v_bool"),
        kind.alias("value_kind"),
    ]


def response_values(parsed: DataFrame) -> DataFrame:
    """Scalars of flat bodies: one row per document and key of the body itself."""
    rows = parsed.filter(F.col("failure").isNull())
    named = rows.select("doc_id", F.explode(_entries(F.col("parsed"))).alias("field_id", "value"))
    return named.select("doc_id", "field_id", *_scalars("value"))


def response_field_values(parsed: DataFrame) -> DataFrame:
    """Rows of ``fields`` of each body: ``doc_id, field_id, item_ix`` and the value.

    A list gives a row per item with its place, an empty list one row with the place -1; other
    values have no place. What is neither scalar nor list has no value and its ``value_kind``.
    """
    rows = parsed.filter(F.col("failure").isNull())
    fields = _entries(F.try_variant_get("parsed", "$.fields", "variant"))
    named = rows.select("doc_id", F.explode(fields).alias("field_id", "whole"))
    listed = F.schema_of_variant("whole").startswith("ARRAY")
    items = F.when(listed, F.try_variant_get("whole", "$", "array<variant>"))
    placed = named.select("doc_id", "field_id", "whole", listed.alias("listed"), F.posexplode_outer(items).alias("at", "item"))
    place = F.coalesce("at", F.when(F.col("listed"), F.lit(-1))).alias("item_ix")
    value = F.when(~F.col("listed"), F.col("whole")).otherwise(F.col("item"))
    return placed.withColumn("value", value).select("doc_id", "field_id", place, *_scalars("value"))


def response_cell_values(parsed: DataFrame) -> DataFrame:
    """Rows of ``tables`` of each body: ``doc_id, table_id, row_ix, column_id`` and the value.

    An empty table gives one row with the place -1, a row without cells one without a column, and
    a table that is no list one without a place; none of them has a value.
    """
    rows = parsed.filter(F.col("failure").isNull())
    tables = _entries(F.try_variant_get("parsed", "$.tables", "variant"))
    named = rows.select("doc_id", F.explode(tables).alias("table_id", "whole"))
    listed = F.schema_of_variant("whole").startswith("ARRAY")
    items = F.when(listed, F.try_variant_get("whole", "$", "array<variant>"))
    placed = named.select("doc_id", "table_id", listed.alias("listed"), F.posexplode_outer(items).alias("at", "line"))
    place = F.coalesce("at", F.when(F.col("listed"), F.lit(-1))).alias("row_ix")
    cells = placed.select("doc_id", "table_id", place, F.explode_outer(_entries(F.col("line"))).alias("column_id", "value"))
    return cells.select("doc_id", "table_id", "row_ix", "column_id", *_scalars("value"))


def resolve_attempts(log: DataFrame) -> DataFrame:
    """Per document, stage and batch: the first valid response, or what to ask for next.

    ``log`` has ``doc_id, stage, batch_id, attempt, correction, mode, budget, http_status,
    generated_mismatch, valid``; attempts count up over every request that was made.
    """
    key = ["doc_id", "stage", "batch_id"]
    last = F.max_by(
        F.struct("mode", "correction", "budget", "http_status", "generated_mismatch", "content_chars"),
        "attempt",
    )
    state = log.groupBy(*key).agg(
        F.min(F.when(F.col("valid"), F.col("attempt"))).alias("accepted_attempt"),
        F.max("attempt").alias("last_attempt"),
        last.alias("last"),
    )
    status, mode = F.col("last.http_status"), F.col("last.mode")
    discovery, answered = F.col("stage") == "discovery", F.col("last.http_status") == 200
    # The next rung is the largest budget below what was shown, where there is one.
    shown = F.least("last.budget", "last.content_chars")
    smaller = F.when(shown > 6_000, 6_000).when(shown > 3_000, 3_000)
    next_form = (
        F.when(F.col("accepted_attempt").isNotNull(), "accepted")
        .when((status == 413) & smaller.isNotNull(), "smaller_budget")
        .when(status == 413, "failed")
        .when(
            discovery & (mode == "strict_schema") & (status == 400), "best_effort_schema"
        )
        .when(
            discovery & F.col("last.generated_mismatch") & (mode != "json_object"), "json_object"
        )
        .when(~answered, "failed")
        .when(F.col("last.correction"), "failed")
        .when(discovery, "correction_json_object")
        .otherwise("correction")
    )
    rows = state.withColumn("next_form", next_form)
    return rows.select(
        *key, "accepted_attempt", "last_attempt", "next_form",
        F.when(F.col("next_form") == "smaller_budget", smaller).alias("next_budget"),
    )


def failure_reason(
    status: Column, error_type: Column, error_code: Column, message: Column
) -> Column:
    """Why a request failed: by what is said, then by status, then by the type given."""
    searchable = F.lower(
        F.concat_ws(" ", F.coalesce(error_code, F.lit("")), F.coalesce(error_type, F.lit("")), F.coalesce(message, F.lit("")))
    )

    def says(*words: str) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | searchable.contains(word)
        return found

    # Phrases, statuses and reasons, first match wins.
    return (
        F.when(says("blocked_api_access", "spend limit"), "access_blocked")
        .when(says("response_format"), "invalid_response_format")
        .when(says("json schema", "json_schema"), "invalid_schema")
        .when(says("context length", "context_length", "too many tokens"), "context_length_exceeded")
        .when(says("model") & says("unsupported", "not found", "not available"), "model_rejected")
        .when(status == 400, "bad_request")
        .when(status == 401, "authentication")
        .when(status == 403, "permission_denied")
        .when(status == 413, "payload_too_large")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "provider_unavailable")
        .otherwise(error_type)
    )


def mapped_code(status: Column, timed_out: Column) -> Column:
    return (
        F.when(timed_out, "PROVIDER_TIMEOUT")
        .when(status == 429, "PROVIDER_RATE_LIMITED")
        .otherwise("PROVIDER_UNAVAILABLE")
    )


def classify_failures(log: DataFrame) -> DataFrame:
    """Failed requests with a reason, a stable code and a redacted message."""
    safe = redact(F.col("message"), MESSAGE_CAP)
    failed = log.filter(F.col("http_status").isNull() | (F.col("http_status") >= 400))
    return failed.withColumn("safe_message", safe).select(
        "request_id", "http_status",
        failure_reason(
            F.col("http_status"), F.col("error_type"), F.col("error_code"), F.col("safe_message")
        ).alias("reason"),
        mapped_code(F.col("http_status"), F.col("timed_out")).alias("mapped_code"),
        "safe_message",
    )


def classify_layout_failures(log: DataFrame) -> DataFrame:
    """Failed layout requests with a stable code and the status to answer with.

    ``log`` has ``request_id, http_status, timed_out, cancelled, operation_status``, one row per last
    answer. Answers that succeeded, and operations that still run, are no failures. A request without
    any status did not reach the provider. Null flags count as false.
    """
    status, said = F.col("http_status"), F.lower(F.coalesce("operation_status", F.lit("")))
    # Codes and statuses, first match wins.
    code, answer = (
        F.when(F.col("timed_out"), outcomes[0]).when(F.col("cancelled"), outcomes[1])
        .when(status.isNull(), outcomes[2]).when(status == 429, outcomes[3]).when(status >= 500, outcomes[2])
        .when(~status.between(200, 299), outcomes[4]).when(said == "failed", outcomes[5])
        .when(~said.isin("succeeded", "running", "notstarted"), outcomes[6])
        for outcomes in (
            ("LAYOUT_TIMEOUT", "LAYOUT_FAILED", "LAYOUT_UNAVAILABLE", "LAYOUT_RATE_LIMITED", "LAYOUT_UNAVAILABLE", "LAYOUT_FAILED", "LAYOUT_INVALID_RESPONSE"),
            (503, 499, 503, 503, 502, 422, 502),
        )
    )
    rows = log.select("request_id", code.alias("mapped_code"), answer.alias("answer_status"))
    return rows.filter(F.col("mapped_code").isNotNull())


def batch_failure_metrics(failed: DataFrame, batches: DataFrame) -> DataFrame:
    """Failed batches with the size of what they asked for.

    ``batches`` has one row per field or table of a batch: ``schema_id, batch_id, kind, repeatable``.
    """
    sizes = batches.groupBy("schema_id", "batch_id").agg(
        F.count_if(F.col("kind") == "field").alias("fields"),
        F.count_if((F.col("kind") == "field") & F.col("repeatable")).alias("repeatables"),
        F.countDistinct(F.when(F.col("kind") == "table", F.col("item_id"))).alias("tables"),
    )
    return failed.select("doc_id", "schema_id", "batch_id", "http_status").join(
        sizes, ["schema_id", "batch_id"]
    )


def log_severity(status: Column, failed: Column) -> Column:
    return F.when(failed | (status >= 500), "error").when(status >= 400, "warn").otherwise("info")


def public_headers(headers: Column) -> Column:
    """A header map without the entries that carry credentials."""
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(*SENSITIVE_HEADERS))
