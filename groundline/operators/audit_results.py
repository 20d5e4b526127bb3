"""Audits of stored review results: each rule yields one row per violation.

Rules that need several tables are told apart by a role that takes part in the join keys, so that
each table is read once and rows of other roles pass the joins as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.numbers import round_two
from groundline.operators.ground_fixed import REVIEW_THRESHOLD
from groundline.operators.rules import repeat_rows

# The legal combinations of status, match type and confidence.
LEGAL_REVIEWS = (
    ("verified", "exact", 1.0),
    ("verified", "normalized", 0.9),
    ("needs_review", "fuzzy", 0.6),
    ("needs_review", "none", 0.25),
    ("missing", "none", 0.0),
)
COUNTS = ("verified_fields", "needs_review_fields", "missing_fields", "required_missing_fields")


FLAGS = (*COUNTS, "confidence", "review_required")


def _roles(*names: str) -> Column:
    return F.explode(F.array(*[F.lit(name) for name in names])).alias("role")


def _asked_and_stray(documents: DataFrame, marks: DataFrame, items: DataFrame, strays_only: bool = False) -> DataFrame:
    """Items of each document's schema (role ``item``) and marks its schema does not know (``stray``).

    ``marks`` has ``doc_id, role, mark``: those of role ``stray`` are looked up in the schema, those of
    other roles only meet the documents (``met``) or, without one, are passed on. ``items`` has
    ``schema_id, id, listed, required``: all are known, the listed ones are asked for. A document is
    read once, as one row for its items and one for each role of marks. With ``strays_only``, all marks are
    of role ``stray``: those without a document say nothing, and rows stay where their document is; the items
    are a registered catalog then, and of discovered schemas, one a document, otherwise.
    """
    names = ("item", "stray") if strays_only else ("item", "stray", "met")
    roles = documents.select("doc_id", "schema_id", "document_type", _roles(*names))
    # Rows generated from an order look as small as the order; without the hint they are sent whole through the driver.
    rows = roles.withColumn("known_doc", F.lit(True)).join(
        marks.withColumn("marked", F.lit(True)).hint("merge"), ["doc_id", "role"], "left" if strays_only else "full"
    )
    is_item = F.col("role") == "item"
    rows = rows.filter(is_item | F.col("marked"))
    probe = F.when(is_item, F.lit("")).when(F.col("role") == "stray", F.concat(F.lit("="), "mark"))
    known = items.select(
        "schema_id",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("stray").alias("role"), F.concat(F.lit("="), "id").alias("probe")),
            F.when(F.col("listed"), F.struct(F.lit("item").alias("role"), F.lit("").alias("probe"))),
        ))).alias("at"),
        "id", "required",
    ).select("schema_id", "at.role", "at.probe", "id", "required", F.lit(True).alias("known"))
    known = known if strays_only else known.hint("merge")
    rows = rows.withColumn("probe", probe).join(known, ["schema_id", "role", "probe"], "left")
    kept = (
        F.when(is_item, F.col("known"))
        .when(F.col("role") == "stray", F.col("known_doc") & F.col("known").isNull())
        .otherwise(True)
    )
    return rows.filter(kept).drop("probe", "known", "marked")


def _finding(condition: Column, rule: str, path: Column) -> Column:
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), path.cast("string").alias("path")))


def audit_extraction_result(
    documents: DataFrame,
    fields: DataFrame,
    values: DataFrame,
    reviews: DataFrame,
    meta: DataFrame,
    warning_keys: DataFrame,
) -> DataFrame:
    """Stored results of registered schemas against what their own rows imply.

    Returns ``doc_id, rule, path``, one row per violation; every input is read once. Repeated values or
    reviews count as often as they meet. A document without stored meta or fields has no ``meta_mismatch``.
    """
    status, role = F.col("status"), F.col("role")
    key = ["doc_id", "schema_id", "field_key"]
    rows = _asked_and_stray(
        documents.select("doc_id", "schema_id", F.lit(None).cast("string").alias("document_type")),
        warning_keys.select("doc_id", F.lit("stray").alias("role"), F.col("field_key").alias("mark")),
        fields.select("schema_id", F.col("field_key").alias("id"), F.lit(True).alias("listed"), "required"),
        strays_only=True,
    )
    legal = F.lit(False)
    for s, m, c in LEGAL_REVIEWS:
        legal = legal | ((status == s) & (F.col("match_type") == m) & (F.col("confidence") == c))
    known_status = F.when(status.isin("verified", "needs_review", "missing"), status).when(status.isNotNull(), "other")
    needed = (role == "item") & F.coalesce("required", F.lit(False))
    filled = F.col("v_str").isNotNull() | F.col("v_num").isNotNull()

    def stated(df: DataFrame, field_key: Column, part: Column, score: Column | None = None, illegal: Column | None = None) -> DataFrame:
        return df.select(
            "doc_id", "schema_id", field_key.alias("field_key"), part.alias("part"),
            (F.lit(None) if score is None else score).cast("bigint").alias("score"),
            (F.lit(False) if illegal is None else illegal).alias("illegal"),
        )

    parts = (
        stated(
            rows, F.when(role == "item", F.col("id")).otherwise(F.col("mark")),
            F.when(needed, "required").when(role == "item", "optional").otherwise("stray"),
        )
        .unionByName(stated(values, F.col("field_key"), F.when(filled, "filled").otherwise("empty")))
        .unionByName(stated(
            reviews, F.col("field_key"), F.coalesce(known_status, F.lit("unstated")),
            F.round(F.col("confidence") * 100), ~F.coalesce(legal, F.lit(False)),
        ))
    )
    # How many rows of each part share a key; what their join would count follows by multiplication.
    number = lambda *names: F.count_if(F.col("part").isin(*names))
    counted = parts.groupBy(*key).agg(
        number("required").alias("needed"), number("required", "optional").alias("asked"), number("stray").alias("strays"),
        number("filled").alias("filled"), number("empty").alias("empty"),
        *[number(name).alias(name) for name in ("verified", "needs_review", "missing", "other", "unstated")],
        F.count_if("illegal").alias("illegal"), F.coalesce(F.sum("score"), F.lit(0)).alias("score"),
    )
    # Rows with a null in their key meet nothing.
    whole = F.col("doc_id").isNotNull() & F.col("schema_id").isNotNull() & F.col("field_key").isNotNull()
    sides = ("filled", "empty", "verified", "needs_review", "missing", "other", "unstated", "score")
    counted = counted.withColumns({name: F.when(whole, F.col(name)).otherwise(0) for name in sides})
    counted = counted.filter((F.col("asked") > 0) | (F.col("strays") > 0) | (F.col("illegal") > 0))
    asked, present = F.col("asked"), F.col("filled")
    stated_reviews = F.col("verified") + F.col("needs_review") + F.col("missing") + F.col("other")
    given = F.greatest(present + F.col("empty"), F.lit(1))
    absent = given - present
    unreviewed = F.when(stated_reviews + F.col("unstated") == 0, F.lit(1)).otherwise(F.col("unstated"))
    sums = {
        "verified_fields": asked * given * F.col("verified"),
        "needs_review_fields": asked * given * F.col("needs_review"),
        "missing_fields": asked * given * F.col("missing"),
        "required_missing_fields": F.col("needed") * given * F.col("missing"),
        "included": stated_reviews * (F.col("needed") * given + (asked - F.col("needed")) * present),
        "score": asked * present * F.col("score"),
    }

    def finding(rule: str, times: Column) -> Column:
        return F.when(times > 0, F.struct(
            F.lit(rule).alias("rule"), F.col("field_key").cast("string").alias("path"), times.alias("n")
        ))

    findings = F.array_compact(F.array(
        finding("review_state", F.col("illegal")),
        finding("warning_key", F.col("strays")),
        finding("review_absent", asked * given * unreviewed),
        finding("null_not_missing", asked * absent * (stated_reviews - F.col("missing"))),
        finding("present_but_missing", asked * present * F.col("missing")),
        F.when(asked > 0, F.struct(
            F.lit("meta_mismatch").alias("rule"), F.lit(None).cast("string").alias("path"), F.lit(1).cast("bigint").alias("n")
        )),
    ))
    told = (
        counted.select("doc_id", *[value.alias(name) for name, value in sums.items()], F.inline(findings))
        .groupBy("doc_id", "rule", "path")
        .agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in sums])
    )
    average = round_two(F.col("score") / 100 / F.nullif(F.col("included"), F.lit(0)))
    told = told.withColumn("confidence", F.when(F.col("included") == 0, 0.0).otherwise(average))
    told = told.withColumn(
        "review_required",
        (F.col("needs_review_fields") > 0)
        | (F.col("required_missing_fields") > 0)
        | (F.col("confidence") < REVIEW_THRESHOLD),
    )
    claimed = meta.select("doc_id", F.lit("meta_mismatch").alias("rule"), F.struct(*FLAGS).alias("claimed"))
    differs = [F.when(F.col("claimed")[name] != F.col(name), F.lit(name)) for name in FLAGS]
    is_meta = F.col("rule") == "meta_mismatch"
    paths = F.when(is_meta, F.array_compact(F.array(*differs))).otherwise(F.array("path"))
    reported = told.join(claimed, ["doc_id", "rule"], "left").select("doc_id", "rule", "n", F.explode(paths).alias("path"))
    times = F.when(is_meta, F.lit(1)).otherwise(F.col("n"))
    return repeat_rows(reported, times).select("doc_id", "rule", "path")


def audit_discovered_result(
    documents: DataFrame,
    fields: DataFrame,
    columns: DataFrame,
    field_values: DataFrame,
    cell_values: DataFrame,
    value_reviews: DataFrame,
    table_reviews: DataFrame,
    results: DataFrame,
    warning_ids: DataFrame,
) -> DataFrame:
    """Stored results of discovered schemas against what their own rows imply.

    Reviews carry ``status, confidence, evidence_count`` (tables also ``row_count``),
    results carry ``detected_type, confidence, review_required``. Returns ``doc_id, rule, path``, one row
    per violation; every input is read once, and rows are counted per document and item before they are
    shuffled.
    """
    status, role, path = F.col("status"), F.col("role"), F.col("path")
    low = F.coalesce(F.col("confidence") < REVIEW_THRESHOLD, F.lit(False))
    unflagged = F.when(~F.col("review_required"), F.when(low, F.lit("low")).otherwise(F.lit("settled")))
    marks = results.select(
        "doc_id", F.col("detected_type").alias("mark"),
        F.explode(F.array_compact(F.array(F.lit("met"), unflagged))).alias("role"),
    ).unionByName(warning_ids.select("doc_id", F.col("id").alias("mark"), F.lit("stray").alias("role")))
    nothing = F.lit(None).cast("boolean").alias("required")
    items = fields.select("schema_id", F.col("field_id").alias("id"), F.lit(True).alias("listed"), nothing).unionByName(
        columns.select("schema_id", F.col("table_id").alias("id"), F.lit(False).alias("listed"), nothing)
    )
    rows = _asked_and_stray(documents.select("doc_id", "schema_id", "document_type"), marks, items)
    differs = (role != "met") | (F.col("known_doc") & (F.col("mark") != F.col("document_type")))
    no_row = F.lit(None).cast("bigint").alias("row_ix")
    facts = (
        rows.filter(differs)
        .select(
            "doc_id", "role", no_row, F.lit("asked").alias("kind"),
            F.when(role == "item", F.col("id")).when(~role.isin("low", "settled"), F.col("mark")).alias("path"),
        )
        .unionByName(field_values.select(
            "doc_id", F.lit("item").alias("role"), no_row, F.lit("value").alias("kind"), F.col("field_id").alias("path")
        ))
        .unionByName(cell_values.select(
            "doc_id", F.lit("table").alias("role"), F.col("row_ix").cast("bigint").alias("row_ix"),
            F.lit("value").alias("kind"), F.col("table_id").alias("path"),
        ))
        .groupBy("doc_id", "role", "path")
        .agg(
            F.count_if(F.col("kind") == "asked").alias("asked"),
            F.count_if(F.col("kind") == "value").alias("given"),
            F.count_distinct("row_ix").alias("rows"),
        )
    )
    state = ("status", "confidence", "evidence_count")
    reviews = value_reviews.select(
        "doc_id", F.lit("item").alias("role"), F.col("field_id").alias("path"), *state,
        F.lit(None).cast("bigint").alias("row_count"), F.lit(True).alias("reviewed"),
    ).unionByName(table_reviews.select(
        "doc_id", F.lit("table").alias("role"), F.col("table_id").alias("path"), *state,
        F.col("row_count").cast("bigint").alias("row_count"), F.lit(True).alias("reviewed"),
    ))
    met = facts.join(reviews, ["doc_id", "role", "path"], "full")
    asked, present = F.coalesce("asked", F.lit(0)), F.coalesce("given", F.lit(0)) > 0
    reviewed, item, table = F.col("reviewed"), F.col("role") == "item", F.col("role") == "table"
    flag = F.lit("review_required")

    def told(condition: Column, rule: str, target: Column, times: Column | int, kind: str = "") -> Column:
        number = F.lit(times) if isinstance(times, int) else times
        return F.when(condition, F.struct(
            F.lit(rule).alias("rule"), target.cast("string").alias("path"),
            number.cast("bigint").alias("times"), F.lit(kind).alias("kind"),
        ))

    findings = F.array_compact(F.array(
        told(role == "met", "detected_type", path, asked),
        told(role == "stray", "warning_id", path, asked),
        told(role == "low", "review_flag", flag, asked, "low"),
        told(role == "settled", "review_flag", flag, asked, "settled"),
        told(F.col("doc_id").isNotNull() & reviewed & (status != "verified"), "review_flag", flag, 1, "open"),
        told(reviewed & (status == "missing") & (F.col("confidence") != 0), "missing_scored", path, 1),
        told(reviewed & (status == "verified") & (F.col("evidence_count") == 0), "no_evidence", path, 1),
        told(reviewed & item & ~present & (status != "missing"), "null_not_missing", path, asked),
        told(reviewed & item & present & (status == "missing"), "present_but_missing", path, asked),
        told(reviewed & table & (F.coalesce("rows", F.lit(0)) != F.col("row_count")), "row_count", path, 1),
    ))
    kind, times = F.col("kind"), F.col("times")
    counted = met.select("doc_id", F.inline(findings)).groupBy("doc_id", "rule", "path").agg(
        F.sum(F.when(kind == "", times)).alias("plain"),
        F.coalesce(F.sum(F.when(kind == "low", times)), F.lit(0)).alias("low"),
        F.sum(F.when(kind == "settled", times)).alias("settled"),
        F.count_if(kind == "open").alias("open"),
    )
    waiting = F.when(F.col("open") > 0, F.coalesce("settled", F.lit(0))).otherwise(0)
    repeats = F.when(F.col("rule") == "review_flag", F.col("low") + waiting).otherwise(F.col("plain"))
    return repeat_rows(counted, repeats).select("doc_id", "rule", "path")
