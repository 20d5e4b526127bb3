"""Page texts and analysed layouts as block and cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import WS, clean_text, is_blank

# Bounds of a layout.
MAX_CONTENT = 100_000
MAX_PAGES = 50
MIN_VISIBLE = 20
MAX_ITEMS = 20_000
MAX_TABLES = 100
MAX_CELLS = 20_000
MAX_CELL_CHARS = 10_000
MAX_REGIONS = 100


def content_unit(source_format: Column) -> Column:
    return (
        F.when(source_format == "xlsx", "sheet")
        .when(source_format == "pptx", "slide")
        .when(source_format == "html", "document")
        .otherwise("page")
    )


def unit_count(source_format: Column, pages: Column) -> Column:
    return F.when(source_format == "html", 1).otherwise(F.greatest(F.lit(1), pages))


def location(source_format: Column, page_number: Column) -> Column:
    """Where a region lies, in the terms of its format."""
    unit = content_unit(source_format)
    return F.struct(
        F.when(unit == "document", "html").otherwise(unit).alias("kind"),
        F.when(unit == "page", page_number).alias("page_number"),
        F.when(unit == "sheet", F.concat(F.lit("Sheet "), page_number.cast("string"))).alias("sheet_name"),
        F.when(unit == "slide", page_number).alias("slide_number"),
    )


def normalize_polygon(points: Column, width: Column, height: Column) -> Column:
    """Corner points as shares of the page, or null where there are not four to eight."""
    count = F.size(points)
    usable = (
        count.between(8, 16) & (count % 2 == 0) & (width > 0) & (height > 0)
        & ~F.exists(points, lambda value: value.isNull())
    )

    def share(value: Column, extent: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / extent))

    pairs = F.transform(
        F.sequence(F.lit(1), count - 1, F.lit(2)),
        lambda i: F.struct(
            share(F.get(points, i - 1), width).alias("x"), share(F.get(points, i), height).alias("y")
        ),
    )
    return F.when(usable, pairs)


def assemble_pages(pages: DataFrame, max_chars: int = MAX_CONTENT) -> DataFrame:
    """Documents joined from page texts, each with a reason where it is not acceptable.

    Pages come in the order of their numbers, which may have gaps and repeats. Only the first
    fifty by position, and only while their running length is within the budget, are collected:
    what lies beyond makes the document unacceptable, so an accepted one is always whole.
    """
    text = clean_text(F.col("text"))
    marker = F.when(F.col("page") == 1, text).otherwise(
        F.concat(F.lit("\n\n--- Page "), F.col("page").cast("string"), F.lit(" ---\n\n"), text)
    )
    rows = pages.select("doc_id", "page", marker.alias("part"))
    order = Window.partitionBy("doc_id").orderBy("page", "part")
    rows = rows.withColumn("position", F.row_number().over(order)).withColumn("running", F.sum(F.length("part")).over(order))
    keep = (F.col("position") <= MAX_PAGES) & (F.col("running") <= max_chars)
    grouped = rows.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("page_count"),
        F.sum(F.length("part")).alias("joined_chars"),
        F.array_sort(F.collect_list(F.when(keep, F.struct("position", "part")))).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    fits = (F.col("page_count") <= MAX_PAGES) & (F.col("joined_chars") <= max_chars)
    docs = grouped.select(
        "doc_id", "page_count", "joined_chars", F.when(fits, clean_text(joined)).alias("content")
    )
    visible = F.length(F.regexp_replace("content", WS, ""))
    reason = (
        F.when(F.col("page_count") > MAX_PAGES, "too_many_pages")
        .when(F.col("joined_chars") > max_chars, "text_limit")
        .when(visible < MIN_VISIBLE, "no_text")
    )
    return docs.withColumn("reason", reason)


def single_block_layout(documents: DataFrame) -> DataFrame:
    """Text-only documents as one paragraph on page one."""
    return documents.select(
        "doc_id", F.lit(0).alias("block_ix"), F.lit("paragraph").alias("kind"), "content",
        F.lit(1).alias("page_number"), F.lit(0).alias("span_offset"),
        F.length("content").alias("span_length"),
    )


def audit_layout(layouts: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Layouts that break a bound, with the first rule they break.

    ``layouts`` has ``doc_id, source_format, requested_format, content, content_unit_count``.
    """
    block_counts = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    per_table = cells.groupBy("doc_id", "table_ix").agg(F.count("*").alias("cells"))
    cell_counts = per_table.groupBy("doc_id").agg(
        F.count("*").alias("tables"), F.sum("cells").alias("cells")
    )
    rows = (
        layouts.join(block_counts, "doc_id", "left")
        .join(cell_counts, "doc_id", "left")
        .na.fill(0, ["blocks", "tables", "cells"])
    )
    rule = (
        F.when(F.col("source_format") != F.col("requested_format"), "format_mismatch")
        .when(is_blank(F.col("content")), "blank_content")
        .when(F.length("content") > MAX_CONTENT, "content_too_long")
        .when(F.col("content_unit_count") < 1, "no_units")
        .when(F.col("blocks") > MAX_ITEMS, "too_many_blocks")
        .when(F.col("tables") > MAX_TABLES, "too_many_tables")
        .when(F.col("cells") > MAX_CELLS, "too_many_cells")
    )
    return rows.select("doc_id", rule.alias("rule")).filter(F.col("rule").isNotNull())


# What an analysis response holds; numbers are read loosely and checked afterwards.
_REGION = "struct<pageNumber:double,polygon:array<double>>"
_SPAN = "struct<offset:double,length:double>"
ANALYSIS_SCHEMA = (
    "content string,"
    "pages array<struct<pageNumber:double,width:double,height:double>>,"
    f"paragraphs array<struct<content:string,role:string,boundingRegions:array<{_REGION}>,spans:array<{_SPAN}>>>,"
    "tables array<struct<rowCount:double,columnCount:double,"
    f"boundingRegions:array<{_REGION}>,spans:array<{_SPAN}>,"
    f"cells:array<struct<content:string,confidence:double,rowIndex:double,columnIndex:double,"
    f"rowSpan:double,columnSpan:double,boundingRegions:array<{_REGION}>,spans:array<{_SPAN}>>>>>"
)


def _whole(value: Column, least: int, default: int | None) -> Column:
    fits = (value == F.floor(value)) & (value >= least)
    return F.when(fits, value.cast("int")).otherwise(F.lit(default).cast("int"))


def _first_region(regions: Column, pages: Column, source_format: Column) -> tuple[Column, Column]:
    """Page number and normalised polygon of an item's first region."""
    region = F.get(F.filter(F.slice(regions, 1, MAX_REGIONS), lambda r: r.isNotNull()), F.lit(0))
    number = F.when(region.isNotNull(), _whole(region["pageNumber"], 1, 1))
    page = F.element_at(
        F.filter(pages, lambda p: p["number"] == number), -1
    )
    width = F.coalesce(page["width"], F.lit(1.0))
    height = F.coalesce(page["height"], F.lit(1.0))
    return number, normalize_polygon(region["polygon"], width, height)


def _all_regions(regions: Column, pages: Column, source_format: Column) -> Column:
    """Location and normalised polygon of each of an item's regions, by its own page's size."""

    def read(region: Column) -> Column:
        number = _whole(region["pageNumber"], 1, 1)
        page = F.element_at(F.filter(pages, lambda p: p["number"] == number), -1)
        width, height = F.coalesce(page["width"], F.lit(1.0)), F.coalesce(page["height"], F.lit(1.0))
        return F.struct(
            location(source_format, number).alias("location"),
            normalize_polygon(region["polygon"], width, height).alias("polygon"),
        )

    return F.transform(F.filter(F.slice(F.coalesce(regions, F.array()), 1, MAX_REGIONS), lambda r: r.isNotNull()), read)


def _all_spans(spans: Column) -> Column:
    """Offsets and lengths of an item's spans; those that are not whole and from 0 are dropped."""
    read = F.transform(
        F.slice(F.coalesce(spans, F.array()), 1, MAX_ITEMS),
        lambda s: F.struct(_whole(s["offset"], 0, None).alias("offset"), _whole(s["length"], 0, None).alias("length")),
    )
    return F.filter(read, lambda s: s["offset"].isNotNull() & s["length"].isNotNull())


def rejected_analysis(responses: DataFrame) -> DataFrame:
    """``doc_id, reason`` of responses that :func:`read_analysis` leaves out or reads in part."""
    r = F.from_json("body", ANALYSIS_SCHEMA)
    cells = F.aggregate(F.coalesce(F.col("r.tables"), F.array()), F.lit(0), lambda n, t: n + F.greatest(F.size(t["cells"]), F.lit(0)))
    reason = (
        F.when(F.col("r.content").isNull() & F.col("r.paragraphs").isNull() & F.col("r.tables").isNull(), "unreadable")
        .when(is_blank(F.col("r.content")), "blank_content")
        .when(F.length("r.content") > MAX_CONTENT, "content_too_long")
        .when(F.size("r.pages") > MAX_ITEMS, "too_many_pages")
        .when(F.size("r.paragraphs") > MAX_ITEMS, "too_many_blocks")
        .when(F.size("r.tables") > MAX_TABLES, "too_many_tables")
        .when(cells > MAX_CELLS, "too_many_cells")
    )
    rows = responses.select("doc_id", r.alias("r")).select("doc_id", F.coalesce(reason, F.when(F.col("r").isNull(), "unreadable")).alias("reason"))
    return rows.filter(F.col("reason").isNotNull())


def _parsed_analysis(responses: DataFrame) -> DataFrame:
    """``doc_id, source_format, r, pages`` of the responses with usable content, pages with their sizes."""
    parsed = responses.select("doc_id", "source_format", F.from_json("body", ANALYSIS_SCHEMA).alias("r"))
    content = F.col("r.content")
    pages = F.transform(
        F.filter(F.slice(F.coalesce("r.pages", F.array()), 1, MAX_ITEMS), lambda p: p.isNotNull()),
        lambda p, i: F.struct(
            F.coalesce(_whole(p["pageNumber"], 1, None), i + 1).alias("number"),
            F.when(p["width"] > 0, p["width"]).otherwise(1.0).alias("width"),
            F.when(p["height"] > 0, p["height"]).otherwise(1.0).alias("height"),
        ),
    )
    return parsed.filter((~is_blank(content)) & (F.length(content) <= MAX_CONTENT)).withColumn("pages", pages)


def read_items(responses: DataFrame) -> DataFrame:
    """Every block, table and cell of the usable responses, with all its regions and spans.

    Gives ``doc_id, part, table_ix, ix, content, regions, spans, loss, kept``. ``ix`` is the place of a
    block in its document, of a table likewise and of a cell in its table. ``loss`` says why an item is
    not part of the layout (``kept`` false) or only in part (``kept`` true): ``malformed``, ``blank``,
    ``too_long``, ``no_size``, ``table_dropped``, ``beyond_limit``, ``content_cut``, ``regions_cut``.
    No item is left out, so what a layout lacks can be told from this table. One pass, no shuffle.
    """
    fmt, pages = F.col("source_format"), F.col("pages")
    cut_regions = lambda item: F.coalesce(F.size(item["boundingRegions"]) > MAX_REGIONS, F.lit(False))

    def entry(part: str, table_ix: Column, ix: Column, item: Column, content: Column, dropped: Column, reduced: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), table_ix.cast("int").alias("table_ix"), ix.cast("int").alias("ix"),
            content.cast("string").alias("content"), _all_regions(item["boundingRegions"], pages, fmt).alias("regions"),
            _all_spans(item["spans"]).alias("spans"), F.coalesce(dropped, reduced).alias("loss"), dropped.isNull().alias("kept"),
        )

    def block(p: Column, i: Column) -> Column:
        dropped = (
            F.when(p.isNull(), "malformed").when(i >= MAX_ITEMS, "beyond_limit")
            .when(is_blank(p["content"]), "blank").when(F.length(p["content"]) > MAX_CONTENT, "too_long")
        )
        return entry("block", F.lit(None), i, p, p["content"], dropped, F.when(cut_regions(p), "regions_cut"))

    def table_loss(t: Column, i: Column) -> Column:
        sized = F.coalesce((_whole(t["rowCount"], 1, 0) > 0) & (_whole(t["columnCount"], 1, 0) > 0), F.lit(False))
        return F.when(t.isNull(), "malformed").when(i >= MAX_TABLES, "beyond_limit").when(~sized, "no_size")

    def table(t: Column, i: Column) -> Column:
        return entry("table", i, i, t, F.lit(None), table_loss(t, i), F.when(cut_regions(t), "regions_cut"))

    def cells(t: Column, i: Column) -> Column:
        def cell(c: Column, j: Column) -> Column:
            text = F.coalesce(c["content"], F.lit(""))
            dropped = F.when(table_loss(t, i).isNotNull(), "table_dropped").when(c.isNull(), "malformed").when(j >= MAX_CELLS, "beyond_limit")
            reduced = F.when(F.length(text) > MAX_CELL_CHARS, "content_cut").when(cut_regions(c), "regions_cut")
            return entry("cell", i, j, c, F.left(text, F.lit(MAX_CELL_CHARS)), dropped, reduced)

        return F.transform(F.coalesce(t["cells"], F.array()), cell)

    tables = F.coalesce(F.col("r.tables"), F.array())
    items = F.concat(
        F.transform(F.coalesce(F.col("r.paragraphs"), F.array()), block),
        F.transform(tables, table), F.flatten(F.transform(tables, cells)),
    )
    return _parsed_analysis(responses).select("doc_id", F.explode(items).alias("i")).select("doc_id", "i.*")


def read_analysis(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layouts, blocks and cells from analysis JSON (``doc_id, source_format, body``).

    Malformed items are dropped and missing integers defaulted; a response without usable
    content has no layout. Arrays are cut at the item bounds before they are exploded; the documents
    this concerns, and those without a layout, are listed by :func:`rejected_analysis`.
    """
    parsed = _parsed_analysis(responses)
    page_numbers = F.array_distinct(F.transform("pages", lambda p: p["number"]))
    layouts = parsed.select(
        "doc_id", "source_format", F.col("r.content").alias("content"),
        content_unit(F.col("source_format")).alias("content_unit"),
        unit_count(F.col("source_format"), F.size(page_numbers)).alias("content_unit_count"),
    )
    fmt = F.col("source_format")
    exploded = parsed.select(
        "doc_id", fmt, "pages", F.posexplode(F.slice("r.paragraphs", 1, MAX_ITEMS)).alias("ix", "p")
    ).filter(~is_blank(F.col("p.content")) & (F.length("p.content") <= MAX_CONTENT))
    number, polygon = _first_region(F.col("p.boundingRegions"), F.col("pages"), fmt)
    role = F.col("p.role")
    blocks = exploded.select(
        "doc_id", F.col("ix").alias("block_ix"), F.col("p.content").alias("content"),
        F.when(~is_blank(role) & (F.length(role) <= 100), role).alias("role"),
        number.alias("page_number"), F.to_json(polygon).alias("polygon"),
    )
    tables = parsed.select(
        "doc_id", fmt, "pages", F.posexplode(F.slice("r.tables", 1, MAX_TABLES)).alias("table_ix", "t")
    ).filter((F.col("t.rowCount") >= 1) & (F.col("t.columnCount") >= 1))
    cells = tables.select(
        "doc_id", fmt, "pages", "table_ix",
        F.posexplode(F.slice("t.cells", 1, MAX_CELLS)).alias("cell_ix", "c"),
    ).filter(F.col("c").isNotNull())
    number, polygon = _first_region(F.col("c.boundingRegions"), F.col("pages"), fmt)
    cells = cells.select(
        "doc_id", "table_ix", "cell_ix",
        _whole(F.col("c.rowIndex"), 0, 0).alias("row_index"),
        _whole(F.col("c.columnIndex"), 0, 0).alias("column_index"),
        _whole(F.col("c.rowSpan"), 1, 1).alias("row_span"),
        _whole(F.col("c.columnSpan"), 1, 1).alias("column_span"),
        F.left(F.coalesce("c.content", F.lit("")), F.lit(MAX_CELL_CHARS)).alias("content"),
        F.when(F.col("c.confidence").between(0, 1), F.col("c.confidence")).alias("confidence"),
        number.alias("page_number"), F.to_json(polygon).alias("polygon"),
    )
    return layouts, blocks, cells
