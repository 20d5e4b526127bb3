"""Registered queries over files, pages, layouts, requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import groundline.plans.form_inputs  # noqa: F401  (adds derived inputs)
from groundline.functions.text import path_only, redact, request_id
from groundline.operators import requests as rq
from groundline.operators import responses as rs
from groundline.plans.inputs import INPUTS
from groundline.plans.registry import Tables, query
from groundline.sources import files as fs
from groundline.sources import html, layout

# Files whose bytes are the pages' own text behind a leading mark that varies.
INPUTS["page_files"] = """
SELECT page_id AS file_id,
  CASE page_id % 13 WHEN 0 THEN 'scan.pdf' WHEN 1 THEN 'scan.PDF' WHEN 2 THEN 'a/b.html' WHEN 3 THEN ' page.html '
    WHEN 4 THEN 'page.htm' WHEN 5 THEN 'photo.png' WHEN 6 THEN 'sheet.xlsx' WHEN 7 THEN 'notes.txt' WHEN 8 THEN '.html'
    WHEN 9 THEN 'photo.jpeg' WHEN 10 THEN 'scan.tiff' WHEN 11 THEN 'photo.heic' ELSE concat(repeat('n', 260), '.html') END AS filename,
  CASE page_id % 7 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'TEXT/HTML; charset=utf-8' WHEN 2 THEN 'application/pdf'
    WHEN 3 THEN 'image/png' WHEN 4 THEN 'text/html' ELSE 'application/octet-stream' END AS media_type,
  concat(CASE page_id % 6 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'PK' WHEN 2 THEN 'II*' WHEN 3 THEN 'junk %PDF-' WHEN 4 THEN ''
    ELSE '  ' END, CASE page_id % 29 WHEN 3 THEN '' ELSE html END) AS body
FROM @pages
"""
INPUTS["turns"] = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page,
  concat(text, CASE turn % 3 WHEN 0 THEN concat('  ', chr(10), chr(10), chr(10), chr(10), 'end', chr(9)) WHEN 1 THEN chr(7) ELSE ' ' END) AS text
FROM @conversations
"""
INPUTS["polygons"] = """
SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_quantity AS w, l_discount * 100 AS h,
  l_quantity / 2 AS a, l_extendedprice / 1000 AS b, l_tax * 100 AS c
FROM @lineitem
"""


def _files(t: Tables) -> DataFrame:
    content = F.col("body").cast("binary")
    return t.page_files.select("file_id", "filename", "media_type", content.alias("content"), F.length(content).cast("bigint").alias("length"))


_SNIFF = r"""(length(body) <= 1000000 AND (lower(ltrim(body, chr(32) || chr(9) || chr(10) || chr(13))) LIKE '<!doctype html%'
  OR lower(ltrim(body, chr(32) || chr(9) || chr(10) || chr(13))) LIKE '<html%'
  OR regexp_matches(left(lower(ltrim(body, chr(32) || chr(9) || chr(10) || chr(13))), 4096), '<(head|body|main|article|section)(\s|>)')))"""


@query(rf"""WITH n AS (SELECT *, trim(filename) AS name, trim(split_part(lower(media_type), ';', 1)) AS media FROM page_files),
x AS (SELECT *, CASE WHEN length(regexp_extract(name, '^(.+)\.[^.]*$', 1)) > 0 THEN lower(regexp_extract(name, '\.([^.]*)$', 1)) ELSE '' END AS ext FROM n)
SELECT file_id, CASE WHEN octet_length(encode(body)) NOT BETWEEN 1 AND 10485760 THEN 'too_large'
  WHEN length(name) NOT BETWEEN 1 AND 255 OR contains(name, '/') OR contains(name, '\') THEN 'unsupported'
  WHEN NOT CASE WHEN ext = 'pdf' THEN media IN ('application/pdf', 'application/octet-stream')
    WHEN ext IN ('html', 'htm') THEN media IN ('text/html', 'application/xhtml+xml', 'application/octet-stream')
    WHEN ext = 'png' THEN media IN ('image/png', 'application/octet-stream')
    WHEN ext IN ('xlsx', 'jpeg', 'tiff', 'heic') THEN media = 'application/octet-stream' ELSE false END THEN 'unsupported'
  WHEN NOT CASE WHEN ext = 'pdf' THEN contains(left(body, 1000), '%PDF-') WHEN ext = 'xlsx' THEN body LIKE 'PK%'
    WHEN ext IN ('html', 'htm') THEN {_SNIFF} ELSE false END THEN 'signature_invalid' END AS reason
FROM x""")
def file_admission(t: Tables) -> DataFrame:
    return fs.admit_files(_files(t)).select("file_id", "reason")


@query("""SELECT file_id, CASE WHEN octet_length(encode(body)) NOT BETWEEN 1 AND 10485760 THEN 'too_large'
  WHEN media_type <> 'application/pdf' THEN 'invalid_type' WHEN NOT contains(left(body, 1000), '%PDF-') THEN 'pdf_invalid' END AS reason
FROM page_files""")
def pdf_admission(t: Tables) -> DataFrame:
    return fs.admit_pdf(_files(t)).select("file_id", "reason")


@query(f"SELECT file_id, {_SNIFF} AS is_html FROM page_files")
def html_sniff(t: Tables) -> DataFrame:
    return _files(t).select("file_id", fs.html_signature(F.col("content")).alias("is_html"))


@query("""SELECT page_id, split_part(url, '?', 1) AS path FROM @pages""")
def url_paths(t: Tables) -> DataFrame:
    return t.given("pages").select("page_id", path_only(F.col("url")).alias("path"))


@query(r"""WITH c AS (SELECT doc_id, page, rtrim(regexp_replace(regexp_replace(regexp_replace(text, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'),
    '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS t FROM turns),
p AS (SELECT doc_id, page, CASE WHEN page = 1 THEN t ELSE chr(10) || chr(10) || '--- Page ' || page || ' ---' || chr(10) || chr(10) || t END AS part FROM c),
j AS (SELECT doc_id, CAST(count(*) AS INT) AS page_count, sum(length(part)) AS joined_chars, string_agg(part, '' ORDER BY page) AS joined FROM p GROUP BY doc_id),
r AS (SELECT doc_id, page_count, joined_chars, rtrim(regexp_replace(regexp_replace(joined, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  ' ' || chr(9) || chr(10)) AS content FROM j)
SELECT doc_id, page_count, CAST(joined_chars AS BIGINT) AS joined_chars, md5(content) AS content_md5,
  CASE WHEN page_count > 50 THEN 'too_many_pages' WHEN joined_chars > 100000 THEN 'text_limit'
  WHEN length(regexp_replace(content, '\s', '', 'g')) < 20 THEN 'no_text' END AS reason FROM r""")
def assembled_pages(t: Tables) -> DataFrame:
    return layout.assemble_pages(t.turns).select(
        "doc_id", "page_count", "joined_chars", F.md5("content").alias("content_md5"), "reason"
    )


@query("""SELECT doc_id, 0 AS block_ix, 'paragraph' AS kind, md5(text) AS content_md5, 1 AS page_number, 0 AS span_offset,
  length(text) AS span_length FROM @documents""")
def single_blocks(t: Tables) -> DataFrame:
    documents = t.given("documents").select("doc_id", F.col("text").alias("content"))
    return layout.single_block_layout(documents).withColumn("content_md5", F.md5("content")).drop("content")


def _listed(names) -> str:
    return f"[{', '.join(repr(name) for name in sorted(names))}]::VARCHAR[]"


def _page_rules() -> str:
    """What each tag ends, and what shuts that off, as rows."""
    rows = []
    for name in sorted(html.KEPT_OPEN | {"hr"}):
        ends, walls = html.ENDS_LIKE.get(name, (frozenset(), frozenset()))
        if name in html.ENDS_PARAGRAPH:
            ends, walls = frozenset({"p"}) | (html.HEADINGS if name in html.HEADINGS else frozenset()), html.SCOPES
        rows.append(f"('{name}', {_listed(ends)}, {_listed(walls)}, {_listed({name} - {'hr'})})")
        own = html.HEADINGS if name in html.HEADINGS else {name}
        rows.append(f"('/{name}', {_listed(own)}, {_listed(html.SCOPES - {name} if name in html.ENDS_IN_SCOPE else ())}, {_listed(())})")
    return f"rules(tag, ends, walls, opens) AS (VALUES {', '.join(rows)})"


def _last(names: str) -> str:
    """Place of the last open element among some names."""
    return f"coalesce(list_max(list_filter(range(1, len(open) + 1), lambda i: list_contains({names}, open[i]))), 0)"


_SHAPING = "|".join(sorted(html.KEPT_OPEN | {"hr"}, key=lambda name: (-len(name), name)))
_BLOCKS = _listed(html.BLOCK_ELEMENTS)
# Every page is followed tag by tag with the list of its open elements.
PAGE_BLOCKS = rf"""WITH RECURSIVE s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'),
    '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM @pages),
m AS (SELECT page_id, string_split(regexp_replace(h, '(?i)<(/?(?:{_SHAPING}))(?:[\s/][^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM s),
p AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM m),
t AS (SELECT page_id, i, CASE WHEN contains(part, chr(2)) THEN lower(split_part(part, chr(2), 1)) ELSE '' END AS tag,
  CASE WHEN contains(part, chr(2)) THEN split_part(part, chr(2), 2) ELSE part END AS body FROM p),
{_page_rules()},
walk AS (SELECT page_id, i, tag, body, []::VARCHAR[] AS open, 0::BIGINT AS place, 'body' AS element, 0::BIGINT AS block_ix FROM t WHERE i = 1
  UNION ALL
  SELECT page_id, i, tag, body, open, deep, found, block_ix + CASE WHEN list_contains({_BLOCKS}, ltrim(tag, '/')) OR deep <> place OR found <> element THEN 1 ELSE 0 END
  FROM (SELECT *, {_last(_BLOCKS)} AS deep, CASE WHEN {_last(_BLOCKS)} = 0 THEN 'body' ELSE open[{_last(_BLOCKS)}] END AS found FROM (
    SELECT page_id, i, tag, body, place, element, block_ix, list_concat(CASE WHEN last > wall THEN open[1:last - 1] ELSE open END, opens) AS open FROM (
      SELECT t.page_id, t.i, t.tag, t.body, w.open, w.place, w.element, w.block_ix, r.opens,
        {_last("r.ends").replace("open", "w.open")} AS last, {_last("r.walls").replace("open", "w.open")} AS wall
      FROM walk AS w JOIN t ON t.page_id = w.page_id AND t.i = w.i + 1 JOIN rules AS r ON r.tag = t.tag) x) y) z),
b AS (SELECT page_id, block_ix, any_value(element) AS element, string_agg(body, ' ' ORDER BY i) AS body FROM walk GROUP BY page_id, block_ix)
SELECT doc_id, CAST(block_ix AS INT) AS block_ix, element, md5(content) AS content_md5 FROM (SELECT page_id AS doc_id, block_ix, element,
  trim(regexp_replace(html_unescaped, '\s+', ' ', 'g')) AS content FROM
  (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS html_unescaped FROM b) y) x WHERE content <> ''"""


@query(PAGE_BLOCKS)
def html_page_blocks(t: Tables) -> DataFrame:
    return html.html_blocks(t.given("pages")).withColumn("content_md5", F.md5("content")).drop("content")


def _box(t: Tables) -> DataFrame:
    points = F.when(
        F.col("pk") % 5 == 0, F.array("a", "b", "c", "a")
    ).when(F.col("pk") % 5 == 1, F.array(*"abcabcabc")).otherwise(F.array(*"abcabcab"))
    return t.polygons.withColumn("points", points)


@query("""WITH x AS (SELECT *, CASE pk % 5 WHEN 0 THEN [a, b, c, a] WHEN 1 THEN [a, b, c, a, b, c, a, b, c] ELSE [a, b, c, a, b, c, a, b] END AS p FROM polygons)
SELECT k, ln, pk, CASE WHEN pk % 5 > 1 AND w > 0 AND h > 0 THEN least(1.0, greatest(0.0, p[1] / w)) END AS x0,
  CASE WHEN pk % 5 > 1 AND w > 0 AND h > 0 THEN least(1.0, greatest(0.0, p[8] / h)) END AS y3 FROM x""")
def normalized_polygons(t: Tables) -> DataFrame:
    shape = layout.normalize_polygon(F.col("points"), F.col("w"), F.col("h"))
    rows = _box(t).withColumn("shape", shape)
    return rows.select(
        "k", "ln", "pk", F.get(F.col("shape"), F.lit(0))["x"].alias("x0"), F.get(F.col("shape"), F.lit(3))["y"].alias("y3")
    )


def _format_of(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("pdf", "image", "docx", "xlsx", "pptx", "html")])
    k = F.col("doc_id")
    return t.given("documents").select(
        "doc_id", F.get(names, (k % 6).cast("int")).alias("source_format"), (k % 4).cast("int").alias("pages"),
        ((k % 4) > 1).alias("has_text"),
    )


@query("""WITH d AS (SELECT doc_id, ['pdf','image','docx','xlsx','pptx','html'][doc_id % 6 + 1] AS f, CAST(doc_id % 4 AS INT) AS pages FROM @documents)
SELECT doc_id, CASE f WHEN 'xlsx' THEN 'sheet' WHEN 'pptx' THEN 'slide' WHEN 'html' THEN 'document' ELSE 'page' END AS content_unit,
  CASE f WHEN 'html' THEN 1 ELSE greatest(1, pages) END AS content_unit_count, CASE f WHEN 'xlsx' THEN 'sheet' WHEN 'pptx' THEN 'slide'
  WHEN 'html' THEN 'html' ELSE 'page' END AS location_kind, CASE f WHEN 'xlsx' THEN 'Sheet ' || pages END AS sheet_name,
  CASE WHEN f = 'pdf' AND doc_id % 4 > 1 THEN 'local' ELSE 'ocr' END AS route FROM d""")
def unit_and_route(t: Tables) -> DataFrame:
    fmt, pages = F.col("source_format"), F.col("pages")
    where = layout.location(fmt, pages)
    return fs.route_layout(_format_of(t)).select(
        "doc_id", layout.content_unit(fmt).alias("content_unit"), layout.unit_count(fmt, pages).alias("content_unit_count"),
        where["kind"].alias("location_kind"), where["sheet_name"].alias("sheet_name"), "route",
    )


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 9 WHEN 4 THEN 'docx' ELSE 'pdf' END AS f, CASE doc_id % 7 WHEN 3 THEN repeat(' ', 9)
  WHEN 5 THEN repeat(left(text, 50) || '....', 12000) ELSE text END AS content, doc_id % 11 AS units FROM @documents)
SELECT doc_id, rule FROM (SELECT doc_id, CASE WHEN f <> 'pdf' THEN 'format_mismatch' WHEN trim(content) = '' THEN 'blank_content'
  WHEN length(content) > 100000 THEN 'content_too_long' WHEN units < 1 THEN 'no_units'
  WHEN (SELECT count(DISTINCT l_linenumber) FROM @lineitem WHERE l_orderkey = doc_id) > 100 THEN 'too_many_tables' END AS rule FROM l) x
WHERE rule IS NOT NULL""")
def layout_audit(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    content = F.when(k % 7 == 3, F.lit(" " * 9)).when(
        k % 7 == 5, F.repeat(F.concat(F.left("text", F.lit(50)), F.lit("....")), F.lit(12_000))
    ).otherwise(F.col("text"))
    layouts = t.given("documents").select(
        "doc_id", F.when(k % 9 == 4, "docx").otherwise("pdf").alias("source_format"), F.lit("pdf").alias("requested_format"),
        content.alias("content"), (k % 11).alias("content_unit_count"),
    )
    blocks = t.given("documents").select("doc_id", F.lit(0).alias("block_ix"))
    cells = t.given("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("table_ix"))
    return layout.audit_layout(layouts, blocks, cells)


def _analysis(t: Tables) -> DataFrame:
    """Analysis JSON made from each page: two paragraphs, one of them blank at times, and one cell."""
    k = F.col("page_id")
    fmt = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "xlsx").otherwise("html")
    region = F.array(F.struct(F.lit(1).alias("pageNumber"), F.array(*[F.lit(float(x)) for x in (0, 0, 4, 0, 4, 9, 0, 2)]).alias("polygon")))
    body = F.to_json(F.struct(
        F.col("html").alias("content"),
        F.array(F.struct(F.lit(1).alias("pageNumber"), F.lit(8).alias("width"), F.lit(4).alias("height"))).alias("pages"),
        F.array(
            F.struct(F.col("url").alias("content"), region.alias("boundingRegions")),
            F.struct(F.when(k % 2 == 0, " ").otherwise("second").alias("content"), region.alias("boundingRegions")),
        ).alias("paragraphs"),
        F.array(F.struct(
            F.lit(1).alias("rowCount"), (k % 4).alias("columnCount"),
            F.array(F.struct(F.col("url").alias("content"), ((k % 5) / 3).alias("confidence"), (-(k % 2)).alias("rowIndex"))).alias("cells"),
        )).alias("tables"),
    ))
    return t.given("pages").select(k.alias("doc_id"), fmt.alias("source_format"), body.alias("body"))


@query("""WITH b AS (SELECT page_id AS doc_id, 'block' AS part, 0 AS ix, url AS content, CAST(NULL AS DOUBLE) AS confidence FROM @pages
  UNION ALL SELECT page_id, 'block', 1, 'second', NULL FROM @pages WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, 'cell', 0, url, CASE WHEN (page_id % 5) / 3 <= 1 THEN (page_id % 5) / 3 END FROM @pages WHERE page_id % 4 >= 1)
SELECT b.doc_id, part, ix, content, confidence, CASE page_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'sheet' ELSE 'document' END AS content_unit,
  1 AS content_unit_count, 1 AS page_number, part = 'cell' AS row_defaulted FROM b JOIN @pages ON page_id = b.doc_id
  WHERE length(html) <= 100000""")
def analysis_layouts(t: Tables) -> DataFrame:
    layouts, blocks, cells = layout.read_analysis(_analysis(t))
    nothing = F.lit(None).cast("double")
    parts = blocks.select(
        "doc_id", F.lit("block").alias("part"), F.col("block_ix").alias("ix"), "content", nothing.alias("confidence"),
        "page_number", F.lit(False).alias("row_defaulted"),
    ).unionByName(cells.select(
        "doc_id", F.lit("cell").alias("part"), F.col("cell_ix").alias("ix"), "content", "confidence",
        F.lit(1).alias("page_number"), (F.col("row_index") == 0).alias("row_defaulted"),
    ))
    return parts.join(layouts.select("doc_id", "content_unit", "content_unit_count"), "doc_id")


def _regions_and_spans(t: Tables) -> DataFrame:
    """Analysis JSON made from each page, with up to two regions an item on pages of their own size, and spans."""
    k = F.col("page_id")
    fmt = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "xlsx").otherwise("html")
    page = lambda n, w, h: F.struct(F.lit(n).alias("pageNumber"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    corners = lambda n: F.array(*[F.lit(float(x)) for x in (n, 0, n, 1, 0, 1, 0, 0)])
    regions = F.array(*[F.struct(F.lit(n).alias("pageNumber"), corners(n).alias("polygon")) for n in (1, 2)])
    span = lambda offset, length: F.struct(F.lit(offset).alias("offset"), length.alias("length"))
    some = lambda n: F.slice(regions, F.lit(1), n)
    body = F.to_json(F.struct(
        F.col("html").alias("content"), F.array(page(1, 8, 4), page(2, 2, 2)).alias("pages"),
        F.array(
            F.struct(F.col("url").alias("content"), some((k % 3).cast("int")).alias("boundingRegions"), F.array(span(0, k % 7), span(-1, k % 2)).alias("spans")),
            F.struct(F.lit(" ").alias("content"), some(F.lit(0)).alias("boundingRegions"), F.array(span(3, k % 5)).alias("spans")),
        ).alias("paragraphs"),
        F.array(F.struct(
            F.lit(1).alias("rowCount"), (k % 4).alias("columnCount"), regions.alias("boundingRegions"),
            F.array(F.struct(F.repeat(F.lit("x"), (k % 3 + 9_999).cast("int")).alias("content"), some(F.lit(1)).alias("boundingRegions"))).alias("cells"),
        )).alias("tables"),
    ))
    return t.given("pages").select(k.alias("doc_id"), fmt.alias("source_format"), body.alias("body"))


@query("""WITH i AS (SELECT page_id AS doc_id, 'block' AS part, 0 AS ix, length(url) AS n_chars, CAST(NULL AS VARCHAR) AS loss, page_id % 3 AS regions,
    1 AS n_spans, page_id % 7 AS span_chars FROM @pages
  UNION ALL SELECT page_id, 'block', 1, 1, 'blank', 0, 1, page_id % 5 FROM @pages
  UNION ALL SELECT page_id, 'table', 0, NULL, CASE WHEN page_id % 4 = 0 THEN 'no_size' END, 2, 0, 0 FROM @pages
  UNION ALL SELECT page_id, 'cell', 0, least(10000, 9999 + page_id % 3),
    CASE WHEN page_id % 4 = 0 THEN 'table_dropped' WHEN page_id % 3 = 2 THEN 'content_cut' END, 1, 0, 0 FROM @pages)
SELECT i.doc_id, part, ix, n_chars, loss, loss IS NULL OR loss = 'content_cut' AS kept, n_spans, span_chars, region_ix,
  CASE WHEN region_ix >= 0 THEN CASE doc_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'sheet' ELSE 'html' END END AS place,
  CASE WHEN doc_id % 3 = 0 THEN region_ix + 1 END AS page_number, CASE WHEN doc_id % 3 = 1 THEN 'Sheet ' || (region_ix + 1) END AS sheet_name,
  CASE region_ix WHEN 0 THEN 0.125::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS corner_x
FROM i JOIN @pages ON page_id = i.doc_id LEFT JOIN (VALUES (0), (1)) r(region_ix) ON region_ix < regions
WHERE length(html) <= 100000 AND length(trim(html)) > 0""")
def analysis_items(t: Tables) -> DataFrame:
    rows = layout.read_items(_regions_and_spans(t))
    return rows.select(
        "doc_id", "part", "ix", F.length("content").alias("n_chars"), "loss", "kept", F.size("spans").alias("n_spans"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["length"]).alias("span_chars"), F.posexplode_outer("regions").alias("region_ix", "region"),
    ).select(
        "doc_id", "part", "ix", "n_chars", "loss", "kept", "n_spans", "span_chars", "region_ix", F.col("region.location.kind").alias("place"),
        "region.location.page_number", "region.location.sheet_name", F.get("region.polygon", F.lit(0))["x"].alias("corner_x"),
    )


@query("""SELECT page_id AS doc_id, CASE WHEN page_id % 9 = 3 THEN 'unreadable' WHEN page_id % 9 = 1 THEN 'blank_content'
  ELSE 'content_too_long' END AS reason FROM @pages
  WHERE page_id % 9 IN (1, 3) OR length(html) * CASE WHEN page_id % 9 = 2 THEN 40 ELSE 1 END > 100000""")
def rejected_layouts(t: Tables) -> DataFrame:
    k, content = F.col("page_id"), F.col("html")
    content = F.when(k % 9 == 1, " ").when(k % 9 == 2, F.repeat(content, F.lit(40))).otherwise(content)
    body = F.when(k % 9 == 3, "{").otherwise(F.to_json(F.struct(content.alias("content"))))
    return layout.rejected_analysis(t.given("pages").select(k.alias("doc_id"), F.lit("pdf").alias("source_format"), body.alias("body")))


def _request_docs(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", F.lit("pdf").alias("source_format"), F.lit(1).alias("schema_id"), F.col("text").alias("content"))


@query("""WITH r AS (SELECT doc_id, text, unnest([0, 1, 2]) AS rung, unnest([12000, 6000, 3000]) AS budget FROM @documents),
s AS (SELECT doc_id, CAST(rung AS INT) AS rung, CAST(budget AS INT) AS budget, CASE WHEN length(text) <= budget THEN text ELSE
  left(text, CAST(ceil((budget - 23) * 0.65::DOUBLE) AS INT)) || chr(10) || chr(10) || '[CONTENT_TRUNCATED]' || chr(10) || chr(10) ||
  right(text, CAST((budget - 23) - ceil((budget - 23) * 0.65::DOUBLE) AS INT)) END AS shown, length(text) > 12000 AS truncated FROM r
  WHERE rung = 0 OR length(text) > budget)
SELECT doc_id, rung, budget, md5(shown) AS shown_md5, truncated FROM s""")
def sampled_content(t: Tables) -> DataFrame:
    rows = rq.attempts(_request_docs(t))
    return rows.select(
        "doc_id", "rung", "budget", F.md5("shown").alias("shown_md5"), rq.truncated_flag(F.col("content")).alias("truncated")
    )


@query("""WITH b AS (SELECT unnest(['fields_1', 'table 1']) AS batch_id),
r AS (SELECT doc_id, length(text) AS n, unnest([0, 1, 2]) AS rung, unnest([12000, 6000, 3000]) AS budget FROM @documents),
c AS (SELECT unnest([false, true]) AS correction)
SELECT doc_id, 'extraction' AS stage, batch_id, CAST(rung AS INT) AS rung, CAST(budget AS INT) AS budget,
  'extract_' || left(regexp_replace('values_order_notice_' || batch_id || '_v1', '[^A-Za-z0-9_]', '_', 'g'), 48) AS schema_name, '{}' AS contract, correction,
  CAST(least(n, budget) + CASE WHEN correction THEN 60 ELSE 0 END + 121 AS INT) AS text_chars
FROM r CROSS JOIN b CROSS JOIN c WHERE rung = 0 OR n > budget""")
def model_requests(t: Tables) -> DataFrame:
    batches = t.spark.createDataFrame(
        [(1, "fields_1", "order_notice", "{}"), (1, "table 1", "order_notice", "{}")],
        "schema_id int, batch_id string, document_type string, contract string",
    )
    built = rq.build_requests(_request_docs(t), batches)
    return built.withColumn("text_chars", F.length("text")).drop("text")


@query(r"""WITH r AS (SELECT doc_id, body, CASE WHEN body IS NULL OR trim(body) = '' THEN 'missing_content' WHEN NOT json_valid(body) THEN 'invalid_json'
  WHEN json_type(body) <> 'OBJECT' THEN 'schema_validation' END AS failure FROM responses)
SELECT doc_id, failure, '' AS field_id, NULL AS v_str, CAST(NULL AS DOUBLE) AS v_num FROM r WHERE failure IS NOT NULL
UNION ALL SELECT doc_id, failure, key, CASE WHEN json_type(body, '$.' || key) = 'VARCHAR' THEN json_extract_string(body, '$.' || key) END,
  CASE WHEN json_type(body, '$.' || key) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(body, '$.' || key) AS DOUBLE) END
  FROM (SELECT doc_id, body, failure, unnest(json_keys(body)) AS key FROM r WHERE failure IS NULL) x""")
def parsed_responses(t: Tables) -> DataFrame:
    parsed = rs.parse_responses(t.responses)
    failed = parsed.filter(F.col("failure").isNotNull()).select(
        "doc_id", "failure", F.lit("").alias("field_id"), F.lit(None).cast("string").alias("v_str"), F.lit(None).cast("double").alias("v_num")
    )
    values = rs.response_values(parsed).select("doc_id", F.lit(None).cast("string").alias("failure"), "field_id", "v_str", "v_num")
    return failed.unionByName(values)


_VALUE = """CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' END AS v_str,
  CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(x ->> '$' AS DOUBLE) END AS v_num,
  CASE WHEN json_type(x) = 'BOOLEAN' THEN CAST(x ->> '$' AS BOOLEAN) END AS v_bool"""


@query(f"""WITH r AS (SELECT doc_id, CAST(body AS JSON) AS j FROM (SELECT * FROM responses WHERE json_valid(body)) x WHERE json_type(body) = 'OBJECT'),
f AS (SELECT doc_id, k, json_extract(j, '$.fields."' || k || '"') AS v FROM (SELECT doc_id, j, unnest(json_keys(j, '$.fields')) AS k FROM r) x),
n AS (SELECT doc_id, k, ix, json_extract(v, '$[' || ix || ']') AS x
    FROM (SELECT doc_id, k, v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS ix FROM f WHERE json_type(v) = 'ARRAY') y
  UNION ALL SELECT doc_id, k, -1, NULL FROM f WHERE json_type(v) = 'ARRAY' AND json_array_length(v) = 0
  UNION ALL SELECT doc_id, k, NULL, v FROM f WHERE json_type(v) <> 'ARRAY'),
t AS (SELECT doc_id, k, json_extract(j, '$.tables."' || k || '"') AS v FROM (SELECT doc_id, j, unnest(json_keys(j, '$.tables')) AS k FROM r) x),
l AS (SELECT doc_id, k, ix, json_extract(v, '$[' || ix || ']') AS v FROM (SELECT doc_id, k, v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS ix FROM t) x),
c AS (SELECT doc_id, k, ix, c, json_extract(v, '$."' || c || '"') AS x FROM (SELECT doc_id, k, ix, v, unnest(json_keys(v)) AS c FROM l) y
  UNION ALL SELECT doc_id, k, -1, NULL, NULL FROM t WHERE json_array_length(v) = 0)
SELECT doc_id, 'field' AS owner_kind, k AS owner_id, CAST(ix AS INT) AS place, CAST(NULL AS VARCHAR) AS column_id, {_VALUE} FROM n
UNION ALL SELECT doc_id, 'table', k, CAST(ix AS INT), c, {_VALUE} FROM c""")
def response_rows(t: Tables) -> DataFrame:
    parsed = rs.parse_responses(t.responses)
    value = ["v_str", "v_num", "v_bool"]
    fields = rs.response_field_values(parsed).select(
        "doc_id", F.lit("field").alias("owner_kind"), F.col("field_id").alias("owner_id"), F.col("item_ix").alias("place"),
        F.lit(None).cast("string").alias("column_id"), *value,
    )
    cells = rs.response_cell_values(parsed).select(
        "doc_id", F.lit("table").alias("owner_kind"), F.col("table_id").alias("owner_id"), F.col("row_ix").alias("place"), "column_id", *value
    )
    return fields.unionByName(cells)


@query("""WITH s AS (SELECT doc_id, stage, batch_id, min(attempt) FILTER (valid) AS accepted_attempt, max(attempt) AS last_attempt,
  arg_max({m: mode, c: correction, s: least(budget, content_chars), h: http_status, g: generated_mismatch}, attempt) AS l
  FROM attempt_log GROUP BY ALL),
n AS (SELECT *, CASE WHEN l.s > 6000 THEN 6000 WHEN l.s > 3000 THEN 3000 END AS smaller FROM s),
f AS (SELECT *, CASE WHEN accepted_attempt IS NOT NULL THEN 'accepted' WHEN l.h = 413 THEN CASE WHEN smaller IS NULL THEN 'failed' ELSE 'smaller_budget' END
  WHEN stage = 'discovery' AND l.m = 'strict_schema' AND l.h = 400 THEN 'best_effort_schema'
  WHEN stage = 'discovery' AND l.g AND l.m <> 'json_object' THEN 'json_object' WHEN l.h <> 200 OR l.c THEN 'failed'
  WHEN stage = 'discovery' THEN 'correction_json_object' ELSE 'correction' END AS next_form FROM n)
SELECT doc_id, stage, batch_id, accepted_attempt, last_attempt, next_form, CASE WHEN next_form = 'smaller_budget' THEN smaller END AS next_budget FROM f""")
def resolved_attempts(t: Tables) -> DataFrame:
    return rs.resolve_attempts(t.attempt_log)


_REDACT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '(?i)\b[A-Z0-9._%%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b',
  '[redacted-email]', 'g'), '\b(?:gsk_|sk-)[A-Za-z0-9_-]{8,}\b', '[redacted-secret]', 'g'), '\b(?:\+?\d[\d(). -]{8,}\d)\b', '[redacted-phone]', 'g'),
  '\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, md5({_REDACT % 'text'}) AS redacted_md5 FROM @documents")
def redacted_documents(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", F.md5(redact(F.col("text"))).alias("redacted_md5"))


@query(f"""WITH s AS (SELECT *, left({_REDACT % 'message'}, 320) AS safe_message FROM failure_log WHERE http_status IS NULL OR http_status >= 400),
q AS (SELECT *, lower(coalesce(error_code, '') || ' ' || coalesce(error_type, '') || ' ' || coalesce(safe_message, '')) AS x FROM s)
SELECT request_id, http_status, CASE WHEN contains(x, 'blocked_api_access') OR contains(x, 'spend limit') THEN 'access_blocked'
  WHEN contains(x, 'response_format') THEN 'invalid_response_format' WHEN contains(x, 'json schema') OR contains(x, 'json_schema') THEN 'invalid_schema'
  WHEN contains(x, 'context length') OR contains(x, 'context_length') OR contains(x, 'too many tokens') THEN 'context_length_exceeded'
  WHEN contains(x, 'model') AND (contains(x, 'unsupported') OR contains(x, 'not found') OR contains(x, 'not available')) THEN 'model_rejected'
  ELSE CASE http_status WHEN 400 THEN 'bad_request' WHEN 401 THEN 'authentication' WHEN 403 THEN 'permission_denied' WHEN 413 THEN 'payload_too_large'
    WHEN 429 THEN 'rate_limited' WHEN 503 THEN 'provider_unavailable' ELSE error_type END END AS reason,
  CASE WHEN timed_out THEN 'PROVIDER_TIMEOUT' WHEN http_status = 429 THEN 'PROVIDER_RATE_LIMITED' ELSE 'PROVIDER_UNAVAILABLE' END AS mapped_code, safe_message FROM q""")
def classified_failures(t: Tables) -> DataFrame:
    return rs.classify_failures(t.failure_log)


@query("""WITH l AS (SELECT request_id, http_status, request_id % 11 = 0 AS late, request_id % 13 = 0 AS gone,
  CASE request_id % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'notStarted' WHEN 3 THEN 'lost' END AS said FROM failure_log),
c AS (SELECT request_id, CASE WHEN late THEN 'TIMEOUT 503' WHEN gone THEN 'FAILED 499' WHEN http_status IS NULL OR http_status >= 500 THEN 'UNAVAILABLE 503'
  WHEN http_status = 429 THEN 'RATE_LIMITED 503' WHEN http_status >= 400 THEN 'UNAVAILABLE 502' WHEN said = 'Failed' THEN 'FAILED 422'
  WHEN said = 'lost' OR said IS NULL THEN 'INVALID_RESPONSE 502' END AS x FROM l)
SELECT request_id, 'LAYOUT_' || split_part(x, ' ', 1) AS mapped_code, CAST(split_part(x, ' ', 2) AS INT) AS answer_status FROM c WHERE x IS NOT NULL""")
def layout_failures(t: Tables) -> DataFrame:
    k = F.col("request_id")
    said = F.when(k % 5 == 0, "Failed").when(k % 5 == 1, "succeeded").when(k % 5 == 2, "notStarted").when(k % 5 == 3, "lost")
    log = t.failure_log.withColumns({"timed_out": k % 11 == 0, "cancelled": k % 13 == 0, "operation_status": said})
    return rs.classify_layout_failures(log)


@query("""WITH x AS (SELECT k AS doc_id, k AS schema_id, 'fields_1' AS batch_id, 500 + k % 4 AS http_status FROM order_facts)
SELECT x.schema_id, x.batch_id, x.doc_id, x.http_status, (SELECT count(*) FROM notice_fields f WHERE f.schema_id = x.schema_id) AS fields,
  (SELECT count(*) FILTER (repeatable) FROM notice_fields f WHERE f.schema_id = x.schema_id) AS repeatables, 0 AS tables FROM x""")
def batch_failures(t: Tables) -> DataFrame:
    batches = t.notice_fields.select(
        "schema_id", F.lit("fields_1").alias("batch_id"), F.lit("field").alias("kind"), F.col("field_id").alias("item_id"), "repeatable"
    )
    k = F.col("k")
    failed = t.order_facts.select(
        k.alias("doc_id"), k.alias("schema_id"), F.lit("fields_1").alias("batch_id"), (500 + k % 4).alias("http_status")
    )
    return rs.batch_failure_metrics(failed, batches)


@query("""SELECT event_id, CASE WHEN event_type = 'error' OR 200 + event_id % 350 >= 500 THEN 'error' WHEN 200 + event_id % 350 >= 400 THEN 'warn' ELSE 'info' END
  AS severity, CASE WHEN event_id % 2 = 0 THEN 'accept' ELSE 'accept,x-trace' END AS headers FROM @events""")
def log_lines(t: Tables) -> DataFrame:
    status = 200 + F.col("event_id") % 350
    headers = F.create_map(
        F.lit("accept"), F.lit("*/*"), F.lit("Authorization"), F.lit("secret"),
        F.when(F.col("event_id") % 2 == 0, "Cookie").otherwise("x-trace"), F.lit("1"),
    )
    kept = F.array_join(F.array_sort(F.map_keys(rs.public_headers(headers))), ",")
    return t.given("events").select(
        "event_id", rs.log_severity(status, F.col("event_type") == "error").alias("severity"), kept.alias("headers")
    )


@query("""SELECT event_id, length(CASE WHEN event_id % 3 = 0 THEN repeat('-', 36) ELSE 'req-' || event_id END) AS id_chars FROM @events""")
def request_ids(t: Tables) -> DataFrame:
    raw: Column = F.when(F.col("event_id") % 3 == 0, F.lit("bad id!")).otherwise(
        F.concat(F.lit("req-"), F.col("event_id").cast("string"))
    )
    return t.given("events").select("event_id", F.length(request_id(raw)).alias("id_chars"))
