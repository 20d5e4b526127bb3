"""File corpora: listing, admission and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions.text import trim_all

# Limits, accepted extensions, their media types and leading bytes.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_NAME_CHARS = 255
MAX_HTML_CHARS = 1_000_000
HTML_HEAD_CHARS = 4_096
ANY_MEDIA = "application/octet-stream"
FORMATS = (
    ("pdf", "pdf", "application/pdf"),
    ("jpg", "image", "image/jpeg"),
    ("jpeg", "image", "image/jpeg"),
    ("png", "image", "image/png"),
    ("bmp", "image", "image/bmp image/x-ms-bmp"),
    ("tif", "image", "image/tiff"),
    ("tiff", "image", "image/tiff"),
    ("heic", "image", "image/heic image/heif"),
    ("heif", "image", "image/heic image/heif"),
    ("docx", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("xlsx", "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("pptx", "pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("html", "html", "text/html application/xhtml+xml"),
    ("htm", "html", "text/html application/xhtml+xml"),
)
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path. Bytes are only read where a later step asks for ``content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return files.option("recursiveFileLookup", "true").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content"
    )


def html_signature(content: Column) -> Column:
    """Valid UTF-8 of bounded length that opens like an HTML page."""
    text = F.try_validate_utf8(content.cast("string"))
    start = F.lower(F.left(F.regexp_replace(text, r"^\x{FEFF}?\s*", ""), F.lit(HTML_HEAD_CHARS)))
    opens = (
        start.startswith("<!doctype html")
        | start.startswith("<html")
        | start.rlike(r"<(?:head|body|main|article|section)(?:\s|>)")
    )
    return F.coalesce((F.length(text) <= MAX_HTML_CHARS) & opens, F.lit(False))


def _starts(content: Column, *heads: str) -> Column:
    found = F.lit(False)
    for head in heads:
        found = found | (F.hex(F.substring(content, 1, len(head) // 2)) == head)
    return found


def signature_agrees(extension: Column, content: Column) -> Column:
    """Whether the leading bytes fit the extension. Containers are recognised by their mark."""
    head = F.hex(F.substring(content, 1, 1024))
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    heif = (F.hex(F.substring(content, 5, 4)) == "66747970") & brand.isin(*HEIF_BRANDS)
    return (
        # The mark must start on a byte, that is at an even place of the hexadecimal form.
        F.when(extension == "pdf", head.rlike("^(?:..)*?255044462D"))
        .when(extension.isin("jpg", "jpeg"), _starts(content, "FFD8FF"))
        .when(extension == "png", _starts(content, "89504E470D0A1A0A"))
        .when(extension == "bmp", _starts(content, "424D"))
        .when(extension.isin("tif", "tiff"), _starts(content, "49492A00", "4D4D002A"))
        .when(extension.isin("heic", "heif"), heif)
        .when(extension.isin("docx", "xlsx", "pptx"), _starts(content, "504B"))
        .otherwise(html_signature(content))
    )


def admit_files(files: DataFrame) -> DataFrame:
    """Each file with its format and the first reason against it, null where accepted.

    ``files`` has ``filename, media_type, content`` and a ``length``; checks go from
    the cheap ones to the bytes.
    """
    spark = files.sparkSession
    formats = F.broadcast(
        spark.createDataFrame(FORMATS, "extension string, source_format string, media string")
    )
    name = trim_all(F.col("filename"))
    extension = F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)\z", 1))
    media = trim_all(F.substring_index(F.lower("media_type"), ";", 1))
    bad_name = (
        (F.length(name) < 1)
        | (F.length(name) > MAX_NAME_CHARS)
        | name.rlike(r"[/\\\x00-\x1F\x7F]")
    )
    known_media = (F.col("sent_media") == ANY_MEDIA) | F.array_contains(
        F.split("media", " "), F.col("sent_media")
    )
    rows = files.withColumns(
        {"name": name, "extension": extension, "sent_media": media, "bad_name": bad_name}
    ).join(formats, "extension", "left")
    reason = (
        F.when((F.col("length") < 1) | (F.col("length") > MAX_FILE_BYTES), "too_large")
        .when(F.col("bad_name"), "unsupported")
        .when(F.col("source_format").isNull() | ~known_media, "unsupported")
        .when(~signature_agrees(F.col("extension"), F.col("content")), "signature_invalid")
    )
    return rows.withColumn("reason", reason).drop("extension", "bad_name", "media", "filename").withColumnRenamed(
        "name", "filename"
    )


def admit_pdf(files: DataFrame) -> DataFrame:
    """The single-format variant: PDF only, by declared type and then by bytes."""
    reason = (
        F.when((F.col("length") < 1) | (F.col("length") > MAX_FILE_BYTES), "too_large")
        .when(F.col("media_type") != "application/pdf", "invalid_type")
        .when(~signature_agrees(F.lit("pdf"), F.col("content")), "pdf_invalid")
    )
    return files.withColumn("reason", reason)


def route_layout(documents: DataFrame, ocr_configured: bool = True) -> DataFrame:
    """Where each document's layout comes from (``source_format, has_text``)."""
    ocr = F.lit("ocr" if ocr_configured else "not_configured")
    local = (F.col("source_format") == "pdf") & F.col("has_text")
    return documents.withColumn("route", F.when(local, "local").otherwise(ocr))
