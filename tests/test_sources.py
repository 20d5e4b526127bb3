"""File scans, registered definitions and the extractor hook."""

import json

import pandas as pd
from pyspark.sql import functions as F

from groundline.operators.catalog import audit_registered, registered_contract, required_counts
from groundline.operators.requests import budget_ladder, build_requests, run_extractor
from groundline.sources.files import admit_files, scan_files
from groundline.sources.registered import load_definitions, load_fields, load_options, load_templates


def test_scan_and_admit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 text")
    (tmp_path / "in" / "b.png").write_bytes(b"not an image")
    (tmp_path / "in" / "c.html").write_bytes(b"\xef\xbb\xbf <!DOCTYPE html><p>x")
    (tmp_path / "in" / "d.html").write_bytes(b"<html>\xff\xfe")
    files = scan_files(spark, str(tmp_path / "in")).withColumn("media_type", F.lit("application/octet-stream"))
    reasons = {r.filename: r.reason for r in admit_files(files).collect()}
    assert reasons == {"a.pdf": None, "b.png": "signature_invalid", "c.html": None, "d.html": "signature_invalid"}


def test_registered_definitions(spark):
    definitions, fields = load_definitions(spark), load_fields(spark)
    options, templates = load_options(spark), load_templates(spark)
    assert audit_registered(definitions, fields, options, templates).count() == 0
    counts = {r.schema_id: (r.fields, r.required_fields) for r in required_counts(fields).collect()}
    assert counts == {"job-application": (12, 5), "basic-invoice": (13, 8)}
    contracts = {r.schema_id: json.loads(r.contract) for r in registered_contract(fields, options).collect()}
    invoice = contracts["basic-invoice"]
    assert invoice["required"][:2] == ["issuerName", "issuerAddress"]
    assert invoice["properties"]["total"] == {"type": ["number", "null"]} and invoice["additionalProperties"] is False


def test_extractor_hook(spark):
    assert budget_ladder(8_000) == [8_000, 6_000, 3_000] and budget_ladder(2_000) == [2_000]
    documents = spark.createDataFrame([(1, 1, "pdf", "word " * 2_000)], "doc_id long, schema_id int, source_format string, content string")
    batches = spark.createDataFrame([(1, "fields_1", "note", "{}")], "schema_id int, batch_id string, document_type string, contract string")
    requests = build_requests(documents, batches)
    assert {r.budget for r in requests.select("budget").collect()} == {12_000, 6_000, 3_000}

    def stub(frames):
        for frame in frames:
            yield pd.DataFrame({
                "doc_id": frame.doc_id, "stage": frame.stage, "batch_id": frame.batch_id, "attempt": frame.correction.astype("int32"),
                "mode": "strict_schema", "http_status": 200, "body": "{}",
            }).astype({"http_status": "int32"})

    assert run_extractor(requests, stub).count() == requests.count()
