import os

import corpus_pipeline
import pytest
from fixtures import awkward_rows, documents
from pyspark.sql import functions as F
from test_pairs_and_mix import fingerprint_by_hand, groups_by_hand
from test_text_operators import counts_by_hand, dedup_by_hand

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are not here")


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    docs, tables = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*tables, docs]


def rows_of(table):
    return [tuple(r) for r in table.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_return_the_columns_of_documents(chain):
    for table in chain[:-1]:
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rules_reject_what_fails_and_keep_good_documents(spark, chain):
    kept = {r[0] for r in rows_of(chain[1])}
    for doc_id, text, *_ in rows_of(chain[0]):
        words, _, _, _, repeats = counts_by_hand(text)
        if words < 10 or 100 * repeats > 20 * words:
            assert doc_id not in kept
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    by_id = {r[0]: counts_by_hand(r[1]) for r in rows_of(chain[0])}
    fine = [r.doc_id for r in labels if r.quality and by_id[r.doc_id][0] >= 10 and 100 * by_id[r.doc_id][4] <= 20 * by_id[r.doc_id][0]]
    assert sum(d in kept for d in fine) >= 0.98 * len(fine)


def test_lines_are_dropped_as_by_hand(chain):
    before, after = rows_of(chain[1]), rows_of(chain[2])
    import hashlib

    digests = {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in after}
    assert {d.split("'")[1] for d in dedup_by_hand(before, 10, True)} == set(digests.values())
    assert all(r[4] == len(r[1]) for r in after) and len(after) == len(before)


def test_many_exact_copies_leave_one_document(spark):
    rows = [(n, "A line of its own\nand another one, both in many copies\n" + "word " * 20, "en", "s", 0) for n in range(12)]
    rows += [(50 + n, f"own {n} " * 12, "en", "s", 0) for n in range(5)]
    left = corpus_pipeline.duplicate_stage(spark, corpus_pipeline.line_stage(spark, documents(spark, rows), DATA), DATA).collect()
    assert [r.text for r in left if r.text == rows[0][1]] == [rows[0][1]]


def test_one_document_of_each_group_stays(chain):
    before, after = rows_of(chain[2]), rows_of(chain[3])
    groups = groups_by_hand([fingerprint_by_hand(r[1]) for r in before])
    want = {g: min(r[0] for r, h in zip(before, groups, strict=True) if h == g) for g in set(groups)}
    assert sorted(want.values()) == sorted(r[0] for r in after)


def test_the_mix_and_the_packing_lose_nothing(spark, chain):
    from groundline.llm import mixing

    copies = {r.doc_id: r.copies for r in mixing.mix(chain[3]).collect() if r.copies}
    mixed = [r[0] for r in rows_of(chain[4])]
    assert {d: mixed.count(d) for d in set(mixed)} == copies
    pieces = chain[5]
    counted = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in counted} == {r.doc_id: r.t * copies[r.doc_id] for r in counted} and len(counted) == len(copies)


def test_run_equals_the_stages(spark, chain):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, DATA).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in chain[5].select(columns).collect())


def test_every_stage_takes_awkward_and_no_documents(spark):
    for rows in (awkward_rows(), []):
        docs = documents(spark, rows).withColumn("score", F.lit("extra")).withColumn("length", F.lit(1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()
