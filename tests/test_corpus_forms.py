"""The forms of a document are not made a second time to test whether it has keys."""

import re

from groundline.functions.unicode import nfkd_without_marks
from groundline.operators.corpus_search import candidate_pairs, document_forms, token_frequencies, value_forms, value_keys
from pyspark.sql import functions as F


def test_forms_are_made_once_a_pass(spark):
    forms = value_forms(spark.createDataFrame([(1, "one two three four")], "value_id long, text string"))
    sources = document_forms(spark.createDataFrame([(1, "so one two three four"), (2, None), (3, ""), (4, "three")], "doc_id long, text string"))
    frequencies = token_frequencies(forms, sources)
    keys = value_keys(forms, frequencies)
    pairs = candidate_pairs(forms, keys, sources)
    for made in (frequencies, pairs):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Filter .*size\(.*array_distinct\(split", plan)
    assert {tuple(r) for r in frequencies.collect()} == {("one", 1), ("two", 1), ("three", 2), ("four", 1)}
    assert [(r.value_id, r.doc_id) for r in pairs.collect()] == [(1, 1)]


def test_only_other_texts_are_folded(spark):
    rows = spark.createDataFrame([("plain",), ("café",), ("ﬁne",), (None,)], "t string")
    assert [r[0] for r in rows.select(nfkd_without_marks(F.col("t"))).collect()] == ["plain", "cafe", "fine", None]
