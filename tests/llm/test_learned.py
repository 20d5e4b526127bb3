import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward_rows, documents, prose
from pyspark.sql import functions as F

from groundline.llm import gbt, lm, quality, quality_rules, toxicity
from groundline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
GIVEN = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are not here")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_walk(forest, row):
    total = forest.base
    for t in range(len(forest.feature)):
        node = 0
        while forest.left[t, node] != node:
            node = forest.left[t, node] if row[forest.feature[t, node]] <= forest.cut[t, node] else forest.right[t, node]
        total += forest.value[t, node]
    return total


def test_flat_trees_equal_a_plain_walk_and_follow_the_constraint():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(800, 4))
    labels = (rows[:, 0] - 0.5 * rows[:, 1] + 0.4 * rng.normal(size=800) > 0).astype(float)
    forest = gbt.fit(rows, labels, trees=20, monotone={0: 1, 1: -1})
    assert np.allclose(forest.raw(rows[:50]), [plain_walk(forest, r) for r in rows[:50]])
    assert ((forest.score(rows) > 0.5) == labels).mean() > 0.85
    for column, sign in ((0, 1), (1, -1)):
        moved = np.repeat(rows[:40], 30, axis=0)
        moved[:, column] = np.tile(np.linspace(-3, 3, 30), 40)
        steps = np.diff(forest.raw(moved).reshape(40, 30), axis=1) * sign
        assert steps.min() >= -1e-12


def test_without_rows_or_with_one_label():
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (gbt.fit(np.ones((30, 3)), np.ones(30)).score(np.zeros((1, 3))) > 0.9).all()


def test_rules_and_scores_on_awkward_rows(spark):
    docs = documents(spark).withColumn("kept", F.lit("clash")).withColumn("features", F.lit(2))
    labels = labels_of(spark, [(n, n % 2, 0) for n in range(50)] + [(None, 1, 0), (1, 0, 1), (7, None, 1)])
    forest = quality_rules.fit_rules(docs, labels)
    judged = quality_rules.judge(docs, forest).collect()
    assert len(judged) == len(awkward_rows())
    for r in judged:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule_score >= quality_rules.KEEP_FROM)
    scores = quality.score_quality(docs, forest).collect()
    assert len(scores) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in scores)
    assert quality_rules.judge(documents(spark, []), forest).count() == 0


def test_the_choice_of_labelled_rows_is_bounded(spark):
    labels = labels_of(spark, [(n, n % 2, 0) for n in range(100)])
    chosen = quality.labelled(labels, "quality", quality.remainder(5) != 0, limit=30)
    rows = {r.doc_id for r in chosen.collect()}
    assert len(rows) == 30
    import zlib

    assert all(zlib.crc32(str(r).encode()) % 5 for r in rows)


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.2
    fire = np.where(truth[:, None], [0.8, 0.6, 0.7], [0.05, 0.02, 0.1])
    votes = rng.random((20000, 3)) < fire
    votes = np.column_stack([votes, votes[:, 0] ^ (rng.random(20000) < 0.02)])  # the fourth repeats the first
    masks, n = np.unique(votes @ (1 << np.arange(4)), return_counts=True)
    start = np.array([[0.06, 0.03, 0.08, 0.06], [0.7, 0.5, 0.6, 0.7]])
    model = toxicity.estimate(dict(zip(masks.tolist(), n.tolist(), strict=True)), 4, start, 0.2)
    assert model.rates[1, 1] > 7 * model.rates[0, 1] and abs(model.rates[1, 1] - 0.6) < 0.2
    assert model.weights[0] < model.weights[1] and model.weights[3] < model.weights[2]
    assert abs(model.rates[1, 2] - 0.7) < 0.15
    assert ((model.posterior(votes.astype(float)) > 0.5) == truth).mean() > 0.9


def test_toxicity_on_awkward_rows(spark):
    rows = awkward_rows() + [(200 + n, prose(n, 30) + (" you stupid idiot" if n % 2 else ""), "en", "s", 0) for n in range(80)]
    docs = documents(spark, rows).withColumn("label", F.lit("clash"))
    learnable = spark.createDataFrame([(200 + n, n % 2) for n in range(60)], "doc_id long, label int")
    model = toxicity.fit(docs, learnable)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert all(by_id[261 + 2 * n] > 0.7 > by_id[260 + 2 * n] for n in range(9))
    assert toxicity.score_toxicity(documents(spark, []), model).count() == 0


def test_terms_follow_the_posterior_labels_of_all_documents(spark):
    rows = [(n, prose(n, 30) + (" you stupid idiot wretchling" if n % 4 == 0 and n >= 100 else " you stupid idiot" if n % 2 else ""), "en", "s", 0) for n in range(400)]
    docs = documents(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).repartition(3)
    learnable = spark.createDataFrame([(f"d{n}", n % 2) for n in range(100)], "doc_id string, label int")
    model = toxicity.fit(docs, learnable)
    assert "wretchling" in model.terms[0]  # in no labelled document


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = toxicity.fit(documents(spark, []), none)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(documents(spark), model).collect())


@GIVEN
@pytest.mark.parametrize(("name", "label", "number", "rest", "least"), [("op5_quality", "quality", 5, 0, 0.97), ("op6_toxicity", "toxic", 3, 1, 0.8)])
def test_held_out_accuracy(spark, name, label, number, rest, least):
    import zlib

    got = {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}
    for doc_id, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % number == rest)
    truth = duckdb.sql(f"SELECT doc_id, {label} FROM '{DATA}/labels.parquet'").fetchall()
    held = sorted((got[i].score, y) for i, y in truth if got[i].held_out)
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area > least


def losses_by_hand(rows, target):
    """Counts in dictionaries, cells by the operator's own rule for pairs."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    size, names = lm.BIGRAM_CELLS, ("t", "b")
    single = {m: {} for m in names}
    pairs = {m: {} for m in names}
    cell = lambda a, b: int(lm.cells(np.array([a]), np.array([b]), size)[0])
    for doc, seq in ids.items():
        for m in names if doc in target else "b":
            for before, token in zip([lm.VOCABULARY, *seq], seq, strict=False):
                single[m][token] = single[m].get(token, 0) + 1
                pairs[m][cell(before, token)] = pairs[m].get(cell(before, token), 0) + 1
    total = {m: sum(single[m].values()) for m in names}
    scale = {"t": 1.0, "b": total["t"] / total["b"]}
    out = {}
    for doc, seq in ids.items():
        sums = {"t": 0.0, "b": 0.0}
        for m in names:
            for before, token in zip([lm.VOCABULARY, *seq], seq, strict=False):
                alone = (scale[m] * single[m].get(token, 0) + lm.TOKEN_WEIGHT) / (total["t"] + lm.TOKEN_WEIGHT * lm.VOCABULARY)
                context = scale[m] * single[m].get(before, 0)
                pair = min(scale[m] * pairs[m].get(cell(before, token), 0), context)
                sums[m] -= np.log((pair + lm.BIGRAM_WEIGHT * alone) / (context + lm.BIGRAM_WEIGHT))
        n = max(1, len(seq))
        out[doc] = (len(seq), sums["t"] / n, sums["b"] / n)
    return out


def test_losses_against_brute_force(spark):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] not in (1, 104)]
    docs = documents(spark, rows).withColumn("n_tokens", F.lit("clash")).repartition(3)
    models = lm.gather(docs, F.col("doc_id") % 3 == 0, PATH)
    want = losses_by_hand(rows, {r[0] for r in rows if r[0] % 3 == 0})
    for r in lm.score_difference(docs, models, PATH).collect():
        n, target, background = want[r.doc_id]
        assert r.n_tokens == n
        assert np.allclose([r.target_loss, r.background_loss, r.score], [target, background, target - background], rtol=1e-4, atol=1e-5)


def test_language_models_without_rows_or_target(spark):
    models = lm.gather(documents(spark, []), F.lit(True), PATH)
    assert lm.score_difference(documents(spark, []), models, PATH).count() == 0
    none = lm.gather(documents(spark), F.lit(None).cast("boolean"), PATH)
    assert all(np.isfinite(r.score) for r in lm.score_difference(documents(spark), none, PATH).collect())


def exact_losses(rows, target):
    """Mean losses of each row from dictionaries of whole pairs."""
    from collections import Counter

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids = [tok.encode(r[1], add_special_tokens=False).ids for r in rows]
    chosen = {"t": [s for s, r in zip(ids, rows, strict=True) if r[0] in target], "b": ids}
    single = {m: Counter(t for s in seqs for t in s) for m, seqs in chosen.items()}
    pairs = {m: Counter(p for s in seqs for p in zip(s, s[1:], strict=False)) for m, seqs in chosen.items()}
    total = single["t"].total()
    scale = {"t": 1.0, "b": total / single["b"].total()}

    def loss(m, before, token):
        alone = (scale[m] * single[m][token] + lm.TOKEN_WEIGHT) / (total + lm.TOKEN_WEIGHT * lm.VOCABULARY)
        pair, context = scale[m] * pairs[m][before, token], scale[m] * single[m][before]
        return -np.log((pair + lm.BIGRAM_WEIGHT * alone) / (context + lm.BIGRAM_WEIGHT))

    out = [tuple(sum(loss(m, *p) for p in zip([None, *s], s, strict=False)) / len(s) for m in "tb") for s in ids]
    return out, len(pairs["b"])


@pytest.mark.parametrize("limit", [None, 700, 0])
def test_pairs_are_counted_exactly_also_beyond_what_is_broadcast(spark, limit):
    import random

    dice = random.Random(8)
    names = [a + b for a in ("ba", "do", "fe", "gi", "ku", "la", "mo", "ne", "pa", "ri", "so", "te", "wa") for b in ("rn", "st", "ll", "mp", "nd", "ck", "rt", "ss")]
    rows = [(n, " ".join(dice.choices(names, k=1500)), "en", "s", 0) for n in range(24)]
    rows += [rows[2], rows[2], (None, rows[3][1], "en", "s", 0)]
    docs = documents(spark, rows).repartition(3)
    want, n_pairs = exact_losses(rows, {n for n in range(24) if n % 3 == 0})
    models = lm.gather(docs, F.col("doc_id") % 3 == 0, PATH, **({} if limit is None else {"part": 500}))
    scored = lm.score_difference(docs, models, PATH, **({} if limit is None else {"limit": limit}))
    got = sorted(((r.doc_id is None, r.doc_id, r.target_loss, r.background_loss) for r in scored.collect()), key=lambda r: (r[0], r[1] or 0))
    assert np.allclose([r[2:] for r in got], [w for _, w in sorted(zip(rows, want, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0))], rtol=1e-5)
    assert models.pairs.count() == n_pairs > 3000
