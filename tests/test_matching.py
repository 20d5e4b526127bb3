"""Matching against brute force on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from groundline.operators.corpus_search import candidate_pairs, document_forms, ground_in_corpus, token_frequencies, value_forms, value_keys
from groundline.functions.text import normalize_minimal, normalize_search
from groundline.operators import evidence
from groundline.operators.evidence import match_evidence
from groundline.operators.fixed_matching import FUZZY_THRESHOLD, _window_hit
from groundline.session import ensure_checkpoint_dir

WORDS = "the of total due north paper supply house road quay district trading number seven a b".split()


def plain_window_hit(candidate, source):
    """Every window counted afresh."""
    want, have = candidate.split(), source.split()
    for width in range(max(1, len(want) - 2), min(len(have), len(want) + 2) + 1):
        for start in range(len(have) - width + 1):
            window = have[start:start + width]
            shared = sum(min(want.count(t), window.count(t)) for t in set(want))
            if shared and 2 * (shared / width) * (shared / len(want)) / (shared / width + shared / len(want)) >= FUZZY_THRESHOLD:
                return True
    return False


def corpus(seed=3):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for i in range(40)]
    docs += [(100 + i, docs[0][1] + f" copy {i}") for i in range(20)]
    values = []
    for i in range(60):
        words = rng.choice(docs)[1].split()
        start = rng.randrange(len(words))
        picked = words[start:start + rng.randint(1, 12)]
        if i % 3 == 1:
            rng.shuffle(picked)
        if i % 5 == 2:
            picked[0] = "absent"
        joined = " ".join(picked)
        values.append((i, joined[1:-1] or joined if i % 4 == 3 else joined))
    return values + [(900, "!"), (901, "  "), (902, "e")], docs


def expected_match(value, doc):
    if not value.strip():
        return None
    if value.strip() in doc:
        return "exact"
    if value == "!":
        return None
    tokens = value.split()
    if 2 <= len(tokens) <= 80 and len("".join(tokens)) >= 8 and plain_window_hit(" ".join(tokens), doc):
        return "fuzzy"
    return None


def test_window_count_agrees_with_recount():
    rng = random.Random(5)
    for _ in range(400):
        source = " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))
        candidate = " ".join(rng.choices(WORDS, k=rng.randint(2, 9)))
        assert _window_hit(candidate, source) == plain_window_hit(candidate, source)


def test_corpus_grounding_equals_brute_force(spark):
    values, docs = corpus()
    v = spark.createDataFrame(values, "value_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.value_id, r.doc_id): r.match_type for r in ground_in_corpus(v, d).collect()}
    want = {(i, j): m for i, t in values for j, s in docs if (m := expected_match(t, s))}
    assert got == want


def test_shuffled_candidates_equal_broadcast_ones(spark, monkeypatch):
    values, docs = corpus(9)
    ensure_checkpoint_dir(spark)
    forms = value_forms(spark.createDataFrame(values, "value_id long, text string"))
    sources = document_forms(spark.createDataFrame(docs, "doc_id long, text string"))
    keys = value_keys(forms, token_frequencies(forms, sources)).checkpoint()
    near = {(r.value_id, r.doc_id) for r in candidate_pairs(forms, keys, sources).collect()}
    monkeypatch.setattr("groundline.operators.corpus_search.fits_broadcast", lambda df: False)
    far = [(r.value_id, r.doc_id) for r in candidate_pairs(forms, keys, sources).collect()]
    assert len(far) == len(set(far)) and set(far) == near


def test_evidence_equals_brute_force(spark):
    blocks = ["Invoice INV-1001", "Total USD 1,200.00", "desk @ north.example.com", "Tel (555) 123-4567", "Due July 3rd, 2026",
              "Paid: yes / no", "x 12026 07 195", "!!", "", "1200.0000000001", "Acme-Corp Ltd"]
    items = [("identifier", "inv-1001", None, None), ("currency", None, 1200.0, None), ("email", "Desk@north.example.com", None, None),
             ("phone", "555 1234567", None, None), ("date", "2026-07-03", None, None), ("date", "2026-07-19", None, None),
             ("boolean", None, None, True), ("text", "!", None, None), ("text", "e", None, None), ("text", "corp l", None, None),
             ("text", "12", None, None), ("phone", "123456", None, None), ("date", "not a day", None, None),
             ("email", "n/a", None, None), ("email", "a@b.c", None, None), ("email", "none", None, None), ("email", " ", None, None), ("email", "zz", None, None)]
    blocks += ["Mail: N / A", "write to a@B.c or none", "n/ab c"]
    want = {(0, 0), (1, 1), (1, 9), (2, 2), (3, 3), (4, 4), (5, 6), (6, 5), (7, 7), (9, 10)}
    want |= {(13, 11), (13, 13), (14, 12), (15, 12)}
    want |= {(8, i) for i, b in enumerate(blocks) if "e" in b.lower()}
    cands = spark.createDataFrame(
        [(1, i, b, None, None, None) for i, b in enumerate(blocks)],
        "doc_id long, cand_pos long, content string, confidence double, page_number int, polygon string",
    )
    rows = spark.createDataFrame(
        [(1, "field", "f", i, *item) for i, item in enumerate(items)],
        "doc_id long, owner_kind string, owner_id string, item_ord long, value_type string, v_str string, v_num double, v_bool boolean",
    )
    pairs = [(r.item_ord, r.cand_pos) for r in match_evidence(rows, cands).collect()]
    got = set(pairs)
    assert len(pairs) == len(got)
    want |= {(10, i) for i, b in enumerate(blocks) if "12" in b}
    assert got == want


@pytest.mark.parametrize(("chunk", "bundle"), [(4096, 256), (3, 2)])
def test_evidence_in_parts_equals_substring_search(spark, monkeypatch, chunk, bundle):
    monkeypatch.setattr(evidence, "CHUNK_ITEMS", chunk)
    monkeypatch.setattr(evidence, "BUNDLE_BLOCKS", bundle)
    rng = random.Random(chunk)
    blocks = [(d, p, " ".join(rng.choices(["ab", "abc", "bc", "a", "cab", "é", "12", "x\0y"], k=rng.randint(0, 6)))) for d in range(3) for p in range(25)]
    items = [(d, "field", f"f{n}", n, "text", "".join(rng.choices("abc é12", k=rng.randint(1, 4)))) for d in range(3) for n in range(20)]
    cands = spark.createDataFrame([(*b, None, None, None) for b in blocks], "doc_id long, cand_pos long, content string, confidence double, page_number int, polygon string")
    rows = spark.createDataFrame([(*i, None, None) for i in items], "doc_id long, owner_kind string, owner_id string, item_ord long, value_type string, v_str string, v_num double, v_bool boolean")
    got = sorted((r.doc_id, r.item_ord, r.cand_pos) for r in match_evidence(rows, cands).collect())
    forms = lambda s: (normalize_minimal(F.col(s)).alias("m"), normalize_search(F.col(s)).alias("s"))
    needles = [tuple(r) for r in rows.select("doc_id", "item_ord", *forms("v_str")).collect()]
    texts = [tuple(r) for r in cands.select("doc_id", "cand_pos", *forms("content")).collect()]
    assert got == sorted((d, n, p) for d, n, m, s in needles for e, p, bm, bs in texts if d == e and m and (m in bm or (s and s in bs)))
