import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from fixtures import awkward_rows, documents
from pyspark.sql import functions as F

from groundline.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def field():
    return pii.fitted()


def base_by_hand(text):
    out = []
    for order, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(2 * int(d), 10)) if n % 2 else int(d) for n, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def spelt_by_hand(text):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base_by_hand(text))


PLAIN = [
    "write to Anna.b+x@mail7.example.com, or a@b.c@d.e.f and x@y",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.255 or 1.2.3",
    "card 4539 1488 0343 6467 and 4539-1488-0343-6467 5 or 4539148803436468",
    "+1 (555) 010-2345 +49 30 1234567 +12 +1 (555) 010-2345 190.137.223.20",
    "élan ü@x.y ñ 4539148803436467",
    "a.@.b @a.b %@-.- ..@a..b",
    "+1+2+3 + 1 (2) +1234567890123456 +123-456-789-0.",
]


def test_base_rules_equal_the_plain_expressions():
    rng = random.Random(3)
    texts = PLAIN + ["".join(rng.choice("0123456789.@+-() aZ%_") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += [" ".join(rng.choice(PLAIN).split()[:3]) * 3 for _ in range(300)]
    for text in texts:
        assert pii.spelt(pii.base_spans(text)) == spelt_by_hand(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 50_000, "1." * 50_000, "12 " * 50_000, "+1" * 50_000, "a.b@c-" * 10_000, "4539148803436467 " * 3_000])
def test_long_texts_of_one_kind_end(text, field):
    base, spans = pii.spans_of(text, field)
    assert set(base) <= set(spans)


def cuts(n, found):
    """Every cut of n tokens into candidates and single others, as lists of candidate indexes."""
    def go(i):
        if i == n:
            yield []
            return
        for rest in go(i + 1):
            yield rest
        for x, c in enumerate(found):
            if c.first == i:
                for rest in go(c.after):
                    yield [x, *rest]

    return list(go(0))


def score_by_hand(field, n, found, cut):
    return sum(field.weights[list(found[x].features)].sum() for x in cut) + (pii._chosen(n, [found[x] for x in cut]) * field.pairs).sum()


def random_field(seed):
    rng = np.random.default_rng(seed)
    return pii.Field(rng.normal(0, 1, pii.WEIGHTS), rng.normal(0, 1, (len(pii.KINDS) + 1,) * 2))


def random_window(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 6)
    spans = {(a, b, k) for a, b in itertools.combinations(range(n + 1), 2) if b - a < 4 for k in range(3) if rng.random() < 0.2}
    return n, [pii.Candidate(a, b, k, tuple(rng.randrange(pii.WEIGHTS) for _ in range(3))) for a, b, k in sorted(spans)]


@pytest.mark.parametrize("seed", range(25))
def test_best_cut_and_expectations_against_all_cuts(seed):
    field, (n, found) = random_field(seed), random_window(seed)
    every = cuts(n, found)
    scores = np.array([score_by_hand(field, n, found, cut) for cut in every])
    best = [found.index(c) for c in field.best(n, found)]
    assert np.isclose(score_by_hand(field, n, found, best), scores.max())
    whole, often, pairs = field.expected(n, found, field.scores(found))
    share = np.exp(scores - scores.max())
    assert np.isclose(whole, scores.max() + np.log(share.sum()))
    share /= share.sum()
    assert np.allclose(often, [sum(p for p, cut in zip(share, every, strict=True) if x in cut) for x in range(len(found))])
    assert np.allclose(pairs, sum(p * pii._chosen(n, [found[x] for x in cut]) for p, cut in zip(share, every, strict=True)))


def test_slopes_of_the_likelihood():
    rng = random.Random(5)
    examples = [pii.example(*pii.sentence(rng)) for _ in range(6)]
    field = random_field(1)
    field.weights *= 0.1
    total, weights, pairs = pii.gradient(field, examples, 0.3)
    used = sorted({f for e in examples for c in e.found for f in c.features})[:12]
    for place in used:
        moved = pii.Field(field.weights.copy(), field.pairs)
        moved.weights[place] += 1e-5
        assert np.isclose((pii.gradient(moved, examples, 0.3)[0] - total) / 1e-5, weights[place], rtol=1e-3, atol=1e-3)
    moved = pii.Field(field.weights, field.pairs.copy())
    moved.pairs[-1, 2] += 1e-5
    assert np.isclose((pii.gradient(moved, examples, 0.3)[0] - total) / 1e-5, pairs[-1, 2], rtol=1e-3, atol=1e-3)


def test_held_out_sentences(field):
    rng = random.Random(4711)
    hit = wrong = missed = 0
    for _ in range(500):
        text, spans = pii.sentence(rng)
        window = pii.Window(0, text, [m.span() for m in pii._TOKEN.finditer(text)])
        got = {(window.tokens[c.first][0], window.tokens[c.after - 1][1], c.kind) for c in field.best(len(window.tokens), pii.candidates(window))}
        hit, wrong, missed = hit + len(got & spans), wrong + len(got - spans), missed + len(spans - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("reach nora dot paul at uni dot org today", "email", "nora dot paul at uni dot org"),
        ("mail leo(at)corp.net please", "email", "leo(at)corp.net"),
        ("host 10[.]20[.]30[.]40 fell", "ip", "10[.]20[.]30[.]40"),
        ("card 4539.1488.0343.6467 was", "card", "4539.1488.0343.6467"),
        ("please call (555) 010-2345 today", "phone", "(555) 010-2345"),
        ('token = "9b0b3c6a43eb78aa99cbd7049c572391" then', "secret", "9b0b3c6a43eb78aa99cbd7049c572391"),
        ("ssn 123-45-6789 was", "identity", "123-45-6789"),
        ("number 7536784127813050 4845168114407329 was", "card", "4845168114407329"),
    ],
)
def test_spans_beyond_the_base_rules(field, text, kind, value):
    _, spans = pii.spans_of(text, field)
    assert (kind, value) in {(pii.KINDS[s.kind], text[s.start : s.end]) for s in spans}


@pytest.mark.parametrize("text", ["version 4.19.2.3000 of it", "commit 986d178794c8b5db55a00268e4c63b271f5afdc4 after", "order 123456789012", "on 2024-05-11 12:30:55", "number 4539148803436468 was", "the secret token of anna", "look at page 12.5 and stay", "ISBN 978-3-16-148410-0"])
def test_look_alikes_are_left_alone(field, text):
    assert pii.spans_of(text, field)[1] == []


def test_table_of_awkward_rows(spark, field):
    texts = [*PLAIN, "call (555) 010-2345 " * 400, "4" * 16 + " " + "x" * 2_000 + " anna(at)corp.net", "secret"]
    rows = awkward_rows() + [(500 + n, t, "en", "s", 1) for n, t in enumerate(texts)]
    docs = documents(spark, rows).withColumn("spans", F.lit("clash")).withColumn("found", F.lit(1)).repartition(4)
    got = pii.find_personal_data(docs, field)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
    want = []
    for doc_id, text, *_ in rows:
        base = base_by_hand(text or "")
        counts = [sum(k == kind for *_, k in base) for kind in RULES]
        want.append(str((doc_id, *counts, hashlib.sha256(spelt_by_hand(text or "").encode()).hexdigest(), pii.spelt(pii.spans_of(text or "", field)[1]))))
    found = got.collect()
    assert sorted(str(tuple(r)[:-1]) for r in found) == sorted(want)
    for r in found:
        assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found)
    assert pii.find_personal_data(documents(spark, []), field).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(docs.filter("doc_id >= 500"), field).collect()}
    assert "@mail7" not in clean[500] and "<email>" in clean[500] and clean[507].count("<phone>") == 400


def test_base_spans_stay_and_nothing_of_the_field_touches_them(field):
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join(rng.choice([rng.choice(PLAIN), pii.sentence(rng)[0]]) for _ in range(3))
        base, spans = pii.spans_of(text, field)
        assert set(base) <= set(spans) and spans == sorted(spans)
        for s in set(spans) - set(base):
            assert all(s.end <= b.start or b.end <= s.start for b in base)
