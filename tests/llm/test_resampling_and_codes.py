import hashlib
import math
import os
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from fixtures import awkward_rows, documents, prose
from pyspark.sql import functions as F

from groundline.llm import grid_codes, resampling
from groundline.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_by_hand(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled_by_hand(rows, targets, longest=1, buckets=10_000, fewest=20):
    of = lambda f: crc32(f.encode()) % buckets
    s = Counter(of(g) for r in rows for g in grams_by_hand(r[1], longest)[1])
    t = Counter(of(g) for x in targets for g in grams_by_hand(x, longest)[1])
    whole_s, whole_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for r in rows:
        words, grams = grams_by_hand(r[1], longest)
        weight = sum(math.floor(1000 * math.log((t[of(g)] + 1) * whole_s / ((s[of(g)] + 1) * whole_t))) for g in grams)
        h = int(hashlib.sha256(f"2024:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= fewest])
    eligible = sorted((o for o in out if o[4]), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    ranks = {id(o): n for n, o in enumerate(eligible[: 10 * len(eligible) // 100], 1)}
    return sorted(str((*o[:4], ranks.get(id(o)))) for o in out)


def rows_of(frame):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in frame.collect())


TARGETS = ["The river, the RIVER and 12 stones", None, "", "élan vital \x00 x", prose(900, 300)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_against_brute_force(spark, longest):
    rows = awkward_rows() + [(200, "A b c \x7f d_e", "en", "s", 1), (201, "a" * 300_000 + " " + "b c " * 50_000, "en", "s", 1)]
    rows += [(300, "river " * 25, "en", "s", 1)] * 40  # one id with a fifth of all rows, all equal
    docs = documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash")).repartition(5)
    target = spark.createDataFrame([(n, t) for n, t in enumerate(TARGETS)], "item_id long, text string")
    got = resampling.resample(docs, target, longest=longest, buckets=97)
    assert got.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    assert rows_of(got) == resampled_by_hand(rows, TARGETS, longest, 97)


def test_resampling_of_nothing_and_towards_nothing(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resample(documents(spark, []), target).count() == 0
    rows = awkward_rows()
    assert rows_of(resampling.resample(documents(spark, rows), target.limit(0))) == resampled_by_hand(rows, [])


def test_places_are_gapless_over_many_ranges(spark):
    scored = spark.range(5000).select((F.col("id") % 700).alias("doc_id"), F.when(F.col("id") < 2000, 5).otherwise(F.col("id") % 90).cast("long").alias("score"))
    got = [tuple(r) for r in resampling.ranked(scored, 16).select("place", "score", "doc_id").collect()]
    assert [(-s, d) for _, s, d in sorted(got)] == sorted((-s, d) for _, s, d in got) and sorted(p for p, *_ in got) == list(range(1, 5001))


def test_spans_overlap_and_keep_to_word_boundaries():
    text = resampling.collapsed("One  two-THREE\tvier".encode())
    assert text == b"one two three vier"
    assert list(resampling.features(text, resampling.runs(3))) == [b"one", b"two", b"three", b"vier", b"one two", b"two three", b"three vier", b"one two three", b"two three vier"]


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next(len(r[1]) for r in order if r[1])
    whole = lambda v: [max(-(1 << 26), min(1 << 26, math.floor(1024 * x))) for x in v]
    cut = lambda v: [whole(v)[p * size // parts : (p + 1) * size // parts] for p in range(parts)]
    same = [r for r in order if len(r[1]) == size]
    books = [[cut(r[1])[p] for r in same[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        hits = [[[] for _ in book] for book in books]
        for r in same:
            for p, x in enumerate(cut(r[1])):
                hits[p][near(p, x)[1]].append(x)
        books = [[[sum(d) // len(h) for d in zip(*h, strict=True)] if h else c for h, c in zip(hits[p], books[p], strict=True)] for p in range(parts)]
    out, sums = [], Counter()
    for r in kept:
        best = [near(p, x) for p, x in enumerate(cut(r[1]))] if len(r[1]) == size else None
        error = None if best is None else sum(d for d, _ in best)
        out.append((r[0], None if best is None else bytes(e for _, e in best).hex(), error, r[2]))
        sums[r[2]] += error or 0
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    known = {o[3] for o in out if o[2] is not None}
    return sorted(str((i, code, error, sums[label] if label in known else None)) for i, code, error, label in out), digest


def vectors(seed, n, size=8):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, size)], int(i) % 3) for i in rng.permutation(n)]


AWKWARD = [(5000, None, 1), (5001, [0.1] * 7 + [None], 1), (5002, [0.1] * 7 + [float("nan")], 1), (5003, [float("inf")] * 8, 1), (None, [0.25] * 8, None), (5004, [0.0] * 8, None), (5005, [0.1] * 4, 9), (5006, [], 1), (5007, [1e30, -1e30] * 4, 2)]


@pytest.mark.parametrize("entries", [256, 40])
def test_codes_against_brute_force(spark, entries):
    rows = vectors(1, 400) + AWKWARD + [(7, [0.5] * 8, 4)] * 30 + [(9000, [0.03125, -0.03125] * 4, 5)] * 90
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    got, codebooks = grid_codes.compress(table, entries=entries)
    want, digest = codes_by_hand(rows, entries=entries)
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got.collect()) == want
    assert grid_codes.digest(codebooks) == digest


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    got, codebooks = grid_codes.compress(spark.createDataFrame([], schema))
    assert got.count() == 0 and codebooks is None
    got, codebooks = grid_codes.compress(spark.createDataFrame([(3, [1.0, 2.0, 3.0, 4.0], None)], schema))
    assert [tuple(r) for r in got.collect()] == [(3, "00000000", 0, 0)] and codebooks.shape == (4, 1, 1)
    with pytest.raises(ValueError):
        grid_codes.compress(spark.createDataFrame([(3, [1.0, 2.0, 3.0], None)], schema))


@pytest.mark.parametrize("width", [1, 7, 32, 500])
def test_cells_keep_every_nearest_entry(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-300, 300, (60, 5))
    entries[40:50] = entries[:10]  # equal entries: ties to the lower one
    points = np.concatenate([rng.integers(-400, 400, (2000, 5)), entries, (entries[:20] + entries[20:40]) // 2])
    full = np.square(points[:, None] - entries[None]).sum(axis=2)
    cells = grid_codes.Cells(entries, width, held=300)
    for _ in range(2):
        for start in range(0, len(points), 250):
            entry, distance = cells.nearest(points[start : start + 250])
            assert (entry == full.argmin(axis=1)[start : start + 250]).all() and (distance == full.min(axis=1)[start : start + 250]).all()
    assert len(cells.masks) <= 300
    if width <= 32:
        assert cells.measured < full.size  # twice the points, fewer measurements than once all pairs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are not here")
@pytest.mark.parametrize("name", ["op11_resampling", "op13_vector_codes"])
def test_reference_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = QUERIES[name](spark, DATA)
    want = duck.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in frame.collect())
