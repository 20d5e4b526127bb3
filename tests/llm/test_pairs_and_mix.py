import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import awkward_rows, documents, prose
from pyspark.sql import functions as F

from groundline.llm import components, mixing, rabitq, simhash
from groundline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def fingerprint_by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [words[n : n + 3] for n in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints, distance=3):
    """Smallest member index of each index's component."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check_groups(got, rows):
    prints = [fingerprint_by_hand(r[1]) for r in rows]
    groups = groups_by_hand(prints)
    least = defaultdict(list)
    for g, r in zip(groups, rows, strict=True):
        if r[0] is not None:
            least[g].append(r[0])
    want = sorted(str((r[0], f"{p:016x}", min(least[g], default=None))) for r, p, g in zip(rows, prints, groups, strict=True))
    assert sorted(str((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id)) for r in got) == want


def test_near_duplicates_against_brute_force(spark):
    rows = awkward_rows()
    rng = random.Random(4)
    for n in range(120):
        words = prose(n % 6, 150).split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + n, " ".join(words), "en", "s", 0))
    docs = documents(spark, rows).withColumn("fp", F.lit("clash")).repartition(4)
    check_groups(simhash.near_duplicates(docs).collect(), rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = groups_by_hand([fingerprint_by_hand(r[1]) for r in rows])
    assert kept.count() == len(set(groups))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({min(own) for g in set(groups) if (own := [r[0] for r, h in zip(rows, groups, strict=True) if h == g and r[0] is not None])})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("large", [4096, 20])
@pytest.mark.parametrize("total", [500, 10**6, 10**9])
def test_buckets_lose_no_link(spark, large, total):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(350):
        one = rng.choice(prints)
        for _ in range(rng.randrange(1, 5)):
            one ^= 1 << rng.randrange(64)
        prints.append(one)
    base = prints[0]
    prints += [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    prints = sorted(set(prints))
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    groups = simhash.bit_groups(table)
    assert sorted(b for g in groups for b in g) == list(range(64))
    parts = simhash.allocate(total, simhash.atom_distances(table, groups, 3)[1], 3)
    assert sum(p.threshold + 1 for p in parts) == 4 and sum(p.width for p in parts) <= 64
    keys = simhash.bucket_keys(table, groups, parts)
    links = simhash.links_in_buckets(keys, groups, parts, 3, large)
    roots = {r.node & (1 << 64) - 1: r.root for r in components.components(links).collect()}
    want = groups_by_hand(prints)
    by_group = defaultdict(set)
    for p, g in zip(prints, want, strict=True):
        by_group[g].add(roots.get(p, ("alone", p)))
    assert all(len(names) == 1 for names in by_group.values())
    assert len({next(iter(n)) for n in by_group.values()}) == len(by_group)


def test_thresholds_follow_the_number_of_fingerprints():
    even = np.tile([1 / 256, 8 / 256, 28 / 256, 56 / 256], (8, 1))
    few, many = simhash.allocate(10**4, even, 3), simhash.allocate(10**9, even, 3)
    assert max(p.width for p in many) > max(p.width for p in few)


def test_components_of_paths_stars_and_nothing(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def nearest_by_hand(rows, k, divisor=20):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, (i, v) in enumerate(usable):
        if i % divisor == 0:
            scored = sorted((-float(w @ v), j) for c, (j, w) in enumerate(usable) if c != q)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_nearest_with_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(n, rng.normal(size=16).tolist()) for n in range(300)]
    rows += [(300 + n, rows[40][1]) for n in range(60)]  # a vector that occurs often: ties
    rows += [(500, None), (None, rows[0][1]), (520, [0.0] * 16), (540, [1.0] * 15 + [None]), (560, [float("nan")] * 16), (580, [1.0] * 15 + [float("inf")])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = defaultdict(list)
    for r in rabitq.nearest(table, F.col("vec_id") % 20 == 0, k=20, candidate_block=128, query_block=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = nearest_by_hand(rows, 20)
    assert got.keys() == want.keys()
    hits = 0
    for i, found in got.items():
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        hits += len({f[1] for f in found} & {w[0] for w in want[i]})
    assert hits / (20 * len(want)) > 0.97
    tied = [f[1] for f in sorted(got[40])]
    assert tied == [j for j, _ in want[40]] and len(set(tied) & set(range(300, 330))) > 10


def test_fewer_candidates_repeated_ids_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 2.0])], "vec_id long, embedding array<float>")
    got = rabitq.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 0, 1.0), (0, 2, 1, 0.5)]
    assert rabitq.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are not here")
def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = nearest_by_hand(rows, 20)
    got = defaultdict(dict)
    for r in QUERIES["op4_nearest"](spark, "/root/testdata/sf0.1").collect():
        got[r.query_id][r.vec_id] = r.score
    hits = sum(len(got[i].keys() & {j for j, _ in w}) for i, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.95
    for i, w in want.items():
        assert all(abs(got[i][j] - s) < 1e-9 for j, s in w if j in got[i])


def targets_by_hand(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[n % 3] for n, s in enumerate(order)}
    target, left, active = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and active:
        share = left / sum(weight[s] for s in active)
        left = 0.0
        for s in list(active):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                active.discard(s)
    return target


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_mix_reaches_its_targets(spark, ranges):
    rows = awkward_rows()
    docs = documents(spark, rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).repartition(3)
    got = mixing.mix(docs, ranges=ranges).collect()
    size_of = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((r[0], size_of(r[1]))) for r in rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
        largest[r[3]] = max(largest[r[3]], size_of(r[1]))
    want = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(6), ranges=5).collect()
    assert sorted(str((r.doc_id, r.size, r.taken)) for r in again) == sorted(str((r.doc_id, r.size, r.taken)) for r in got)
    mixed = mixing.mixed_documents(docs, ranges=ranges)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(documents(spark, [])).count() == 0


def test_quality_weights_change_the_odds(spark):
    rows = [(n, "word " * 10 if n % 2 else "W0RD " * 10, "en", "s", 0) for n in range(2000)] + [(5000, "a " * 60000, "en", "t", 0)]
    docs = documents(spark, rows)
    taken = {r.doc_id: r.copies for r in mixing.mix(docs, whole=0.4, weights=(1.0,)).collect()}
    plain, marked = sum(taken[n] for n in range(1, 2000, 2)), sum(taken[n] for n in range(0, 2000, 2))
    assert plain > 1.5 * marked > 0


def test_ranges_of_keys_hold_few_documents_of_every_weight(spark):
    for weight in (0.1, 0.14, 0.4, 1.0):
        draws = spark.range(40_000).select((-F.log((F.col("id") + 0.5) / 40_000) / weight).alias("k"))
        sized = draws.groupBy(mixing.key_range(F.col("k"), 100).alias("r")).agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"))
        rows = sorted(sized.collect())
        assert max(r.n for r in rows) < 15 * 400
        assert all(low.b <= high.a for low, high in zip(rows, rows[1:], strict=False))


def test_nearest_spreads_a_frequent_id_and_keeps_its_equal_rows(spark):
    rng = np.random.default_rng(3)
    draw = lambda: rng.normal(size=16).tolist()
    rows = [(n, draw()) for n in range(100, 400)] + [(40, draw()) for _ in range(200)]
    rows += [(40, rows[300][1])] * 4 + [(41, draw())] * 90
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors = rabitq.usable_vectors(table, "vec_id", "embedding")
    blocks = rabitq.dealt(vectors, 8, 20).groupBy("cb").agg(F.sum("copies").alias("n")).collect()
    assert len(blocks) == 8 and max(r.n for r in blocks) < 120
    got = {}
    for r in rabitq.nearest(table, F.col("vec_id") % 20 == 0, k=20, candidate_block=64, query_block=2, certainty=50.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score))
    asked = {i: min(v for j, v in rows if j == i) for i in {r[0] for r in rows} if i % 20 == 0}
    assert set(got) == set(asked)
    for i, q in asked.items():
        own = rows.index((i, q))
        best = sorted((float(np.dot(q, v)) for at, (_, v) in enumerate(rows) if at != own), reverse=True)[:20]
        assert np.allclose([s for _, s in sorted(got[i])], best)


def test_vectors_of_other_lengths_do_not_meet(spark):
    rows = [(0, [1.0, 2.0]), (1, [5.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 1.0]), (20, [4.0]), (40, [1.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.vec_id, r.score) for r in rabitq.nearest(table, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 3, 4.0), (20, 1, 20.0)]


def test_mix_keeps_each_sources_copies(spark):
    text = prose(3, 40)
    docs = documents(spark, [(7, text, "en", "a", 0)] + [(7, text, "en", "b", 0)] * 2).withColumn("_llm_row", F.lit("own"))
    mixed = mixing.mixed_documents(docs, whole=1.0, weights=(1.0, 2.0))
    assert mixed.columns == docs.columns
    got = [(r.source, r["_llm_row"]) for r in mixed.collect()]
    taken = mixing.mix(docs, whole=1.0, weights=(1.0, 2.0)).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert sorted(got) == sorted((r.source, "own") for r in taken for _ in range(r.n))


def test_one_id_with_most_rows_is_split_and_drawn_by_rank(spark):
    rows = [(9, f"word {n % 50} " * 5, "en", "s", 0) for n in range(3000)] + [(9, "equal words here", "en", "s", 0)] * 1500 + [(5000 + n, prose(n, 20), "en", "t", 0) for n in range(500)]
    docs = documents(spark, rows).repartition(5)
    mixes = [mixing.mix(d, weights=(1.0, 3.0), whole=0.7, ranges=r).collect() for d, r in ((docs, None), (docs.repartition(3), 4))]
    one, two = (sorted(str((r.doc_id, r.size, r.row_key, r.taken)) for r in m) for m in mixes)
    assert one == two
    by_source = defaultdict(list)
    for r in mixes[0]:
        by_source[r.source].append(r)
    for own in by_source.values():
        # brute-force draw: keys from ids and weights, in order, up to the budget beyond whole epochs
        target, total = own[0].target, own[0].source_size
        rest = target - total * int(target // total)
        assert abs(sum(r.taken for r in own) - total * int(target // total) - rest) <= max(r.size for r in own) / 2 + 1e-6
    part = mixing._in_order(docs.select("source", F.lit(0).alias("_range"), F.lit(1.0).alias("_key"), "doc_id", F.lit(2).cast("long").alias("size"), mixing.row_key().alias("row_key"), F.monotonically_increasing_id().alias("_row")), 100)
    for source, number in (("s", 4500), ("t", 500)):
        assert sorted(r._within for r in part.filter(F.col("source") == source).collect()) == list(range(0, 2 * number, 2))


def test_the_draw_against_brute_force(spark):
    import hashlib
    import math

    rows = [(n, prose(n, 10 + n % 40) + "#" * (n % 30), "en", f"s{n % 2}", 0) for n in range(400)]
    got = {r.doc_id: r for r in mixing.mix(documents(spark, rows).repartition(4), weights=(1.0, 3.0), whole=0.8, ranges=6).collect()}
    for source in ("s0", "s1"):
        own = []
        for doc_id, text, _, s, _ in rows:
            if s == source:
                odd = sum(c not in "abcdefghijklmnopqrstuvwxyz .,\n" for c in text)
                draw = (int(hashlib.md5(f"mix-1:{doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                own.append((-math.log(draw) / max(0.1, 1 - odd / len(text)), doc_id))
        size = {i: got[i].size for _, i in own}
        total, target = sum(size.values()), got[own[0][1]].target
        epochs, so_far, rest = int(target // total), 0, target - total * int(target // total)
        for _, i in sorted(own):
            assert got[i].copies == epochs + (so_far + size[i] / 2 <= rest)
            so_far += size[i]
