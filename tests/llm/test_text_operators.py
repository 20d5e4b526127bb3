import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward_rows, documents
from pyspark.sql import functions as F

from groundline.llm import doc_stats, licenses, line_dedup

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


LICENSED = [
    (1, "Released Under the MIT-License; under the mit license and under THE  mit\nlicense.", "", "", 0),
    (2, "Apache License, Version 2.0. CC BY-NC! Accept cc by nc", "", "", 0),
    (3, "apache license version 20 and cc by ncé are none", "", "", 0),
    (4, "This program is licensed under the GNU Lesser General Public License version 3", "", "", 0),
    (5, "SPDX-License-Identifier: Apache-2.0", "", "", 0),
    (6, "occ by nc, the license of the river", "", "", 0),
    (7, "İ under the mit license", "", "", 0),
]


def base_by_hand(text):
    words = WORD.findall(ascii_lower(text or ""))
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        found += [(n, label) for n in range(len(words)) if words[n : n + len(parts)] == parts]
    return words, found


def test_license_scan_against_brute_force(spark):
    rows = LICENSED + awkward_rows()
    docs = documents(spark, rows).withColumn("labels", F.lit("clash")).withColumn("score", F.lit("x"))
    got = licenses.scan_licenses(docs).collect()
    want = []
    for doc_id, text, *_ in rows:
        words, found = base_by_hand(text)
        want.append((doc_id, len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({f[1] for f in found}))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    by_id = {r.doc_id: r for r in got if r.doc_id in range(1, 8) and r.detections}
    assert by_id[4].labels == "lgpl-3" and by_id[5].labels == "apache-2"
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_contained_detections_are_suppressed():
    inner = licenses.Detection(3, 5, 2, "gpl", "title")
    outer = licenses.Detection(2, 6, 4, "lgpl-3", "grant")
    beside = licenses.Detection(6, 8, 1, "mit", "mention")
    assert licenses.resolve([inner, outer, beside]) == [outer, beside]
    assert sum(len(group) for group in licenses.rules().values()) >= 200


def test_suppression_of_many_detections_against_brute_force():
    dice = random.Random(5)
    for _ in range(40):
        found = []
        for _ in range(dice.randrange(60)):
            first = dice.randrange(40)
            found.append(licenses.Detection(first, first + dice.randrange(8), dice.randrange(1, 6), dice.choice("ab"), "title"))
        kept = []
        for one in sorted(set(found), key=lambda d: (-d.order, d.first - d.last, d.first, d.label)):
            if not any(k.first <= one.first and one.last <= k.last for k in kept):
                kept.append(one)
        assert licenses.resolve(found) == kept


def test_places_in_a_very_long_text():
    text = b"under the mit license and " * 60_000
    base, kept = licenses.scan(text)
    assert len(base) == 60_000 and base[-1][0] == 5 * 59_999 and {k.label for k in kept} == {"mit"}


def dedup_by_hand(rows, least, keep_first=False):
    def key(line):
        return ascii_lower(line.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for r in rows for k in {key(line) for line in (r[1] or "").split("\n")} if k)
    drop = {k for k, n in seen.items() if n >= least}
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for line in (r[1] or "").split("\n"):
            first.setdefault(key(line), r[0])
    out = []
    for r in rows:
        lines, kept, spared = (r[1] or "").split("\n"), [], set()
        for line in lines:
            k = key(line)
            if k not in drop:
                kept.append(line)
            elif keep_first and first[k] == r[0] and k not in spared:
                spared.add(k)
                kept.append(line)
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("largest_bits", [line_dedup.LARGEST_FILTER_BITS, 0])
def test_line_dedup_against_brute_force(spark, largest_bits):
    docs = documents(spark).withColumn("n_lines", F.lit("clash")).withColumn("line", F.lit(1)).repartition(5)
    got = line_dedup.drop_shared_lines(docs, min_documents=4, largest_bits=largest_bits)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "n_lines", "n_dropped"]
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()) == dedup_by_hand(awkward_rows(), 4)


@pytest.mark.parametrize("lines", [20, 200])
def test_few_lines_are_suspected_at_every_size(spark, monkeypatch, lines):
    monkeypatch.setattr(line_dedup, "LAYER_BITS", 1 << 10)
    monkeypatch.setattr(line_dedup, "RANGE_BYTES", 4096)
    rows = [(n, "\n".join([f"line {n} {k}" for k in range(lines)] + [f"twice {n // 2} {k}" for k in range(lines // 10)]), "en", "s", 0) for n in range(100)]
    for largest in (line_dedup.LARGEST_FILTER_BITS, 0):
        docs = documents(spark, rows).withColumn("_llm_row", F.monotonically_increasing_id()).repartition(7)
        found = line_dedup.suspected_lines(docs, 1, "_llm_row", largest)
        repeated = 100 * (lines // 10)
        assert repeated <= found.count() <= repeated + 0.01 * 100 * lines


def test_filter_grows_and_forgets_nothing():
    once = line_dedup.Once(bits=1 << 12)
    hashes = line_dedup._hashes([b"%d" % n for n in range(9000)])
    parts = np.array_split(hashes, 23)
    fresh = [once.seen(p) for p in parts]
    assert np.concatenate(fresh).mean() < 0.1 and all(once.seen(p).all() for p in parts) and len(once.layers) > 20


def test_line_dedup_with_own_columns_of_inner_names(spark):
    docs = documents(spark).withColumn("_llm_row", F.lit("own")).withColumn("_llm_drops", F.lit(1))
    got = line_dedup.drop_shared_lines(docs, min_documents=4)
    assert {(r["_llm_row"], r["_llm_drops"]) for r in got.collect()} == {("own", 1)}


def test_line_dedup_of_many_lines_is_exact(spark):
    rows = [(n, "\n".join(f"line {n} {k}" for k in range(400)) + ("\ncommon" if n % 3 else ""), "en", "s", 0) for n in range(60)]
    got = line_dedup.drop_shared_lines(documents(spark, rows), largest_bits=0)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()) == dedup_by_hand(rows, 10)


def test_first_line_can_stay(spark):
    rows = [(n, f"Same line\nown {n}\nsame line", "en", "s", 0) for n in range(12)]
    got = line_dedup.drop_shared_lines(documents(spark, rows), keep_first=True)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()) == dedup_by_hand(rows, 10, True)
    assert line_dedup.drop_shared_lines(documents(spark, [])).count() == 0


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[n : n + 5]) for n in range(len(words) - 4))
    inside = set()
    for n in range(len(words) - 4):
        if runs[tuple(words[n : n + 5])] > 1:
            inside |= set(range(n, n + 5))
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_counts_against_brute_force():
    import pyarrow as pa

    texts = [r[1] for r in awkward_rows()] + ["a b c d e a b c d e f", "x x x x x x", "l\nl\n \n \nl ", "#*$%&|<> é\x85\xa0 ü", "go " * 200]
    found = doc_stats.stats(pa.array(texts, pa.string()))
    assert found.features.shape == (len(texts), len(doc_stats.FEATURES)) and (found.features == found.features).all()
    for n, text in enumerate(texts):
        assert tuple(int(found.counts[c][n]) for c in doc_stats.COUNTS) == counts_by_hand(text), text
    assert doc_stats.stats(pa.array([], pa.string())).features.shape == (0, len(doc_stats.FEATURES))


def examples(body):
    """Texts of a pattern: without and with what is optional, by the first and by the last of alternatives."""
    import re

    for optional in (False, True):
        for pick in (0, -1):
            text, before = body.replace("\\w+", "x"), None
            while text != before:
                before = text
                text = re.sub(r"\((?:\?:)?([^()]*)\)(\??)", lambda m: "" if m[2] and not optional else m[1].split("|")[pick], text)  # noqa: B023
                text = re.sub(r"\[([^]]*)\](\??)", lambda m: "" if m[2] and not optional else m[1][pick], text)  # noqa: B023
            yield re.sub(r"(.)\?", r"\1" if optional else "", text)


def test_quick_tests_hide_no_rule():
    every = [rule for group in licenses.rules().values() for rule in group]
    for rule in every:
        for text in examples(rule.pattern.pattern.decode().removeprefix("(?<= )(?:").removesuffix(")(?= )")):
            spaced = f" {text} ".encode()
            assert rule.pattern.search(spaced), (rule, text)
            found = []
            for other in every:
                for m in other.pattern.finditer(spaced):
                    first = spaced[: m.start()].count(b" ") - 1
                    found.append(licenses.Detection(first, first + m.group().count(b" "), licenses.KINDS[other.kind][0], other.label, other.kind))
            want = licenses.resolve(found)
            for joint in (" ", "/", ".\n"):
                assert licenses.scan(text.replace(" ", joint).encode())[1] == want, text
    labels = lambda text: {d.label for d in licenses.scan(text)[1]}
    assert labels(b"covered by https://www.mozilla.org/mpl/2.0/") == {"mpl-2"}
    assert labels(b"released under the expat license") == {"mit"}
    assert labels(b"the open data commons database license") == {"odbl-1"}
    assert labels(b"all rights\nreserved") == {"proprietary"}
