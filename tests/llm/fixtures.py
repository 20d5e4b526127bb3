"""Small document tables with the awkward cases, shared by the tests of the subpackage."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
VOICES = ["the", "of", "and", "river", "stone", "cloud", "wander", "quiet", "ember", "lantern", "sable", "drift", "élan", "Ünder"]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for n in range(words):
        out.append(rng.choice(VOICES) + str(rng.randrange(40)) * (rng.random() < 0.4))
        if n % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def awkward_rows() -> list[tuple]:
    """Null and empty texts, blanks, one word, a long text, copies, repeated rows, null ids and sources."""
    rows = [(n, prose(n, 20 + n % 60), "en", f"s{n % 4}", 1) for n in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", None, 0), (102, " \t\n\x0b ", None, "s1", 5), (103, "one", "en", "s2", 3)]
    rows += [(None, prose(3, 30), "en", "s1", 9), (None, None, None, None, None), (104, prose(5, 9000), "en", "s3", 4)]
    rows += [(105, prose(1, 21), "en", "s3", 2), (106, prose(1, 21), "en", "s0", 2), (1, prose(1, 21), "en", "s1", 1), (1, prose(1, 21), "en", "s1", 1)]
    rows += [(110 + n, "Shared banner line\n" + prose(300 + n, 25), "en", "s2", 0) for n in range(12)]
    rows += [(130 + n, "  shared BANNER line\t\nshort " + "go " * 12, "en", "s2", 0) for n in range(3)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOCUMENTS)
