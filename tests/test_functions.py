"""Golden values of the text, number and date expressions."""

import unicodedata

from pyspark.sql import functions as F

from groundline.functions import dates, numbers, text


def values(spark, items, expression):
    rows = [(i, item) for i, item in enumerate(items)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_minimal_and_search_forms(spark):
    items = ["  Ａcme \r\nCo. ", "Café — “Déjà”", "½ ﬁle", "ĲSSEL Straße", "日本 ㌔"]
    minimal = [" ".join(unicodedata.normalize("NFKC", t).lower().split()) for t in items]
    assert values(spark, items, text.normalize_minimal) == minimal
    assert values(spark, items, text.normalize_search) == [
        "acme co", "cafe deja", "1 2 file", "ijssel straße", "日本 キロ"
    ]


def test_emails_phones_numbers(spark):
    assert values(spark, ["a @ b . co, x.y@z.org;q@r.com.", "none"], text.extract_emails) == [
        ["a@b.co", "x.y@z.org"], []
    ]
    assert values(spark, ["call +47 (555) 12-34 567"], text.extract_phones) == [["4755512 34567".replace(" ", "")]]
    mentions = ["USD 1,234.56", "TOTAL 100", "(12.5) EUR", "12 300", "2026-07-19", "5USD"]
    assert values(spark, mentions, numbers.extract_numbers) == [
        [1234.56], [], [-12.5], [12300.0], [2026.0, -7.0, -19.0], []
    ]


def test_numbers(spark):
    assert values(spark, ["USD 75,000", "(5)", "abc", "1.2.3"], numbers.canonicalize_number) == [75000.0, -5.0, None, None]
    rounded = spark.createDataFrame([(0.575,), (0.125,), (1.0,)], "n double").select(numbers.round_two(F.col("n")))
    assert [r[0] for r in rounded.collect()] == [0.58, 0.13, 1.0]


def test_adjacent_buckets_hold_every_match(spark):
    pairs = [(x, x + d) for x in (0.0, 0.5, 1.0, 99.99, 1e6, -3.25, 1e12) for d in (0.0, 9e-10, -9e-10, x * 9e-10)]
    df = spark.createDataFrame(pairs, "a double, b double").select(
        numbers.numbers_match(F.col("a"), F.col("b")).alias("m"),
        F.abs(numbers.tolerance_bucket(F.col("a")) - numbers.tolerance_bucket(F.col("b"))).alias("d"),
    )
    assert all(r.d <= 1 for r in df.collect() if r.m)


def test_dates(spark):
    assert values(spark, ["2024-02-29", "2023-02-29", "2024-13-01", "24-01-01"], dates.is_iso_date) == [True, False, False, False]
    spelt = values(spark, ["2026-07-19", "2026-07-03", "x"], dates.date_spellings)
    assert len(spelt[0]) == 17 and "19th July 2026" in spelt[0] and "07/19/2026" in spelt[0]
    assert len(spelt[1]) == 13 and "July 3rd 2026" in spelt[1]
    assert spelt[2] is None


def test_day_mentions_invert_spellings(spark):
    days = ["2026-07-19", "2024-02-29", "1999-12-01", "2001-05-11", "2011-11-22"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(
        "d", F.explode(dates.search_spellings(F.col("d"))).alias("s")
    )
    found = df.select("d", "s", dates.day_mentions(F.concat(F.lit("x"), "s", F.lit(" y"))).alias("m")).collect()
    assert found and all(r.d in r.m for r in found)


def test_clean_redact_and_stem(spark):
    assert values(spark, ["a\x00b\x07 \n\n\n\nc \n"], text.clean_text) == ["ab\n\nc"]
    assert values(spark, ["me@x.org sk-abcdefgh1 +47 555 12 34 56"], text.redact) == [
        "[redacted-email] [redacted-secret] +[redacted-phone]"
    ]
    assert values(spark, ["Résumé / 2024 ", "***"], text.safe_stem) == ["Re-sume-2024", "document-extraction"]
