"""Reference SQL for the text forms, written apart from the Spark expressions."""

from __future__ import annotations


def minimal(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def search(x: str) -> str:
    marks = f"regexp_replace(lower(strip_accents({x})), '[\\p{{P}}\\p{{S}}]+', ' ', 'g')"
    return f"trim(regexp_replace({marks}, '\\s+', ' ', 'g'))"


def emails(x: str) -> str:
    body = (
        r"[A-Za-z0-9_%+-]+(?:\s*\.\s*[A-Za-z0-9_%+-]+)*\s*@\s*[A-Za-z0-9-]+(?:\s*\.\s*[A-Za-z0-9-]+)+"
    )
    pattern = rf"(?:^|[^A-Za-z0-9._%+-])({body})([._%+-]?)"
    return (
        f"list_transform(list_filter(list_zip(regexp_extract_all({x}, '{pattern}', 1), "
        f"regexp_extract_all({x}, '{pattern}', 2)), lambda z: z[2] = ''), "
        r"lambda z: regexp_replace(lower(z[1]), '\s+', '', 'g'))"
    )


def phones(x: str) -> str:
    return (
        rf"list_transform(regexp_extract_all({x}, '\+?\d[\d\s().-]{{5,}}\d'), "
        "lambda p: regexp_replace(p, '[^0-9]', '', 'g'))"
    )


CODES = "'AED','AUD','CAD','CHF','CNY','EUR','GBP','HKD','INR','JPY','NZD','SGD','USD'"


def _stripped(m: str) -> str:
    return (
        rf"translate(array_to_string(list_filter(string_split(trim(regexp_replace({m}, '\s+', ' ', 'g')), ' '), "
        f"lambda w: upper(w) NOT IN ({CODES})), ' '), '$€£¥₹', '')"
    )


def canonical_number(m: str) -> str:
    s = _stripped(m)
    u = f"translate({s}, '(), ', '')"
    return (
        rf"CASE WHEN regexp_full_match({u}, '[+-]?\d+(\.\d+)?') THEN CASE WHEN {s} LIKE '(%)' "
        f"THEN -abs(CAST({u} AS DOUBLE)) ELSE CAST({u} AS DOUBLE) END END"
    )


def numbers(x: str) -> str:
    pattern = (
        r"(?:[$€£¥₹]\s*)?(?:[A-Z]{3}\s*)?(?:\([+-]?\d[\d,\s]*(?:\.\d+)?\)|[+-]?\d[\d,\s]*(?:\.\d+)?)"
        r"(?:\s*[A-Z]{3})?"
    )
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: {canonical_number('m')}), "
        "lambda v: v IS NOT NULL)"
    )


def iso_date(x: str) -> str:
    return rf"(regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}') AND try_cast({x} AS DATE) IS NOT NULL)"


def spellings(d: str) -> str:
    """Search forms of the spellings of a DATE."""
    day = f"day({d})"
    suffix = (
        f"CASE WHEN {day} IN (11, 12, 13) THEN 'th' WHEN {day} % 10 = 1 THEN 'st' "
        f"WHEN {day} % 10 = 2 THEN 'nd' WHEN {day} % 10 = 3 THEN 'rd' ELSE 'th' END"
    )
    forms = ["%Y %m %d", "%-d %B %Y", "%d %B %Y", "%B %-d %Y", "%B %d %Y"]
    forms += ["%-d %b %Y", "%d %b %Y", "%b %-d %Y", "%b %d %Y"]
    parts = [f"lower(strftime({d}, '{form}'))" for form in forms]
    parts.append(f"lower(strftime({d}, '%-d')) || ({suffix}) || lower(strftime({d}, ' %B %Y'))")
    parts.append(f"lower(strftime({d}, '%B %-d')) || ({suffix}) || strftime({d}, ' %Y')")
    numeric = f"[strftime({d}, '%d %m %Y'), strftime({d}, '%m %d %Y')]"
    return f"list_concat([{', '.join(parts)}], CASE WHEN {day} > 12 THEN {numeric} ELSE [] END)"


def fuzzy_tables(opened: str, key: str) -> str:
    """Common tables that end in ``fz``: the open candidates some window shares enough with.

    ``opened`` selects ``key, csea, ssea``. Windows are counted from the tokens they hold.
    """
    return f"""
elig AS (SELECT *, len(ct) AS n, len(st) AS m FROM (
  SELECT DISTINCT {key}, csea, string_split(csea, ' ') AS ct, string_split(ssea, ' ') AS st FROM ({opened}) o) x
  WHERE len(ct) BETWEEN 2 AND 80 AND length(replace(csea, ' ', '')) >= 8),
want AS (SELECT {key}, csea, t, count(*) AS need FROM (SELECT {key}, csea, unnest(ct) AS t FROM elig) x GROUP BY ALL),
held AS (SELECT {key}, csea, n, m, unnest(st) AS t, unnest(range(1, m + 1)) AS p FROM elig),
hits AS (SELECT * FROM held JOIN want USING ({key}, csea, t)),
widths AS (SELECT *, unnest(range(greatest(1, n - 2), least(m, n + 2) + 1)) AS w FROM hits),
wins AS (SELECT {key}, csea, n, w, s, t, need, count(*) AS c FROM (
  SELECT *, unnest(range(greatest(1, p - w + 1), least(p, m - w + 1) + 1)) AS s FROM widths) x GROUP BY ALL),
score AS (SELECT {key}, csea, n, w, s, sum(least(c, need))::DOUBLE AS ov FROM wins GROUP BY ALL),
fz AS (SELECT DISTINCT {key}, csea FROM score WHERE (2 * (ov / w) * (ov / n)) / ((ov / w) + (ov / n)) >= 0.85)"""


def round_two(x: str) -> str:
    return f"floor(({x} + 2.220446049250313e-16) * 100 + 0.5) / 100"
