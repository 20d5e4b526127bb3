"""Rules over tables that refer to each other, read once each.

A row states in *claims* what it means for the rules: that it breaks one by itself, that it is
one more of something counted, that it needs rows elsewhere, or that it is such a row. The claims
of all tables meet in one aggregation by scope and key, which counts them before they are shuffled;
what a rule reports follows from the counts. No table is read twice and none is joined to another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEAT_AT_ONCE = 10_000
# Numbers, as an aggregation of strings is sorted instead of hashed.
BREACH, COUNTED, PARENT, NEEDS, BOUNDED, BARS, CHILD = range(7)


def _claim(
    part: int, rule: str, path: Column, keys: tuple[Column, ...], limit: int = 0, detail: Column | None = None
) -> Column:
    key = F.array(*[k.cast("string") for k in keys]).cast("array<string>")
    return F.struct(
        path.cast("string").alias("path"), F.lit(rule).alias("rule"), key.alias("key"),
        F.lit(part).alias("part"), F.lit(limit).alias("limit"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def breach(rule: str, path: Column, condition: Column) -> Column:
    """The row breaks ``rule`` by itself; every such row is reported."""
    return F.when(condition, _claim(BREACH, rule, path, (path,)))


def at_most(rule: str, path: Column, limit: int, *keys: Column) -> Column:
    """More than ``limit`` rows with these keys are reported once; null keys are equal."""
    return _claim(COUNTED, rule, path, keys, limit)


def unique(rule: str, path: Column, *keys: Column) -> Column:
    return at_most(rule, path, 1, *keys)


def parent(rule: str, path: Column, *keys: Column, condition: Column | None = None) -> Column:
    """Every row without a child of these keys is reported."""
    claim = _claim(PARENT, rule, path, keys)
    return claim if condition is None else F.when(condition, claim)


def needs(rule: str, path: Column, *keys: Column, condition: Column) -> Column:
    """Rows of the same keys without a child are reported once together."""
    return F.when(condition, _claim(NEEDS, rule, path, keys))


def bounded(rule: str, path: Column, limit: int, *keys: Column, condition: Column) -> Column:
    """Rows of the same keys with more than ``limit`` children are reported once together."""
    return F.when(condition, _claim(BOUNDED, rule, path, keys, limit))


def bars(rule: str, path: Column, detail: Column, *keys: Column, condition: Column) -> Column:
    """Rows of the same keys with any child are reported once for each distinct ``detail``."""
    return F.when(condition, _claim(BARS, rule, path, keys, detail=detail))


def child(rule: str, path: Column, *keys: Column) -> Column:
    """The row is a child for ``rule``; rows with a null key are nobody's child."""
    known = reduce(Column.__and__, [k.isNotNull() for k in keys], F.col("schema_id").isNotNull())
    return F.when(known, _claim(CHILD, rule, path, keys))


def claims(table: DataFrame, *stated: Column) -> DataFrame:
    return table.select("schema_id", F.inline(F.array_compact(F.array(*stated))))


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says (not at all if null), without an array of that length."""
    names = df.columns
    counted = df.select(*names, times.cast("bigint").alias("_times")).filter(F.col("_times") > 0)
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_times") - 1) / REPEAT_AT_ONCE))
    cut = counted.select(*names, "_times", F.explode(runs).alias("_run"))
    left = F.least(F.lit(REPEAT_AT_ONCE), F.col("_times") - F.col("_run") * REPEAT_AT_ONCE).cast("int")
    return cut.select(*names, F.explode(F.array_repeat(F.lit(0), left)).alias("_one")).select(*names)


def settle(parts: list[DataFrame], details: bool = False) -> DataFrame:
    """The reports that follow from all claims: ``schema_id, path, rule``.

    ``details`` asks for rules of :func:`bars`; telling their details apart takes a second shuffle of all claims.
    """
    part, children, rows = F.col("part"), F.col("children"), F.col("rows")
    of = lambda name: F.count_if(part == name)
    counted = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("schema_id", "rule", "key", "path")
        .agg(
            F.max(F.when(part != CHILD, part)).alias("asks"),
            of(CHILD).alias("children"),
            F.count_if(part != CHILD).alias("rows"),
            F.max("limit").alias("limit"),
            *([F.count_distinct("detail").alias("details")] if details else []),
        )
    )
    asks = F.col("asks")
    times = (
        F.when(asks == BREACH, rows)
        .when(asks == COUNTED, (rows > F.col("limit")).cast("bigint"))
        .when((asks == PARENT) & (children == 0), rows)
        .when((asks == NEEDS) & (children == 0), F.lit(1))
        .when((asks == BOUNDED) & (children > F.col("limit")), F.lit(1))
        .when((asks == BARS) & (children > 0), F.col("details") if details else F.raise_error("bars needs details").cast("bigint"))
    )
    return repeat_rows(counted, times).select("schema_id", "path", "rule")
