"""Counting over rows or over pre-counted cells.

Every report number is a count of cases, so any table may be fed either raw rows or cells that already
carry how many rows they stand for (column ``n_cases``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WEIGHT = "n_cases"


def weight(df: DataFrame) -> Column:
    """How many cases one row of ``df`` stands for."""
    return F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1).cast("bigint")


def cells(df: DataFrame, *keys: str) -> DataFrame:
    """Count per key combination. Partial counts form before the shuffle, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.sum(weight(df)).alias(WEIGHT))


def tally(test: str, df: DataFrame, strict_na: bool = False) -> Column:
    """Cases in ``df`` for which the SQL condition ``test`` holds, 0 when there are none.

    ``strict_na`` makes the result null as soon as the test is undecided for any row.
    """
    n = WEIGHT if WEIGHT in df.columns else "1L"
    total = f"coalesce(sum(CASE WHEN {test} THEN {n} END), 0L)"
    if strict_na:
        return F.expr(f"CASE WHEN NOT bool_or(({test}) IS NULL) THEN {total} END")
    return F.expr(total)


def quoted(text: str) -> str:
    """``text`` as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent with two digits; null when ``whole`` is 0."""
    return F.round(F.try_divide(part, whole) * 100, 2)
