"""Age bins, as a label and as a predicate on the raw age."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from tallywick.domains import AGE_LIMIT, AGE_UNKNOWN


def _bins(age: Column) -> dict[str, Column]:
    bins = {"<1": age == 0, "1-9": (age > 0) & (age < 10)}
    for low in range(10, 70, 10):
        bins[f"{low}-{low + 9}"] = (age >= low) & (age < low + 10)
    bins["70+"] = (age >= 70) & (age < AGE_LIMIT)
    bins["Unknown"] = age == AGE_UNKNOWN
    return bins


def age_range(age: Column) -> Column:
    """Bin label of an age; null for negatives, 555-998 and anything above 999."""
    return F.coalesce(*[F.when(test, F.lit(label)) for label, test in _bins(age).items()])


def age_floor(age: Column) -> Column:
    """The first age of an age's bin, which is in the same bin; null where :func:`age_range` is."""
    floors = {"<1": 0, "1-9": 1, "70+": 70, "Unknown": AGE_UNKNOWN} | {f"{low}-{low + 9}": low for low in range(10, 70, 10)}
    return F.coalesce(*[F.when(test, F.lit(floors[label])) for label, test in _bins(age).items()])


def age_in(age: Column, labels: Iterable[str]) -> Column:
    """Same rows as ``age_range(age).isin(labels)``, but as ranges on the stored column.

    Plain comparisons reach the file scan as pushed filters; a label computed by CASE does not.
    """
    bins = _bins(age)
    tests = [bins[label] for label in labels if label in bins]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
