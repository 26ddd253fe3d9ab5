"""Legend break points and colour positions over a numeric column.

The column is normally a map's county totals, one row per county. Limits are ordinary aggregates, used
through scalar subqueries instead of a window over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywick.operators.quantiles import quantiles

# fixed values of the "pretty" rule: a step may overshoot the raw step by these factors
_BIAS = 1.5
_BIAS_5 = 0.5 + 1.5 * _BIAS
_TOLERANCE = 1e-10


def _pretty_step(cell: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten near ``cell``, the coarser one when it is close enough."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    prefers_2 = 2 * base - cell < _BIAS * (cell - base)
    prefers_5 = prefers_2 & (5 * base - cell < _BIAS_5 * (cell - 2 * base))
    prefers_10 = prefers_5 & (10 * base - cell < _BIAS * (cell - 5 * base))
    return F.when(prefers_10, 10 * base).when(prefers_5, 5 * base).when(prefers_2, 2 * base).otherwise(base)


def legend_breaks_numeric(df: DataFrame, column: str, bins: int | Sequence[float] = 7) -> DataFrame:
    """Cuts inside the column's range and their relative positions, as rows ``(cut, position)``.

    With a number, about that many round cuts; with a sequence, those cuts, which must be equally spaced.
    """
    limits = df.agg(
        F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")
    )
    if isinstance(bins, int):
        spread = F.col("hi") - F.col("lo")
        level = F.greatest(F.abs("lo"), F.abs("hi"))
        # one single value: the step follows from the value itself
        level = F.when(level == 0, 1.0).when(level > 10, 9 + level / 10).otherwise(level)
        flat = level * 0.75 / max(1, bins // 3)
        step = _pretty_step(F.when(spread > 0, spread / bins).otherwise(flat))
        cuts = limits.select("lo", "hi", step.alias("step")).select(
            "lo",
            "hi",
            F.explode(
                F.transform(
                    F.sequence(
                        F.floor(F.col("lo") / F.col("step") + _TOLERANCE),
                        F.ceil(F.col("hi") / F.col("step") - _TOLERANCE),
                    ),
                    lambda i: i * F.col("step"),
                )
            ).alias("cut"),
        )
    else:
        _check_equal_spacing(bins)
        cuts = limits.select("lo", "hi", F.explode(F.array(*[F.lit(float(b)) for b in bins])).alias("cut"))
    position = F.try_divide(F.col("cut") - F.col("lo"), F.col("hi") - F.col("lo"))
    return cuts.filter(F.col("cut").between(F.col("lo"), F.col("hi"))).select("cut", position.alias("position"))


def _check_equal_spacing(bins: Sequence[float]) -> None:
    steps = [b - a for a, b in zip(bins, bins[1:])]
    if any(abs(b - a) > 1.5e-8 for a, b in zip(steps, steps[1:])):
        raise ValueError("break points must be equally spaced")


def legend_breaks_bin(df: DataFrame, cuts: str) -> DataFrame:
    """Midpoints between neighbours of the ordered array column ``cuts``, as rows ``(bin, midpoint)``."""
    upper = F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0)))
    lower = F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0)))
    mids = F.zip_with(lower, upper, lambda a, b: (a + b) / 2)
    return df.select(F.posexplode(mids).alias("bin", "midpoint"))


def legend_breaks_quantile(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles at ``probs`` and halfway between neighbours, as rows ``(kind, prob, value)``.

    Linear interpolation, nulls ignored; see :func:`quantiles` for columns of any size.
    """
    mids = [(a + b) / 2 for a, b in zip(probs, probs[1:])]
    entries = [("cut", float(p)) for p in probs] + [("mid", float(p)) for p in mids]
    kinds = df.sparkSession.createDataFrame(entries, "kind string, prob double")
    return kinds.join(quantiles(df, column, [p for _, p in entries]), "prob").select("kind", "prob", "value").orderBy("kind", "prob")


def legend_breaks_factor(df: DataFrame, column: str, decreasing: bool = False) -> DataFrame:
    """Distinct non-null values in order."""
    order = F.col(column).desc() if decreasing else F.col(column).asc()
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(order)


def color_position(df: DataFrame, column: str) -> DataFrame:
    """Adds each row's place between the column's smallest (0) and largest (1) value."""
    limits = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    lo, hi = limits.getField("lo"), limits.getField("hi")
    return df.withColumn("position", F.try_divide(F.col(column) - lo, hi - lo))
