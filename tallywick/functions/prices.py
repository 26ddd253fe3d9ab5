"""Price-history expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallywick.domains import LEGACY_TICKER


def history_tier(weeks: Column, strict: bool = False) -> Column:
    """Which averages a history of ``weeks`` bars gets: ``200``, ``100``, ``50`` or ``overall``.

    Every history has a tier. With ``strict`` the limits are exclusive, as published: histories of exactly 75, 100
    and more than 200 bars then have none.
    """
    if strict:
        return (
            F.when(weeks == 200, "200")
            .when((weeks > 100) & (weeks < 200), "100")
            .when((weeks > 75) & (weeks < 100), "50")
            .when(weeks < 75, "overall")
        )
    return F.when(weeks >= 200, "200").when(weeks >= 100, "100").when(weeks >= 75, "50").otherwise("overall")


def current_ticker(base: Column) -> Column:
    """Legacy base codes in today's spelling, others unchanged."""
    renamed = [F.when(base == old, F.lit(new)) for old, new in LEGACY_TICKER.items()]
    return F.coalesce(*renamed, base)


def overall_title(weeks: Column) -> Column:
    """Name of the overall average, e.g. ``150 Week Average``."""
    return F.concat(weeks.cast("string"), F.lit(" Week Average"))
