"""Time expressions, none of which depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallywick.domains import EST_OFFSET_SECONDS

_EPOCH = "1970-01-01 00:00:00"


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def epoch_to_utc(epoch: Column) -> Column:
    return F.to_timestamp_ntz(F.lit(_EPOCH)) + _seconds(epoch)


def epoch_to_est(epoch: Column) -> Column:
    """Wall clock at a fixed five hours behind UTC, without summer time."""
    return epoch_to_utc(epoch + F.lit(EST_OFFSET_SECONDS))


def iso_date(text: Column) -> Column:
    """Date part of an ISO date-time text; null when it is not a date."""
    return F.substring(text, 1, 10).try_cast("date")


def iso_timestamp(text: Column) -> Column:
    """UTC wall clock of ``yyyy-MM-ddTHH:mm:ss.SSSZ``; null for any other form."""
    return F.when(
        text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"), F.rtrim(text, F.lit("Z"))
    ).try_cast("timestamp_ntz")


def weeks_before(as_of: Column, weeks: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(7 * weeks))


def in_zone(utc: Column, zone: str) -> Column:
    """UTC wall clock shown as wall clock of ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
