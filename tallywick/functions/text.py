"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def without_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def pair_display_name(key: Column) -> Column:
    """A blank in front of the first ``USD`` only."""
    return F.regexp_replace(key, "^(.*?)USD", "$1 USD")


def pair_key(display_name: Column) -> Column:
    """Back from the display name; here every `` USD`` loses its blank."""
    return F.replace(display_name, F.lit(" USD"), F.lit("USD"))


def dollars(amount: Column, digits: int) -> Column:
    """``$`` and the rounded amount without trailing zeros and never in scientific notation."""
    text = F.round(amount, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.concat(F.lit("$"), F.regexp_replace(text, r"(\.[0-9]*[1-9])0+$|\.0+$", "$1"))
