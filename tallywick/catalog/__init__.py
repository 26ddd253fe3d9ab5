"""Every operation as a query over the generated tables, next to plain SQL that must give the same rows.

A query takes ``(spark, sf_dir)``. The SQL starts from the same adapter texts but computes the result its
own way. Times leave as text, so that engines compare alike.
"""

from tallywick.catalog import documents, incidents, prices, report  # noqa: F401  (importing registers)
from tallywick.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
