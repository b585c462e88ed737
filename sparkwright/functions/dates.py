"""Calendar dates read strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """The date, or null if the text does not have the pattern's form or there is no such day."""
    return F.try_to_date(F.when(F.length(text) == len(pattern), text), pattern)


def due(issued: Column, days: Column) -> Column:
    return F.date_add(issued.cast("date"), days)
