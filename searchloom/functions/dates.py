"""Timestamps as text: normalisation to UTC and milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchloom.functions.text import strip


def rfc3339(c: Column) -> Column:
    """An ISO date, or a timestamp with an offset, as UTC text ending in Z; null
    for anything else. A fraction is printed only if it isn't zero."""
    t = strip(c)
    day = F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    full = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(t))
    at = F.coalesce(day, full)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(at, "SSSSSS"))), F.lit("Z"))


def epoch_ms(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def first_date(*columns: Column) -> Column:
    return F.coalesce(*[rfc3339(c) for c in columns])


def latest(*times: Column) -> Column:
    """The latest of the times that are there; null if none is."""
    return F.greatest(*times) if len(times) > 1 else times[0]
