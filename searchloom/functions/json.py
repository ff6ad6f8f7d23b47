"""Canonical JSON: compact, keys sorted, nulls kept, text as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(**fields: Column) -> Column:
    """A JSON object of the fields; structs in them come with sorted fields."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
