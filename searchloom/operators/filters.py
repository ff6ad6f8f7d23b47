"""The filter plan that both search branches share."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchloom.contracts import METADATA_VERSION, SOURCE_KINDS, TOP_K_MAX


def values(given: Iterable[str] | None, allowed: tuple[str, ...] | None = None) -> list[str]:
    """Stripped, non-empty, distinct, in order; values not allowed are an error."""
    out = list(dict.fromkeys(x for v in given or () if (x := v.strip())))
    if allowed and (bad := [v for v in out if v not in allowed]):
        raise ValueError(f"unknown values: {', '.join(bad)}")
    return out


def bound_ms(value: str) -> int:
    """Milliseconds of an ISO date or a timestamp with an offset; else an error."""
    v = value.strip()
    at = datetime.fromisoformat(v.replace("Z", "+00:00"))
    if len(v) == 10:
        at = at.replace(tzinfo=timezone.utc)
    if at.tzinfo is None:
        raise ValueError(f"a bound needs an offset: {value}")
    return round(at.timestamp() * 1000)


def clamp_k(k: int) -> int:
    return max(1, min(k, TOP_K_MAX))


def plan(
    section: str | None = None,
    source_kinds: Iterable[str] | None = None,
    authors: Iterable[str] | None = None,
    occurred_from: str | None = None,
    occurred_to: str | None = None,
    updated_from: str | None = None,
    updated_to: str | None = None,
) -> Column | None:
    """One condition for both branches, None without filters. Any filter but the
    section also asks for the current metadata version; bounds are inclusive and
    rows without the time never satisfy them."""
    parts: list[Column] = []
    if kinds := values(source_kinds, SOURCE_KINDS):
        parts.append(F.col("source_kind").isin(*kinds))
    if names := values(authors):
        parts.append(F.col("author").isin(*names))
    for column, low, high in (("occurred_ms", occurred_from, occurred_to), ("updated_ms", updated_from, updated_to)):
        if low is not None:
            parts.append(F.col(column) >= bound_ms(low))
        if high is not None:
            parts.append(F.col(column) <= bound_ms(high))
    if parts:
        parts.append(F.col("schema_version") == METADATA_VERSION)
    if section is not None:
        parts.append(F.col("section") == section)
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(df, condition: Column | None):
    return df if condition is None else df.where(condition)
