"""Instants written as ISO 8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant_us(text: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of an ISO 8601 text with any precision and offset.

    Texts without an offset count in the session's zone (UTC here). Null, blank and unreadable texts give
    null. Digits beyond microseconds are cut.
    """
    return F.unix_micros(F.trim(text).try_cast("timestamp"))
