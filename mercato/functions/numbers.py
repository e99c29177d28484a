"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_double(value: Column | str) -> Column:
    """True for a non-NULL, non-NaN double (``isnan(NULL)`` is false)."""
    value = F.col(value) if isinstance(value, str) else value
    return value.isNotNull() & ~F.isnan(value)


def to_double(value: Column | str) -> Column:
    """Lenient cast to double: text that is no number becomes NULL.

    Spark 4 runs in ANSI mode, where ``cast`` raises on bad input; the
    reports must instead carry such rows with a missing quantity.
    """
    value = F.col(value) if isinstance(value, str) else value
    return value.try_cast("double")
