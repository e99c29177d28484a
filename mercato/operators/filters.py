"""Row filters of the reports.

All of them build Catalyst predicates from driver-side literals, so they are
pushed into the Parquet scan (``PushedFilters``) or, on partition columns,
prune whole partitions (``PartitionFilters``).
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.dates import day_literal, ts_literal
from mercato.params import DateRange


def in_list(df: DataFrame, column: str, values: Iterable | None) -> DataFrame:
    """``column IN (values)``; NULL never passes.  ``None`` means no filter."""
    if values is None:
        return df
    return df.where(F.col(column).isin(list(values)))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """``column = value``; ``None`` means no filter."""
    if value is None:
        return df
    return df.where(F.col(column) == F.lit(value))


def ts_range(df: DataFrame, column: str, rng: DateRange) -> DataFrame:
    """Closed timestamp range ``[initial 00:00 (and >= floor), final 23:59:00]``.

    With ``rng.half_open`` the upper bound becomes ``< final + 1 day``.
    Literals take the column's own timestamp kind (NTZ or session zone).
    """
    dtype = df.schema[column].dataType
    col = F.col(column)
    lower = col >= ts_literal(rng.lower, dtype)
    if rng.half_open:
        upper = col < ts_literal(rng.upper, dtype)
    else:
        upper = col <= ts_literal(rng.upper, dtype)
    return df.where(lower & upper)


def _day_value(df: DataFrame, column: str, day: date):
    """A day to compare a column with: ISO text for a text column, so that the filter still prunes
    partitions and a malformed value fails no job (it compares as text); else a date."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.lit(f"{day:%Y-%m-%d}")
    return day_literal(day)


def day_range(df: DataFrame, column: str, rng: DateRange) -> DataFrame:
    """Closed day range on a date (or ``yyyy-MM-dd`` text) column."""
    first, last = (_day_value(df, column, d) for d in (rng.first_day, rng.final))
    return df.where(F.col(column).between(first, last))


def before_day(df: DataFrame, column: str, day: date) -> DataFrame:
    """``column < day`` (the archive's "strictly before today")."""
    return df.where(F.col(column) < _day_value(df, column, day))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())
