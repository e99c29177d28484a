"""Date helpers: literals that match a column's type, day formatting, month limits.

Parameters are turned into literals on the driver (constant folding), so the
comparisons reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.params import minus_months

DAY_FORMAT = "yyyy-MM-dd"
MONTH_FORMAT = "yyyy-MM"


def ts_literal(value: datetime | date, like: T.DataType | None = None) -> Column:
    """A timestamp literal of the same kind as the column it is compared with.

    ``timestamp_ntz`` columns get an NTZ literal (no session-zone shift);
    ``timestamp`` columns get a session-zone literal; ``date`` columns a date.
    """
    if isinstance(value, datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    else:
        text = value.strftime("%Y-%m-%d") + " 00:00:00"
    if isinstance(like, T.DateType):
        return F.lit(text[:10]).cast("date")
    if isinstance(like, T.TimestampType):
        return F.lit(text).cast("timestamp")
    return F.lit(text).cast("timestamp_ntz")


def day_literal(value: date | datetime | str) -> Column:
    if isinstance(value, (date, datetime)):
        value = value.strftime("%Y-%m-%d")
    return F.lit(value).cast("date")


def day_string(ts: Column | str) -> Column:
    """Timestamp/date -> ``yyyy-MM-dd`` text (the time of day is dropped)."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, DAY_FORMAT)


def from_day_string(text: Column | str, ntz: bool = True) -> Column:
    """``yyyy-MM-dd`` text -> timestamp at midnight."""
    text = F.col(text) if isinstance(text, str) else text
    if ntz:
        return F.to_timestamp_ntz(text, F.lit(DAY_FORMAT))
    return F.to_timestamp(text, DAY_FORMAT)


def month_limit(as_of: date | datetime, months_back: int) -> str:
    """``as_of - months_back`` months as ``yyyy-MM`` (day clamped)."""
    return minus_months(as_of, months_back).strftime("%Y-%m")
