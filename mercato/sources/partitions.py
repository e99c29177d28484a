"""Rolling month-partition scans.

The limit is ``as_of - months_back`` months formatted ``yyyy-MM`` and folded
to a literal on the driver.  On a text partition column (``yyyy-MM`` or
``yyyy-MM-dd`` values) the comparison is lexicographic, exactly as written:
``>=`` keeps the limit month, ``>`` drops it for ``yyyy-MM`` values but keeps
it for ``yyyy-MM-dd`` values (a longer string sorts after its prefix).  The
filter lands in ``PartitionFilters`` and prunes directories.

On a date / timestamp column the column is read as its month: inclusive keeps
rows from the first day of the limit month, exclusive from the first day of
the following month.  Both are range predicates pushed to the Parquet scan.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.dates import month_limit, ts_literal
from mercato.params import minus_months


def month_window(df: DataFrame, column: str, as_of: date | datetime, months_back: int = 1,
                 inclusive: bool = True) -> DataFrame:
    dtype = df.schema[column].dataType
    col = F.col(column)
    if isinstance(dtype, T.StringType):
        limit = F.lit(month_limit(as_of, months_back))
        return df.where(col >= limit if inclusive else col > limit)
    first = minus_months(as_of, months_back)
    first = date(first.year, first.month, 1)
    if not inclusive:
        nxt = minus_months(first, -1)
        first = date(nxt.year, nxt.month, 1)
    return df.where(col >= ts_literal(first, dtype))


def write_month_partitions(df: DataFrame, ts_col: str, path: str, column: str = "load_part") -> None:
    """Write a table as the lake lays its facts: one directory per ``yyyy-MM`` month of ``ts_col``.

    Rows are rebalanced by month before the write, so a month gets files by its
    bytes and not one of every task.
    """
    (df.withColumn(column, F.date_format(ts_col, "yyyy-MM")).hint("rebalance", column)
     .write.partitionBy(column).parquet(path))


def read_month_partitions(spark, path: str, columns: T.StructType, column: str = "load_part") -> DataFrame:
    """Read such a table with the month as text, whatever Spark would infer from the directory names."""
    schema = T.StructType([*[f for f in columns.fields if f.name != column], T.StructField(column, T.StringType())])
    return spark.read.schema(schema).parquet(path)
