"""Archive job: copy every partition strictly before a day into an archive table.

Dynamic partition overwrite replaces only the partitions that receive rows;
older archived partitions survive.  Spark's commit protocol makes each task's
output visible only on commit, so a lost executor just re-runs its tasks.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame

from mercato.operators.filters import before_day
from mercato.session import DYNAMIC_OVERWRITE


def archive_before(df: DataFrame, partition_col: str, today: date, target: str,
                   is_table: bool = False) -> None:
    """``INSERT OVERWRITE target PARTITION (partition_col) SELECT * ... WHERE part < today``.

    ``target`` is a directory (Parquet, partitioned by ``partition_col``) or,
    with ``is_table``, an existing catalog table.  Rows are rebalanced by day
    before the write: adaptive execution sizes the files, so a day gets a few
    files whatever the number of input splits, and a day that holds a third of
    all rows is split among many tasks.
    """
    rows = before_day(df, partition_col, today).hint("rebalance", partition_col)
    if is_table:
        _insert_overwrite(rows, target)
        return
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(target))


def _insert_overwrite(rows: DataFrame, table: str) -> None:
    """Replace the partitions of a catalog table that receive rows, from a session of its own.

    Which partitions an overwrite replaces is a setting of the session, for file
    tables and for Hive tables; in the caller's session it would change the
    meaning of other writes that run at the same time.  The new session shares
    catalog and executors and takes over the caller's other settings.
    """
    spark = rows.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in DYNAMIC_OVERWRITE.items():
        own.conf.set(key, value)
    name = table if "." in table else f"{spark.catalog.currentDatabase()}.{table}"
    view = f"archive_{uuid.uuid4().hex}"
    rows.createGlobalTempView(view)
    try:
        own.table(f"global_temp.{view}").write.insertInto(name, overwrite=True)
    finally:
        spark.catalog.dropGlobalTempView(view)
