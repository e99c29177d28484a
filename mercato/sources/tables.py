"""Table access: Parquet directories or catalog tables, loaded lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The driver's test tables.
TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


class Tables:
    """``tables["orders"]`` -> DataFrame, read on first use.

    ``base`` is a directory holding ``<name>.parquet``; without it names are
    catalog tables.  ``refresh=True`` drops Spark's cached file listing of a
    catalog table before reading it, so files added by upstream loads are seen.
    """

    def __init__(self, spark: SparkSession, base: str | None = None, refresh: bool = False):
        self.spark = spark
        self.base = base.rstrip("/") if base else None
        self.refresh = refresh
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if self.base is not None:
                self._cache[name] = self.spark.read.parquet(f"{self.base}/{name}.parquet")
            else:
                if self.refresh:
                    self.spark.catalog.refreshTable(name)
                self._cache[name] = self.spark.table(name)
        return self._cache[name]
