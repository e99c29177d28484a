"""CSV exchange with an explicit schema.

Identifiers such as CNPJ, EAN and SKU are text with meaningful leading zeros;
schema inference would turn them into numbers, so reads always take a schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             null_value: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("mode", "FAILFAST").schema(schema)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, null_value: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", "true")
    if null_value is not None:
        writer = writer.option("nullValue", null_value)
    writer.csv(path)
