import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mercato.functions import brand_sales, brand_wms, day_string, from_day_string, to_double, valid_double


def test_brand_sales_every_code(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("7",)], "b string")
    got = [r[0] for r in df.select(brand_sales("b")).collect()]
    assert got == ["SHOP", "ACOM", "SUBA", "SOUB"]


def test_brand_wms_every_code(spark):
    df = spark.createDataFrame([("1",), ("26",), ("29",)], "b string")
    got = [r[0] for r in df.select(brand_wms("b")).collect()]
    assert got == ["SHOP", "ACOM", "SUBA"]


@pytest.mark.parametrize("fn", [brand_sales, brand_wms])
@pytest.mark.parametrize("code", ["X", None])
def test_unknown_brand_fails(spark, fn, code):
    df = spark.createDataFrame([(code,)], "b string")
    with pytest.raises(PySparkException, match="Invalid brandId specified"):
        df.select(fn("b")).collect()


def test_day_format_roundtrip(spark):
    df = spark.sql("select timestamp_ntz'2024-01-05 13:14:15' as ts")
    row = df.select(day_string("ts").alias("d"), from_day_string(day_string("ts")).alias("m")).first()
    assert row.d == "2024-01-05"
    assert str(row.m) == "2024-01-05 00:00:00"


def test_valid_double_and_lenient_cast(spark):
    df = spark.createDataFrame([(1.0, "3.5"), (float("nan"), "abc"), (None, None), (0.0, "0")],
                               "v double, t string")
    rows = df.select(valid_double("v").alias("ok"), to_double("t").alias("x")).collect()
    assert [r.ok for r in rows] == [True, False, False, True]
    assert rows[0].x == 3.5 and rows[1].x is None and rows[2].x is None and rows[3].x == 0.0
    assert not math.isnan(rows[3].x)
    # the plain ANSI cast would fail on the same input
    with pytest.raises(PySparkException):
        df.select(F.col("t").cast("double")).collect()
