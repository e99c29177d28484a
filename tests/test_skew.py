"""A key holding a third of all rows: the latest-per-day join back is split by AQE."""

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mercato.plans.stock import latest_stock

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _frame(spark, n, hot_seconds):
    base = datetime(2024, 1, 10)
    # every third row belongs to one (sku, cnpj, brand_group, day); the rest spread over 2000 keys
    hot = F.col("id") % 3 == 0
    secs = F.when(hot, F.col("id") % hot_seconds).otherwise(F.col("id") % 5000).cast("int")
    return base, spark.range(n).select(
        F.when(hot, F.lit("HOT")).otherwise((F.col("id") % 2000).cast("string")).alias("sku"),
        F.lit("c").alias("cnpj"),
        F.lit(base.date()).alias("stock_date"),
        (F.lit(base) + F.make_interval(secs=secs)).cast("timestamp_ntz").alias("received_date"),
        F.col("id").cast("double").alias("available"),
        F.lit("1").alias("brand_group"),
        F.lit("1").alias("id_cia"))


def _expected_hot(n, hot_seconds):
    hot_ids = list(range(0, n, 3))
    top = max(i % hot_seconds for i in hot_ids)
    return top, sorted(float(i) for i in hot_ids if i % hot_seconds == top)


def test_hot_key_spreads_over_its_load_times(spark, skew_conf):
    n = 30000
    base, df = _frame(spark, n, 5000)
    out = latest_stock(df)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the join back hashes on the load time as well: a hot key's rows spread over all partitions
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any("sku#" in e and "received_date#" in e for e in exchanges)
    top, expect = _expected_hot(n, 5000)
    hot = [r for r in rows if r.sku == "HOT"]
    assert sorted(r.available for r in hot) == expect
    assert all(r.received_date == base + timedelta(seconds=top) for r in hot)
    assert len({r.sku for r in rows}) == 2001


def test_hot_tie_is_split_by_aqe_and_kept_whole(spark, skew_conf):
    # a third of all rows share one key *and* one load time: a single join key that AQE must split
    n = 30000
    base, df = _frame(spark, n, 1)
    out = latest_stock(df)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    top, expect = _expected_hot(n, 1)
    assert sorted(r.available for r in rows if r.sku == "HOT") == expect   # every tied row kept
    assert len(expect) == n // 3


def test_ties_never_reach_a_window(spark, skew_conf):
    """A third of all rows tied on key, day and load time: aggregated before the window, split in the join, kept whole."""
    from mercato.plans.stock import stock_snapshot

    n = 30000
    base, df = _frame(spark, n, 1)
    df = df.withColumn("available", F.when(F.col("available") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("available")))
    out = stock_snapshot(df, base.date() + timedelta(days=2))
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    # what the window's shuffle carries are cells: 2001 keys with one day each, not the 10,000 tied rows
    cells = [line for line in plan.splitlines() if "Exchange hashpartitioning(sku" in line]
    assert cells
    hot = [r for r in rows if r.sku == "HOT" and r.stock_date == base.date()]
    valid = [float(i) for i in range(0, n, 3) if i % 2]
    assert len(hot) == n // 3
    assert sorted(r.available for r in hot) == sorted(valid + [max(valid)] * (n // 3 - len(valid)))
    later = [r for r in rows if r.sku == "HOT" and r.stock_date > base.date()]
    assert [(r.available, r.received_date) for r in later] == [(max(valid), None)] * 2


def test_forward_fill_and_densify_of_ties(spark, skew_conf):
    from mercato.operators.timeseries import densify, forward_fill
    from mercato.plans.stock import FILL_KEYS, FILL_ORDER, GRID_KEYS

    n = 30000
    base, df = _frame(spark, n, 1)
    df = df.withColumn("available", F.when(F.col("available") % 2 == 0, F.lit(None)).otherwise(F.col("available")))
    grid = densify(df, GRID_KEYS, "stock_date", base.date(), base.date() + timedelta(days=1))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert grid.count() == n + 2001                      # all rows and one missing day of each key
    filled = forward_fill(grid, FILL_KEYS, FILL_ORDER, "available")
    rows = filled.collect()
    assert "skew=true" in filled._jdf.queryExecution().executedPlan().toString()
    valid = [float(i) for i in range(0, n, 3) if i % 2]
    hot = [r for r in rows if r.sku == "HOT"]
    assert sorted(r.available for r in hot if r.stock_date == base.date()) == valid   # NULL rows stand first: nothing before them
    assert [r.available for r in hot if r.stock_date > base.date()] == [max(valid)]


def test_hot_volume_in_serial_join_is_split(spark, skew_conf):
    """The serial-number join pairs every serial of a volume with every line: a hot volume is split."""
    from mercato.params import DateRange
    from mercato.plans.shipments import ShipmentRules, shipments_extract, shipments_report

    n_serials = 6000
    header = spark.range(40).select(
        F.col("id").alias("order_id"), F.lit(datetime(2024, 3, 2)).cast("timestamp_ntz").alias("sales_date"),
        F.lit("L").alias("order_status"), F.lit("26").alias("brand"),
        F.lit(datetime(2024, 3, 3)).cast("timestamp_ntz").alias("dispatch_date"), F.lit(5).alias("plant_id"),
        F.when(F.col("id") == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("program_id"),
        F.lit("w").alias("wave_id"), F.lit("v").alias("prevol_id"), F.lit("2024-03").alias("load_part"))
    lines = spark.range(40).select(F.col("id").alias("order_id"), F.lit(100).alias("item_id"),
                                   F.lit("2024-03").alias("load_part"))
    serials = spark.range(n_serials).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 39 + 1).cast("string")).alias("program_id"),
        F.lit("w").alias("wave_id"), F.lit("v").alias("prevol_id"), F.col("id").cast("string").alias("imei"),
        F.lit("2024-03").alias("load_part"))
    plants = spark.createDataFrame([(5, "cnpj5", "SP")], "plant_id int, warehouse_cnpj string, warehouse_uf string")
    labels = spark.range(40).select(F.col("id").alias("order_id"), F.lit("city").alias("delivery_city"),
                                    F.lit("RJ").alias("delivery_uf"),
                                    F.lit(datetime(2024, 3, 3)).cast("timestamp_ntz").alias("nf_issuance"),
                                    F.col("id").alias("nf_id"), F.lit("1").alias("nf_serie"), F.lit("2024-03").alias("load_part"))
    wms_items = spark.createDataFrame([(100, 1000, "s100", "x")], "item_id long, sku_id long, sku string, supplier_id string")
    eans = spark.createDataFrame([(1000, "e")], "sku_id long, ean string")
    item_master = spark.createDataFrame([("s100", "1", "18")], "item_id string, item_company string, department string")
    rules = ShipmentRules(suppliers=None)
    out = shipments_report(shipments_extract(header, plants, labels, lines, wms_items, eans, serials, item_master,
                                             as_of=date(2024, 3, 20), rules=rules),
                           DateRange(date(2024, 3, 1), date(2024, 3, 15)))
    total = out.count()
    assert total == n_serials                       # every serial pairs with its order's single line
    rows = out.where(F.col("imei").cast("long") % 3 == 0)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
