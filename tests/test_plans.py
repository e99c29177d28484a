"""Plan assertions: the physical plans keep the properties the scale design relies on."""

from datetime import date, datetime

import pytest

import __spark_entry__ as E
from mercato.sources.partitions import month_window

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_window_prunes_text_partitions(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = [(i, m) for i, m in enumerate(["2024-01", "2024-02", "2024-03", "2024-04"])]
    spark.createDataFrame(rows, "id int, load_part string").write.partitionBy("load_part").parquet(path)
    df = spark.read.schema("id int, load_part string").parquet(path)
    out = month_window(df, "load_part", date(2024, 4, 10), 1, True)
    plan = physical(out)
    assert "PartitionFilters: [isnotnull(load_part" in plan and "2024-03" in plan
    assert sorted(r.load_part for r in out.collect()) == ["2024-03", "2024-04"]


def test_report_range_reaches_the_scan(spark):
    plan = physical(E.queries()["sales_report"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate,2001-01-01T00:00)" in plan
    assert "LessThanOrEqual(o_orderdate,2001-07-31T23:59)" in plan


def test_sales_sum_is_partial_then_final(spark):
    plan = physical(E.queries()["sales_report"](spark, SF))
    assert plan.count("HashAggregate") >= 2 and "partial_sum" in plan


def test_stock_scan_reads_only_the_calendar(spark):
    plan = physical(E.queries()["stock_snapshot"](spark, SF))
    assert "GreaterThanOrEqual(ts,2023-12-31T00:00)" in plan and "LessThan(ts,2024-01-31T00:00)" in plan


@pytest.mark.parametrize("name", ["stock_snapshot", "stock_report", "stock_gap_fill", "join_cross_calendar",
                                  "stock_forward_fill", "shipments_report", "join_composite_key"])
def test_no_cartesian_product(spark, name):
    plan = physical(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_column_pruning_on_wide_scan(spark):
    plan = physical(E.queries()["stock_snapshot"](spark, SF))
    # events has six columns; the snapshot reads four of them (props and event_id are pruned)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


@pytest.fixture
def large_scan_conf(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fact_scan_gets_runtime_bloom_filter(spark, large_scan_conf):
    # emulate a line table far above the scan-size threshold: the filtered headers feed a bloom
    # filter that prunes lineitem rows at the scan, before any shuffle
    plan = E.queries()["sales_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pruned = [line for line in plan.split("\n") if "might_contain" in line]
    assert any("l_orderkey" in line for line in pruned)


def test_stock_snapshot_prunes_day_partitions(spark, tmp_path):
    """Lake layout: positions partitioned by a text day; only calendar partitions are read."""
    from datetime import timedelta

    from mercato.plans.stock import StockRules, stock_extract, stock_snapshot

    path = str(tmp_path / "positions")
    as_of = date(2024, 3, 20)
    rows = []
    for back in range(0, 60, 3):   # 20 day partitions, 11 of them inside the 31-day calendar
        day = as_of - timedelta(days=back)
        rows.append(("0042", "7", datetime.combine(day, datetime.min.time()), "5", "1", "1", day.isoformat()))
    schema = ("sku string, branch_id string, received_date timestamp_ntz, available string, brand_group string, "
              "id_cia string, stock_date string")
    spark.createDataFrame(rows, schema).write.partitionBy("stock_date").parquet(path)
    positions = spark.read.schema(schema).parquet(path)
    branches = spark.createDataFrame([("7", "0001")], "branch_id string, cnpj string")
    items = spark.createDataFrame([("0042", "280273002938")], "item_id string, supplier_id string")
    snap = stock_snapshot(stock_extract(positions, branches, items, StockRules()), as_of)
    assert snap.count() == 31
    plan = physical(snap)
    part_filters = [seg.split("]")[0] for seg in plan.split("PartitionFilters: [")[1:]]
    assert part_filters and all("2024-02-19" in f and "2024-03-20" in f for f in part_filters)
