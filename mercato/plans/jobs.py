"""Daily batch jobs: snapshot refresh and stock archive.

The original service ran them from an in-process timer (sales 01:00,
archive 01:05, stock 01:10, shipments 01:20); here they are plain functions
a scheduler calls.  Extracts are rebuilt from fresh table listings and
written as new snapshot versions laid out by day; readers keep the previous
version until the new one is committed, and no row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from mercato.plans.items import item_master
from mercato.plans.sales import SalesRules, sales_extract
from mercato.plans.shipments import ShipmentRules, shipments_extract
from mercato.plans.stock import StockRules, stock_extract, stock_snapshot
from mercato.sinks.archive import archive_before
from mercato.sinks.snapshot import SnapshotStore
from mercato.sources import lake

# The snapshots the daily job refreshes; items first, as the stock report joins them.
REFRESHED = ("items", "sales", "stock", "shipments")
# The column whose day a snapshot is laid out by: the one that its report's range is on.
DAY_COLUMNS = {"sales": "sales_date", "shipments": "sales_date", "stock": "stock_date"}


def lake_builders(spark: SparkSession, as_of: date | datetime,
                  sales_rules: SalesRules = SalesRules(),
                  shipment_rules: ShipmentRules = ShipmentRules(),
                  stock_rules: StockRules = StockRules(),
                  umbrella: str | None = lake.UMBRELLA_DB,
                  wms: str | None = lake.WMS_DB) -> dict[str, Callable[[], DataFrame]]:
    """Extract builders over the lake; each call re-reads the tables."""

    def sales():
        r = lake.sales_roles(spark, umbrella)
        return sales_extract(r["header"], r["party"], r["line"], r["items"], r["branches"],
                             as_of, sales_rules)

    def shipments():
        r = lake.shipment_roles(spark, wms, umbrella)
        return shipments_extract(r["header"], r["plants"], r["labels"], r["lines"], r["wms_items"],
                                 r["eans"], r["serials"], r["item_master"], as_of, shipment_rules)

    def stock():
        r = lake.stock_roles(spark, umbrella)
        return stock_snapshot(stock_extract(r["positions"], r["branches"], r["items"], stock_rules, as_of),
                              as_of, stock_rules.months_back)

    def items():
        return item_master(lake.raw_items(spark, umbrella), "iteg_id_fornec", stock_rules.suppliers)

    return {"sales": sales, "shipments": shipments, "stock": stock, "items": items}


def refresh_snapshots(store: SnapshotStore, builders: dict[str, Callable[[], DataFrame]],
                      names: Iterable[str] = REFRESHED) -> dict[str, DataFrame]:
    """Rebuild each named snapshot into a new version and switch to it."""
    return {name: store.refresh(name, builders[name], DAY_COLUMNS.get(name)) for name in names}


def archive_positions(positions: DataFrame, today: date, target: str, is_table: bool = False,
                      partition_col: str = "partition_date") -> None:
    """Copy every position partition strictly before ``today`` into the archive."""
    archive_before(positions, partition_col, today, target, is_table=is_table)
