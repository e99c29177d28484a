"""The three report requests and the daily jobs, as plain functions over the lake.

Mirrors the original service's surface without its HTTP layer: each request
validates its dates first (errors are raised before any Spark work), reads
the current snapshot of its extract (built on first use), applies the report
and returns a DataFrame; ``json=True`` returns the JSON-lines form instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from mercato.params import DEFAULT_MIN_DATE, validate_dates
from mercato.plans.incremental import refresh_sales
from mercato.plans.jobs import DAY_COLUMNS, REFRESHED, archive_positions, lake_builders, refresh_snapshots
from mercato.plans.sales import SalesRules, sales_report
from mercato.plans.shipments import ShipmentRules, shipments_report
from mercato.plans.stock import StockRules, stock_report
from mercato.sinks.json_lines import SALE_FIELDS, SHIPMENT_FIELDS, STOCK_FIELDS, to_json_lines
from mercato.sinks.snapshot import SnapshotStore, days
from mercato.sources import lake


class ReportService:
    """``as_of`` fixes the moment of all requests and jobs; without it each call takes its own "now", or the one it is given.

    ``months_back`` widens the load-month windows and the stock calendar of the
    three extracts; ``half_open`` lets ranges end with the last day's midnight
    instead of 23:59.  Snapshots are laid out by day, and a request reads the
    days of its range.  ``incremental`` refreshes the sales snapshot by the load
    months that have changed.
    """

    def __init__(self, spark: SparkSession, as_of: date | datetime | None = None,
                 store: SnapshotStore | None = None,
                 sales_rules: SalesRules = SalesRules(), shipment_rules: ShipmentRules = ShipmentRules(),
                 stock_rules: StockRules = StockRules(), umbrella: str | None = lake.UMBRELLA_DB,
                 wms: str | None = lake.WMS_DB, min_date: date = DEFAULT_MIN_DATE,
                 skip_max_period: bool = False, months_back: int | None = None, half_open: bool = False,
                 incremental: bool = False):
        self.spark = spark
        self.as_of = as_of
        self.store = store or SnapshotStore(spark)
        self.min_date, self.skip_max_period, self.half_open = min_date, skip_max_period, half_open
        self.umbrella, self.wms = umbrella, wms
        self.incremental = incremental
        rules = (sales_rules, shipment_rules, stock_rules)
        self.rules = rules if months_back is None else tuple(replace(r, months_back=months_back) for r in rules)

    def _now(self, as_of: date | datetime | None) -> date | datetime:
        return as_of or self.as_of or datetime.now()

    def _builders(self, as_of: date | datetime | None):
        return lake_builders(self.spark, self._now(as_of), *self.rules, self.umbrella, self.wms)

    def _snapshot(self, name: str, as_of: date | datetime | None) -> DataFrame:
        return self.store.get(name, self._builders(as_of)[name], DAY_COLUMNS.get(name))

    def _report(self, name: str, initial: str | None, final: str | None, as_of: date | datetime | None):
        """The dates are checked before the snapshot is looked up or built."""
        rng = validate_dates(initial, final, as_of=self._now(as_of), skip_max_period=self.skip_max_period,
                             min_date=self.min_date, half_open=self.half_open)
        return days(self._snapshot(name, as_of), rng.first_day, rng.final), rng

    def sales(self, initial: str | None, final: str | None, json: bool = False,
              as_of: date | datetime | None = None) -> DataFrame:
        out = sales_report(*self._report("sales", initial, final, as_of))
        return to_json_lines(out, SALE_FIELDS) if json else out

    def shipments(self, initial: str | None, final: str | None, json: bool = False,
                  as_of: date | datetime | None = None) -> DataFrame:
        out = shipments_report(*self._report("shipments", initial, final, as_of))
        return to_json_lines(out, SHIPMENT_FIELDS) if json else out

    def stock(self, initial: str | None, final: str | None, json: bool = False,
              as_of: date | datetime | None = None) -> DataFrame:
        snapshot, rng = self._report("stock", initial, final, as_of)
        # the report joins the item master's id, EAN and company columns
        items = self.items(as_of=as_of).selectExpr(*[f"`{src}` as {dst}" for src, dst in lake.ITEM_MASTER[1].items()])
        out = stock_report(snapshot, items, rng)
        return to_json_lines(out, STOCK_FIELDS) if json else out

    def items(self, json: bool = False, as_of: date | datetime | None = None) -> DataFrame:
        """The item master of the allow-listed suppliers, all its columns."""
        out = self._snapshot("items", as_of)
        return to_json_lines(out, out.columns) if json else out

    def refresh(self, names: Iterable[str] = REFRESHED, as_of: date | datetime | None = None) -> dict[str, DataFrame]:
        """The daily snapshot refresh (item master, sales, stock, shipments)."""
        names, out = list(names), {}
        if self.incremental and "sales" in names:
            names.remove("sales")
            out["sales"] = refresh_sales(self.store, "sales", lake.sales_roles(self.spark, self.umbrella),
                                         self._now(as_of), self.rules[0])
        return {**out, **refresh_snapshots(self.store, self._builders(as_of), names)}

    def archive(self, target: str, today: date | None = None, is_table: bool = True) -> None:
        """The daily archive of every position partition strictly before ``today``."""
        now = self._now(today)
        day = now.date() if isinstance(now, datetime) else now
        archive_positions(lake.raw_positions(self.spark, self.umbrella), day, target, is_table=is_table)
