"""Daily stock: latest intra-day position per warehouse / SKU / day, completed
to a full trailing calendar, last observation carried forward, then joined to
the item master for the report.

Role tables:

=========  ===============================================================
positions  sku, branch_id, stock_date, received_date, available (any type,
           read leniently as double), brand_group, id_cia
branches   branch_id, cnpj
items      item_id, supplier_id, [ean, item_company]
=========  ===============================================================
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.numbers import to_double
from mercato.operators.filters import day_range, equals, in_list, not_null
from mercato.operators.timeseries import (
    calendar_bounds, densify, fill_calendar, latest_per_period,
)
from mercato.params import DateRange
from mercato.plans.sales import ALLOWED_SUPPLIERS

# Output column order of the extract and of the daily snapshot.
STOCK_COLUMNS = ("sku", "cnpj", "stock_date", "received_date", "available", "brand_group", "id_cia")
LATEST_COLUMNS = ("cnpj", "brand_group", "sku", "stock_date", "received_date", "available", "id_cia")
REPORT_COLUMNS = ("warehouse_cnpj", "brand_group", "stock_date", "ean", "sku", "available_stock")
PERIOD_KEYS = ("cnpj", "brand_group", "sku", "stock_date")
GRID_KEYS = ("sku", "brand_group", "cnpj", "id_cia")
FILL_KEYS = ("sku", "brand_group", "cnpj")
# Deterministic order inside a fill key: day first, then the columns that can
# differ between rows of one day (company, exact ties on the load time).
FILL_ORDER = ("stock_date", "id_cia", "received_date", "available")


@dataclass(frozen=True)
class StockRules:
    """Extract filters.  ``None`` switches a filter off.

    Fixed values (defaults): company '1', brand group '1', the supplier
    allow-list, one month back (a 31-day calendar).
    """

    company: str | None = "1"
    brand_group: str | None = "1"
    suppliers: tuple | None = ALLOWED_SUPPLIERS
    months_back: int = 1


def stock_extract(positions: DataFrame, branches: DataFrame, items: DataFrame,
                  rules: StockRules = StockRules(), as_of: date | datetime | None = None) -> DataFrame:
    """positions JOIN branch JOIN item (allow-listed supplier), inner.

    The item join is on the item id alone and selects no item column: an
    existence test that, like the original, repeats a position once per
    matching item row.  ``available`` and a text ``stock_date`` are read
    leniently: text that is no number or no day becomes NULL instead of failing
    the job, and a position without a day has no place in the calendar.

    With ``as_of`` the positions are cut to the calendar of the snapshot first.
    On text days text is compared, which prunes day partitions (in a metastore
    too) where a cast of the column could not.
    """
    pos = positions
    if as_of is not None:
        pos = day_range(pos, "stock_date", DateRange(*calendar_bounds(as_of, rules.months_back)))
    pos = equals(pos, "id_cia", rules.company)
    pos = equals(pos, "brand_group", rules.brand_group)
    br = branches.select("branch_id", "cnpj")
    it = in_list(items, "supplier_id", rules.suppliers).select(F.col("item_id").alias("__item"))
    joined = pos.join(br, "branch_id").join(it, F.col("sku") == F.col("__item"))
    return joined.select(
        "sku", "cnpj", F.col("stock_date").try_cast("date").alias("stock_date"), "received_date",
        to_double("available").alias("available"), "brand_group", "id_cia")


def latest_stock(extract: DataFrame) -> DataFrame:
    """Latest position of each (cnpj, brand_group, sku, day); ties kept."""
    return latest_per_period(extract, PERIOD_KEYS, "received_date", LATEST_COLUMNS)


def stock_grid(latest: DataFrame, as_of: date | datetime, months_back: int = 1) -> DataFrame:
    """Every key x every calendar day, NULL where no position was taken."""
    start, end = calendar_bounds(as_of, months_back)
    return densify(latest, GRID_KEYS, "stock_date", start, end).select(*STOCK_COLUMNS)


def stock_snapshot(extract: DataFrame, as_of: date | datetime, months_back: int = 1) -> DataFrame:
    """Latest per day -> calendar grid -> forward fill.

    History before the calendar plays no part (as in the grid join), so the
    extract is cut to the calendar first: on a day-partitioned table this is
    partition pruning.  The three steps are one window over a cell per key,
    company and day and one join of the extract to the cells, exact for any mix
    of companies.
    """
    start, end = calendar_bounds(as_of, months_back)
    return fill_calendar(extract.select(*STOCK_COLUMNS), FILL_KEYS, GRID_KEYS, "stock_date", "received_date",
                         "available", start, end)


def stock_report(snapshot: DataFrame, items: DataFrame, rng: DateRange) -> DataFrame:
    """Day range, non-NULL stock, EAN from the item master (on sku and company)."""
    kept = not_null(day_range(snapshot, "stock_date", rng), "available")
    it = items.select(F.col("item_id").alias("__item"), F.col("ean").alias("__ean"),
                      F.col("item_company").alias("__cia"))
    joined = kept.join(it, (F.col("sku") == F.col("__item")) & (F.col("id_cia") == F.col("__cia")))
    return joined.select(
        F.col("cnpj").alias("warehouse_cnpj"), "brand_group", "stock_date",
        F.col("__ean").alias("ean"), "sku", F.col("available").alias("available_stock"))
