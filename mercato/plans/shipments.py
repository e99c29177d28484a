"""Shipments report: warehouse orders joined down to the serial number.

Role tables (columns in brackets may sit on whichever role carries them in a
given lake; each join uses the key columns of everything joined before it):

===========  ============================================================
header       order_id, sales_date, order_status, [brand, dispatch_date,
             plant_id, program_id, wave_id, prevol_id], [load_part]
plants       plant_id, warehouse_cnpj, warehouse_uf
labels       <label_key>, delivery_city, delivery_uf, nf_issuance, nf_id,
             nf_serie, [load_part]
lines        order_id, item_id, [...], [load_part]
wms_items    item_id, sku_id, sku, supplier_id, [brand]
eans         sku_id, ean
serials      program_id, wave_id, prevol_id, imei, [load_part]
item_master  item_id, item_company, department
===========  ============================================================

``label_key`` is ``order_id`` in the original lake; a lake keeping the
delivery address per customer joins on ``customer_id`` (then the invoice
columns come with the header).  Every join is inner.  The serial numbers join the *order* on the three-part
volume key, so every serial of a volume pairs with every item and EAN of the
order: that multiplication is the report's defined output and is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.brands import brand_wms
from mercato.operators.filters import equals, in_list, ts_range
from mercato.params import DateRange
from mercato.plans.sales import ALLOWED_SUPPLIERS
from mercato.sources.partitions import month_window

EXTRACT_COLUMNS = ("brand", "warehouse_cnpj", "warehouse_uf", "delivery_city", "delivery_uf", "sku",
                   "ean", "imei", "dispatch_date", "sales_date", "nf_issuance", "nf_id", "nf_serie")
REPORT_COLUMNS = ("warehouse_cnpj", "warehouse_uf", "brand", "nf_issuance", "sales_date",
                  "dispatch_date", "nf_id", "nf_serie", "delivery_city", "delivery_uf", "ean",
                  "sku", "imei")
VOLUME_KEY = ("program_id", "wave_id", "prevol_id")

_NEEDED = set(EXTRACT_COLUMNS) | set(VOLUME_KEY) | {
    "order_id", "customer_id", "plant_id", "item_id", "sku_id", "supplier_id", "order_status"}


@dataclass(frozen=True)
class ShipmentRules:
    """Extract filters.  ``None`` switches a filter off.

    Fixed values (defaults): dispatched status 'L', business units 1/29/26,
    item company '1', department '18', one month back, *exclusive* limit.
    """

    status: str | None = "L"
    brands: tuple | None = ("1", "29", "26")
    suppliers: tuple | None = ALLOWED_SUPPLIERS
    item_company: str | None = "1"
    department: str | None = "18"
    months_back: int | None = 1
    inclusive: bool = False


def _prep(df: DataFrame, as_of, rules: ShipmentRules) -> DataFrame:
    if "load_part" in df.columns:
        if rules.months_back is not None:
            df = month_window(df, "load_part", as_of, rules.months_back, rules.inclusive)
        df = df.drop("load_part")
    return df.select(*[c for c in df.columns if c in _NEEDED])


def shipments_extract(header: DataFrame, plants: DataFrame, labels: DataFrame, lines: DataFrame,
                      wms_items: DataFrame, eans: DataFrame, serials: DataFrame,
                      item_master: DataFrame, as_of: date | datetime,
                      rules: ShipmentRules = ShipmentRules(), label_key: str = "order_id") -> DataFrame:
    """The 8-table inner join with the warehouse filters.

    Join order: the allow-listed items with the item-master check first, then
    the lines, so that only their lines are shuffled to the filtered header;
    then the dimensions, and the serial numbers (the multiplying join) last, so
    the widest intermediate result is produced once, at the end.  How the
    serials are joined is left to adaptive execution, which knows the size of
    the side that has been cut.
    """
    h = equals(_prep(header, as_of, rules), "order_status", rules.status)
    it = in_list(_prep(wms_items, as_of, rules), "supplier_id", rules.suppliers)
    ln = _prep(lines, as_of, rules)
    im = item_master
    im = equals(im, "item_company", rules.item_company)
    im = equals(im, "department", rules.department)
    im = im.select(F.col("item_id").alias("__iteg_id"))

    lb = _prep(labels, as_of, rules)
    if rules.brands is not None and "brand" in it.columns:
        it = it.where(F.col("brand").isin(list(rules.brands)))
    it = it.join(im, F.col("sku") == im["__iteg_id"])              # item-master check, before any fact
    joined = h.join(ln.join(it, "item_id"), "order_id")
    if label_key == "order_id":
        joined = joined.join(lb, label_key)   # same key as header x lines: reuses its partitioning
    if rules.brands is not None:
        joined = joined.where(F.col("brand").isin(list(rules.brands)))
    joined = joined.join(_prep(eans, as_of, rules), "sku_id").join(_prep(plants, as_of, rules), "plant_id")
    if label_key != "order_id":
        joined = joined.join(lb, label_key)
    joined = (joined
              .join(_prep(serials, as_of, rules), list(VOLUME_KEY)))
    return joined.select(*EXTRACT_COLUMNS)


def shipments_report(extract: DataFrame, rng: DateRange) -> DataFrame:
    """Closed range on the order date, warehouse brand decoded, fields in report order.

    No aggregation and no de-duplication.
    """
    kept = ts_range(extract, "sales_date", rng)
    return kept.select(
        "warehouse_cnpj", "warehouse_uf", brand_wms("brand").alias("brand"), "nf_issuance",
        "sales_date", "dispatch_date", "nf_id", "nf_serie", "delivery_city", "delivery_uf",
        "ean", "sku", "imei")
