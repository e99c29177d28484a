"""Sales report: order header, delivery party, order lines, item and branch,
summed per warehouse, brand, order timestamp, EAN, SKU and target state.

Role tables and their columns (any extra column is ignored):

========  ==============================================================
header    order_id, sales_date, brand, order_status, [approved, origin,
          company], [branch_id], [load_part]
party     <party_key>, uf_target, [party_type], [load_part]
line      order_id, sku, quantity, [branch_id], [load_part]
items     item_id, ean, supplier_id
branches  branch_id, cnpj
========  ==============================================================

``party_key`` is ``order_id`` in the original lake (a party row per order);
a lake that keeps the delivery address on a customer table joins it on
``customer_id`` carried by the header instead.  ``branch_id`` may live on the
header or on the line; ``load_part`` is the
load-month partition of a table (text ``yyyy-MM``, or a date / timestamp read
as its month) and is filtered per table because each has its own load date.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.brands import brand_sales
from mercato.operators.filters import equals, in_list, ts_range
from mercato.params import DateRange
from mercato.sources.partitions import month_window

# Supplier allow-list of the item master.
ALLOWED_SUPPLIERS = ("280273002938", "280273000137", "280273000218", "280273000722")

EXTRACT_COLUMNS = ("sales_date", "brand", "sku", "cnpj", "uf_target", "ean", "quantity")
REPORT_COLUMNS = ("warehouse_cnpj", "uf_target", "brand", "sales_date", "ean", "sku", "quantity")
GROUP_KEYS = ("cnpj", "brand", "sales_date", "ean", "sku", "uf_target")


@dataclass(frozen=True)
class SalesRules:
    """Extract filters.  ``None`` switches a filter off.

    Fixed values (defaults): order status A/L, brand codes 1/2/3, approved
    'S', origin 'LJ', company '1', party type 'E', one month back, inclusive.
    """

    statuses: tuple | None = ("A", "L")
    brands: tuple | None = ("1", "2", "3")
    approved: str | None = "S"
    origin: str | None = "LJ"
    company: str | None = "1"
    party_type: str | None = "E"
    suppliers: tuple | None = ALLOWED_SUPPLIERS
    months_back: int | None = 1
    inclusive: bool = True


def _window(df: DataFrame, as_of, rules: SalesRules) -> DataFrame:
    if rules.months_back is None or "load_part" not in df.columns:
        return df.drop("load_part") if "load_part" in df.columns else df
    return month_window(df, "load_part", as_of, rules.months_back, rules.inclusive).drop("load_part")


def _keep(df: DataFrame, wanted) -> DataFrame:
    return df.select(*[c for c in df.columns if c in wanted])


def _filtered(header: DataFrame, party: DataFrame, line: DataFrame, items: DataFrame, branches: DataFrame,
              as_of: date | datetime, rules: SalesRules, party_key: str, carry: tuple = ()) -> tuple[DataFrame, ...]:
    """The role tables after their own filters, with the columns the report needs; lines already carry their item.

    The allow-list cuts the lines before the largest shuffle: line x item first
    (the items of a few suppliers).
    """
    h = _window(header, as_of, rules)
    h = in_list(h, "order_status", rules.statuses)
    h = in_list(h, "brand", rules.brands)
    h = equals(h, "approved", rules.approved)
    h = equals(h, "origin", rules.origin)
    h = equals(h, "company", rules.company)
    h = _keep(h, {"order_id", "sales_date", "brand", "branch_id", party_key, *carry})

    p = equals(_window(party, as_of, rules), "party_type", rules.party_type)
    p = _keep(p, {party_key, "uf_target"})

    ln = _keep(_window(line, as_of, rules), {"order_id", "sku", "quantity", "branch_id"})
    it = _keep(items, {"item_id", "ean", "supplier_id"})
    ln = ln.join(it, F.col("sku") == it["item_id"], "left")
    if rules.suppliers is not None:
        ln = ln.where(F.col("supplier_id").isin(list(rules.suppliers)))
    return h, p, ln, _keep(branches, {"branch_id", "cnpj"})


def sales_extract(header: DataFrame, party: DataFrame, line: DataFrame, items: DataFrame,
                  branches: DataFrame, as_of: date | datetime,
                  rules: SalesRules = SalesRules(), party_key: str = "order_id", carry: tuple = ()) -> DataFrame:
    """One row per delivery party x order line of an admitted order; ``carry`` names header columns to add.

    header JOIN party (type 'E') JOIN line, LEFT JOIN item (made inner by the
    supplier allow-list, which rejects NULL), LEFT JOIN branch (a sale whose
    branch is unknown keeps a NULL cnpj).  An order with several delivery
    parties repeats its lines: the sum counts each.
    """
    h, p, ln, br = _filtered(header, party, line, items, branches, as_of, rules, party_key, carry)
    # A party keyed by order joins right after the header, on the same key, so it reuses that partitioning;
    # then the remaining dimensions.
    joined = h.join(ln, "order_id").join(p, party_key).join(br, "branch_id", "left")
    return joined.select(*EXTRACT_COLUMNS, *carry)


def sales_report_eager(header: DataFrame, party: DataFrame, line: DataFrame, items: DataFrame,
                       branches: DataFrame, rng: DateRange, as_of: date | datetime,
                       rules: SalesRules = SalesRules(), party_key: str = "order_id") -> DataFrame:
    """``sales_report(sales_extract(...), rng)`` without making the rows of party x line.

    Before they meet, lines are summed by order, item and branch, and parties are
    counted by key and state; a sum then counts as often as there are parties
    of a state.  An order with p parties and l lines makes states x items rows
    instead of p x l, and both sides cross their shuffle already reduced.  The
    report's range is a filter of the header, before any join.
    """
    h, p, ln, br = _filtered(header, party, line, items, branches, as_of, rules, party_key)
    h = ts_range(h, "sales_date", rng)
    on_line = [c for c in ("branch_id",) if c in ln.columns]
    lines = (ln.groupBy("order_id", "sku", "ean", *on_line)
             .agg(F.sum("quantity").alias("__quantity")))
    parties = p.groupBy(party_key, "uf_target").agg(F.count(F.lit(1)).alias("__parties"))
    joined = h.join(lines, "order_id").join(parties, party_key).join(br, "branch_id", "left")
    return _summed(joined, F.col("__quantity") * F.col("__parties"))


def sales_report(extract: DataFrame, rng: DateRange) -> DataFrame:
    """Sum of quantity per (cnpj, brand, sales_date, ean, sku, uf_target).

    The group key is the full order timestamp.  NULL keys form groups; a sum
    over only NULL quantities reads as 0.0.  Brand codes are decoded after
    the aggregate (fewer rows to decode); an unknown code fails the job.
    """
    return _summed(ts_range(extract, "sales_date", rng), F.col("quantity"))


def _summed(rows: DataFrame, quantity: Column) -> DataFrame:
    summed = rows.groupBy(*GROUP_KEYS).agg(F.coalesce(F.sum(quantity), F.lit(0.0)).alias("quantity"))
    return summed.select(
        F.col("cnpj").alias("warehouse_cnpj"),
        "uf_target",
        brand_sales("brand").alias("brand"),
        "sales_date", "ean", "sku", "quantity",
    )
