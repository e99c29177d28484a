"""Adapters from the driver's star-schema test tables to the report roles.

The reports were written for a retail lake whose tables are not available;
the TPC-H-like test tables stand in for them:

=====================================  ==========================================
role                                   stand-in
=====================================  ==========================================
sales order header                     orders (brand code = first character of
                                       o_orderpriority, status F/O admitted)
delivery party (target state)          customer JOIN nation, by customer
order line                             lineitem
item / EAN / supplier                  part / p_name / p_brand
branch (cnpj)                          supplier (s_name), by l_suppkey
load-month partition                   o_orderdate read as its month
warehouse brand code                   p_size (1, 26, 29) as text
warehouse / state                      supplier JOIN nation, by l_suppkey
delivery city / state                  customer JOIN nation, by customer
serial number, 3-column volume key     second lineitem on (l_orderkey,
                                       l_returnflag, l_linestatus); serial =
                                       l_linenumber
stock position: sku / brand group /    events: user_id / event_type / day of ts /
day / load time / available            ts / value
stock branch                           supplier on s_suppkey = user_id % 10
stock item                             part on p_partkey = user_id
=====================================  ==========================================

A second set, ``filtered_*``, gives every filter and key of the reports a column with several
values: approved, origin, company and load month (text ``yyyy-MM``) on the header; delivery and
other parties, several to an order; two companies and departments in the item master; two
companies of positions, with an EAN each.

Identifiers keep their native (integer) types so joins stay on numeric keys.
Projections are written as SQL expressions (one call into the JVM per table).
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame

from mercato.plans.sales import SalesRules
from mercato.plans.shipments import ShipmentRules
from mercato.plans.stock import StockRules
from mercato.sources.tables import Tables

# The stand-in supplier allow-list and reference dates.
STANDIN_SUPPLIERS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4")
SALES_AS_OF = datetime(2001, 8, 1)
STOCK_AS_OF = date(2024, 1, 30)

SALES_RULES = SalesRules(statuses=("F", "O"), brands=("1", "2", "3"), approved=None, origin=None,
                         company=None, party_type=None, suppliers=STANDIN_SUPPLIERS,
                         months_back=7, inclusive=True)
FILTERED_SALES_RULES = SalesRules(statuses=("F", "O"), suppliers=STANDIN_SUPPLIERS, months_back=40)
FILTERED_SHIPMENT_RULES = ShipmentRules(status="F", suppliers=STANDIN_SUPPLIERS, months_back=80)
FILTERED_STOCK_RULES = StockRules(company="1", brand_group="click", suppliers=STANDIN_SUPPLIERS)
SHIPMENT_RULES = ShipmentRules(status="F", brands=("1", "29", "26"), suppliers=STANDIN_SUPPLIERS,
                               item_company="1", department="18", months_back=80, inclusive=False)
STOCK_RULES = StockRules(company="1", brand_group=None, suppliers=STANDIN_SUPPLIERS, months_back=1)


def _customer_nation(t: Tables) -> DataFrame:
    return t["customer"].join(t["nation"], t["customer"]["c_nationkey"] == t["nation"]["n_nationkey"])


def sales_roles(t: Tables) -> dict[str, DataFrame]:
    return {
        "header": t["orders"].selectExpr(
            "o_orderkey as order_id", "o_custkey as customer_id", "o_orderdate as sales_date",
            "substring(o_orderpriority, 1, 1) as brand", "o_orderstatus as order_status",
            "o_orderdate as load_part"),
        "party": _customer_nation(t).selectExpr("c_custkey as customer_id", "n_name as uf_target"),
        "line": t["lineitem"].selectExpr(
            "l_orderkey as order_id", "l_partkey as sku", "l_quantity as quantity", "l_suppkey as branch_id"),
        "items": t["part"].selectExpr("p_partkey as item_id", "p_name as ean", "p_brand as supplier_id"),
        "branches": t["supplier"].selectExpr("s_suppkey as branch_id", "s_name as cnpj"),
    }


def shipment_roles(t: Tables) -> dict[str, DataFrame]:
    supplier_nation = t["supplier"].join(t["nation"], t["supplier"]["s_nationkey"] == t["nation"]["n_nationkey"])
    return {
        "header": t["orders"].selectExpr(
            "o_orderkey as order_id", "o_custkey as customer_id", "o_orderdate as sales_date",
            "o_orderstatus as order_status", "o_orderkey as nf_id", "o_orderdate as nf_issuance",
            "o_orderpriority as nf_serie", "o_orderdate as load_part"),
        "plants": supplier_nation.selectExpr(
            "s_suppkey as plant_id", "s_name as warehouse_cnpj", "n_name as warehouse_uf"),
        "labels": _customer_nation(t).selectExpr(
            "c_custkey as customer_id", "c_name as delivery_city", "n_name as delivery_uf"),
        "lines": t["lineitem"].selectExpr(
            "l_orderkey as order_id", "l_partkey as item_id", "l_suppkey as plant_id",
            "l_shipdate as dispatch_date", "l_orderkey as program_id", "l_returnflag as wave_id",
            "l_linestatus as prevol_id"),
        "wms_items": t["part"].selectExpr(
            "p_partkey as item_id", "p_partkey as sku_id", "p_partkey as sku", "p_brand as supplier_id",
            "cast(p_size as string) as brand"),
        "eans": t["part"].selectExpr("p_partkey as sku_id", "p_name as ean"),
        "serials": t["lineitem"].selectExpr(
            "l_orderkey as program_id", "l_returnflag as wave_id", "l_linestatus as prevol_id",
            "l_linenumber as imei"),
        "item_master": t["part"].selectExpr("p_partkey as item_id", "'1' as item_company", "'18' as department"),
    }


def stock_positions(t: Tables) -> DataFrame:
    """The raw position table: one row per intra-day load."""
    return t["events"].selectExpr(
        "user_id as sku", "user_id % 10 as branch_id", "cast(ts as date) as stock_date",
        "ts as received_date", "value as available", "event_type as brand_group", "'1' as id_cia")


def stock_items(t: Tables) -> DataFrame:
    return t["part"].selectExpr(
        "p_partkey as item_id", "p_brand as supplier_id", "p_name as ean", "'1' as item_company")


def stock_roles(t: Tables) -> dict[str, DataFrame]:
    return {
        "positions": stock_positions(t),
        "branches": t["supplier"].selectExpr("s_suppkey as branch_id", "s_name as cnpj"),
        "items": stock_items(t),
    }


def branch_positions(t: Tables) -> DataFrame:
    """Positions with their branch cnpj (no item filter): input of the single-operator queries."""
    roles = stock_roles(t)
    pos = roles["positions"].join(roles["branches"], "branch_id")
    return pos.select("sku", "cnpj", "stock_date", "received_date", "available", "brand_group", "id_cia")


def filtered_sales_roles(t: Tables) -> dict[str, DataFrame]:
    """Roles with a real column behind every filter; an order's parties are its customer and the suppliers of its lines."""
    header = t["orders"].selectExpr(
        "o_orderkey as order_id", "o_orderdate as sales_date", "substring(o_orderpriority, 1, 1) as brand",
        "o_orderstatus as order_status", "if(o_totalprice >= 100000, 'S', 'N') as approved",
        "if(o_custkey % 2 = 0, 'LJ', 'TV') as origin", "if(o_orderkey % 3 = 0, '2', '1') as company",
        "date_format(o_orderdate, 'yyyy-MM') as load_part")
    customer = t["orders"].join(_customer_nation(t), t["orders"]["o_custkey"] == t["customer"]["c_custkey"]).selectExpr(
        "o_orderkey as order_id", "n_name as uf_target", "'E' as party_type")
    sup = t["supplier"].join(t["nation"], t["supplier"]["s_nationkey"] == t["nation"]["n_nationkey"])
    supplier = t["lineitem"].join(sup, t["lineitem"]["l_suppkey"] == t["supplier"]["s_suppkey"]).selectExpr(
        "l_orderkey as order_id", "n_name as uf_target", "if(l_returnflag = 'R', 'E', 'C') as party_type")
    base = sales_roles(t)
    return {"header": header, "party": customer.unionByName(supplier), "line": base["line"],
            "items": base["items"], "branches": base["branches"]}


def filtered_shipment_roles(t: Tables) -> dict[str, DataFrame]:
    """An item master of two companies and departments; load months as text."""
    roles = shipment_roles(t)
    part = t["part"]
    master = part.selectExpr("p_partkey as item_id", "'1' as item_company", "if(p_partkey % 3 = 0, '20', '18') as department")
    other = part.where("p_partkey % 2 = 0").selectExpr("p_partkey as item_id", "'2' as item_company", "'18' as department")
    header = roles["header"].selectExpr("* except (load_part)", "date_format(sales_date, 'yyyy-MM') as load_part")
    return {**roles, "header": header, "item_master": master.unionByName(other)}


def filtered_stock_roles(t: Tables) -> dict[str, DataFrame]:
    """Positions of two companies in as many branches as there are suppliers with a user of their number."""
    positions = t["events"].selectExpr(
        "user_id as sku", "user_id as branch_id", "cast(cast(ts as date) as string) as stock_date",
        "ts as received_date", "cast(value as string) as available", "event_type as brand_group",
        "cast(1 + event_id % 2 as string) as id_cia")
    items = t["part"].selectExpr("p_partkey as item_id", "p_brand as supplier_id", "p_name as ean", "'1' as item_company")
    other = t["part"].where("p_partkey % 2 = 0").selectExpr(
        "p_partkey as item_id", "p_brand as supplier_id", "concat(p_name, ' (2)') as ean", "'2' as item_company")
    return {"positions": positions, "items": items, "companies": items.unionByName(other),
            "branches": stock_roles(t)["branches"]}


def tied_positions(t: Tables) -> DataFrame:
    """Positions of two companies that all tie on the load time of their day, with NULL and NaN among the quantities."""
    positions = t["events"].selectExpr(
        "user_id as sku", "user_id % 10 as branch_id", "cast(ts as date) as stock_date",
        "cast(cast(ts as date) as timestamp_ntz) as received_date",
        "case when event_id % 5 = 0 then null when event_id % 7 = 0 then double('nan') else value end as available",
        "event_type as brand_group", "cast(event_id % 2 as string) as id_cia")
    return positions.join(stock_roles(t)["branches"], "branch_id").select(
        "sku", "cnpj", "stock_date", "received_date", "available", "brand_group", "id_cia")
