"""Registered queries over the driver's test tables, one per operator of the
inventory, each with the DuckDB SQL that computes the same rows.

Every query reads whole tables (no sampling, id subsets or row caps).  The
stand-in mapping is in ``mercato.sources.standins``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.brands import brand_sales, brand_wms
from mercato.functions.dates import day_string, from_day_string
from mercato.functions.numbers import to_double
from mercato.operators.filters import day_range, in_list, not_null, ts_range
from mercato.operators.timeseries import (
    calendar_bounds, calendar_of, densify, densify_join, fill_calendar, forward_fill, max_per_period,
)
from mercato.params import DateRange, validate_dates
from mercato.plans.incremental import refresh_sales
from mercato.plans.items import item_master
from mercato.plans.sales import sales_extract, sales_report, sales_report_eager
from mercato.plans.shipments import shipments_extract, shipments_report
from mercato.plans.stock import (
    FILL_KEYS, FILL_ORDER, GRID_KEYS, PERIOD_KEYS, STOCK_COLUMNS, latest_stock,
    stock_extract, stock_report, stock_snapshot,
)
from mercato.session import unique_path
from mercato.sinks.archive import archive_before
from mercato.sinks.json_lines import SALE_FIELDS, SHIPMENT_FIELDS, STOCK_FIELDS, to_json_lines
from mercato.sinks.snapshot import SnapshotStore, days
from mercato.sources import standins as S
from mercato.sources.csv import read_csv, write_csv
from mercato.sources.partitions import month_window, read_month_partitions, write_month_partitions
from mercato.sources.tables import Tables

# Report ranges used on the test tables.
SALES_RANGE = ("2001-01-01", "2001-07-31")
FILTERED_SALES_RANGE = ("1999-01-01", "2001-06-30")
SHIPMENTS_RANGE = ("1995-01-01", "2001-07-31")
STOCK_RANGE = ("2024-01-10", "2024-01-20")
UNION_SPLIT = (date(2024, 1, 15), date(2024, 1, 10))


_TABLES: WeakKeyDictionary[SparkSession, dict[str, Tables]] = WeakKeyDictionary()


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Table handles per session and directory, resolved once (like catalog tables) and let go with the session."""
    held = _TABLES.setdefault(spark, {})
    if sf_dir not in held:
        held[sf_dir] = Tables(spark, sf_dir)
    return held[sf_dir]


def _range(bounds: tuple[str, str]) -> DateRange:
    return validate_dates(bounds[0], bounds[1], skip_max_period=True)


# --------------------------------------------------------------------------- sales

def q_sales_extract(spark, sf_dir):
    r = S.sales_roles(_tables(spark, sf_dir))
    return sales_extract(r["header"], r["party"], r["line"], r["items"], r["branches"],
                         S.SALES_AS_OF, S.SALES_RULES, party_key="customer_id")


def q_sales_report(spark, sf_dir):
    return sales_report(q_sales_extract(spark, sf_dir), _range(SALES_RANGE))


def _filtered_sales(spark, sf_dir):
    r = S.filtered_sales_roles(_tables(spark, sf_dir))
    return r["header"], r["party"], r["line"], r["items"], r["branches"]


def q_sales_extract_filtered(spark, sf_dir):
    """Every filter of the extract over a column with several values, several delivery parties to an order."""
    return sales_extract(*_filtered_sales(spark, sf_dir), S.SALES_AS_OF, S.FILTERED_SALES_RULES)


def q_sales_report_filtered(spark, sf_dir):
    return sales_report(q_sales_extract_filtered(spark, sf_dir), _range(FILTERED_SALES_RANGE))


def q_sales_report_eager(spark, sf_dir):
    """The same report, lines summed and parties counted before they meet."""
    return sales_report_eager(*_filtered_sales(spark, sf_dir), _range(FILTERED_SALES_RANGE), S.SALES_AS_OF,
                              S.FILTERED_SALES_RULES)


def q_sales_report_json(spark, sf_dir):
    return to_json_lines(q_sales_report(spark, sf_dir), SALE_FIELDS)


def _snapshot_store(spark) -> SnapshotStore:
    return SnapshotStore(spark, unique_path(spark, "snapshots"))


def q_snapshot_read(spark, sf_dir):
    store = _snapshot_store(spark)
    return store.get("sales", lambda: q_sales_extract(spark, sf_dir))


def q_snapshot_refresh(spark, sf_dir):
    store = _snapshot_store(spark)
    store.refresh("sales", lambda: q_sales_extract(spark, sf_dir))
    return store.refresh("sales", lambda: q_sales_extract(spark, sf_dir))


def _landed(spark, rows: DataFrame, name: str) -> DataFrame:
    """Rows written below the scratch folder, as a table of their own."""
    path = unique_path(spark, "landed", name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def q_snapshot_incremental(spark, sf_dir):
    """The sales snapshot of earlier sources, refreshed by the months that have changed since."""
    store = _snapshot_store(spark)
    roles = S.filtered_sales_roles(_tables(spark, sf_dir))
    # Tables of a lake, which hold their load month: joined to it once, not again by each step that reads them.
    months = roles["header"].select("order_id", "load_part")
    roles |= {t: _landed(spark, roles[t].join(months, "order_id"), t) for t in ("line", "party")}
    late = F.col("load_part") >= "2001-05"
    earlier = {**roles, "header": roles["header"].where(~(F.col("load_part") > "2001-06")),
               "line": roles["line"].where(~late | (F.col("sku") % 3 != 0)),
               "party": roles["party"].withColumn("uf_target", F.when(late, F.lit("-")).otherwise(F.col("uf_target")))}
    refresh_sales(store, "sales", earlier, S.SALES_AS_OF, S.FILTERED_SALES_RULES, day_col=None)
    return refresh_sales(store, "sales", roles, S.SALES_AS_OF, S.FILTERED_SALES_RULES, day_col=None)


def q_snapshot_days(spark, sf_dir):
    """A range read from a snapshot laid out by day."""
    store = _snapshot_store(spark)
    snapshot = store.get("sales", lambda: q_sales_extract(spark, sf_dir), "sales_date")
    rng = _range(SALES_RANGE)
    return ts_range(days(snapshot, rng.first_day, rng.final), "sales_date", rng)


# ----------------------------------------------------------------------- shipments

def q_shipments_extract(spark, sf_dir):
    r = S.shipment_roles(_tables(spark, sf_dir))
    return shipments_extract(r["header"], r["plants"], r["labels"], r["lines"], r["wms_items"],
                             r["eans"], r["serials"], r["item_master"], S.SALES_AS_OF,
                             S.SHIPMENT_RULES, label_key="customer_id")


def q_shipments_extract_filtered(spark, sf_dir):
    """The item master's company and department decide."""
    r = S.filtered_shipment_roles(_tables(spark, sf_dir))
    return shipments_extract(r["header"], r["plants"], r["labels"], r["lines"], r["wms_items"], r["eans"], r["serials"],
                             r["item_master"], S.SALES_AS_OF, S.FILTERED_SHIPMENT_RULES, label_key="customer_id")


def q_shipments_report(spark, sf_dir):
    return shipments_report(q_shipments_extract(spark, sf_dir), _range(SHIPMENTS_RANGE))


def q_shipments_report_json(spark, sf_dir):
    return to_json_lines(q_shipments_report(spark, sf_dir), SHIPMENT_FIELDS)


# --------------------------------------------------------------------------- stock

def _stock_extract(spark, sf_dir):
    r = S.stock_roles(_tables(spark, sf_dir))
    return stock_extract(r["positions"], r["branches"], r["items"], S.STOCK_RULES)


def q_stock_extract(spark, sf_dir):
    return _stock_extract(spark, sf_dir)


def _positions(spark, sf_dir):
    return S.branch_positions(_tables(spark, sf_dir))


def q_stock_latest_per_day(spark, sf_dir):
    return latest_stock(_positions(spark, sf_dir))


def q_stock_max_received(spark, sf_dir):
    return max_per_period(_positions(spark, sf_dir), PERIOD_KEYS, "received_date")


def q_stock_distinct_keys(spark, sf_dir):
    return _grid_keys(spark, sf_dir)


def _grid_keys(spark, sf_dir):
    """Distinct keys that have a latest position: those of rows with period keys and a load time."""
    rows = _positions(spark, sf_dir)
    for c in (*PERIOD_KEYS, "received_date"):
        rows = not_null(rows, c)
    return rows.select(*GRID_KEYS).distinct()


def q_stock_calendar(spark, sf_dir):
    return calendar_of(_tables(spark, sf_dir)["events"], "ts", months_back=1)


def q_join_cross_calendar(spark, sf_dir):
    start, end = calendar_bounds(S.STOCK_AS_OF)
    keys = _grid_keys(spark, sf_dir)
    return keys.select(*GRID_KEYS, F.explode(F.sequence(F.lit(start), F.lit(end))).alias("stock_date"))


def _gap_fill(spark, sf_dir, form=densify):
    start, end = calendar_bounds(S.STOCK_AS_OF)
    latest = latest_stock(_positions(spark, sf_dir))
    return form(latest, GRID_KEYS, "stock_date", start, end).select(*STOCK_COLUMNS)


def q_stock_gap_fill(spark, sf_dir):
    return _gap_fill(spark, sf_dir)


def q_stock_gap_fill_join(spark, sf_dir):
    """The grid as distinct keys x calendar, left-joined on five columns."""
    return _gap_fill(spark, sf_dir, densify_join)


def q_filter_not_null(spark, sf_dir):
    return not_null(_gap_fill(spark, sf_dir), "available")


def q_stock_forward_fill(spark, sf_dir):
    return forward_fill(_gap_fill(spark, sf_dir), FILL_KEYS, FILL_ORDER, "available")


def q_stock_forward_fill_fused(spark, sf_dir):
    start, end = calendar_bounds(S.STOCK_AS_OF)
    return fill_calendar(_positions(spark, sf_dir), FILL_KEYS, GRID_KEYS, "stock_date", "received_date", "available",
                         start, end).select(*STOCK_COLUMNS)


def q_stock_snapshot(spark, sf_dir):
    return stock_snapshot(_stock_extract(spark, sf_dir), S.STOCK_AS_OF, 1)


def q_stock_snapshot_companies(spark, sf_dir):
    """The snapshot with two companies behind every stock key."""
    t = _tables(spark, sf_dir)
    roles = S.stock_roles(t)
    positions = t["events"].selectExpr(
        "user_id as sku", "user_id % 10 as branch_id", "cast(ts as date) as stock_date", "ts as received_date",
        "value as available", "event_type as brand_group", "cast(event_id % 2 as string) as id_cia")
    extract = stock_extract(positions, roles["branches"], roles["items"],
                            replace(S.STOCK_RULES, company=None))
    return stock_snapshot(extract, S.STOCK_AS_OF, 1)


def q_stock_extract_filtered(spark, sf_dir):
    """Company and brand group decide; text days and quantities."""
    r = S.filtered_stock_roles(_tables(spark, sf_dir))
    return stock_extract(r["positions"], r["branches"], r["items"], S.FILTERED_STOCK_RULES, S.STOCK_AS_OF)


def q_stock_report_companies(spark, sf_dir):
    """Two companies behind a stock key, each with its own EAN: the report joins on item and company."""
    r = S.filtered_stock_roles(_tables(spark, sf_dir))
    rules = replace(S.FILTERED_STOCK_RULES, company=None, brand_group=None)
    extract = stock_extract(r["positions"], r["branches"], r["items"], rules, S.STOCK_AS_OF)
    items = item_master(r["companies"], "supplier_id", S.STANDIN_SUPPLIERS)
    return stock_report(stock_snapshot(extract, S.STOCK_AS_OF), items, _range(STOCK_RANGE))


def q_stock_forward_fill_ties(spark, sf_dir):
    """The literal chain where all positions of a day tie, some without a quantity."""
    start, end = calendar_bounds(S.STOCK_AS_OF)
    grid = densify(latest_stock(S.tied_positions(_tables(spark, sf_dir))), GRID_KEYS, "stock_date", start, end)
    return forward_fill(grid, FILL_KEYS, FILL_ORDER, "available").select(*STOCK_COLUMNS)


def q_stock_snapshot_ties(spark, sf_dir):
    """The snapshot of the same positions."""
    return stock_snapshot(S.tied_positions(_tables(spark, sf_dir)), S.STOCK_AS_OF)


def q_stock_report(spark, sf_dir):
    t = _tables(spark, sf_dir)
    snap = stock_snapshot(_stock_extract(spark, sf_dir), S.STOCK_AS_OF, 1)
    items = item_master(S.stock_items(t), "supplier_id", S.STANDIN_SUPPLIERS)
    return stock_report(snap, items, _range(STOCK_RANGE))


def q_stock_report_json(spark, sf_dir):
    return to_json_lines(q_stock_report(spark, sf_dir), STOCK_FIELDS)


def q_filter_day_range(spark, sf_dir):
    return day_range(_positions(spark, sf_dir), "stock_date", _range(STOCK_RANGE))


def q_stock_cast_available(spark, sf_dir):
    ev = _tables(spark, sf_dir)["events"]
    return ev.select("event_id", to_double(F.col("value").cast("string")).alias("available"),
                     to_double("props").alias("props_number"))


def q_stock_archive(spark, sf_dir):
    ev = _tables(spark, sf_dir)["events"]
    raw = ev.withColumn("partition_date", F.col("ts").cast("date"))
    target = unique_path(spark, "archive")
    archive_before(raw, "partition_date", S.STOCK_AS_OF, target)
    schema = T.StructType([*ev.schema.fields, T.StructField("partition_date", T.DateType())])
    return spark.read.schema(schema).parquet(target)


def q_sort_within_partitions(spark, sf_dir):
    """Hash repartition by the fill key, then sort inside each partition.

    Applied, as in the original, to the day grid, where a key holds at most one row per calendar day
    (plus ties), so no partition receives an unbounded group.
    """
    grid = _gap_fill(spark, sf_dir)
    return grid.repartition(*FILL_KEYS).sortWithinPartitions("sku", "stock_date", "brand_group", "cnpj")


def q_union_all(spark, sf_dir):
    pos = _positions(spark, sf_dir)
    early = pos.where(F.col("stock_date") < F.lit(UNION_SPLIT[0]))
    late = pos.where(F.col("stock_date") >= F.lit(UNION_SPLIT[1]))
    return early.unionByName(late)


# ------------------------------------------------------------------ single operators

def q_item_master(spark, sf_dir):
    return item_master(_tables(spark, sf_dir)["part"], "p_brand", S.STANDIN_SUPPLIERS)


def q_month_window_inclusive(spark, sf_dir):
    return month_window(_tables(spark, sf_dir)["orders"], "o_orderdate", S.SALES_AS_OF, 1, True)


def q_month_window_exclusive(spark, sf_dir):
    return month_window(_tables(spark, sf_dir)["orders"], "o_orderdate", S.SALES_AS_OF, 1, False)


def _month_partitions(spark, sf_dir):
    """``orders`` laid out by load month, as text."""
    orders = _tables(spark, sf_dir)["orders"]
    path = unique_path(spark, "months")
    write_month_partitions(orders, "o_orderdate", path)
    return read_month_partitions(spark, path, orders.schema)


def q_month_window_text_inclusive(spark, sf_dir):
    return month_window(_month_partitions(spark, sf_dir), "load_part", S.SALES_AS_OF, 7, True)


def q_month_window_text_exclusive(spark, sf_dir):
    return month_window(_month_partitions(spark, sf_dir), "load_part", S.SALES_AS_OF, 7, False)


def q_filter_in_list(spark, sf_dir):
    o = _tables(spark, sf_dir)["orders"]
    o = in_list(o, "o_orderstatus", ("F", "O"))
    return o.where(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"))


def q_filter_ts_range(spark, sf_dir):
    return ts_range(_tables(spark, sf_dir)["orders"], "o_orderdate", _range(SALES_RANGE))


def q_brand_sales(spark, sf_dir):
    o = _tables(spark, sf_dir)["orders"]
    code = F.substring("o_orderpriority", 1, 1)
    return o.where(code.isin("1", "2", "3")).select("o_orderkey", brand_sales(code).alias("brand"))


def q_brand_wms(spark, sf_dir):
    p = _tables(spark, sf_dir)["part"]
    return p.where(F.col("p_size").isin(1, 26, 29)).select("p_partkey", brand_wms("p_size").alias("brand"))


def q_date_format_day(spark, sf_dir):
    o = _tables(spark, sf_dir)["orders"]
    day = day_string("o_orderdate")
    return o.select("o_orderkey", day.alias("order_day"), from_day_string(day).alias("order_midnight"))


def q_join_left_null_rejected(spark, sf_dir):
    t = _tables(spark, sf_dir)
    li, p = t["lineitem"], t["part"]
    joined = li.join(p, li["l_partkey"] == p["p_partkey"], "left")
    return joined.where(F.col("p_brand").isin(*S.STANDIN_SUPPLIERS)).select("l_orderkey", "l_linenumber", "p_name")


def q_join_left_branch(spark, sf_dir):
    t = _tables(spark, sf_dir)
    branches = t["supplier"].select(F.col("s_suppkey").alias("branch_id"), F.col("s_name").alias("cnpj"))
    # there are more parts than suppliers, so many of these keys have no branch
    li = t["lineitem"].select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("branch_id"))
    return li.join(branches, "branch_id", "left").select("l_orderkey", "l_linenumber", "cnpj")


def q_join_composite_key(spark, sf_dir):
    t = _tables(spark, sf_dir)
    o = t["orders"].where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("k"))
    d = t["lineitem"].select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"),
                             F.col("l_linestatus").alias("s"), F.col("l_partkey").alias("sku"))
    ns = t["lineitem"].select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"),
                              F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("imei"))
    return o.join(d, "k").join(ns, ["k", "f", "s"]).select(
        F.col("k").alias("order_id"), "sku", "imei")


def q_csv_roundtrip(spark, sf_dir):
    sup = _tables(spark, sf_dir)["supplier"]
    path = unique_path(spark, "csv")
    write_csv(sup, path)
    return read_csv(spark, path, sup.schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sales_report": q_sales_report,
    "sales_extract": q_sales_extract,
    "sales_report_json": q_sales_report_json,
    "sales_extract_filtered": q_sales_extract_filtered,
    "sales_report_filtered": q_sales_report_filtered,
    "sales_report_eager": q_sales_report_eager,
    "snapshot_read": q_snapshot_read,
    "snapshot_refresh": q_snapshot_refresh,
    "snapshot_incremental": q_snapshot_incremental,
    "snapshot_days": q_snapshot_days,
    "shipments_report": q_shipments_report,
    "shipments_extract": q_shipments_extract,
    "shipments_report_json": q_shipments_report_json,
    "shipments_extract_filtered": q_shipments_extract_filtered,
    "stock_extract": q_stock_extract,
    "stock_extract_filtered": q_stock_extract_filtered,
    "stock_report_companies": q_stock_report_companies,
    "stock_forward_fill_ties": q_stock_forward_fill_ties,
    "stock_snapshot_ties": q_stock_snapshot_ties,
    "stock_latest_per_day": q_stock_latest_per_day,
    "stock_max_received": q_stock_max_received,
    "stock_distinct_keys": q_stock_distinct_keys,
    "stock_calendar": q_stock_calendar,
    "join_cross_calendar": q_join_cross_calendar,
    "stock_gap_fill": q_stock_gap_fill,
    "stock_gap_fill_join": q_stock_gap_fill_join,
    "filter_not_null": q_filter_not_null,
    "stock_forward_fill": q_stock_forward_fill,
    "stock_forward_fill_fused": q_stock_forward_fill_fused,
    "stock_snapshot": q_stock_snapshot,
    "stock_snapshot_companies": q_stock_snapshot_companies,
    "stock_report": q_stock_report,
    "stock_report_json": q_stock_report_json,
    "filter_day_range": q_filter_day_range,
    "stock_cast_available": q_stock_cast_available,
    "stock_archive": q_stock_archive,
    "sort_within_partitions": q_sort_within_partitions,
    "union_all": q_union_all,
    "item_master": q_item_master,
    "month_window_inclusive": q_month_window_inclusive,
    "month_window_exclusive": q_month_window_exclusive,
    "month_window_text_inclusive": q_month_window_text_inclusive,
    "month_window_text_exclusive": q_month_window_text_exclusive,
    "filter_in_list": q_filter_in_list,
    "filter_ts_range": q_filter_ts_range,
    "brand_sales": q_brand_sales,
    "brand_wms": q_brand_wms,
    "date_format_day": q_date_format_day,
    "join_left_null_rejected": q_join_left_null_rejected,
    "join_left_branch": q_join_left_branch,
    "join_composite_key": q_join_composite_key,
    "csv_roundtrip": q_csv_roundtrip,
}
