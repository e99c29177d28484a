"""DuckDB SQL computing the same rows as each registered query.

Written directly against the test tables (views ``orders``, ``lineitem`` ...)
so the Spark plans are checked against an independent formulation.
"""

from __future__ import annotations

_BRANDS = "('Brand#1','Brand#2','Brand#3','Brand#4')"

_SALES_EXTRACT = f"""
select o.o_orderdate as sales_date, substr(o.o_orderpriority, 1, 1) as brand, l.l_partkey as sku,
       s.s_name as cnpj, n.n_name as uf_target, p.p_name as ean, l.l_quantity as quantity
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
join lineitem l on o.o_orderkey = l.l_orderkey
left join part p on p.p_partkey = l.l_partkey
left join supplier s on s.s_suppkey = l.l_suppkey
where o.o_orderstatus in ('F', 'O') and substr(o.o_orderpriority, 1, 1) in ('1', '2', '3')
  and p.p_brand in {_BRANDS}
  and o.o_orderdate >= timestamp '2001-01-01 00:00:00'
"""

_SALES_REPORT = f"""
select cnpj as warehouse_cnpj, uf_target,
       case brand when '1' then 'SHOP' when '2' then 'ACOM' when '3' then 'SUBA' when '7' then 'SOUB' end as brand,
       sales_date, ean, sku, coalesce(sum(quantity), 0.0) as quantity
from ({_SALES_EXTRACT}) x
where sales_date >= timestamp '1900-01-01 00:00:00' and sales_date >= timestamp '2001-01-01 00:00:00'
  and sales_date <= timestamp '2001-07-31 23:59:00'
group by cnpj, brand, sales_date, ean, sku, uf_target
"""

_SHIPMENTS_EXTRACT = f"""
select cast(p.p_size as varchar) as brand, s.s_name as warehouse_cnpj, sn.n_name as warehouse_uf,
       c.c_name as delivery_city, cn.n_name as delivery_uf, p.p_partkey as sku, pe.p_name as ean,
       ns.l_linenumber as imei, d.l_shipdate as dispatch_date, o.o_orderdate as sales_date,
       o.o_orderdate as nf_issuance, o.o_orderkey as nf_id, o.o_orderpriority as nf_serie
from orders o
join lineitem d on o.o_orderkey = d.l_orderkey
join part p on d.l_partkey = p.p_partkey
join part pe on pe.p_partkey = p.p_partkey
join supplier s on d.l_suppkey = s.s_suppkey
join nation sn on s.s_nationkey = sn.n_nationkey
join customer c on o.o_custkey = c.c_custkey
join nation cn on c.c_nationkey = cn.n_nationkey
join lineitem ns on ns.l_orderkey = d.l_orderkey and ns.l_returnflag = d.l_returnflag
                and ns.l_linestatus = d.l_linestatus
join part im on im.p_partkey = p.p_partkey
where o.o_orderstatus = 'F' and p.p_brand in {_BRANDS}
  and cast(p.p_size as varchar) in ('1', '29', '26')
  and o.o_orderdate >= timestamp '1995-01-01 00:00:00'
"""

_SHIPMENTS_REPORT = f"""
select warehouse_cnpj, warehouse_uf,
       case brand when '1' then 'SHOP' when '26' then 'ACOM' when '29' then 'SUBA' end as brand,
       nf_issuance, sales_date, dispatch_date, nf_id, nf_serie, delivery_city, delivery_uf, ean, sku, imei
from ({_SHIPMENTS_EXTRACT}) x
where sales_date >= timestamp '1900-01-01 00:00:00' and sales_date >= timestamp '1995-01-01 00:00:00'
  and sales_date <= timestamp '2001-07-31 23:59:00'
"""

_STOCK_EXTRACT = f"""
select e.user_id as sku, s.s_name as cnpj, cast(e.ts as date) as stock_date, e.ts as received_date,
       try_cast(e.value as double) as available, e.event_type as brand_group, '1' as id_cia
from events e
join supplier s on s.s_suppkey = e.user_id % 10
join part p on p.p_partkey = e.user_id and p.p_brand in {_BRANDS}
"""

_POSITIONS = """
select e.user_id as sku, s.s_name as cnpj, cast(e.ts as date) as stock_date, e.ts as received_date,
       e.value as available, e.event_type as brand_group, '1' as id_cia
from events e join supplier s on s.s_suppkey = e.user_id % 10
"""

_DAYS = """
select cast(range as date) as stock_date
from range(date '2023-12-31', date '2024-01-31', interval 1 day)
"""


def _latest(src: str) -> str:
    return f"""
select b.cnpj, b.brand_group, b.sku, b.stock_date, b.received_date, b.available, b.id_cia
from ({src}) b
join (select cnpj, brand_group, sku, stock_date, max(received_date) as m
      from ({src}) z group by cnpj, brand_group, sku, stock_date) g
  on b.cnpj = g.cnpj and b.brand_group = g.brand_group and b.sku = g.sku
 and b.stock_date = g.stock_date and b.received_date = g.m
"""


def _grid(latest: str) -> str:
    return f"""
select k.sku, k.cnpj, d.stock_date, l.received_date, l.available, k.brand_group, k.id_cia
from (select distinct sku, brand_group, cnpj, id_cia from ({latest}) q) k
cross join ({_DAYS}) d
left join ({latest}) l
  on l.sku = k.sku and l.brand_group = k.brand_group and l.cnpj = k.cnpj and l.id_cia = k.id_cia
 and l.stock_date = d.stock_date
"""


def _fill(grid: str) -> str:
    return f"""
select sku, cnpj, stock_date, received_date, available, brand_group, id_cia from (
  select sku, cnpj, stock_date, received_date, brand_group, id_cia,
         last_value(case when available is not null and not isnan(available) then available end ignore nulls)
           over (partition by sku, brand_group, cnpj
                 order by stock_date asc nulls first, id_cia asc nulls first,
                          received_date asc nulls first, available asc nulls first
                 rows between unbounded preceding and current row) as available
  from ({grid}) g) f
where available is not null
"""


_LATEST_POS = _latest(_POSITIONS)
_GRID_POS = _grid(_LATEST_POS)
_SNAPSHOT = _fill(_grid(_latest(
    f"select * from ({_STOCK_EXTRACT}) x where stock_date between date '2023-12-31' and date '2024-01-30'")))

_STOCK_EXTRACT_COMPANIES = _STOCK_EXTRACT.replace("'1' as id_cia", "cast(e.event_id % 2 as varchar) as id_cia")
_SNAPSHOT_COMPANIES = _fill(_grid(_latest(
    f"select * from ({_STOCK_EXTRACT_COMPANIES}) x where stock_date between date '2023-12-31' and date '2024-01-30'")))

_STOCK_REPORT = f"""
select s.cnpj as warehouse_cnpj, s.brand_group, s.stock_date, p.p_name as ean, s.sku,
       s.available as available_stock
from ({_SNAPSHOT}) s
join (select * from part where p_brand in {_BRANDS}) p on s.sku = p.p_partkey and s.id_cia = '1'
where s.stock_date >= date '1900-01-01' and s.stock_date >= date '2024-01-10'
  and s.stock_date <= date '2024-01-20' and s.available is not null
"""

_SALES_EXTRACT_FILTERED = f"""
select o.o_orderdate as sales_date, substr(o.o_orderpriority, 1, 1) as brand, l.l_partkey as sku,
       s.s_name as cnpj, e.uf_target, p.p_name as ean, l.l_quantity as quantity
from orders o
join (select o_orderkey as k, n_name as uf_target from orders join customer on c_custkey = o_custkey
      join nation on n_nationkey = c_nationkey
      union all
      select l_orderkey, n_name from lineitem join supplier on s_suppkey = l_suppkey
      join nation on n_nationkey = s_nationkey where l_returnflag = 'R') e on e.k = o.o_orderkey
join lineitem l on o.o_orderkey = l.l_orderkey
join part p on p.p_partkey = l.l_partkey
left join supplier s on s.s_suppkey = l.l_suppkey
where o.o_orderstatus in ('F', 'O') and substr(o.o_orderpriority, 1, 1) in ('1', '2', '3')
  and o.o_totalprice >= 100000 and o.o_custkey % 2 = 0 and o.o_orderkey % 3 <> 0
  and p.p_brand in {_BRANDS} and strftime(o.o_orderdate, '%Y-%m') >= '1998-04'
"""

_SALES_REPORT_FILTERED = f"""
select cnpj as warehouse_cnpj, uf_target,
       case brand when '1' then 'SHOP' when '2' then 'ACOM' when '3' then 'SUBA' end as brand,
       sales_date, ean, sku, coalesce(sum(quantity), 0.0) as quantity
from ({_SALES_EXTRACT_FILTERED}) x
where sales_date >= timestamp '1999-01-01 00:00:00' and sales_date <= timestamp '2001-06-30 23:59:00'
group by cnpj, brand, sales_date, ean, sku, uf_target
"""

_STOCK_EXTRACT_BOTH = f"""
select e.user_id as sku, s.s_name as cnpj, cast(e.ts as date) as stock_date, e.ts as received_date,
       try_cast(e.value as double) as available, e.event_type as brand_group,
       cast(1 + e.event_id % 2 as varchar) as id_cia
from events e
join supplier s on s.s_suppkey = e.user_id
join part p on p.p_partkey = e.user_id and p.p_brand in {_BRANDS}
where cast(e.ts as date) between date '2023-12-31' and date '2024-01-30'
"""

_TIED_POSITIONS = """
select e.user_id as sku, s.s_name as cnpj, cast(e.ts as date) as stock_date,
       cast(cast(e.ts as date) as timestamp) as received_date,
       case when e.event_id % 5 = 0 then null when e.event_id % 7 = 0 then cast('nan' as double) else e.value end as available,
       e.event_type as brand_group, cast(e.event_id % 2 as varchar) as id_cia
from events e join supplier s on s.s_suppkey = e.user_id % 10
"""

ORACLES: dict[str, str] = {
    "sales_extract_filtered": _SALES_EXTRACT_FILTERED,
    "sales_report_filtered": _SALES_REPORT_FILTERED,
    "sales_report_eager": _SALES_REPORT_FILTERED,
    "snapshot_incremental": _SALES_EXTRACT_FILTERED,
    "snapshot_days": f"""
select * from ({_SALES_EXTRACT}) x
where sales_date >= timestamp '2001-01-01 00:00:00' and sales_date <= timestamp '2001-07-31 23:59:00'
""",
    "shipments_extract_filtered": _SHIPMENTS_EXTRACT.replace(
        "join part im on im.p_partkey = p.p_partkey", "join part im on im.p_partkey = p.p_partkey and im.p_partkey % 3 <> 0").replace(
        "o.o_orderdate >= timestamp '1995-01-01 00:00:00'", "strftime(o.o_orderdate, '%Y-%m') > '1994-12'"),
    "stock_extract_filtered": f"select * from ({_STOCK_EXTRACT_BOTH}) x where id_cia = '1' and brand_group = 'click'",
    "stock_report_companies": f"""
select s.cnpj as warehouse_cnpj, s.brand_group, s.stock_date,
       case when s.id_cia = '1' then p.p_name else p.p_name || ' (2)' end as ean, s.sku, s.available as available_stock
from ({_fill(_grid(_latest(_STOCK_EXTRACT_BOTH)))}) s
join part p on p.p_partkey = s.sku and p.p_brand in {_BRANDS} and (s.id_cia = '1' or p.p_partkey % 2 = 0)
where s.stock_date between date '2024-01-10' and date '2024-01-20'
""",
    "stock_forward_fill_ties": _fill(_grid(_latest(_TIED_POSITIONS))),
    "stock_snapshot_ties": _fill(_grid(_latest(_TIED_POSITIONS))),
    "month_window_text_inclusive":
        "select *, strftime(o_orderdate, '%Y-%m') as load_part from orders where strftime(o_orderdate, '%Y-%m') >= '2001-01'",
    "month_window_text_exclusive":
        "select *, strftime(o_orderdate, '%Y-%m') as load_part from orders where strftime(o_orderdate, '%Y-%m') > '2001-01'",
    "sales_report": _SALES_REPORT,
    "sales_extract": _SALES_EXTRACT,
    "sales_report_json": f"""
select cast(json_object('warehouseCnpj', warehouse_cnpj, 'ufTarget', uf_target, 'brand', brand,
                           'salesDate', strftime(sales_date, '%Y-%m-%d'), 'ean', ean, 'sku', sku,
                           'quantity', quantity) as varchar) as json
from ({_SALES_REPORT}) r
""",
    "snapshot_read": _SALES_EXTRACT,
    "snapshot_refresh": _SALES_EXTRACT,
    "shipments_report": _SHIPMENTS_REPORT,
    "shipments_extract": _SHIPMENTS_EXTRACT,
    "stock_extract": _STOCK_EXTRACT,
    "stock_latest_per_day": _LATEST_POS,
    "stock_max_received": f"""
select cnpj, brand_group, sku, stock_date, max(received_date) as received_date
from ({_POSITIONS}) p group by cnpj, brand_group, sku, stock_date
""",
    "stock_distinct_keys": f"select distinct sku, brand_group, cnpj, id_cia from ({_LATEST_POS}) l",
    "stock_calendar": """
select cast(unnest(generate_series(m - interval 30 day, m, interval 1 day)) as date) as stock_date
from (select max(cast(ts as date)) as m from events) x
""",
    "join_cross_calendar": f"""
select k.sku, k.brand_group, k.cnpj, k.id_cia, d.stock_date
from (select distinct sku, brand_group, cnpj, id_cia from ({_LATEST_POS}) l) k cross join ({_DAYS}) d
""",
    "stock_gap_fill": _GRID_POS,
    "stock_gap_fill_join": _GRID_POS,
    "filter_not_null": f"select * from ({_GRID_POS}) g where available is not null",
    "stock_forward_fill": _fill(_GRID_POS),
    "stock_forward_fill_fused": _fill(_GRID_POS),
    "stock_snapshot": _SNAPSHOT,
    "stock_snapshot_companies": _SNAPSHOT_COMPANIES,
    "stock_report": _STOCK_REPORT,
    "stock_report_json": f"""
select cast(json_object('warehouseCnpj', warehouse_cnpj, 'brandGroup', brand_group,
                           'stockDate', strftime(stock_date, '%Y-%m-%d'), 'ean', ean, 'sku', sku,
                           'availableStock', available_stock) as varchar) as json
from ({_STOCK_REPORT}) r
""",
    "shipments_report_json": f"""
select cast(json_object('warehouseCnpj', warehouse_cnpj, 'warehouseUF', warehouse_uf, 'brand', brand,
                           'nfIssuance', strftime(nf_issuance, '%Y-%m-%d'),
                           'salesDate', strftime(sales_date, '%Y-%m-%d'),
                           'dispatchDate', strftime(dispatch_date, '%Y-%m-%d'),
                           'nfId', nf_id, 'nfSerie', nf_serie, 'deliveryCity', delivery_city,
                           'deliveryUF', delivery_uf, 'ean', ean, 'sku', sku, 'IMEI', imei) as varchar) as json
from ({_SHIPMENTS_REPORT}) r
""",
    "filter_day_range": f"""
select * from ({_POSITIONS}) p
where stock_date >= date '1900-01-01' and stock_date between date '2024-01-10' and date '2024-01-20'
""",
    "stock_cast_available": """
select event_id, try_cast(cast(value as varchar) as double) as available,
       try_cast(props as double) as props_number
from events
""",
    "stock_archive": "select *, cast(ts as date) as partition_date from events where cast(ts as date) < date '2024-01-30'",
    "sort_within_partitions": _GRID_POS,
    "union_all": f"""
select * from ({_POSITIONS}) a where stock_date < date '2024-01-15'
union all
select * from ({_POSITIONS}) b where stock_date >= date '2024-01-10'
""",
    "item_master": f"select * from part where p_brand in {_BRANDS}",
    "month_window_inclusive": "select * from orders where o_orderdate >= timestamp '2001-07-01 00:00:00'",
    "month_window_exclusive": "select * from orders where o_orderdate >= timestamp '2001-08-01 00:00:00'",
    "filter_in_list": """
select * from orders where o_orderstatus in ('F', 'O') and substr(o_orderpriority, 1, 1) in ('1', '2', '3')
""",
    "filter_ts_range": """
select * from orders
where o_orderdate >= timestamp '2001-01-01 00:00:00' and o_orderdate <= timestamp '2001-07-31 23:59:00'
""",
    "brand_sales": """
select o_orderkey,
       case substr(o_orderpriority, 1, 1) when '1' then 'SHOP' when '2' then 'ACOM' when '3' then 'SUBA'
                                          when '7' then 'SOUB' end as brand
from orders where substr(o_orderpriority, 1, 1) in ('1', '2', '3')
""",
    "brand_wms": """
select p_partkey, case cast(p_size as varchar) when '1' then 'SHOP' when '26' then 'ACOM'
                                               when '29' then 'SUBA' end as brand
from part where p_size in (1, 26, 29)
""",
    "date_format_day": """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as order_day,
       cast(cast(o_orderdate as date) as timestamp) as order_midnight
from orders
""",
    "join_left_null_rejected": f"""
select l.l_orderkey, l.l_linenumber, p.p_name
from lineitem l left join part p on l.l_partkey = p.p_partkey
where p.p_brand in {_BRANDS}
""",
    "join_left_branch": """
select l_orderkey, l_linenumber, s_name as cnpj from lineitem left join supplier on s_suppkey = l_partkey
""",
    "join_composite_key": """
select d.l_orderkey as order_id, d.l_partkey as sku, ns.l_linenumber as imei
from orders o
join lineitem d on o.o_orderkey = d.l_orderkey
join lineitem ns on ns.l_orderkey = d.l_orderkey and ns.l_returnflag = d.l_returnflag
                and ns.l_linestatus = d.l_linestatus
where o.o_orderstatus = 'F'
""",
    "csv_roundtrip": "select * from supplier",
}
