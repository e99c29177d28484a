from datetime import date, datetime

from pyspark.sql import functions as F

from mercato.params import DateRange
from mercato.plans.sales import REPORT_COLUMNS, SalesRules, sales_extract, sales_report
from mercato.sources.partitions import month_window

EXTRACT = "cnpj string, brand string, sales_date timestamp_ntz, ean string, sku string, uf_target string, quantity double"
RANGE = DateRange(date(2024, 3, 1), date(2024, 3, 15))


def ext(spark, rows):
    return spark.createDataFrame(rows, EXTRACT)


def test_one_row_passes_with_brand_name(spark):
    rows = [("c1", "3", datetime(2024, 3, 10, 8), "e", "s", "SP", 2.0)]
    out = sales_report(ext(spark, rows), RANGE)
    assert out.columns == list(REPORT_COLUMNS)
    assert out.first().brand == "SUBA"


def test_sum_of_equal_keys(spark):
    ts = datetime(2024, 3, 10, 8)
    rows = [("c1", "1", ts, "e", "s", "SP", 3.0), ("c1", "1", ts, "e", "s", "SP", 5.0)]
    out = sales_report(ext(spark, rows), RANGE).collect()
    assert [(r.brand, r.quantity) for r in out] == [("SHOP", 8.0)]


def test_group_is_on_full_timestamp(spark):
    rows = [("c1", "1", datetime(2024, 3, 10, 8), "e", "s", "SP", 3.0),
            ("c1", "1", datetime(2024, 3, 10, 9), "e", "s", "SP", 5.0)]
    assert sales_report(ext(spark, rows), RANGE).count() == 2


def test_range_bounds(spark):
    rows = [("c", "1", datetime(2024, 2, 29, 23, 59), "e", "a", "SP", 1.0),    # before
            ("c", "1", datetime(2024, 3, 1, 0, 0), "e", "b", "SP", 1.0),       # first instant
            ("c", "1", datetime(2024, 3, 15, 23, 59), "e", "c", "SP", 1.0),    # 23:59:00 kept
            ("c", "1", datetime(2024, 3, 15, 23, 59, 30), "e", "d", "SP", 1.0)]  # 23:59:30 out
    got = sorted(r.sku for r in sales_report(ext(spark, rows), RANGE).collect())
    assert got == ["b", "c"]
    half_open = DateRange(date(2024, 3, 1), date(2024, 3, 15), half_open=True)
    assert sorted(r.sku for r in sales_report(ext(spark, rows), half_open).collect()) == ["b", "c", "d"]


def test_null_keys_group_and_null_sum_is_zero(spark):
    ts = datetime(2024, 3, 10, 8)
    rows = [(None, "2", ts, "e", "s", None, None), (None, "2", ts, "e", "s", None, None),
            ("c", "2", ts, "e", "s", "SP", 4.0)]
    got = sorted((r.warehouse_cnpj or "", r.quantity) for r in sales_report(ext(spark, rows), RANGE).collect())
    assert got == [("", 0.0), ("c", 4.0)]


def _roles(spark):
    header = spark.createDataFrame(
        [(1, datetime(2024, 3, 5), "1", "A", "S", "LJ", "1", 10, "2024-03"),
         (2, datetime(2024, 3, 6), "2", "L", "S", "LJ", "1", 99, "2024-03"),    # unknown branch
         (3, datetime(2024, 3, 6), "5", "L", "S", "LJ", "1", 10, "2024-03"),    # brand not admitted
         (4, datetime(2024, 1, 6), "1", "L", "S", "LJ", "1", 10, "2024-01")],   # old load month
        "order_id long, sales_date timestamp_ntz, brand string, order_status string, approved string, "
        "origin string, company string, branch_id long, load_part string")
    party = spark.createDataFrame([(1, "E", "SP", "2024-03"), (1, "C", "RJ", "2024-03"), (2, "E", "MG", "2024-03"),
                                   (3, "E", "SP", "2024-03"), (4, "E", "SP", "2024-01")],
                                  "order_id long, party_type string, uf_target string, load_part string")
    line = spark.createDataFrame([(1, "i1", 2.0, "2024-03"), (1, "i9", 1.0, "2024-03"), (2, "i1", 3.0, "2024-03"),
                                  (3, "i1", 3.0, "2024-03"), (4, "i1", 3.0, "2024-01")],
                                 "order_id long, sku string, quantity double, load_part string")
    items = spark.createDataFrame([("i1", "789", "280273002938"), ("i9", "000", "other")],
                                  "item_id string, ean string, supplier_id string")
    branches = spark.createDataFrame([(10, "0001")], "branch_id long, cnpj string")
    return header, party, line, items, branches


def test_extract_filters_and_joins(spark):
    out = sales_extract(*_roles(spark), as_of=date(2024, 4, 2))
    got = sorted(((r.sku, r.cnpj, r.uf_target, r.quantity) for r in out.collect()), key=repr)
    # order 1: line i9 rejected by the supplier list; party 'C' rejected; order 2 keeps a NULL cnpj;
    # order 3 brand 5 rejected; order 4 outside the month window (limit 2024-03)
    assert got == sorted([("i1", None, "MG", 3.0), ("i1", "0001", "SP", 2.0)], key=repr)


def test_left_join_with_supplier_filter_becomes_inner(spark):
    out = sales_extract(*_roles(spark), as_of=date(2024, 4, 2))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan          # the branch join stays outer
    assert plan.count("LeftOuter") == 1  # the item join was turned into an inner join


def test_month_window_text_semantics(spark):
    df = spark.createDataFrame([("2024-02",), ("2024-03",), ("2024-03-01",), ("2024-04",)], "p string")
    as_of = date(2024, 4, 10)
    assert sorted(r.p for r in month_window(df, "p", as_of, 1, True).collect()) == ["2024-03", "2024-03-01", "2024-04"]
    # strict '>' drops the limit month for yyyy-MM but keeps yyyy-MM-dd values of that month
    assert sorted(r.p for r in month_window(df, "p", as_of, 1, False).collect()) == ["2024-03-01", "2024-04"]


def test_month_window_on_timestamp_is_pushed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(datetime(2024, 2, 28),), (datetime(2024, 3, 1),), (datetime(2024, 4, 1),)],
                          "ts timestamp_ntz").write.parquet(path)
    df = spark.read.parquet(path)
    inc = month_window(df, "ts", date(2024, 4, 30), 1, True)
    exc = month_window(df, "ts", date(2024, 4, 30), 1, False)
    assert inc.count() == 2 and exc.count() == 1
    assert "GreaterThanOrEqual(ts" in inc._jdf.queryExecution().executedPlan().toString()


def test_rules_switch_filters_off(spark):
    rules = SalesRules(statuses=None, brands=None, approved=None, origin=None, company=None,
                       party_type=None, suppliers=None, months_back=None)
    out = sales_extract(*_roles(spark), as_of=date(2024, 4, 2), rules=rules)
    assert out.where(F.col("sku") == "i9").count() == 2  # order 1 has two parties now
