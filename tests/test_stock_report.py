from datetime import date, datetime

from mercato.params import DateRange
from mercato.plans.stock import REPORT_COLUMNS, StockRules, stock_extract, stock_report

SNAP = ("sku string, cnpj string, stock_date date, received_date timestamp_ntz, available double, "
        "brand_group string, id_cia string")


def test_ean_from_item_and_range(spark):
    snap = spark.createDataFrame([("1", "c", date(2024, 1, 10), None, 30.0, "1", "1"),
                                  ("1", "c", date(2024, 1, 5), None, 30.0, "1", "1"),
                                  ("1", "c", date(2024, 1, 11), None, None, "1", "1"),
                                  ("2", "c", date(2024, 1, 10), None, 9.0, "1", "2")], SNAP)
    items = spark.createDataFrame([("1", "1234", "1"), ("2", "999", "1")], "item_id string, ean string, item_company string")
    out = stock_report(snap, items, DateRange(date(2024, 1, 8), date(2024, 1, 12)))
    assert out.columns == list(REPORT_COLUMNS)
    got = out.collect()
    # only the in-range, non-NULL row whose (sku, company) matches an item
    assert [(r.sku, r.ean, r.stock_date, r.available_stock) for r in got] == [("1", "1234", date(2024, 1, 10), 30.0)]


def test_extract_reads_text_quantity_leniently(spark):
    positions = spark.createDataFrame(
        [("1", 10, date(2024, 1, 10), datetime(2024, 1, 10, 5), "12.5", "1", "1"),
         ("1", 10, date(2024, 1, 11), datetime(2024, 1, 11, 5), "n/a", "1", "1"),
         ("1", 10, date(2024, 1, 11), datetime(2024, 1, 11, 5), "1", "2", "1"),   # other brand group
         ("2", 10, date(2024, 1, 11), datetime(2024, 1, 11, 5), "3", "1", "1")],  # item not allowed
        "sku string, branch_id long, stock_date date, received_date timestamp_ntz, available string, "
        "brand_group string, id_cia string")
    branches = spark.createDataFrame([(10, "0001")], "branch_id long, cnpj string")
    items = spark.createDataFrame([("1", "280273002938"), ("2", "x")], "item_id string, supplier_id string")
    got = sorted((r.stock_date, r.available) for r in stock_extract(positions, branches, items, StockRules()).collect())
    assert got == [(date(2024, 1, 10), 12.5), (date(2024, 1, 11), None)]
