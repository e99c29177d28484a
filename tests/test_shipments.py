from datetime import date, datetime

from mercato.params import DateRange
from mercato.plans.shipments import REPORT_COLUMNS, shipments_extract, shipments_report

EXTRACT = ("brand string, warehouse_cnpj string, warehouse_uf string, delivery_city string, delivery_uf string, "
           "sku string, ean string, imei string, dispatch_date timestamp_ntz, sales_date timestamp_ntz, "
           "nf_issuance timestamp_ntz, nf_id int, nf_serie string")
RANGE = DateRange(date(2024, 3, 1), date(2024, 3, 15))


def test_range_filter_and_fields(spark):
    rows = [("26", "w", "SP", "city", "RJ", "s", "e", "imei1", datetime(2024, 3, 2), datetime(2024, 3, 1, 9),
             datetime(2024, 3, 2), 7, "A"),
            ("1", "w", "SP", "city", "RJ", "s", "e", "imei2", datetime(2024, 2, 2), datetime(2024, 2, 1),
             datetime(2024, 2, 2), 8, "A")]
    out = shipments_report(spark.createDataFrame(rows, EXTRACT), RANGE)
    assert out.columns == list(REPORT_COLUMNS)
    got = out.collect()
    assert len(got) == 1
    r = got[0]
    assert (r.brand, r.imei, r.nf_id, r.delivery_uf, r.warehouse_uf) == ("ACOM", "imei1", 7, "RJ", "SP")


def test_empty_in_empty_out(spark):
    assert shipments_report(spark.createDataFrame([], EXTRACT), RANGE).count() == 0


def test_eight_table_join_multiplies_serials(spark):
    header = spark.createDataFrame(
        [(1, datetime(2024, 3, 2), "L", "1", datetime(2024, 3, 3), 5, "p", "w", "v", "2024-03")],
        "order_id long, sales_date timestamp_ntz, order_status string, brand string, dispatch_date timestamp_ntz, "
        "plant_id long, program_id string, wave_id string, prevol_id string, load_part string")
    plants = spark.createDataFrame([(5, "cnpj5", "SP")], "plant_id long, warehouse_cnpj string, warehouse_uf string")
    labels = spark.createDataFrame([(1, "city", "RJ", datetime(2024, 3, 3), 77, "S1", "2024-03")],
                                   "order_id long, delivery_city string, delivery_uf string, "
                                   "nf_issuance timestamp_ntz, nf_id int, nf_serie string, load_part string")
    lines = spark.createDataFrame([(1, 100, "2024-03"), (1, 101, "2024-03")],
                                  "order_id long, item_id long, load_part string")
    wms_items = spark.createDataFrame([(100, 1000, "sku100", "280273002938"), (101, 1001, "sku101", "280273002938")],
                                      "item_id long, sku_id long, sku string, supplier_id string")
    eans = spark.createDataFrame([(1000, "e100"), (1001, "e101")], "sku_id long, ean string")
    serials = spark.createDataFrame([("p", "w", "v", "imeiA", "2024-03"), ("p", "w", "v", "imeiB", "2024-03"),
                                     ("p", "w", "x", "imeiC", "2024-03")],
                                    "program_id string, wave_id string, prevol_id string, imei string, load_part string")
    item_master = spark.createDataFrame([("sku100", "1", "18"), ("sku101", "1", "18")],
                                        "item_id string, item_company string, department string")
    out = shipments_extract(header, plants, labels, lines, wms_items, eans, serials, item_master,
                            as_of=date(2024, 3, 20))
    got = sorted((r.sku, r.imei) for r in out.collect())
    # every serial of the volume pairs with every item of the order
    assert got == [("sku100", "imeiA"), ("sku100", "imeiB"), ("sku101", "imeiA"), ("sku101", "imeiB")]
    # the month limit is exclusive: as of April the limit month 2024-03 itself is dropped
    assert shipments_extract(header, plants, labels, lines, wms_items, eans, serials, item_master,
                             as_of=date(2024, 4, 5)).count() == 0
