"""The lake adapters and daily jobs, with temp views standing in for the catalog."""

from datetime import date, datetime

from mercato.params import validate_dates
from mercato.plans.jobs import archive_positions, lake_builders, refresh_snapshots
from mercato.plans.sales import sales_report
from mercato.plans.stock import stock_report
from mercato.session import unique_path
from mercato.sinks import SnapshotStore
from mercato.sources import lake

AS_OF = datetime(2024, 3, 20, 9, 0)
SUPPLIER = "280273002938"


def _views(spark):
    views = {
        "umbrella_pedido_de_venda_cabecalho": (
            [("100", datetime(2024, 3, 10, 8), "1", "A", "S", "LJ", "1", "7", "2024-03"),
             ("101", datetime(2024, 3, 10, 8), "2", "L", "S", "LJ", "1", "7", "2024-01")],
            "pedc_id_pedido string, pedc_dt_emissao timestamp_ntz, pedc_id_marca string, pedc_situacao string, "
            "pedc_in_aprovado string, pedc_id_origem string, pedc_id_cia string, pedc_id_filial string, "
            "data_inclusao_p string"),
        "umbrella_pedc_cliente": (
            [("100", "E", "SP", "2024-03"), ("101", "E", "RJ", "2024-01")],
            "pece_id_pedido string, pece_in_tipo string, pece_id_estado string, data_inclusao_p string"),
        "umbrella_pedido_de_venda_detalhes": (
            [("100", "0042", 3.0, "2024-03"), ("100", "0042", 5.0, "2024-03"), ("101", "0042", 1.0, "2024-01")],
            "pedd_id_pedido string, pedd_id_item string, pedd_qt_ped double, data_inclusao_p string"),
        "umbrella_item_geral": (
            [("0042", "7890001", SUPPLIER, "1", "18", "x")],
            "iteg_id string, iteg_ean string, iteg_id_fornec string, iteg_id_cia string, iteg_id_depto string, "
            "iteg_extra string"),
        "umbrella_filial": ([("7", "00123456000199")], "fili_id_filial string, fili_cgc string"),
        "umbrella_posicao_estoque": (
            [("0042", "7", "2024-03-18", datetime(2024, 3, 18, 6), "10", "1", "1"),
             ("0042", "7", "2024-03-18", datetime(2024, 3, 18, 9), "12", "1", "1"),
             ("0042", "7", "2024-03-19", datetime(2024, 3, 19, 9), "oops", "1", "1")],
            "id_item string, id_filial string, partition_date string, load_timestamp timestamp_ntz, "
            "qtde_disponivel string, id_agrup_valorizacao string, id_cia string"),
    }
    for name, (rows, schema) in views.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)


def test_lake_sales_report_through_snapshot(spark):
    _views(spark)
    builders = lake_builders(spark, AS_OF, umbrella=None, wms=None)
    store = SnapshotStore(spark, unique_path(spark, "lake-snap"))
    snaps = refresh_snapshots(store, builders, names=("sales",))
    rng = validate_dates("2024-03-01", "2024-03-15", as_of=AS_OF)
    got = sales_report(snaps["sales"], rng).collect()
    # order 101 sits in an old load month (limit 2024-02 as of March): excluded
    assert [(r.warehouse_cnpj, r.brand, r.sku, r.ean, r.uf_target, r.quantity) for r in got] == [
        ("00123456000199", "SHOP", "0042", "7890001", "SP", 8.0)]


def test_lake_stock_report(spark):
    _views(spark)
    builders = lake_builders(spark, datetime(2024, 3, 20), umbrella=None, wms=None)
    snap = builders["stock"]()
    items = builders["items"]()
    assert "iteg_extra" in items.columns  # select *: every item column kept
    report_items = lake.read_role(spark, None, lake.ITEM_MASTER, False)
    rng = validate_dates("2024-03-18", "2024-03-20", as_of=datetime(2024, 3, 20))
    got = sorted((r.stock_date, r.available_stock) for r in stock_report(snap, report_items, rng).collect())
    # 18th: latest load (12); 19th: text quantity -> NULL -> carried 12; 20th: gap day carried
    assert got == [(date(2024, 3, 18), 12.0), (date(2024, 3, 19), 12.0), (date(2024, 3, 20), 12.0)]


def test_archive_job(spark):
    _views(spark)
    target = unique_path(spark, "lake-archive")
    archive_positions(lake.raw_positions(spark, None), date(2024, 3, 19), target)
    back = spark.read.parquet(target)
    assert back.count() == 2
    assert {str(r.partition_date) for r in back.select("partition_date").distinct().collect()} == {"2024-03-18"}


def _wms_views(spark):
    views = {
        "wms_pedido_cab": (
            [("P1", "26", datetime(2024, 3, 12), datetime(2024, 3, 10, 8), "PL1", "g", "o", "v", "L", "2024-03"),
             ("P2", "26", datetime(2024, 3, 12), datetime(2024, 3, 10, 8), "PL1", "g", "o", "w", "A", "2024-03")],
            "pedv_id_ped string, pedv_id_unineg string, pedv_dt_situacao timestamp_ntz, pedv_dt_emissao timestamp_ntz, "
            "pedv_id_planta string, pedv_id_programa string, pedv_id_onda string, pedv_id_prevol string, "
            "pedv_situacao string, pedv_dt_registro_p string"),
        "wms_planta": ([("PL1", "00999", "SP")], "plta_id_planta string, plta_id_terceiro string, plta_id_estado string"),
        "wms_pedido_cab_etic": (
            [("P1", "Campinas", "SP", datetime(2024, 3, 11), 501, "1", "2024-03"),
             ("P2", "Campinas", "SP", datetime(2024, 3, 11), 502, "1", "2024-03")],
            "pcae_id_ped string, pcae_muni_nome string, pcae_id_estado string, pcae_data_faturamento timestamp_ntz, "
            "pcae_num_nota int, pcae_serie string, pcae_datahora_p string"),
        "wms_pedido_det": ([("P1", "W1", "2024-03"), ("P2", "W1", "2024-03")],
                           "pedd_id_ped string, pedd_id_item string, pedv_dt_registro_p string"),
        "wms_item": ([("W1", "K1", "0042", SUPPLIER)],
                     "item_id_item string, item_id_sku string, item_cod_terceiro string, item_id_fornec string"),
        "wms_ean": ([("K1", "7890001"), ("K1", "7890002")], "ean_id_sku string, ean_id_ean string"),
        "wms_numero_serie": ([("g", "o", "v", "IMEI-1", "2024-03"), ("g", "o", "w", "IMEI-2", "2024-03")],
                             "nuse_id_programa string, nuse_id_onda string, nuse_id_prevol string, "
                             "nuse_nu_serie string, volu_dt_registro_p string"),
    }
    for name, (rows, schema) in views.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)


def test_lake_shipments_report(spark):
    from mercato.plans.shipments import shipments_report

    _views(spark)
    _wms_views(spark)
    builders = lake_builders(spark, AS_OF, umbrella=None, wms=None)
    rng = validate_dates("2024-03-01", "2024-03-15", as_of=AS_OF)
    got = sorted((r.brand, r.imei, r.ean, r.nf_id, r.sku, r.warehouse_cnpj, r.delivery_city)
                 for r in shipments_report(builders["shipments"](), rng).collect())
    # order P2 is not dispatched ('A'); P1 pairs its serial with both EANs of the item
    assert got == [("ACOM", "IMEI-1", "7890001", 501, "0042", "00999", "Campinas"),
                   ("ACOM", "IMEI-1", "7890002", 501, "0042", "00999", "Campinas")]


def test_lake_stock_without_company_filter_uses_exact_fill(spark):
    from mercato.plans.stock import StockRules

    _views(spark)
    # a second company for the same sku/branch/brand group: the literal fill must be used
    spark.createDataFrame(
        [("0042", "7", "2024-03-18", datetime(2024, 3, 18, 9), "12", "1", "1"),
         ("0042", "7", "2024-03-19", datetime(2024, 3, 19, 9), "20", "1", "2")],
        "id_item string, id_filial string, partition_date string, load_timestamp timestamp_ntz, "
        "qtde_disponivel string, id_agrup_valorizacao string, id_cia string").createOrReplaceTempView(
        "umbrella_posicao_estoque")
    rules = StockRules(company=None)
    snap = lake_builders(spark, datetime(2024, 3, 20), stock_rules=rules, umbrella=None, wms=None)["stock"]()
    got = sorted((str(r.stock_date), r.id_cia, r.available) for r in snap.collect())
    # the fill key (sku, brand group, cnpj) spans both companies; inside a day company 1 sorts first:
    # 18th: 12 (own), company 2 carries 12; 19th: company 1 carries 12, company 2 has 20; 20th: both 20
    assert got == [("2024-03-18", "1", 12.0), ("2024-03-18", "2", 12.0), ("2024-03-19", "1", 12.0),
                   ("2024-03-19", "2", 20.0), ("2024-03-20", "1", 20.0), ("2024-03-20", "2", 20.0)]


def test_lake_party_join_reuses_the_order_partitioning(spark):
    import re

    _views(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        extract = lake_builders(spark, AS_OF, umbrella=None, wms=None)["sales"]()
        plan = extract._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    by_order = re.findall(r"Exchange hashpartitioning\((order_id#\d+), ", plan)
    # header, lines and party are each shuffled once by order id; the joined stream is not re-shuffled
    assert len(by_order) == 3


def test_report_service_requests(spark):
    import pytest

    from mercato.plans.service import ReportService

    _views(spark)
    _wms_views(spark)
    svc = ReportService(spark, as_of=AS_OF, store=SnapshotStore(spark, unique_path(spark, "svc")),
                        umbrella=None, wms=None)
    with pytest.raises(ValueError, match="initialDate was not informed"):
        svc.sales(None, "2024-03-15")
    with pytest.raises(ValueError, match="older than 1 month"):
        svc.stock("2024-01-01", "2024-03-15")
    assert [r.quantity for r in svc.sales("2024-03-01", "2024-03-15").collect()] == [8.0]
    assert svc.shipments("2024-03-01", "2024-03-15").count() == 2
    stock = sorted((str(r.stock_date), r.available_stock) for r in svc.stock("2024-03-18", "2024-03-20").collect())
    assert stock == [("2024-03-18", 12.0), ("2024-03-19", 12.0), ("2024-03-20", 12.0)]
    text = svc.sales("2024-03-01", "2024-03-15", json=True).first().json
    assert text.startswith('{"warehouseCnpj":"00123456000199","ufTarget":"SP","brand":"SHOP","salesDate":"2024-03-10"')
    refreshed = svc.refresh()
    assert set(refreshed) == {"items", "sales", "stock", "shipments"}


def test_service_takes_the_moment_per_call(spark):
    from mercato.plans.service import ReportService

    _views(spark)
    svc = ReportService(spark, store=SnapshotStore(spark, unique_path(spark, "moments")), umbrella=None, wms=None)
    assert [r.quantity for r in svc.sales("2024-03-01", "2024-03-15", as_of=AS_OF).collect()] == [8.0]
    import pytest
    with pytest.raises(ValueError, match="older than 1 month"):
        svc.sales("2024-03-01", "2024-03-15")                       # by the clock of the call
    svc.refresh(["sales"], as_of=datetime(2024, 8, 1))             # no load month of March is in that window
    assert svc.sales("2024-03-01", "2024-03-15", as_of=AS_OF).count() == 0


def test_service_items_months_back_half_open_and_incremental(spark):
    from mercato.plans.service import ReportService

    _views(spark)
    svc = ReportService(spark, as_of=AS_OF, store=SnapshotStore(spark, unique_path(spark, "wide"), keep=2), umbrella=None,
                        wms=None, months_back=4, half_open=True, incremental=True)
    items = svc.items()
    assert "iteg_extra" in items.columns and items.count() == 1
    assert svc.items(json=True).first().json.startswith('{"iteg_id":"0042"')
    both = sorted((r.brand, r.quantity) for r in svc.sales("2024-03-01", "2024-03-15").collect())
    assert both == [("ACOM", 1.0), ("SHOP", 8.0)]                   # order 101, loaded in January, is within four months
    refreshed = svc.refresh(["sales"])["sales"]
    assert refreshed.count() == 3 and svc.store.record("sales")["source"]["built"] == ["2024-01", "2024-03"]
    version = svc.store.record("sales")["version"]
    svc.refresh(["sales"])
    assert svc.store.record("sales")["version"] == version          # nothing changed
    assert sorted((r.brand, r.quantity) for r in svc.sales("2024-03-01", "2024-03-15").collect()) == both


def test_report_requests_read_the_days_of_their_range(spark):
    from mercato.plans.service import ReportService

    _views(spark)
    svc = ReportService(spark, as_of=AS_OF, store=SnapshotStore(spark, unique_path(spark, "pruned")), umbrella=None, wms=None)
    plan = svc.stock("2024-03-18", "2024-03-19")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_day" in plan and "2024-03-18" in plan
    plan = svc.sales("2024-03-01", "2024-03-15")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_day" in plan


def test_refresh_makes_files_added_behind_the_catalog_visible(spark):
    """A file table of Spark's own catalog keeps its listing; only the refreshed read sees new files."""
    spec = ("listing_test", {"order_id": "order_id"})
    path = unique_path(spark, "listing")
    spark.range(3).selectExpr("id as order_id").write.parquet(path)
    spark.sql("drop table if exists listing_test")
    spark.sql(f"create table listing_test (order_id long) using parquet location '{path}'")
    try:
        assert lake.read_role(spark, None, spec, False).count() == 3
        spark.range(4).selectExpr("id + 10 as order_id").write.parquet(f"{path}.more")
        from_files, to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.more"), spark._jvm.org.apache.hadoop.fs.Path(path)
        files = to.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in files.listStatus(from_files):                      # moved by the file system: Spark is not told
            if f.getPath().getName().startswith("part-"):
                files.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(to, f.getPath().getName()))
        assert lake.read_role(spark, None, spec, False).count() == 3
        assert lake.read_role(spark, None, spec, True).count() == 7
    finally:
        spark.sql("drop table listing_test")


def test_malformed_text_day_fails_no_job(spark):
    _views(spark)
    spark.createDataFrame(
        [("0042", "7", "2024-03-18", datetime(2024, 3, 18, 9), "12", "1", "1"),
         ("0042", "7", "2024-03-1x", datetime(2024, 3, 18, 9), "13", "1", "1"),
         ("0042", "7", "unknown", datetime(2024, 3, 19, 9), "20", "1", "1")],
        "id_item string, id_filial string, partition_date string, load_timestamp timestamp_ntz, "
        "qtde_disponivel string, id_agrup_valorizacao string, id_cia string").createOrReplaceTempView(
        "umbrella_posicao_estoque")
    snap = lake_builders(spark, datetime(2024, 3, 20), umbrella=None, wms=None)["stock"]()
    assert sorted((str(r.stock_date), r.available) for r in snap.collect()) == [
        ("2024-03-18", 12.0), ("2024-03-19", 12.0), ("2024-03-20", 12.0)]
