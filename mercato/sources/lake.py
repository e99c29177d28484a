"""Adapters from the original retail lake (Hive catalog) to the report roles.

Each function reads the catalog tables the reports were written for and
renames their columns to the role columns of ``mercato.plans``.  Reads go
through ``spark.table`` so partition pruning on the load-date partitions and
Parquet pushdown apply.  Before reading, the cached file listing of the
tables that receive daily loads is dropped (``refreshTable``), as the
service did; the item master, branch table and the stock extract's item and
branch tables are read without a refresh, also as it did.

``database=None`` reads bare names, so temp views with the table names can
stand in for the catalog (the test hook of the original).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Database names of the lake.
UMBRELLA_DB = "datalake_umbrella"
WMS_DB = "datalake_wms"

# Table names and role column mapping (lake column -> role column).
SALES_HEADER = ("umbrella_pedido_de_venda_cabecalho", {
    "pedc_id_pedido": "order_id", "pedc_dt_emissao": "sales_date", "pedc_id_marca": "brand",
    "pedc_situacao": "order_status", "pedc_in_aprovado": "approved", "pedc_id_origem": "origin",
    "pedc_id_cia": "company", "pedc_id_filial": "branch_id", "data_inclusao_p": "load_part"})
SALES_PARTY = ("umbrella_pedc_cliente", {
    "pece_id_pedido": "order_id", "pece_in_tipo": "party_type", "pece_id_estado": "uf_target",
    "data_inclusao_p": "load_part"})
SALES_LINE = ("umbrella_pedido_de_venda_detalhes", {
    "pedd_id_pedido": "order_id", "pedd_id_item": "sku", "pedd_qt_ped": "quantity",
    "data_inclusao_p": "load_part"})
ITEM_MASTER = ("umbrella_item_geral", {
    "iteg_id": "item_id", "iteg_ean": "ean", "iteg_id_fornec": "supplier_id",
    "iteg_id_cia": "item_company", "iteg_id_depto": "department"})
BRANCH = ("umbrella_filial", {"fili_id_filial": "branch_id", "fili_cgc": "cnpj"})
STOCK_POSITION = ("umbrella_posicao_estoque", {
    "id_item": "sku", "id_filial": "branch_id", "partition_date": "stock_date",
    "load_timestamp": "received_date", "qtde_disponivel": "available",
    "id_agrup_valorizacao": "brand_group", "id_cia": "id_cia"})
STOCK_ARCHIVE = "umbrella_posicao_estoque_temp"
WMS_HEADER = ("wms_pedido_cab", {
    "pedv_id_ped": "order_id", "pedv_id_unineg": "brand", "pedv_dt_situacao": "dispatch_date",
    "pedv_dt_emissao": "sales_date", "pedv_id_planta": "plant_id", "pedv_id_programa": "program_id",
    "pedv_id_onda": "wave_id", "pedv_id_prevol": "prevol_id", "pedv_situacao": "order_status",
    "pedv_dt_registro_p": "load_part"})
WMS_PLANT = ("wms_planta", {
    "plta_id_planta": "plant_id", "plta_id_terceiro": "warehouse_cnpj", "plta_id_estado": "warehouse_uf"})
WMS_LABEL = ("wms_pedido_cab_etic", {
    "pcae_id_ped": "order_id", "pcae_muni_nome": "delivery_city", "pcae_id_estado": "delivery_uf",
    "pcae_data_faturamento": "nf_issuance", "pcae_num_nota": "nf_id", "pcae_serie": "nf_serie",
    "pcae_datahora_p": "load_part"})
WMS_LINE = ("wms_pedido_det", {
    "pedd_id_ped": "order_id", "pedd_id_item": "item_id", "pedv_dt_registro_p": "load_part"})
WMS_ITEM = ("wms_item", {
    "item_id_item": "item_id", "item_id_sku": "sku_id", "item_cod_terceiro": "sku",
    "item_id_fornec": "supplier_id"})
WMS_EAN = ("wms_ean", {"ean_id_sku": "sku_id", "ean_id_ean": "ean"})
WMS_SERIAL = ("wms_numero_serie", {
    "nuse_id_programa": "program_id", "nuse_id_onda": "wave_id", "nuse_id_prevol": "prevol_id",
    "nuse_nu_serie": "imei", "volu_dt_registro_p": "load_part"})


def _name(database: str | None, table: str) -> str:
    return f"{database}.{table}" if database else table


def read_role(spark: SparkSession, database: str | None, spec, refresh: bool) -> DataFrame:
    """Read one lake table and rename its mapped columns to role columns."""
    table, mapping = spec
    name = _name(database, table)
    if refresh:
        spark.catalog.refreshTable(name)
    df = spark.table(name)
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def sales_roles(spark: SparkSession, database: str | None = UMBRELLA_DB) -> dict[str, DataFrame]:
    return {
        "header": read_role(spark, database, SALES_HEADER, True),
        "party": read_role(spark, database, SALES_PARTY, True),
        "line": read_role(spark, database, SALES_LINE, True),
        "items": read_role(spark, database, ITEM_MASTER, True),
        "branches": read_role(spark, database, BRANCH, True),
    }


def shipment_roles(spark: SparkSession, database: str | None = WMS_DB,
                   umbrella: str | None = UMBRELLA_DB) -> dict[str, DataFrame]:
    return {
        "header": read_role(spark, database, WMS_HEADER, True),
        "plants": read_role(spark, database, WMS_PLANT, True),
        "labels": read_role(spark, database, WMS_LABEL, True),
        "lines": read_role(spark, database, WMS_LINE, True),
        "wms_items": read_role(spark, database, WMS_ITEM, True),
        "eans": read_role(spark, database, WMS_EAN, True),
        "serials": read_role(spark, database, WMS_SERIAL, True),
        "item_master": read_role(spark, umbrella, ITEM_MASTER, False),
    }


def stock_roles(spark: SparkSession, database: str | None = UMBRELLA_DB) -> dict[str, DataFrame]:
    return {
        "positions": read_role(spark, database, STOCK_POSITION, True),
        "branches": read_role(spark, database, BRANCH, False),
        "items": read_role(spark, database, ITEM_MASTER, False),
    }


def raw_items(spark: SparkSession, database: str | None = UMBRELLA_DB) -> DataFrame:
    """The item master with all its lake columns (``select *``), not refreshed."""
    return spark.table(_name(database, ITEM_MASTER[0]))


def raw_positions(spark: SparkSession, database: str | None = UMBRELLA_DB) -> DataFrame:
    """The stock position table with all its lake columns, for the archive job."""
    return spark.table(_name(database, STOCK_POSITION[0]))
