"""Report output as JSON: one object per row (JSON Lines).

A single ``{"sales": [...]}`` document would have to be assembled in one
task; one object per line is written in parallel by every task and is read
back by any JSON reader.  Timestamps print as ``yyyy-MM-dd`` (time dropped);
NULL fields are omitted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.dates import day_string

# Field names and order of the report objects.
SALE_FIELDS = {"warehouse_cnpj": "warehouseCnpj", "uf_target": "ufTarget", "brand": "brand",
               "sales_date": "salesDate", "ean": "ean", "sku": "sku", "quantity": "quantity"}
STOCK_FIELDS = {"warehouse_cnpj": "warehouseCnpj", "brand_group": "brandGroup",
                "stock_date": "stockDate", "ean": "ean", "sku": "sku",
                "available_stock": "availableStock"}
SHIPMENT_FIELDS = {"warehouse_cnpj": "warehouseCnpj", "warehouse_uf": "warehouseUF", "brand": "brand",
                   "nf_issuance": "nfIssuance", "sales_date": "salesDate",
                   "dispatch_date": "dispatchDate", "nf_id": "nfId", "nf_serie": "nfSerie",
                   "delivery_city": "deliveryCity", "delivery_uf": "deliveryUF", "ean": "ean",
                   "sku": "sku", "imei": "IMEI"}

_DAYLIKE = (T.TimestampType, T.TimestampNTZType, T.DateType)


def to_json_lines(df: DataFrame, fields: Mapping[str, str] | Sequence[str], out_col: str = "json") -> DataFrame:
    """One JSON text per row, fields renamed and ordered as given."""
    if not isinstance(fields, Mapping):
        fields = {f: f for f in fields}
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for src, name in fields.items():
        col = F.col(src)
        if isinstance(types[src], _DAYLIKE):
            col = day_string(col)
        parts.append(col.alias(name))
    return df.select(F.to_json(F.struct(*parts)).alias(out_col))


def write_json_lines(df: DataFrame, fields: Mapping[str, str] | Sequence[str], path: str) -> None:
    to_json_lines(df, fields, "value").write.mode("overwrite").text(path)
