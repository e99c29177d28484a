"""Item master extract: every column of the items whose supplier is allow-listed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mercato.operators.filters import in_list
from mercato.plans.sales import ALLOWED_SUPPLIERS


def item_master(items: DataFrame, supplier_col: str = "supplier_id",
                suppliers: tuple | None = ALLOWED_SUPPLIERS) -> DataFrame:
    """``select * ... where supplier in (allow-list)``: all columns kept."""
    return in_list(items, supplier_col, suppliers)
