"""Brand code -> brand name lookups.

Both lookups are strict: a code outside the table, NULL included, fails the
job with ``Invalid brandId specified.`` (``raise_error``), exactly like the
service the reports come from.  Reports therefore filter on the admitted
codes *before* decoding.  The lookups compile to a CASE expression, which
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sales-system brand codes.
SALES_BRANDS = {"1": "SHOP", "2": "ACOM", "3": "SUBA", "7": "SOUB"}
# Warehouse-system brand codes.
WMS_BRANDS = {"1": "SHOP", "26": "ACOM", "29": "SUBA"}
# Error text for an unknown code.
INVALID_BRAND = "Invalid brandId specified."


def _strict_lookup(code: Column, table: dict[str, str]) -> Column:
    code = code.cast("string")
    expr = None
    for key, name in table.items():
        expr = F.when(code == key, F.lit(name)) if expr is None else expr.when(code == key, F.lit(name))
    return expr.otherwise(F.raise_error(F.lit(INVALID_BRAND)).cast("string"))


def brand_sales(code: Column | str) -> Column:
    """Sales-system code (1, 2, 3, 7) to name; anything else raises."""
    return _strict_lookup(F.col(code) if isinstance(code, str) else code, SALES_BRANDS)


def brand_wms(code: Column | str) -> Column:
    """Warehouse-system code (1, 26, 29) to name; anything else raises."""
    return _strict_lookup(F.col(code) if isinstance(code, str) else code, WMS_BRANDS)
