"""Column builders: scalar functions as native Spark expressions."""

from mercato.functions.brands import brand_sales, brand_wms  # noqa: F401
from mercato.functions.dates import (  # noqa: F401
    day_string, from_day_string, month_limit, ts_literal, day_literal,
)
from mercato.functions.numbers import valid_double, to_double  # noqa: F401
