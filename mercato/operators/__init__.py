"""Relational and time-series operators (DataFrame in, DataFrame out)."""

from mercato.operators.filters import (  # noqa: F401
    before_day, day_range, equals, in_list, not_null, ts_range,
)
from mercato.operators.timeseries import (  # noqa: F401
    calendar_bounds, calendar_of, densify, densify_join, fill_calendar, forward_fill,
    latest_per_period, max_per_period,
)
