"""Report parameters: the date-range contract shared by the three reports.

Both dates are required and must look like ``yyyy-MM-dd``.  The initial date
is taken at 00:00 and the final date at 23:59 (minute precision, so a row at
23:59:30 of the last day is *outside* the range unless ``half_open`` is used).
An initial date older than one month before ``as_of`` is rejected unless
``skip_max_period`` is set.  ``final < initial`` is not an error: it simply
selects nothing.

Nothing here calls "now" except as a default: every job takes ``as_of`` so
results are reproducible.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

# Messages of the parameter contract.
MSG_INITIAL_MISSING = "The initialDate was not informed."
MSG_FINAL_MISSING = "The finalDate was not informed."
MSG_BAD_FORMAT = "The date {value} was not specified in a valid format (YYYY-MM-DD)."
MSG_TOO_OLD = "The specified initialDate is older than 1 month."

# Default floor applied to every report ("minDate").
DEFAULT_MIN_DATE = date(1900, 1, 1)

_DAY = re.compile(r"^(\d{4})-(\d{1,2})-(\d{1,2})$")


def minus_months(moment: datetime | date, months: int):
    """Calendar month arithmetic that clamps the day (Mar 31 - 1 -> Feb 28/29)."""
    y, m = divmod(moment.year * 12 + (moment.month - 1) - months, 12)
    m += 1
    d = min(moment.day, calendar.monthrange(y, m)[1])
    return moment.replace(year=y, month=m, day=d)


def _parse_day(value: str, suffix: str) -> date:
    match = _DAY.match(value)  # blankness is judged on the trimmed text, the format on the text as given
    if not match:
        raise ValueError(MSG_BAD_FORMAT.format(value=f"{value} {suffix}"))
    try:
        return date(int(match.group(1)), int(match.group(2)), int(match.group(3)))
    except ValueError:
        raise ValueError(MSG_BAD_FORMAT.format(value=f"{value} {suffix}")) from None


@dataclass(frozen=True)
class DateRange:
    """A closed reporting range ``[initial 00:00, final 23:59:00]``.

    ``half_open=True`` switches the upper bound to ``< final + 1 day`` so the
    last minute of the final day is included.
    """

    initial: date
    final: date
    min_date: date = DEFAULT_MIN_DATE
    half_open: bool = False

    @property
    def lower(self) -> datetime:
        return datetime.combine(max(self.initial, self.min_date), datetime.min.time())

    @property
    def upper(self) -> datetime:
        """Inclusive upper bound (exclusive when ``half_open``)."""
        if self.half_open:
            return datetime.combine(self.final + timedelta(days=1), datetime.min.time())
        return datetime.combine(self.final, datetime.min.time()).replace(hour=23, minute=59)

    @property
    def first_day(self) -> date:
        return max(self.initial, self.min_date)


def validate_dates(initial: str | None, final: str | None, as_of: datetime | None = None,
                   skip_max_period: bool = False, min_date: date = DEFAULT_MIN_DATE,
                   half_open: bool = False) -> DateRange:
    """Check the request parameters in the contract's order and build a range.

    Order: presence of both, initial parsed, initial age, final parsed.
    """
    if initial is None or not initial.strip():
        raise ValueError(MSG_INITIAL_MISSING)
    if final is None or not final.strip():
        raise ValueError(MSG_FINAL_MISSING)
    initial_day = _parse_day(initial, "00:00")
    if not skip_max_period:
        now = as_of or datetime.now()
        if not isinstance(now, datetime):
            now = datetime.combine(now, datetime.min.time())
        if minus_months(now, 1) > datetime.combine(initial_day, datetime.min.time()):
            raise ValueError(MSG_TOO_OLD)
    final_day = _parse_day(final, "23:59")
    return DateRange(initial_day, final_day, min_date=min_date, half_open=half_open)
