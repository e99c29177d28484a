from datetime import date, datetime

import pytest

from mercato.params import (
    MSG_BAD_FORMAT, MSG_FINAL_MISSING, MSG_INITIAL_MISSING, MSG_TOO_OLD, DateRange, minus_months,
    validate_dates,
)

AS_OF = datetime(2024, 3, 15, 10, 30)


def test_required_and_blank():
    with pytest.raises(ValueError, match=MSG_INITIAL_MISSING):
        validate_dates(None, "2024-03-01", AS_OF)
    with pytest.raises(ValueError, match=MSG_INITIAL_MISSING):
        validate_dates("  ", "2024-03-01", AS_OF)
    with pytest.raises(ValueError, match=MSG_FINAL_MISSING):
        validate_dates("2024-03-01", "", AS_OF)


def test_format_message_names_the_date_and_time():
    with pytest.raises(ValueError) as err:
        validate_dates("2024/03/01", "2024-03-02", AS_OF)
    assert str(err.value) == MSG_BAD_FORMAT.format(value="2024/03/01 00:00")
    with pytest.raises(ValueError) as err:
        validate_dates("2024-03-01", "2024-02-30", AS_OF)
    assert str(err.value) == MSG_BAD_FORMAT.format(value="2024-02-30 23:59")


def test_check_order_initial_age_before_final_format():
    with pytest.raises(ValueError, match="older than 1 month"):
        validate_dates("2023-01-01", "garbage", AS_OF)
    with pytest.raises(ValueError, match="valid format"):
        validate_dates("garbage", "garbage", AS_OF)


def test_age_limit():
    # exactly one month ago at midnight is older than "now - 1 month" (which has a time of day)
    with pytest.raises(ValueError, match=MSG_TOO_OLD):
        validate_dates("2024-02-15", "2024-03-01", AS_OF)
    rng = validate_dates("2024-02-16", "2024-03-01", AS_OF)
    assert rng.initial == date(2024, 2, 16)
    assert validate_dates("2020-01-01", "2020-01-02", AS_OF, skip_max_period=True).initial == date(2020, 1, 1)


def test_final_before_initial_is_allowed():
    rng = validate_dates("2024-03-10", "2024-03-01", AS_OF)
    assert rng.lower > rng.upper


def test_bounds():
    rng = DateRange(date(2024, 1, 1), date(2024, 1, 31))
    assert rng.lower == datetime(2024, 1, 1)
    assert rng.upper == datetime(2024, 1, 31, 23, 59)
    assert DateRange(date(2024, 1, 1), date(2024, 1, 31), half_open=True).upper == datetime(2024, 2, 1)
    assert DateRange(date(1800, 1, 1), date(2024, 1, 31)).lower == datetime(1900, 1, 1)


def test_minus_months_clamps():
    assert minus_months(date(2024, 3, 31), 1) == date(2024, 2, 29)
    assert minus_months(date(2024, 1, 15), 1) == date(2023, 12, 15)
    assert minus_months(date(2024, 1, 15), -1) == date(2024, 2, 15)


def test_surrounding_spaces_are_a_format_error():
    with pytest.raises(ValueError) as err:
        validate_dates(" 2024-03-01", "2024-03-02", AS_OF)
    assert str(err.value) == MSG_BAD_FORMAT.format(value=" 2024-03-01 00:00")
    assert validate_dates("2024-3-1", "2024-03-02", AS_OF).initial == date(2024, 3, 1)
