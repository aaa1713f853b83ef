"""Date columns and reporting periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: Column) -> Column:
    """The date of a date, timestamp or ISO text with or without a time; NULL if unreadable."""
    return value.try_cast("date")


def day_lag(later: Column, earlier: Column) -> Column:
    """Whole days between two dates; negative when ``later`` comes first."""
    return F.date_diff(as_date(later), as_date(earlier))


def year_of_mdy(value: Column) -> Column:
    """Year of a ``month/day/year`` text, padded or not; NULL when it does not parse."""
    return F.year(F.try_to_date(F.trim(value), "M/d/yyyy"))


def quarter_label(year: Column, month: Column) -> Column:
    """``"2020 Q1"`` and so on; NULL when year or month is missing or not a calendar month."""
    quarter = F.ceil(month / 3).cast("string")
    return F.when(
        month.between(1, 12), F.concat(year.cast("string"), F.lit(" Q"), quarter)
    )


def previous_month(today: dt.date) -> tuple[int, int]:
    last = today.replace(day=1) - dt.timedelta(days=1)
    return last.year, last.month


def previous_quarter(today: dt.date) -> tuple[int, int]:
    """The last completed calendar quarter, so a run in January reports the fourth."""
    year, month = today.year, today.month
    quarter = (month - 1) // 3
    return (year, quarter) if quarter else (year - 1, 4)
