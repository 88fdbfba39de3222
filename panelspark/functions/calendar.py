"""Calendar expressions. Weekdays count 1 (Monday) to 7 (Sunday)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Event name, month, day of month.
FIXED_EVENTS = (
    ("event_Christmas_0", 12, 25),
    ("event_NewYear_0", 1, 1),
    ("event_Halloween_0", 10, 31),
)

# The days a weekend starts with, as asked for and as also seen in the wild.
SATURDAY, FRIDAY = 6, 5


def day_of_week(day: Column) -> Column:
    return F.weekday(day) + 1


def calendar_columns(day: Column, friday_is_weekend: bool = False) -> dict[str, Column]:
    """Month, weekday, ISO week, year, weekend flag and quarter of a date."""
    first = FRIDAY if friday_is_weekend else SATURDAY
    return {
        "month": F.month(day),
        "day_of_week": day_of_week(day),
        "week_of_year": F.weekofyear(day),
        "year": F.year(day),
        "is_weekend": day_of_week(day) >= first,
        "quarter": F.quarter(day),
    }


def event_columns(day: Column, events=FIXED_EVENTS) -> dict[str, Column]:
    """0/1 flags for events that fall on the same day each year."""
    return {
        name: ((F.month(day) == month) & (F.dayofmonth(day) == dom)).cast("int")
        for name, month, dom in events
    }


def parse_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.to_date(text, pattern)
