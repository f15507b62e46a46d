"""Time-dependent columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def time_features(at: Column) -> dict[str, Column]:
    """Weekday (Monday is 0), hour, weekend, business hours (9 to 17 inclusive) and month."""
    day, hour = F.weekday(at), F.hour(at)
    return {
        "day_of_week": day,
        "hour": hour,
        "is_weekend": F.when(day >= 5, 1.0).otherwise(0.0),
        "is_business_hours": F.when(hour.between(9, 17), 1.0).otherwise(0.0),
        "month": F.month(at),
    }


def is_sale_period(at: Column) -> Column:
    """All of November and December, 10 to 16 July, the first week of January."""
    month, day = F.month(at), F.dayofmonth(at)
    return month.isin(11, 12) | ((month == 7) & day.between(10, 16)) | ((month == 1) & (day <= 7))


def interval_multiplier(at: Column) -> Column:
    """Scan interval factor: sale periods, the first two hours of the day, weekends."""
    return (
        F.when(is_sale_period(at), 0.5).when(F.hour(at) < 2, 0.7).when(F.weekday(at) >= 5, 0.9).otherwise(1.0)
    )
