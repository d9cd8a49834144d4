"""Calendar encodings of a UTC timestamp (Monday = 0)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Peak hours of the counter dialect.
COUNTER_PEAK_HOURS = (8, 9, 10, 12, 13, 14, 18, 19, 20, 21)


def cyclic(name: str, value: Column, period: float) -> dict[str, Column]:
    angle = value * (2 * math.pi) / period
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def counter_time_features(ts: Column) -> dict[str, Column]:
    """Hour, weekday and month cycles with weekend and peak flags."""
    hour, dow = F.hour(ts), F.weekday(ts)
    return {
        **cyclic("hour", hour, 24.0),
        **cyclic("dow", dow, 7.0),
        **cyclic("month", F.month(ts) - 1, 12.0),
        "is_weekend": flag(dow >= 5),
        "is_peak_hour": flag(hour.isin(*COUNTER_PEAK_HOURS)),
        "hour_of_day": hour,
        "day_of_week": dow,
    }


def inventory_time_features(ts: Column) -> dict[str, Column]:
    """Adds day-of-year, ISO week, business hours and the 15-minute slot of the day."""
    hour, dow, doy = F.hour(ts), F.weekday(ts), F.dayofyear(ts)
    rop = (hour * 4 + F.floor(F.minute(ts) / 15)).cast("int")
    weekend, morning = flag(dow >= 5), flag((hour >= 7) & (hour <= 9))
    evening = flag((hour >= 17) & (hour <= 21))
    return {
        "hour_of_day": hour,
        **cyclic("hour", hour, 24.0),
        "day_of_week": dow,
        **cyclic("dow", dow, 7.0),
        "day_of_year": doy,
        **cyclic("doy", doy, 365.0),
        "week_of_year": F.weekofyear(ts),
        "is_weekend": weekend,
        "is_morning_peak": morning,
        "is_evening_peak": evening,
        "is_peak_hour": F.greatest(morning, evening),
        "is_business_hours": flag((hour >= 8) & (hour <= 18) & (dow < 5)),
        "rop_of_day": rop,
        **cyclic("rop", rop, 96.0),
    }


def serving_time_features(ts: Column) -> dict[str, Column]:
    """Fractional-hour cycle of the online row; its evening peak ends at 20."""
    hour, dow = F.hour(ts), F.weekday(ts)
    return {
        **cyclic("hour", hour + F.minute(ts) / 60.0, 24.0),
        **cyclic("dow", dow, 7.0),
        "is_peak_hour": flag(hour.between(7, 9) | hour.between(17, 20)),
        "is_weekend": flag(dow >= 5),
    }


def one_hot(col: Column, prefix: str, categories) -> dict[str, Column]:
    """One 0/1 column per listed category, independent of what a batch contains."""
    return {
        f"{prefix}_{c.lower()}": F.coalesce((col == c).cast("int"), F.lit(0)) for c in categories
    }


def band_bucket(band: Column) -> dict[str, Column]:
    return {
        "band_low": flag(band <= 32),
        "band_mid": flag((band > 32) & (band <= 77)),
        "band_high": flag(band > 77),
    }
