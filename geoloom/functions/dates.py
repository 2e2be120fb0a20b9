"""Dates: normalisation of mixed notations, periods before a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_date(value: Column | str, *, strict: bool = True) -> Column:
    """DATE from the notations of field records.

    Null, blank and '00:00:00' give NULL; YYYY gives January 1st; YYYY-MM-DD HH:MM:SS (two or three digits at the end)
    gives its date; DD/MM/YY is of 2000 up to 25 and of 1900 beyond; DD/MM/YYYY. Anything else raises, or gives NULL
    when not ``strict``.
    """
    v = F.col(value) if isinstance(value, str) else value
    part = lambda pattern, k: F.regexp_extract(v, pattern, k).cast("int")
    iso, short, full = r"^(\d{4})-(\d{2})-(\d{2})\s+\d{2}:\d{2}:\d{2,3}$", r"^(\d{2})/(\d{2})/(\d{2})$", r"^(\d{2})/(\d{2})/(\d{4})$"
    year = part(short, 3) + F.when(part(short, 3) <= 25, 2000).otherwise(1900)
    other = F.raise_error(F.concat(F.lit("not a date: "), v)).cast("date") if strict else F.lit(None).cast("date")
    return (
        F.when(v.isNull() | (F.trim(v) == "") | (v == "00:00:00"), F.lit(None).cast("date"))
        .when(v.rlike(r"^\d{4}$"), F.make_date(v.try_cast("int"), F.lit(1), F.lit(1)))
        .when(v.rlike(iso), F.make_date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(v.rlike(short), F.make_date(year, part(short, 2), part(short, 1)))
        .when(v.rlike(full), F.make_date(part(full, 3), part(full, 2), part(full, 1)))
        .otherwise(other)
    )


def lenient_date(value: Column | str) -> Column:
    """DATE, or NULL where the text is none."""
    return F.try_to_timestamp(value).cast("date")


def recharge_days(area_km2: Column | str) -> Column:
    """Days of recharge that a basin of this area looks back on; NULL areas count as the largest."""
    a = F.col(area_km2) if isinstance(area_km2, str) else area_km2
    steps = ((100, 30), (500, 60), (1000, 90), (3000, 120), (5000, 150), (10000, 180))  # fixed values: km2 below, days
    out = F.when(a < steps[0][0], steps[0][1])
    for below, days in steps[1:]:
        out = out.when(a < below, days)
    return out.otherwise(360)


def period_start(date: Column | str, *, period: str = "fixed", days: int = 60, area_km2: Column | str | None = None) -> Column:
    """First day of the climate period that ends at ``date``: a fixed number of days, or by basin area."""
    if period == "fixed":
        return F.date_sub(date, days)
    if period == "by_area" and area_km2 is not None:
        return F.date_sub(date, recharge_days(area_km2))
    raise ValueError("period is 'fixed', or 'by_area' with area_km2")


def date_in_name(name: Column | str, pattern: str = "yyyy.MM.dd") -> Column:
    """The date before a four-character suffix at the end of a file name."""
    n = len(pattern)
    v = F.col(name) if isinstance(name, str) else name
    return F.to_date(F.substring(v, -(n + 4), n), pattern)
