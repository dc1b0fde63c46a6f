"""Calendar expressions: date parts, water years, 365-day year, month names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshade.constants import MONTH_LENGTH, MONTH_NAMES


def literal_map(mapping: dict) -> Column:
    """A constant map column; size is fixed by the code, so no join is needed to look values up."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs)


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a fixed map, null where the key is absent."""
    return F.try_element_at(literal_map(mapping), key)


def month_days(month: Column) -> Column:
    """Fixed month length, February 28."""
    return lookup(MONTH_LENGTH, month.cast("int"))


def date_parts(df: DataFrame, date: str = "date", fmt: str | None = None) -> DataFrame:
    """Add year, month, day, doy; `fmt` parses text or integer dates such as 20240131 first."""
    d = F.to_date(F.col(date).cast("string"), fmt) if fmt else F.col(date).cast("date")
    return df.withColumn(date, d).withColumns({
        "year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date), "doy": F.dayofyear(date)})


def water_year(date: Column, label: str = "start") -> Column:
    """July-June year, named after the year it starts in ('start') or ends in ('end')."""
    start = F.year(F.add_months(date, -6))
    if label == "start":
        return start
    if label == "end":
        return start + 1
    raise ValueError(f"label must be 'start' or 'end', got {label}")


def is_leap_day(date: Column) -> Column:
    return (F.month(date) == 2) & (F.dayofmonth(date) == 29)


def drop_leap_day(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(~is_leap_day(F.col(date)))


def nonleap_doy(date: Column) -> Column:
    """Day of year in a 365-day calendar: one less after February in leap years."""
    leap = F.dayofyear(F.last_day(F.make_date(F.year(date), F.lit(2), F.lit(1)))) == 60
    return F.dayofyear(date) - F.when(leap & (F.month(date) > 2), 1).otherwise(0)


def shift_years(date: Column, years: Column | int) -> Column:
    n = years if isinstance(years, Column) else F.lit(years)
    return F.add_months(date, (n * 12).cast("int"))


def month_name(month: Column) -> Column:
    return lookup(dict(enumerate(MONTH_NAMES, start=1)), month.cast("int"))


def month_number(name: Column) -> Column:
    return lookup({n: i for i, n in enumerate(MONTH_NAMES, start=1)}, name)


def season_order(month: Column) -> Column:
    """0 for July .. 11 for June."""
    return F.pmod(month + 5, F.lit(12))


def season_year(year: Column, month: Column) -> Column:
    """Start year of the July-June season of a (year, month)."""
    return year - F.when(month < 7, 1).otherwise(0)
