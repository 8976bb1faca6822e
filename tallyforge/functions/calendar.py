"""Calendar expressions: working days, weeks, dates in two formats.  Weekends count, holidays don't exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_workday(day: Column) -> Column:
    return F.weekday(day) < 5


def _before(day: Column) -> Column:
    """Working days from Monday 1900-01-01 up to and including a day."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date")) + 1
    weeks = F.floor(n / 7)
    return weeks * 5 + F.least(n - weeks * 7, F.lit(5))


def working_days(start: Column, end: Column) -> Column:
    """Working days in (start, end]; 0 if end is not later.  A closed form, no day list is built."""
    return F.greatest(_before(end) - _before(start), F.lit(0)).cast("int")


def add_working_days(start: Column, n: Column) -> Column:
    """The n-th working day after start; start itself for 0."""
    k = _before(start) + n - 1  # counted from the first Monday
    weeks = F.floor(k / 5)
    return F.when(n <= 0, start).otherwise(F.date_add(F.lit("1900-01-01").cast("date"), (weeks * 7 + (k - weeks * 5)).cast("int")))


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def iso_week(day: Column) -> tuple[Column, Column]:
    """ISO year and week."""
    return F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)


def parse_date(text: Column) -> Column:
    """ISO or DD.MM.YYYY; anything else is null."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd.MM.yyyy"))


def show_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd.MM.yyyy"), F.lit("—"))


def to_local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def weeks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monday weeks clipped to a period: number, first and last day."""
    days = F.explode(F.sequence(F.date_trunc("week", F.lit(start).cast("date")).cast("date"), F.lit(end).cast("date"), F.expr("interval 7 days")))
    grid = spark.range(1).select(days.alias("monday"))
    return grid.select(F.floor(F.datediff("monday", F.date_trunc("week", F.lit(start).cast("date"))) / 7).cast("int").alias("week_no"), F.greatest("monday", F.lit(start).cast("date")).alias("week_start"), F.least(F.date_add("monday", 6), F.lit(end).cast("date")).alias("week_end"))


def viewport(current: int, total: int, back: int = 4, size: int = 13) -> tuple[int, int]:
    """A window of weeks around the current one, clamped to what exists."""
    first = max(0, min(current - back, total - size))
    return first, min(total, first + size)
