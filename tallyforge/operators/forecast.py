"""Overdue works, lags, pace forecasts, look-ahead and critical works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_working_days, iso_week, working_days
from ..functions.expressions import DONE
from .versioned import latest


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def not_done(status: Column) -> Column:
    """Whether a work is still to do; one without a status is."""
    return ~F.coalesce(status.isin(*DONE), F.lit(False))


def resolved_terms(terms: DataFrame) -> DataFrame:
    """terms with the start and finish that hold: the current ones, else those of a baseline with high or medium confidence; works without such a finish are left out."""
    fine = F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False))
    pick = lambda c: F.coalesce(f"current_{c}", F.when(fine, F.col(f"plan_{c}")))
    return terms.withColumns({"start": pick("start"), "finish": pick("finish")}).where("finish is not null")


def overdue(schedule: DataFrame, today: str, finish: str = "plan_finish") -> DataFrame:
    """Works past their planned finish that are not done, with their lag in days."""
    return schedule.where((F.col(finish) < day(today)) & not_done(F.col("status"))).withColumn("lag_days", F.datediff(day(today), F.col(finish)))


def baseline_lag(resolved: DataFrame, today: str) -> DataFrame:
    """One row: the last finish of works not done, put off by the mean lag (half to even) of those overdue; no lag without any, null without works."""
    late = F.datediff(day(today), F.col("finish"))
    one = resolved.where(not_done(F.col("status"))).agg(F.max("finish").alias("last_finish"), F.sum(F.when(late > 0, late)).alias("lag"), F.count(F.when(late > 0, 1)).alias("late_works"))
    mean = F.coalesce(F.bround(F.try_divide(F.col("lag").cast("double"), F.col("late_works"))), F.lit(0)).cast("int")
    return one.select("last_finish", "late_works", mean.alias("mean_lag"), F.date_add("last_finish", mean).alias("forecast"))


def position(start: Column, end: Column, today: Column) -> Column:
    """Elapsed percent of a schedule, below 0 or above 100 outside it; null for an empty span."""
    span = F.datediff(end, start)
    return F.when(span > 0, F.round(100.0 * F.datediff(today, start) / span, 1))


def people_for_date(effort: Column, today: Column, end: Column) -> Column:
    """People needed to finish by a date; null without a working day left."""
    days = working_days(today, end)
    return F.when(days > 0, F.ceil(effort / days))


def date_for_people(effort: Column, people: Column, today: Column) -> Column:
    """The working day on which so many people finish; null for none."""
    return F.when(people > 0, add_working_days(today, F.ceil(effort / people).cast("int")))


def recent_pace(totals: DataFrame, days: int = 14) -> DataFrame:
    """One row: the mean actual of the last days that have any."""
    last = totals.where("actual is not null").orderBy(F.desc("date")).limit(days)
    return last.agg(F.round(F.sum("actual").cast("double") / F.count("*"), 2).alias("pace"), F.max("date").alias("last_date"))


def pace_forecast(totals: DataFrame, remaining: DataFrame, today: str, days: int = 14) -> DataFrame:
    """One row: pace, remaining effort, working days needed and the forecast finish."""
    both = recent_pace(totals, days).crossJoin(remaining.select("remaining"))  # one row each
    need = F.when(F.col("pace") > 0, F.ceil(F.col("remaining") / F.col("pace")).cast("int"))
    return both.select("pace", "remaining", need.alias("days_needed"), add_working_days(day(today), need).alias("forecast"))


def first_of_week(rows: DataFrame, method: str = "user_id") -> DataFrame:
    """The first row of each ISO week and method: snapshots are kept once."""
    year, week = iso_week(F.to_date("ts"))
    keyed = rows.withColumn("iso_year", year).withColumn("iso_week", week)
    return keyed.groupBy("iso_year", "iso_week", method).agg(F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("s")).select("iso_year", "iso_week", method, "s.event_id", "s.value")


def lookahead(terms: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Works not started that should start within the window (by current dates, else a trusted baseline), with what stands in the way: a subcontractor that is missing."""
    fine = F.col("current_start").isNotNull() | F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False))
    start = terms.withColumn("start", F.coalesce("current_start", "plan_start")).where(fine & (F.col("status") == "not_started") & F.col("start").between(day(today), F.date_add(day(today), days)))
    missing = (F.col("executor_type") == "subcontract") & F.col("subcontractor_id").isNull()
    return start.select("work_id", "start", F.when(missing, "no subcontractor").otherwise("").alias("obstacles"))


def critical(resolved: DataFrame, blockers: DataFrame, effort: DataFrame, last_actual: DataFrame, today: str, directive: str) -> DataFrame:
    """Works not done that are overdue, finish after the directive date or are blocked, with the people they lack.

    People are those that do the effort not done yet by the earlier of finish and
    directive date, less those last there (0 if unknown), not below 0; null without effort
    or working days.
    """
    open_ = blockers.where("resolved is null").groupBy("work_id").agg(F.count("*").alias("open"))
    rows = resolved.where(not_done(F.col("status"))).join(open_, "work_id", "left").join(effort.select("work_id", "effort"), "work_id", "left").join(last_actual.select("work_id", "actual"), "work_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("finish") < day(today), "overdue"), F.when(F.col("finish") > day(directive), "after directive"), F.when(F.col("open") > 0, F.concat(F.lit("blocked "), F.col("open").cast("string")))))
    left = F.col("effort") * (100 - F.coalesce(F.col("pct"), F.lit(0))) / 100.0
    need = people_for_date(left, day(today), F.least(F.col("finish"), day(directive)))
    extra = F.when(need.isNotNull(), F.greatest(need - F.coalesce("actual", F.lit(0)), F.lit(0)))
    return rows.withColumn("reasons", F.array_join(reasons, ", ")).where("reasons != ''").select("work_id", "reasons", extra.cast("long").alias("extra_people"))


def latest_actual(rows: DataFrame) -> DataFrame:
    """The last actual of each work."""
    return latest(rows.where("actual is not null"), ["work_id"], ["date", "updated_at", "id"]).select("work_id", "date", "actual")
