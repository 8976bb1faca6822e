"""Plan against fact: weights, weighted progress, earned value, promises kept, losses, deficits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import monday
from .versioned import latest


def daily_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Planned and actual sums of each day, and how many rows have an actual."""
    return rows.groupBy(*(keys or ("date",))).agg(F.sum("planned").alias("planned"), F.sum("actual").alias("actual"), F.count("actual").alias("with_actual"))


def s_curve(totals: DataFrame, first: str, last: str) -> DataFrame:
    """Running sums over all days, then the window: sums include the days before it.  The actual one stays null on days without actuals."""
    up = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a day
    curve = totals.select("date", "planned", "actual", F.sum(F.coalesce("planned", F.lit(0))).over(up).alias("planned_total"), F.when(F.col("with_actual") > 0, F.sum(F.coalesce("actual", F.lit(0))).over(up)).alias("actual_total"))
    return curve.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def weights(works: DataFrame, effort: DataFrame) -> DataFrame:
    """Each work's weight and where it is from: its planned effort, else its largest crew, else 1."""
    out = works.join(effort.select("work_id", "effort", "crew"), "work_id", "left")
    return out.withColumn("weight", F.when(F.col("effort") > 0, F.col("effort")).when(F.col("crew") > 0, F.col("crew")).otherwise(1)).withColumn("weight_source", F.when(F.col("effort") > 0, "effort").when(F.col("crew") > 0, "crew").otherwise("one"))


def weighted_progress(weighted: DataFrame) -> DataFrame:
    """One row: the weighted mean percentage (unknown counts as 0) and how many are unknown."""
    done = F.sum(F.col("weight").cast("decimal(18,2)") * F.coalesce(F.col("pct"), F.lit(0)))
    return weighted.agg((done / F.sum("weight")).cast("double").alias("progress"), F.count_if(F.col("pct").isNull()).alias("unknown"), F.count("*").alias("works"))


def promises(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Promised (plan above 0), met (actual at least the plan) and percent; null without promises."""
    promised = F.count_if(F.col("planned") > 0)
    met = F.count_if((F.col("planned") > 0) & (F.col("actual") >= F.col("planned")))
    return rows.groupBy(*keys).agg(promised.alias("promised"), met.alias("met"), F.round(F.try_divide(F.lit(100.0) * met, promised), 6).alias("ppc"))


def promises_by_week(rows: DataFrame) -> DataFrame:
    """promises by ISO week; weeks without any are left out."""
    return promises(rows, monday(F.col("date")).alias("week")).where("promised > 0")


def earned_value(rows: DataFrame, latest_rows: DataFrame, weighted: DataFrame) -> DataFrame:
    """One row: planned value and cost up to the last day with an actual, earned value, their ratios, and promises of the 14 days up to that day.

    rows are all versions, latest_rows the one that holds for each date and work, weighted
    the works with their weights.  Ratios are rounded half to even, null on division by 0.
    """
    last = rows.where("actual is not null").agg(F.max("date").alias("last_date"))
    done = weighted.agg(F.sum("weight").alias("total_weight"), F.bround(F.try_divide(F.sum(F.col("weight") * F.coalesce(F.col("pct"), F.lit(0))).cast("double"), F.sum("weight")), 1).alias("progress"), F.count_if(F.col("pct").isNull()).alias("unknown"))
    held = latest_rows.join(F.broadcast(last), F.col("date") <= F.col("last_date"))  # one row
    recent, kept = F.col("date") >= F.date_sub("last_date", 13), (F.col("planned") > 0) & (F.col("actual") >= F.col("planned"))
    sums = held.groupBy("last_date").agg(F.coalesce(F.sum("planned"), F.lit(0)).alias("planned_value"), F.coalesce(F.sum("actual"), F.lit(0)).alias("actual_cost"), F.count_if(recent & (F.col("planned") > 0)).alias("promised"), F.count_if(recent & kept).alias("met"))
    both = sums.withColumn("one", F.lit(1)).join(F.broadcast(done.withColumn("one", F.lit(1))), "one")
    earned = F.coalesce(F.col("progress"), F.lit(0.0)) / 100 * F.col("total_weight")
    ratio = lambda b: F.bround(F.when(F.col(b) != 0, earned / F.col(b)), 2)
    ppc = F.bround(F.when(F.col("promised") > 0, F.col("met") * 100.0 / F.col("promised")), 1)
    return both.select("last_date", "progress", "total_weight", "unknown", "planned_value", "actual_cost", F.bround(earned, 1).alias("earned_value"), ratio("planned_value").alias("spi"), ratio("actual_cost").alias("cpi"), "promised", "met", ppc.alias("ppc"))


def deficit(required: Column, actual: Column) -> dict[str, Column]:
    """Deficit and surplus, never negative and null on equality, and coverage in percent."""
    return {"deficit": F.when(actual < required, required - actual), "surplus": F.when(actual > required, actual - required), "coverage": F.round(F.try_divide(F.lit(100.0) * actual, required), 6)}


def losses(rows: DataFrame, blockers: DataFrame, today: str, days: int = 30) -> DataFrame:
    """By kind of blocker raised within the period: the project's deficit of its day, once for every blocker raised on it; and how many there were.

    A day's deficit is its planned less its actual crew over all works, not below 0; a
    day without records has none.
    """
    last = F.lit(today).cast("date")
    within = lambda c: F.col(c).between(F.date_sub(last, days), last)
    lack = rows.where(within("date")).groupBy("date").agg(F.greatest(F.coalesce(F.sum("planned"), F.lit(0)) - F.coalesce(F.sum("actual"), F.lit(0)), F.lit(0)).alias("lost"))
    raised = blockers.where(within("raised")).groupBy("kind", F.col("raised").alias("date")).agg(F.count("*").alias("n"))
    return raised.join(lack, "date", "left").groupBy("kind").agg(F.sum(F.col("n") * F.coalesce("lost", F.lit(0))).alias("lost"), F.sum("n").alias("blockers"))


def loss_overlap(blockers: DataFrame, today: str, days: int = 30) -> DataFrame:
    """One row: blockers of the period, the days they were raised on, and how many more blockers than days there are."""
    last = F.lit(today).cast("date")
    one = blockers.where(F.col("raised").between(F.date_sub(last, days), last)).agg(F.count("*").alias("blockers"), F.count_distinct("raised").alias("days"))
    return one.withColumn("overlap_days", F.col("blockers") - F.col("days"))


def resolution_time(blockers: DataFrame, today: str) -> DataFrame:
    """By kind: mean days to resolve, how many are resolved and open, and the oldest open age."""
    days = F.datediff("resolved", "raised")
    return blockers.groupBy("kind").agg(F.round(F.sum(days).cast("double") / F.count(days), 6).alias("mean_days"), F.count("resolved").alias("resolved"), F.count_if(F.col("resolved").isNull()).alias("open"), F.max(F.when(F.col("resolved").isNull(), F.datediff(F.lit(today).cast("date"), F.col("raised")))).alias("oldest_open"))


def remaining_effort(rows: DataFrame, works: DataFrame) -> DataFrame:
    """One row: effort still to do over works that are not done and have a known effort, and how many are left out."""
    effort = rows.where("source = 'excel'").groupBy("work_id").agg(F.sum("planned").alias("effort"))
    todo = works.where("pct is null or pct < 100").join(effort, "work_id", "left")
    left = F.col("effort") * (100 - F.coalesce(F.col("pct"), F.lit(0)))
    return todo.agg((F.sum(left) / 100.0).alias("remaining"), F.count("effort").alias("known"), F.count_if(F.col("effort").isNull()).alias("unknown"))


def shift_sheet(rows: DataFrame, works: DataFrame, day: str) -> DataFrame:
    """A day's works, their newest plan of the sheet and what was entered for them; works with a plan, or where nothing is planned, all that are not done."""
    of_day = rows.where(F.col("date") == F.lit(day).cast("date"))
    newest = lambda some: latest(some, ["work_id"], ["updated_at", "id"])
    plan = newest(of_day.where("source = 'excel' and planned is not null")).select("work_id", "planned")
    fact = newest(of_day.where("source = 'web'")).select("work_id", F.col("pct").alias("fact_pct"), F.col("actual").alias("fact"), F.lit(True).alias("filled"))
    any_plan = F.broadcast(plan.agg((F.count("*") > 0).alias("_any")).withColumn("_one", F.lit(1)))  # one row
    shown = works.select("work_id", (F.coalesce("pct", F.lit(0)) < 100).alias("_todo"), F.lit(1).alias("_one")).join(plan, "work_id", "left").join(any_plan, "_one")
    shown = shown.where(F.when(F.col("_any"), F.col("planned").isNotNull()).otherwise(F.col("_todo")))
    return shown.join(fact, "work_id", "left").select("work_id", "planned", "fact_pct", "fact", F.coalesce("filled", F.lit(False)).alias("filled"))
