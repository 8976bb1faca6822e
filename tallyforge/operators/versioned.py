"""Versioned facts: the latest wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About the most rows of one task where a table is large.
ROWS_EACH = 1 << 18


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """The newest row of each key (null keys are keys), by the order columns, all descending; the last of them should be unique."""
    rows = rows.where(where) if where is not None else rows
    newest = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def latest_with_plan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], plan: Sequence[str]) -> DataFrame:
    """The newest row of each key, its plan columns taken, where null, from the newest row that has a plan."""
    planned = latest(rows, keys, order, F.col(plan[0]).isNotNull()).select(*keys, *(F.col(c).alias(f"_{c}") for c in plan))
    out = latest(rows, keys, order).join(planned, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in plan}).drop(*(f"_{c}" for c in plan))


def latest_value(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Of each key, the value in its newest row where it is not null; one pre-aggregated shuffle."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def asof_grid(log: DataFrame, grid: DataFrame, key: str, date: str, cutoff: str, value: str, order: Sequence[str]) -> DataFrame:
    """For each key and each cutoff of a small grid, the value of the newest entry on or before it (null if none).

    Entries and cutoffs of a key go by in one order, a cutoff after the entries of its day,
    so no entry meets more than one row.
    """
    cells = log.select(key).distinct().crossJoin(F.broadcast(grid))  # a calendar of a stated period
    by = [f"_by{i}" for i, c in enumerate(order)]
    entries = log.select(key, F.col(date).alias("_at"), F.lit(0).alias("_cell"), *(F.col(c).alias(b) for c, b in zip(order, by)), F.struct(F.col(value).alias("v")).alias("_entry"))
    asked = cells.select(key, F.col(cutoff).alias("_at"), F.lit(1).alias("_cell"), F.struct(*grid.columns).alias("_grid"))
    before = Window.partitionBy(key).orderBy("_at", "_cell", *by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = entries.unionByName(asked, allowMissingColumns=True).withColumn("_last", F.last("_entry", True).over(before))
    return seen.where("_cell = 1").select(key, *(F.col(f"_grid.{c}").alias(c) for c in grid.columns), F.col("_last.v").alias(value))


def decreases(rows: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Pairs of neighbouring dates of a key with a fall of the value; several rows may share a date."""
    known = rows.where(F.col(value).isNotNull()).withColumn("_rank", F.dense_rank().over(Window.partitionBy(key).orderBy(date)))
    later = known.select(key, (F.col("_rank") - 1).alias("_rank"), F.col(date).alias("next_date"), F.col(value).alias("next_value"))
    return known.join(later, [key, "_rank"]).where(F.col("next_value") < F.col(value)).select(key, F.col(date).alias("date"), F.col(value).alias("value"), "next_date", "next_value")


def islands(days: DataFrame, key: str, date: str) -> DataFrame:
    """Unbroken runs of a key's dates with a plan (planned above 0, where there is that column); a weekend does not break one.  key, island, first_day, last_day, days."""
    from ..functions.calendar import working_days

    days = (days.where("planned > 0") if "planned" in days.columns else days).select(key, date)
    parts = days.count() // ROWS_EACH + 1
    if parts > int(days.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # so that a task's share does not grow with the table
        days = days.repartition(parts, key)
    w = Window.partitionBy(key).orderBy(date)
    gap = working_days(F.lag(date).over(w), F.date_sub(date, 1))
    marked = days.distinct().withColumn("_new", F.when(F.lag(date).over(w).isNull() | (gap > 0), 1).otherwise(0))
    return marked.withColumn("island", F.sum("_new").over(w).cast("int")).groupBy(key, "island").agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count("*").alias("days"))
