"""Documentation progress: tiles, streams by tab, state matrix, drill-down, group roll-ups, folders and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import STAGES, folder_cost, folder_stage, status_tier
from .versioned import asof_grid, latest


def current_status(log: DataFrame) -> DataFrame:
    return latest(log, ["row_id"], ["created_at", "id"])


def current_by_type(log: DataFrame, with_untyped: bool = False) -> DataFrame:
    """The newest status by row and work type; entries without a type are left out, or are a type of their own."""
    return latest(log, ["row_id", "work_type"], ["created_at", "id"], None if with_untyped else F.col("work_type").isNotNull())


def tiles(current: DataFrame) -> DataFrame:
    """One row: rows, signed, under way, returned and, by subtraction, the rest."""
    out = current.agg(F.count("*").alias("total"), F.count_if(status_tier(F.col("status")) == 2).alias("signed"), F.count_if(F.col("status") == "in progress").alias("under_way"), F.count_if(F.col("status") == "returned").alias("returned"))
    return out.withColumn("rest", F.col("total") - F.col("signed") - F.col("under_way") - F.col("returned"))


def stream(current: DataFrame, tabs: DataFrame) -> DataFrame:
    """Green, yellow and red rows by tab; tabs without rows stay with zeros."""
    tier = status_tier(F.col("status"))
    counts = current.groupBy("tab_id").agg(F.count_if(tier == 2).alias("green"), F.count_if((tier == 1) & (F.col("status") != "returned")).alias("yellow"), F.count_if(F.col("status") == "returned").alias("red"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tabs.join(counts, "tab_id", "left").select("tab_id", zero("green"), zero("yellow"), zero("red"))


def state_matrix(log: DataFrame, weeks: DataFrame) -> DataFrame:
    """Rows by weeks with the status as of each week's end."""
    return asof_grid(log, weeks.select("week_no", "week_end"), "row_id", "status_date", "week_end", "status", ["created_at", "id"])


def signed_as_of(log: DataFrame, weeks: DataFrame) -> DataFrame:
    """By row and week: work types whose status as of the week's end is signed."""
    typed = log.where("work_type is not null").withColumn("part", F.struct("row_id", "work_type"))
    cells = asof_grid(typed, weeks.select("week_no", "week_end"), "part", "status_date", "week_end", "status", ["created_at", "id"])
    return cells.groupBy(F.col("part.row_id").alias("row_id"), "week_no").agg(F.count_if(F.coalesce(status_tier(F.col("status")) == 2, F.lit(False))).alias("signed"), F.count("*").alias("types"))


def status_tier_first(log: DataFrame) -> DataFrame:
    """The day each row was first signed."""
    return log.where(status_tier(F.col("status")) == 2).groupBy("row_id").agg(F.min("status_date").alias("first_signed"))


def group_rollup(log: DataFrame, group: str = "tab_id") -> DataFrame:
    """By group: members, signed ones, the last of their first signings, and the most usual status of the others (smallest on ties)."""
    rows = current_status(log).join(status_tier_first(log), "row_id", "left")
    signed = status_tier(F.col("status")) == 2
    return rows.groupBy(group).agg(F.count("*").alias("members"), F.count_if(signed).alias("signed"), F.max("first_signed").alias("last_first_signed"), F.expr("mode() within group (order by status) filter (where status <> 'signed')").alias("usual"))


def funnel(folders: DataFrame, stages: DataFrame) -> DataFrame:
    """Folders by stage with their known cost; stages without folders stay."""
    cost = folder_cost(F.col("estimate"), F.col("amount"))
    staged = folders.groupBy(folder_stage(F.col("sent"), F.col("checked"), F.col("signed"), F.col("paid")).alias("stage")).agg(F.count("*").alias("folders"), F.sum(cost).alias("cost"), F.count(cost).alias("with_cost"))
    return stages.join(staged, "stage", "left").select("stage", F.coalesce("folders", F.lit(0)).alias("folders"), F.coalesce(F.col("cost"), F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)").alias("cost"), F.coalesce("with_cost", F.lit(0)).alias("with_cost"))


def stage_table(folders: DataFrame) -> DataFrame:
    return folders.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")


def transitions(folders: DataFrame, n: int = 10) -> DataFrame:
    """The n latest stage dates over all folders; ties by folder, then by stage."""
    long = folders.select("folder_id", F.stack(F.lit(4), F.lit(1), F.lit("sent"), F.col("sent"), F.lit(2), F.lit("checked"), F.col("checked"), F.lit(3), F.lit("ks2_signed"), F.col("signed"), F.lit(4), F.lit("paid"), F.col("paid")).alias("stage_no", "stage", "date")).where("date is not null")
    return long.orderBy(F.desc("date"), "folder_id", "stage_no").limit(n).select("folder_id", "stage", "date")


def balance(folders: DataFrame, by: str = "contract_id") -> DataFrame:
    """By contract: its amount, what is signed and paid, and what remains."""
    cost = F.coalesce(folder_cost(F.col("estimate"), F.col("amount")), F.lit(0).cast("decimal(18,2)"))
    when = lambda c: F.sum(F.when(F.col(c).isNotNull(), cost).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)")
    out = folders.groupBy(by).agg(F.sum(cost).cast("decimal(28,2)").alias("contract"), when("signed").alias("ks2"), when("paid").alias("ks3"), F.count("signed").alias("ks2_count"))
    return out.withColumn("remaining", (F.col("contract") - F.col("ks3")).cast("decimal(28,2)"))


def running_share(rows: DataFrame, by: list[str], order: str, value: str) -> Column:
    """A value's running share of its group."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.sum(value).over(w) / F.sum(value).over(Window.partitionBy(*by))
