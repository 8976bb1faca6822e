"""Data-quality rules, each giving rows of (contour, rule, key, detail), and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forecast import day
from .versioned import decreases, latest


def violations(rows: DataFrame, contour: str, rule: str, key: str, detail: str) -> DataFrame:
    return rows.select(F.lit(contour).alias("contour"), F.lit(rule).alias("rule"), F.col(key).cast("long").alias("key"), F.expr(detail).cast("string").alias("detail"))


def fact_outside_period(rows: DataFrame, first: str, last: str) -> DataFrame:
    return violations(rows.where(F.col("actual").isNotNull() & ~F.col("date").between(day(first), day(last))), "works", "fact_outside_period", "id", "date")


def over_plan(rows: DataFrame, by: int = 3) -> DataFrame:
    return violations(rows.where(F.col("actual") - F.col("planned") >= by), "works", "over_plan", "id", "actual - planned")


def percent_decreased(rows: DataFrame) -> DataFrame:
    return violations(decreases(rows.where("pct is not null"), "work_id", "date", "pct"), "works", "percent_decreased", "work_id", "concat(date, ':', value, '>', next_date, ':', next_value)")


def fact_after_done(rows: DataFrame) -> DataFrame:
    done = rows.where("pct >= 100").groupBy("work_id").agg(F.min("date").alias("done"))
    return violations(rows.where("actual > 0").join(done, "work_id").where("date > done"), "works", "fact_after_done", "id", "done")


def no_schedule(works: DataFrame, *schedules: DataFrame) -> DataFrame:
    rest = reduce(lambda left, s: left.join(s.select("work_id"), "work_id", "left_anti"), schedules, works)
    return violations(rest, "works", "no_schedule", "work_id", "name")


def untyped_entries(log: DataFrame) -> DataFrame:
    """Entries without a work type in tabs that have types."""
    typed = log.where("work_type is not null").select("tab_id").distinct()
    return violations(log.where("work_type is null").join(typed, "tab_id", "left_semi"), "documents", "untyped_entry", "id", "tab_id")


def future_status(log: DataFrame, today: str) -> DataFrame:
    return violations(latest(log, ["row_id"], ["created_at", "id"]).where(F.col("status_date") > day(today)), "documents", "future_status", "row_id", "status_date")


def impossible_dates(folders: DataFrame) -> DataFrame:
    wrong = (F.col("checked") < F.col("sent")) | (F.col("signed") < F.col("checked")) | (F.col("paid") < F.col("signed")) | (F.col("sent") < F.col("formed"))
    return violations(folders.where(F.coalesce(wrong, F.lit(False))), "documents", "impossible_dates", "folder_id", "formed")


def signed_without_cost(folders: DataFrame) -> DataFrame:
    return violations(folders.where("signed is not null and coalesce(estimate, amount) is null"), "documents", "signed_without_cost", "folder_id", "signed")


def empty_folders(folders: DataFrame, members: DataFrame) -> DataFrame:
    return violations(folders.join(members, "folder_id", "left_anti"), "documents", "empty_folder", "folder_id", "formed")


def resolved_in_last_act(items: DataFrame) -> DataFrame:
    last = items.agg(F.max(F.struct("act_date", "act_id")).alias("m")).select("m.act_id")
    return violations(items.join(last, "act_id").where("coalesce(resolved, false)"), "findings", "resolved_in_last_act", "finding_id", "act_id")


def orphan_processing(processing: DataFrame, findings: DataFrame, key: str = "finding_id") -> DataFrame:
    return violations(processing.join(findings.select(key), key, "left_anti"), "findings", "orphan_processing", key, "null")


def summary(rules: list[DataFrame]) -> DataFrame:
    """How many rows break each rule."""
    return reduce(DataFrame.unionByName, rules).groupBy("contour", "rule").agg(F.count("*").alias("total"))
