"""Registers: optional filters, null-safe keys, current states in two orders, next codes, guards and checks of imports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versioned import latest


def where_given(rows: DataFrame, conditions: Mapping[str, Column | None]) -> DataFrame:
    """Rows that meet all conditions that are given (not None)."""
    for c in conditions.values():
        rows = rows if c is None else rows.where(c)
    return rows


def with_status(rows: DataFrame, status: str, wanted: object) -> DataFrame:
    """Rows by current status: wanted is all, none (no status) or one status."""
    return rows if wanted == "all" else rows.where(F.col(status).isNull() if wanted == "none" else F.col(status) == wanted)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null equals null; right's keys are dropped."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*(f"_{k}" for k in keys))


def literal_match(rows: DataFrame, register: DataFrame, key: str, text: str, target: str) -> DataFrame:
    """The register's target of an equal text, else of the text without brackets; none where several are equal."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    only = register.groupBy(F.col(text).alias("_t")).agg(F.count("*").alias("_n"), F.min(target).alias("_one")).select("_t", F.when(F.col("_n") == 1, F.col("_one")).alias("_found"), F.lit(True).alias("_has"))
    exact = rows.join(only, F.col(text) == F.col("_t"), "left").select(*rows.columns, F.col("_found").alias("_exact"), F.col("_has").alias("_hit"))
    loose = exact.join(only, bare(F.col(text)) == F.col("_t"), "left")
    return loose.select(key, F.when(F.col("_hit"), F.col("_exact")).otherwise(F.col("_found")).alias(target))


def best_filled(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key: the first one with a value, else the first."""
    return latest_first(rows, key, [F.col(value).isNull(), F.col(order)])


def latest_first(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def two_currents(log: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The state by its date (then its entry) and the state entered last, which need not be the same."""
    by_date = latest(log, keys, ["status_date", "created_at"]).select(*keys, F.col(value).alias("by_date"))
    by_entry = latest(log, keys, ["created_at", "id"]).select(*keys, F.col(value).alias("by_entry"))
    return by_date.join(by_entry, list(keys))


def next_codes(new: DataFrame, old: DataFrame, group: str, code: str, order: str, prefix: str, width: int = 3) -> DataFrame:
    """Codes for new rows that go on after the largest suffix of their group's codes."""
    last = old.groupBy(group).agg(F.max(F.regexp_extract(code, r"-(\d+)$", 1).try_cast("long")).alias("_last"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    n = (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("string")
    numbered = new.withColumn("_n", place).join(last, group, "left")
    return numbered.withColumn(code, F.concat(F.lit(prefix), F.col(group).cast("string"), F.lit("-"), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n))).drop("_n", "_last")


def partition_identity(rows: DataFrame, parts: Mapping[str, Column], **total: Column) -> DataFrame:
    """One row: the count of each part, the total, and whether the parts are disjoint and make it up."""
    hits = sum((F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()), F.lit(0))
    counts = [F.count_if(c).alias(k) for k, c in parts.items()]
    return rows.agg(*counts, F.count("*").alias("total"), (F.count_if(hits != 1) == 0).alias("holds"))


def hub_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (name, n): how many rows each table has."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def guard(chars: Column, header: Column, number: Column, date: Column, records: Column, image_pages: Column, declared: Column, least_chars: int = 200) -> Column:
    """The first reason to refuse an act's file, null if it is fine."""
    return (
        F.when(chars < least_chars, "no text layer").when(~header, "unknown form").when(number.isNull() | date.isNull(), "no number or date").when(records == 0, "no records")
        .when(image_pages > 0, "image page").when(declared.isNotNull() & (declared != records), "declared differs")
    )


def issues(rows: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """Rows (key, issue) for each check that is true of a row."""
    named = F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))
    return rows.select(key, F.explode(named).alias("issue"))


def restore_channel(current: DataFrame, saved: DataFrame, channel: str, which: str) -> DataFrame:
    """The current rows with those of one channel as they were saved."""
    return current.where(~F.col(channel).eqNullSafe(F.lit(which))).unionByName(saved.where(F.col(channel) == which))


def labour_hours(works: DataFrame, rows: DataFrame) -> DataFrame:
    """Hours of works(work_id, paragraph, numbers, volume) by rows(paragraph, condition_numbers, hours): the only row of the paragraph, else the only one that shares a number; else manual."""
    found = works.join(rows, "paragraph", "left")
    shares = F.coalesce(F.arrays_overlap("numbers", "condition_numbers"), F.lit(False))
    of = found.groupBy("work_id").agg(F.count("hours").alias("n"), F.count_if(shares).alias("hits"), F.max("hours").alias("only"), F.max(F.when(shares, F.col("hours"))).alias("hit"), F.max("volume").alias("volume"))
    hours = F.when(F.col("n") == 1, F.col("only")).when(F.col("hits") == 1, F.col("hit"))
    return of.select("work_id", (hours * F.col("volume")).alias("hours"), F.when(hours.isNotNull(), "auto").otherwise("manual").alias("how"))
