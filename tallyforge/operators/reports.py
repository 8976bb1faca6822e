"""Smaller reports: norm plans, reconciliations, guards, journals, coverage and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_working_days


def norm_plan(items: DataFrame, start: str) -> DataFrame:
    """items(item_id, hours, people) with the working days they take (8 hours each) and the day they end; null without people."""
    days = F.when(F.col("people") > 0, F.ceil(F.col("hours") / 8 / F.col("people")).cast("int"))
    return items.select("item_id", days.alias("days"), add_working_days(F.lit(start).cast("date"), days).alias("finish"))


def evidence(tokens: DataFrame, facts: DataFrame, on: str, value: str) -> DataFrame:
    """By kind and prefix of code tokens: how many there are and how many hold a fact in their range."""
    from .matching import range_join

    known = tokens.where("low is not null")
    hit = range_join(facts, known, on, value, "low", "high").select(on, "place").distinct().withColumn("_hit", F.lit(1))
    return tokens.join(hit, [on, "place"], "left").groupBy("kind", "prefix").agg(F.count("*").alias("tokens"), F.count("_hit").alias("resolved"))


def reconciliation(registry: DataFrame, act: DataFrame, key: str) -> DataFrame:
    """One row: keys of both, of the registry only, of the act only."""
    both = registry.select(key).distinct().withColumn("_r", F.lit(1)).join(act.select(key).distinct().withColumn("_a", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("_r").isNotNull() & F.col("_a").isNotNull()).alias("both"), F.count_if(F.col("_a").isNull()).alias("registry_only"), F.count_if(F.col("_r").isNull()).alias("act_only"))


def previous_version(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each version with the value of the one strictly before it."""
    return items.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def package_amounts(rows: DataFrame, by: str, amount: str, vat: Column) -> DataFrame:
    """By status: how many, the amount with tax, and the share of all rows in percent, to one decimal."""
    out = rows.groupBy(by).agg(F.count("*").alias("packages"), (F.sum(F.coalesce(F.col(amount), F.lit(0).cast("decimal(18,2)"))) * vat).cast("decimal(28,2)").alias("with_tax"))
    everything = F.sum("packages").over(Window.partitionBy())  # one row a status
    return out.withColumn("percent", F.round(F.try_divide(F.lit(100.0) * F.col("packages"), everything), 1))


def blocked_amounts(parts: list[DataFrame], closed: tuple[str, ...]) -> DataFrame:
    """Amounts above 0 of rows that are not closed, over several registers of (source, id, status, amount)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(~F.col("status").isin(*closed) & (F.col("amount") > 0))


def journal(events: DataFrame, where: Column, time: str, key: str, n: int = 200) -> DataFrame:
    """The latest n actions."""
    return events.where(where).orderBy(F.desc(time), F.desc(key)).limit(n)


def coverage(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    """By book: entries, those with a value, percent."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.round(100.0 * F.count_if(ok) / F.count("*"), 1).alias("percent"))


def display_order(rows: DataFrame, group: str, row: str) -> DataFrame:
    """Groups numbered by their first row, and rows within their group."""
    first = rows.groupBy(group).agg(F.min(row).alias("_first"))
    numbered = first.withColumn("site_no", F.dense_rank().over(Window.orderBy("_first")))  # one row a group
    return rows.join(numbered.drop("_first"), group).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(row)))


def remarks(rows: DataFrame, group: str, text: str, most: int = 60) -> DataFrame:
    """The distinct remarks of each group, each cut at so many characters for display, in order."""
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)
    return rows.where(F.col(text).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.transform(F.collect_set(text), cut)), "; ").alias("remarks"))
