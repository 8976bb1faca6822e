"""Writes as pure functions: each returns the table's new state, to be written once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def upsert_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Only these columns are overwritten, where the new value is not null; keys unknown so far are added."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    kept = old.join(n, list(keys), "full_outer")
    return kept.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def least_merge(rows: DataFrame, keys: Sequence[str], date: str, label: str) -> DataFrame:
    """The earliest date of each key and the label that goes with it."""
    return rows.groupBy(*keys).agg(F.min(date).alias(date), F.min_by(label, F.struct(date, label)).alias(label))


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the new rows' keys are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def renumber(rows: DataFrame, order: Sequence[str], prefix: str, width: int = 9) -> DataFrame:
    """Gapless codes by an order over all rows.

    Rows are parted by ranges of the order and settled; each part's count is all that meets
    in one place, and a row's number is its place in its part after the parts before.
    """
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    totals = parts.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    n = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(totals), "_part").withColumn("code", F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))).drop("_part", "_before")


def claim_once(pairs: DataFrame, group: str, member: str) -> DataFrame:
    """Each member goes to the first group that claims it; later claims are conflicts."""
    first = pairs.groupBy(member).agg(F.min(group).alias("owner"))
    return pairs.join(first, member).select(member, group, F.when(F.col(group) == F.col("owner"), "claimed").otherwise("conflict").alias("claim"))


def merge_entities(rows: DataFrame, entity: str, key: str, into: Mapping[int, int]) -> DataFrame:
    """Children of merged entities move to the survivor unless it already has their key."""
    move = F.create_map(*(F.lit(x) for kv in into.items() for x in kv))
    target = F.coalesce(F.try_element_at(move, F.col(entity)), F.col(entity))
    own = (target == F.col(entity)).cast("int")
    ranked = rows.withColumn("_to", target).withColumn("_nth", F.row_number().over(Window.partitionBy(target, key).orderBy(own.desc(), entity)))
    return ranked.where("_nth = 1").withColumn(entity, F.col("_to")).drop("_to", "_nth")


def audit(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """An event for each changed value, old and new as JSON."""
    both = old.select(key, F.col(value).alias("was")).join(new.select(key, F.col(value).alias("now")), key)
    js = lambda c: F.to_json(F.struct(F.col(c).alias(value)))
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(key, js("was").alias("old_value"), js("now").alias("new_value"))


def only_candidate(links: DataFrame, key: str, candidate: str) -> DataFrame:
    """The candidate of keys that have exactly one."""
    return links.groupBy(key).agg(F.count_distinct(candidate).alias("n"), F.min(candidate).alias(candidate)).where("n = 1").drop("n")


def invalid(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of those they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items())))
    return rows.withColumn("errors", broken).where(F.size("errors") > 0)
