"""Inspection findings: registry, dashboard, links and the comparison of two acts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import removed, violation_status
from .versioned import latest


def latest_items(items: DataFrame) -> DataFrame:
    """The newest act's item of each finding."""
    return latest(items, ["finding_id"], ["act_id", "item_no", "act_date", "responsible_id"])


def with_status(items: DataFrame) -> DataFrame:
    gone = removed(F.col("is_active"), F.col("resolved"))
    return items.withColumn("removed", gone).withColumn("state", violation_status(F.col("removed"), F.col("rejected"), F.col("fixed"), F.col("needs_design")))


def dashboard(current: DataFrame) -> DataFrame:
    """One row of tiles over the newest items."""
    open_ = ~F.col("removed")
    return current.agg(F.count("*").alias("total"), F.count_if(F.col("removed")).alias("removed"), F.count_if(open_).alias("active"), F.count_if(open_ & F.col("fixed") & ~F.col("needs_design")).alias("ready"), F.count_if(open_ & F.col("needs_design") & ~F.col("rejected")).alias("needs_design"), F.count_if(open_ & F.col("responsible_id").isNull()).alias("no_responsible"))


def by_responsible(current: DataFrame, names: DataFrame) -> DataFrame:
    """Open findings by who is responsible."""
    open_ = current.where("not removed and responsible_id is not null").groupBy("responsible_id").agg(F.count("*").alias("open"), F.count_if(F.col("state") == "ready").alias("ready"))
    return open_.join(names, open_.responsible_id == names.s_suppkey).select("responsible_id", F.col("s_name").alias("name"), "open", "ready")


def link_candidates(rows: DataFrame, linked: DataFrame, key: str, query: str, column: str, n: int = 100) -> DataFrame:
    """Unlinked rows whose column holds the query, whatever its case; the first n by key (a pick list)."""
    return rows.join(linked, key, "left_anti").where(F.col(column).ilike(f"%{query}%")).orderBy(key).limit(n)


def import_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Each key as new, carried, changed or removed between two versions."""
    a, b = before.select(key, F.col(value).alias("was")), after.select(key, F.col(value).alias("now"))
    out = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "carried").otherwise("changed")
    return out.select(key, kind.alias("change"))


def too_many_closed(diff: DataFrame, most: float = 0.5) -> DataFrame:
    """One row: whether an import would close more than so large a share of what was there."""
    return diff.agg(F.count_if(F.col("change") == "removed").alias("closing"), F.count_if(F.col("change") != "new").alias("before")).withColumn("refuse", F.col("closing") > most * F.col("before"))
