"""The versioned operators on streams: newest fact per key, windowed totals, first snapshot of a week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versioned import latest
from ..sources.readers import weather_days


def latest_facts(stream: DataFrame, keys: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """The newest version of each key as a running state; versions later than the watermark allows are dropped."""
    rest = [c for c in stream.columns if c not in (*keys, ts)]
    return stream.withWatermark(ts, late).groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("v")).select(*keys, "v.*")


def daily_totals(stream: DataFrame, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """Sums by event-time day, sent on once the watermark has passed the day."""
    day = F.window(ts, "1 day")
    return stream.withWatermark(ts, late).groupBy(day).agg(F.sum(value).alias("total"), F.count("*").alias("rows")).select(F.col("window.start").cast("date").alias("date"), "total", "rows")


def first_of_week(stream: DataFrame, key: str, ts: str, late: str = "7 days") -> DataFrame:
    """The first row of each key and ISO week that arrives within the watermark."""
    week = F.window(ts, "7 days", startTime="4 days")  # epoch day 4 was a Monday
    return stream.withWatermark(ts, late).groupBy(key, week).agg(F.min(F.struct(ts, *(c for c in stream.columns if c not in (key, ts)))).alias("v")).select(key, F.col("window.start").cast("date").alias("week"), "v.*")


def poll_days(replies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Days of weather replies that come in, kept by date in versions of a table under path: the last reply about a day holds, and one that comes again changes nothing."""
    return upsert_into(weather_days(replies), path, ["date"], ["fetched_at"], checkpoint)


def upsert_into(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key in versions of a Parquet table under path: each batch writes one named by its number, so a batch that is run again writes the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}") if number else batch.limit(0)
        latest(old.unionByName(batch), keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").start()
