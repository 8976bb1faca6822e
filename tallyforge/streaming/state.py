"""Keyed state on streams: two channels merged into one row, and an audit feed of what changed."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.versioned import latest
from ..session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def plain(row: tuple, kinds: list[str]) -> tuple:
    """A row's values as state and JSON take them; pandas holds whole numbers as floats where one is null."""
    value = lambda v, kind: int(v) if kind in ("tinyint", "smallint", "int", "bigint") else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
    return tuple(None if pd.isna(v) else value(v, kind) for v, kind in zip(row, kinds))


def newer(a: tuple | None, b: tuple | None) -> bool:
    """Whether version a, (time, number), comes after b."""
    return a is not None and (b is None or a > b)


class Channels(StatefulProcessor):
    """The newest row of each channel, and its newest row that has a plan; the merged row goes out when it changes."""

    def __init__(self, keys: list[str], channel: str, order: list[str], plan: str, value: str, types: dict[str, str], ttl_ms: int | None) -> None:
        self.keys, self.channel, self.order, self.plan, self.value, self.types, self.ttl_ms = keys, channel, order, plan, value, types, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        at = ", ".join(f"{c} {self.types[c]}" for c in self.order)
        self.rows = handle.getMapState("rows", "channel string", f"{at}, value {self.types[self.value]}, plan {self.types[self.plan]}", self.ttl_ms)
        self.plans = handle.getMapState("plans", "channel string", f"{at}, plan {self.types[self.plan]}", self.ttl_ms)

    def merged(self) -> tuple | None:
        n = len(self.order)
        last = max(((tuple(r)[:n], tuple(r)[n:]) for _, r in self.rows.iterator()), key=lambda x: x[0], default=None)
        plan = max(((tuple(r)[:n], tuple(r)[n]) for _, r in self.plans.iterator()), key=lambda x: x[0], default=None)
        return last and (*last[0], last[1][0], last[1][1] if last[1][1] is not None else plan and plan[1])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before, names = self.merged(), [self.channel, *self.order, self.value, self.plan]
        for some in rows:
            for r in some[names].itertuples(index=False):
                channel, *at, value, plan = plain(tuple(r), [self.types[c] for c in names])
                of = lambda state: tuple(state.getValue((channel,)))[: len(at)] if state.containsKey((channel,)) else None  # noqa: B023, E731
                if newer(tuple(at), of(self.rows)):
                    self.rows.updateValue((channel,), (*at, value, plan))
                if plan is not None and newer(tuple(at), of(self.plans)):
                    self.plans.updateValue((channel,), (*at, plan))
        after = self.merged()
        if after is not None and after != before:
            yield pd.DataFrame([(*key, *after)], columns=[*self.keys, *self.order, self.value, self.plan])

    def close(self) -> None:
        pass


def merge_channels(stream: DataFrame, keys: list[str], channel: str, order: list[str], plan: str, value: str, ttl_ms: int | None = None) -> DataFrame:
    """The merged row of each key whenever it changes: that of the newest row of either channel, its plan, where null, from the newest row that has one.

    Late and repeated rows change nothing.  order is a time and a number that tells rows apart.
    With ttl_ms, a channel that was not heard of for so long is forgotten, which takes Python for
    each key; without, channels don't matter to the newest rows, and Spark's own aggregation holds them.
    """
    if ttl_ms is None:
        now = F.unix_millis(F.current_timestamp())  # of the batch, the same when it is run again
        rows = stream.withColumn("_came", -now)  # a row that comes again is older than it was
        newest = lambda *columns: F.struct(*order, *columns, "_came")
        held = rows.groupBy(*keys).agg(F.max(newest(value, plan)).alias("_last"), F.max(F.when(F.col(plan).isNotNull(), newest(plan))).alias("_plan"))
        changed = held.where((F.col("_last._came") == -now) | (F.col(f"_last.{plan}").isNull() & (F.col("_plan._came") == -now)))
        return changed.select(*keys, *(f"_last.{c}" for c in (*order, value)), F.coalesce(f"_last.{plan}", f"_plan.{plan}").alias(plan))
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"{c} {types[c]}" for c in (*keys, *order, value, plan))
    return stream.groupBy(*keys).transformWithStateInPandas(Channels(keys, channel, order, plan, value, types, ttl_ms), out, "Update", "None")


def as_json(columns: list[str], schema: T.StructType, row: str) -> Column:
    """A struct's columns as JSON with a blank after commas and colons, nulls included; dates, times and decimals as strings."""
    text = lambda c: F.col(f"{row}.{c}").cast("string") if isinstance(schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)) else F.col(f"{row}.{c}")
    one = lambda c: F.regexp_extract(F.to_json(F.struct(text(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ": "), one(c)) for c in columns)), F.lit("}"))


@dataclass
class AuditFeed:
    """A stream's entries, and what a batch of them makes of the newest entry of each key before it."""

    entries: DataFrame
    keys: list[str]
    order: list[str]
    columns: list[str]

    @property
    def sparkSession(self) -> SparkSession:
        return self.entries.sparkSession

    @property
    def schema(self) -> T.StructType:
        known = self.entries.schema
        return T.StructType([known[c] for c in (*self.keys, *self.order)]).add("op", "string").add("old_row", "string").add("new_row", "string")

    def step(self, batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The events of a batch, and the newest entries after it."""
        both = batch.withColumn("_held", F.lit(False))
        if before is not None:
            both = before.withColumn("_held", F.lit(True)).unionByName(both)
        of_key = Window.partitionBy(*self.keys)
        at, now, old = F.struct(*self.order), F.struct(*self.columns), F.col("_old")
        rows = both.select(*self.keys, *self.order, now.alias("_new"), "_held", at.alias("_at")).withColumn("_from", F.max(F.when(F.col("_held"), F.col("_at"))).over(of_key))
        rows = rows.where(F.col("_held") | F.col("_from").isNull() | (F.col("_at") > F.col("_from")))
        in_turn = of_key.orderBy("_at")
        rows = rows.withColumns({"_old": F.lag("_new").over(in_turn), "_before": F.lag("_at").over(in_turn)}).where("_held or _before is null or _before != _at")
        fresh = rows.where(~F.col("_held") & (F.col("_before").isNull() | ~F.col("_new").eqNullSafe(old)))
        known = self.entries.schema
        events = fresh.select(*self.keys, *self.order, F.when(old.isNull(), "insert").otherwise("update").alias("op"), F.when(old.isNotNull(), as_json(self.columns, known, "_old")).alias("old_row"), as_json(self.columns, known, "_new").alias("new_row"))
        return events, latest(both.drop("_held"), self.keys, self.order)


def audit_feed(stream: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> AuditFeed:
    """An event for each change of a key's columns: keys, order, op (insert, update), old_row and new_row as JSON; run_to_end runs it.

    A row that comes again, or after a newer one, gives none.  order is a time and a number
    that tells a key's rows apart; rows of one batch are taken in that order.  The newest
    rows of all keys are a table that each batch writes anew from the one before it.
    """
    return AuditFeed(stream.select(*keys, *order, *(c for c in columns if c not in (*keys, *order))), keys, order, columns)


def run_to_end(stream: DataFrame | AuditFeed, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All that a stream gives for its present input, with the number of its batch: written by batches, which may be run again, and read back."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one for state by key in Python
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        if isinstance(stream, AuditFeed):
            held = lambda n: f"{folder}/held/b={n}"
            own = batch.sparkSession
            batch, newest = stream.step(batch, own.read.schema(stream.entries.schema).parquet(held(number - 1)) if number else None)
            newest.write.mode("overwrite").parquet(held(number))
            old = own._jvm.org.apache.hadoop.fs.Path(held(number - 2))  # a batch that is run again needs the one before it only
            old.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    entries = stream.entries if isinstance(stream, AuditFeed) else stream
    entries.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields]).add("batch", T.IntegerType())).option("recursiveFileLookup", True).parquet(f"{folder}/out")


def last_of(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    return latest(updates, keys, ["batch"]).drop("batch")
