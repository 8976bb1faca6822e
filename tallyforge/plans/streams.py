"""Queries that run tables through keyed state on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import roles as r
from ..streaming import state as st
from .registry import query

FACTS = "facts as (select user_id, cast(ts as date) as day, event_id, case when event_id % 3 = 0 then 'excel' else 'web' end as channel, ts, case when event_id % 4 <> 0 then cast(event_id % 11 as int) end as plan, cast(event_id % 7 as int) as fact from events)"
KEYS, ORDER = ["user_id", "day"], ["ts", "event_id"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of entries of two channels, a few files at a time."""
    schema = r.read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, so that it may be a file or a folder
    n = F.col("event_id")
    return rows.select("user_id", F.to_date("ts").alias("day"), n, F.when(n % 3 == 0, "excel").otherwise("web").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.when(n % 4 != 0, (n % 11).cast("int")).alias("plan"), (n % 7).cast("int").alias("fact"))


@query(f"""with {FACTS}, last as (select * from facts qualify row_number() over (partition by user_id, day order by ts desc, event_id desc) = 1), planned as (select user_id, day, plan from facts where plan is not null qualify row_number() over (partition by user_id, day order by ts desc, event_id desc) = 1)
 select user_id, day, event_id, fact, coalesce(l.plan, p.plan) as plan from last l left join planned p using (user_id, day)""")
def stream_two_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged entry of two channels, held by a stream's state."""
    updates = st.run_to_end(st.merge_channels(facts(spark, sf_dir), KEYS, "channel", ORDER, "plan", "fact"), "update")
    return st.last_of(updates, KEYS).select("user_id", "day", "event_id", "fact", "plan")


@query(f"""with {FACTS}, f as (select *, lag(event_id) over w as before, lag(fact) over w as old_fact, lag(plan) over w as old_plan from facts window w as (partition by user_id, day order by ts, event_id)),
 j as (select *, '{{"fact": ' || coalesce(cast(fact as varchar), 'null') || ', "plan": ' || coalesce(cast(plan as varchar), 'null') || '}}' as new_row, '{{"fact": ' || coalesce(cast(old_fact as varchar), 'null') || ', "plan": ' || coalesce(cast(old_plan as varchar), 'null') || '}}' as old from f)
 select user_id, day, event_id, case when before is null then 'insert' else 'update' end as op, case when before is not null then old end as old_row, new_row from j where before is null or old <> new_row""")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of an entry with what it was before."""
    return st.run_to_end(st.audit_feed(facts(spark, sf_dir), KEYS, ORDER, ["fact", "plan"])).select("user_id", "day", "event_id", "op", "old_row", "new_row")
