"""The test tables seen in the roles of the domain's tables, as DataFrames and as the same SQL.

events are versioned plan and fact records and a status log, part the works, orders
the schedule, blockers, folders and changes, lineitem the daily crews and findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dates that stand for today; queries never read the clock.
TODAY_EVENTS, TODAY_ORDERS = "2024-01-20", "1999-06-15"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan and fact records: several versions for a date and work, from two channels."""
    kind, whole = F.col("event_type"), F.floor("value").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("user_id").alias("work_id"), F.col("ts").alias("updated_at"),
        F.when(kind.isin("view", "click"), whole % 51).alias("planned"), F.when(kind.isin("purchase", "signup"), whole % 51).alias("actual"),
        F.when(kind.isin("error", "signup"), F.least(whole, F.lit(100))).alias("pct"), F.when(kind.isin("view", "purchase"), "excel").otherwise("web").alias("source"),
    )


PROGRESS = """progress as (select event_id as id, cast(ts as date) as date, user_id as work_id, ts as updated_at,
 case when event_type in ('view','click') then cast(floor(value) as int) % 51 end as planned,
 case when event_type in ('purchase','signup') then cast(floor(value) as int) % 51 end as actual,
 case when event_type in ('error','signup') then least(cast(floor(value) as int), 100) end as pct,
 case when event_type in ('view','purchase') then 'excel' else 'web' end as source from events)"""

STATUSES = ("signed", "signed in pencil", "in progress", "returned")


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status entries of documentation rows and work types; some have no work type."""
    name = F.element_at(F.array(*(F.lit(s) for s in STATUSES)), (F.floor("value").cast("int") % 4 + 1))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("row_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("work_type"), name.alias("status"), F.to_date("ts").alias("status_date"), F.col("ts").alias("created_at"), (F.col("user_id") % 5).cast("int").alias("tab_id"))


STATUS_LOG = """status_log as (select event_id as id, user_id as row_id, case when event_type <> 'error' then event_type end as work_type,
 ['signed','signed in pencil','in progress','returned'][cast(floor(value) as int) % 4 + 1] as status,
 cast(ts as date) as status_date, ts as created_at, cast(user_id % 5 as int) as tab_id from events)"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with a percentage done (unknown for some), a place, a source and a volume."""
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("name"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("location"), F.col("p_type").alias("source"), F.when(size % 7 != 0, F.least(size * 3, F.lit(100))).alias("pct"), F.col("p_retailprice").cast("decimal(18,2)").alias("volume"))


WORKS = """works as (select p_partkey as work_id, p_name as name, case when p_brand <> 'Brand#1' then p_brand end as location, p_type as source,
 case when p_size % 7 <> 0 then least(p_size * 3, 100) end as pct, cast(p_retailprice as decimal(18,2)) as volume from part)"""


def crews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily planned and actual crews of works."""
    q = F.col("l_quantity").cast("int")
    return read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("work_id"), q.alias("planned"), F.when(F.col("l_returnflag") != "N", (q + F.col("l_linenumber") * 3 - 9)).alias("actual"), F.col("l_suppkey").alias("team_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.when(F.col("l_linestatus") == "F", "excel").otherwise("web").alias("source"))


CREWS = """crews as (select cast(l_shipdate as date) as date, l_partkey as work_id, cast(l_quantity as int) as planned,
 case when l_returnflag <> 'N' then cast(l_quantity as int) + l_linenumber * 3 - 9 end as actual, l_suppkey as team_id, l_orderkey as order_id,
 l_linenumber as line_no, case when l_linestatus = 'F' then 'excel' else 'web' end as source from lineitem)"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with baseline and planned finish dates."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        k.alias("work_id"), F.col("o_custkey").alias("customer_id"), start.alias("start_date"), F.when(k % 11 != 0, F.date_add(start, (k % 90 + 5).cast("int"))).alias("plan_finish"), F.when(k % 7 != 0, F.date_add(start, (k % 60).cast("int"))).alias("baseline_finish"),
        F.when(F.col("o_orderstatus") == "F", "done_physically").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("not_started").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (k % 3 + 1).cast("int")).alias("confidence"),
    )


SCHEDULE = """schedule as (select o_orderkey as work_id, o_custkey as customer_id, cast(o_orderdate as date) as start_date,
 case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 90 + 5 as int) end as plan_finish,
 case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 60 as int) end as baseline_finish,
 case o_orderstatus when 'F' then 'done_physically' when 'P' then 'in_progress' else 'not_started' end as status,
 cast(o_totalprice as decimal(18,2)) as amount, ['high','medium','low'][o_orderkey % 3 + 1] as confidence from orders)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with baseline dates of some confidence, current dates of a few, who does them and a percentage."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "done_physically").when(F.col("o_orderstatus") == "P", "in_progress").when(k % 13 != 0, "not_started")
    return read(spark, sf_dir, "orders").select(
        k.alias("work_id"), status.alias("status"), start.alias("plan_start"), F.when(k % 7 != 0, F.date_add(start, (k % 60).cast("int"))).alias("plan_finish"),
        F.when(k % 5 == 0, F.date_add(start, 3)).alias("current_start"), F.when(k % 5 == 0, F.date_add(start, (k % 90 + 5).cast("int"))).alias("current_finish"), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (k % 3 + 1).cast("int")).alias("confidence"),
        F.when(k % 2 == 0, "subcontract").otherwise("own").alias("executor_type"), F.when(k % 4 != 0, F.col("o_custkey")).alias("subcontractor_id"), F.when(k % 9 != 0, (k % 101).cast("int")).alias("pct"),
    )


TERMS = """terms as (select o_orderkey as work_id, case when o_orderstatus = 'F' then 'done_physically' when o_orderstatus = 'P' then 'in_progress' when o_orderkey % 13 <> 0 then 'not_started' end as status,
 cast(o_orderdate as date) as plan_start, case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 60 as int) end as plan_finish,
 case when o_orderkey % 5 = 0 then cast(o_orderdate as date) + 3 end as current_start, case when o_orderkey % 5 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 90 + 5 as int) end as current_finish,
 ['high','medium','low'][o_orderkey % 3 + 1] as confidence, case when o_orderkey % 2 = 0 then 'subcontract' else 'own' end as executor_type, case when o_orderkey % 4 <> 0 then o_custkey end as subcontractor_id,
 case when o_orderkey % 9 <> 0 then cast(o_orderkey % 101 as int) end as pct from orders)"""


def blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops works, from when to when (open ones have no end)."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select(k.alias("blocker_id"), F.col("o_custkey").alias("work_id"), F.col("o_orderpriority").alias("kind"), start.alias("raised"), F.when(F.col("o_orderstatus") == "F", F.date_add(start, (k % 40).cast("int"))).alias("resolved"))


BLOCKERS = """blockers as (select o_orderkey as blocker_id, o_custkey as work_id, o_orderpriority as kind, cast(o_orderdate as date) as raised,
 case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 40 as int) end as resolved from orders)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of documents with the dates of their stages and two amounts."""
    k, start, price = F.col("o_orderkey"), F.to_date("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)")
    stage = lambda n, days: F.when(k % 6 >= n, F.date_add(start, days))
    return read(spark, sf_dir, "orders").select(k.alias("folder_id"), F.col("o_custkey").alias("contract_id"), start.alias("formed"), stage(1, 5).alias("sent"), stage(2, 12).alias("checked"), stage(3, 20).alias("signed"), stage(4, 45).alias("paid"), F.when(k % 4 != 0, price).alias("amount"), F.when(k % 3 == 0, (price * 2).cast("decimal(18,2)")).alias("estimate"), F.when(k % 5 == 0, F.col("o_orderpriority")).alias("rejection"))


FOLDERS = """folders as (select o_orderkey as folder_id, o_custkey as contract_id, cast(o_orderdate as date) as formed,
 case when o_orderkey % 6 >= 1 then cast(o_orderdate as date) + 5 end as sent, case when o_orderkey % 6 >= 2 then cast(o_orderdate as date) + 12 end as checked,
 case when o_orderkey % 6 >= 3 then cast(o_orderdate as date) + 20 end as signed, case when o_orderkey % 6 >= 4 then cast(o_orderdate as date) + 45 end as paid,
 case when o_orderkey % 4 <> 0 then cast(o_totalprice as decimal(18,2)) end as amount,
 case when o_orderkey % 3 = 0 then cast(cast(o_totalprice as decimal(18,2)) * 2 as decimal(18,2)) end as estimate,
 case when o_orderkey % 5 = 0 then o_orderpriority end as rejection from orders)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of inspection acts: a finding recurs in later acts with its state then."""
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("finding_id"), F.col("l_orderkey").alias("act_id"), n.alias("item_no"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("responsible_id"), (F.col("l_linestatus") == "O").alias("is_active"), F.when(n != 4, F.col("l_returnflag") == "R").alias("resolved"), (F.col("l_quantity").cast("int") % 8 == 0).alias("rejected"), (F.col("l_quantity").cast("int") % 3 == 0).alias("fixed"), (F.col("l_quantity").cast("int") % 7 == 0).alias("needs_design"), F.to_date("l_shipdate").alias("act_date"))


FINDINGS = """findings as (select l_partkey as finding_id, l_orderkey as act_id, l_linenumber as item_no, case when l_suppkey % 9 <> 0 then l_suppkey end as responsible_id,
 l_linestatus = 'O' as is_active, case when l_linenumber <> 4 then l_returnflag = 'R' end as resolved, cast(l_quantity as int) % 8 = 0 as rejected,
 cast(l_quantity as int) % 3 = 0 as fixed, cast(l_quantity as int) % 7 = 0 as needs_design, cast(l_shipdate as date) as act_date from lineitem)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for changes with a due date and, for some, an answer."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select(k.alias("change_id"), F.col("o_custkey").alias("section_id"), start.alias("requested"), F.when(k % 6 != 0, F.date_add(start, (k % 30).cast("int"))).alias("due"), F.when(k % 4 == 0, F.date_add(start, (k % 45).cast("int"))).alias("answered"), F.element_at(F.array(F.lit("open"), F.lit("approved"), F.lit("review"), F.lit("rejected"), F.lit(None)), (k % 5 + 1).cast("int")).alias("status"))


CHANGES = """changes as (select o_orderkey as change_id, o_custkey as section_id, cast(o_orderdate as date) as requested,
 case when o_orderkey % 6 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 30 as int) end as due,
 case when o_orderkey % 4 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 45 as int) end as answered,
 ['open','approved','review','rejected',null][o_orderkey % 5 + 1] as status from orders)"""
