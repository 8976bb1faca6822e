"""Queries of ingest operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators.versioned import latest
from ..session import shared_folder
from ..sources import readers as rd
from ..sources import roles as r
from .registry import query

@query("select o_orderkey, o_custkey, case when o_orderkey % 7 <> 0 then concat(o_orderpriority, chr(9), 'a\\b') end as note from orders")
def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as blocks of a database dump, a block for each day between those of other tables, and read back from all splits."""
    cell = F.when(F.col("o_orderkey") % 7 == 0, "\\N").otherwise(F.concat("o_orderpriority", F.lit("\\ta\\\\b")))
    row = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), cell)
    block = F.concat(F.lit("COPY public.days (d) FROM stdin;\n"), F.first(F.col("o_orderdate").cast("string")), F.lit("\n\\.\n\nCOPY public.orders (id, customer, note) FROM stdin;\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\n\\.\n"))
    path = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    r.read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate")).agg(block.alias("value")).select("value").write.text(path)
    rows = rd.read_copy(spark, path, "orders", ["id", "customer", "note"])
    return rows.select(F.col("id").cast("long").alias("o_orderkey"), F.col("customer").cast("long").alias("o_custkey"), "note")


REPLIES = "replies as (select cast(ts as date) as date, sum(value) as rain, min(value) as low, max(value) as high, max(case when hour(ts) = 9 then value end) as nine, cast(max(event_id) % 90 as int) as code, count(*) as n from events group by 1)"


@query(f"with {REPLIES} select date, case when n % 5 > 0 then round(low, 3) end as lowest, case when n % 5 > 0 then round(high, 3) end as highest, case when n % 5 > 0 then code end as code, case when n % 5 > 0 then round(nine, 3) end as temperature_09, case when n % 5 = 0 then 'error' else 'ok' end as status, case when n % 5 = 0 then 'unreadable reply' when nine is null then 'no reading at 09:00' end as note from replies")
def weather_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's weather from replies with parallel arrays, each fifth of which can't be read; the later of two replies holds."""
    day = r.read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.when(F.hour("ts") == 9, F.col("value"))).alias("nine"), (F.max("event_id") % 90).cast("int").alias("code"), F.count("*").alias("n"))
    time, one = F.col("d").cast("string"), lambda x, name: F.array(x).alias(name)
    daily = F.struct(one(time, "time"), one(F.round("low", 3), "temperature_2m_min"), one(F.round("high", 3), "temperature_2m_max"), one(F.col("code"), "weathercode"))
    hourly = F.when(F.col("nine").isNotNull(), F.struct(one(F.concat(time, F.lit("T09:00")), "time"), one(F.round("nine", 3), "temperature_2m")))
    reply = F.when(F.col("n") % 5 == 0, "<html>busy</html>").otherwise(F.to_json(F.struct(daily.alias("daily"), hourly.alias("hourly"))))
    last = day.select(F.col("d").alias("first_day"), F.col("d").alias("last_day"), reply.alias("reply"), F.lit(2).alias("fetched_at"))
    replies = last.unionByName(last.withColumns({"fetched_at": F.lit(1), "reply": F.lit("{}")}))
    return latest(rd.weather_days(replies), ["date"], ["fetched_at"]).select("date", "lowest", "highest", "code", "temperature_09", "status", "note")


DAYS = [f"{d:02d}" for d in range(1, 32)]


@query("select l_partkey as work_id, cast(l_shipdate as date) as date, 'plan' as kind, cast(max(l_quantity) as int) as value from lineitem group by 1, 2 union all select l_partkey, cast(l_shipdate as date), 'fact', cast(min(l_quantity) as int) from lineitem where l_linenumber < 4 group by 1, 2")
def unpivot_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a row for each work and month and columns for its days, as rows."""
    rows = r.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_id"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").cast("int").alias("q"), "l_linenumber")
    on = lambda d: F.dayofmonth("d") == int(d)
    cells = [x for d in DAYS for x in (F.max(F.when(on(d), F.col("q"))).alias(f"plan_{d}"), F.min(F.when(on(d) & (F.col("l_linenumber") < 4), F.col("q"))).alias(f"fact_{d}"))]
    wide = rows.groupBy("work_id", F.trunc("d", "month").alias("month")).agg(*cells)
    return rd.unpivot_calendar(wide, ["work_id", "month"], DAYS, ("plan", "fact"), "month")


@query("""with l as (select l_partkey as work_id, cast(l_shipdate as date) as date, case when l_returnflag = 'N' then 'plan' else 'fact' end as kind, cast(l_quantity as int) as value, l_orderkey * 10 + l_linenumber as seq, case when l_linenumber = 1 then l_linestatus end as comment from lineitem)
 select work_id, date, max_by(value, (seq, value)) filter (where kind = 'plan') as planned, max_by(value, (seq, value)) filter (where kind = 'fact') as actual, coalesce(string_agg(comment, '; ' order by seq, comment), '') as comment from l group by 1, 2""")
def fold_plan_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "plan").otherwise("fact")
    q = F.col("l_quantity").cast("int")
    long = rows.select(F.col("l_partkey").alias("work_id"), F.to_date("l_shipdate").alias("date"), kind.alias("kind"), q.alias("value"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), q.alias("v")).alias("seq"), F.when(F.col("l_linenumber") == 1, F.col("l_linestatus")).alias("comment"))
    return rd.fold_plan_fact(long, ["work_id"], "seq")


@query("""with t as (select conv_id, turn, case when role = 'user' then turn end as key, text, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as int) as record from conversations)
 select conv_id, record, min(key) as key, string_agg(text, ' ' order by turn, text) as text from t group by 1, 2""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "conversations").withColumn("key", F.when(F.col("role") == "user", F.col("turn")))
    return rd.continuation_merge(rows, "key", "turn", "text", ["conv_id"])


@query("select l_orderkey, l_linenumber, l_shipdate, last_value(case when l_linenumber % 3 = 1 then l_returnflag end ignore nulls) over (partition by l_orderkey order by (l_linenumber, l_shipdate, l_partkey, l_suppkey) rows between unbounded preceding and current row) as section from lineitem")
def section_fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "lineitem").withColumn("section", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag"))).withColumn("o", F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"))
    return rd.fill_down(rows, ["l_orderkey"], "o", "section").select("l_orderkey", "l_linenumber", "l_shipdate", "section")


@query("""with b as (select conv_id, turn, case when turn % 4 in (1, 2) then '' else role end as role from conversations), c as (select *, sum(case when role = '' then 1 else 0 end) over (partition by conv_id order by turn rows between 1 preceding and current row) as run from b),
 d as (select *, max(case when run = 2 then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and current row) as over from c) select conv_id, turn, role from d where role <> '' and over = 0""")
def rows_until_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 < 1, F.col("role")).when(F.col("turn") % 4 > 2, F.col("role")).otherwise("").alias("role"))
    return rd.stop_after_blanks(rows, ["conv_id"], "turn", "role", 2)


@query()
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.html_rows(r.read(spark, sf_dir, "pages"), "page_id", "html")


@query("""select p_partkey, case when p_size % 4 = 0 then p_size when p_size % 4 = 1 then p_size + 5 when p_size % 4 = 2 then p_size end as crew, p_size % 4 = 3 as needs_review from part""")
def crew_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    cell = F.when(F.col("p_size") % 4 == 0, n).when(F.col("p_size") % 4 == 1, F.concat(n, F.lit(" - "), (F.col("p_size") + 5).cast("string"))).when(F.col("p_size") % 4 == 2, F.concat(n, F.lit(" people"))).otherwise("contractor")
    c = ex.crew(cell)
    return r.read(spark, sf_dir, "part").select("p_partkey", c["value"].alias("crew"), c["needs_review"].alias("needs_review"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, case when cast(json_extract_string(props, '$.k') as int) <= 0 then 'ok' when cast(json_extract_string(props, '$.k') as int) <= 7 then 'risk' else 'danger' end as class from events")
def deviation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return r.read(spark, sf_dir, "events").select("event_id", k.alias("k"), ex.deviation_class(k).alias("class"))
