"""Queries of the smaller reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fd
from ..operators import progress as pg
from ..operators import reports as rp
from ..sources import roles as r
from .matching import TOKENS, tokens
from .registry import query

START = "1999-03-01"


@query(f"""with c as (select cast(x as date) as x, row_number() over (order by x) as k from range(date '{START}' + 1, date '{START}' + 400, interval 1 day) d(x) where isodow(x) < 6),
 i as (select p_partkey as item_id, case when p_size % 6 > 0 then cast(ceil(p_size * 12.0 / 8 / (p_size % 6)) as int) end as days from part) select item_id, days, x as finish from i left join c on k = days""")
def norm_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return rp.norm_plan(r.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (size * 12).alias("hours"), (size % 6).alias("people")), START)


@query(f"""with {TOKENS} select kind, prefix, count(*) as tokens, count(*) filter (where exists (select 1 from lineitem where l_partkey = p_partkey and cast(l_quantity as int) between low and high)) as resolved from tokens group by 1, 2""")
def evidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = r.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("n"))
    return rp.evidence(tokens(spark, sf_dir), facts, "p_partkey", "n")


@query("with a as (select distinct l_partkey as k from lineitem where l_linestatus = 'F'), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'R') select count(*) filter (where a.k is not null and b.k is not null) as both, count(*) filter (where b.k is null) as registry_only, count(*) filter (where a.k is null) as act_only from a full join b on a.k = b.k".replace(" as both,", ' as "both",'))
def act_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "lineitem")
    key = lambda c: rows.where(c).select(F.col("l_partkey").alias("k"))
    return rp.reconciliation(key("l_linestatus = 'F'"), key("l_returnflag = 'R'"), "k")


@query("with d as (select coalesce(a.k, b.k) as k, a.k is null as new, b.k is null as gone from (select distinct o_custkey as k from orders where o_orderstatus = 'F') a full join (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT') b on a.k = b.k) select count(*) filter (where gone) as closing, count(*) filter (where not new) as before, count(*) filter (where gone) > 0.5 * count(*) filter (where not new) as refuse from d")
def mass_closure_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "orders")
    key = lambda c: rows.where(c).select(F.col("o_custkey").alias("k")).distinct().withColumn("v", F.lit(1))
    return fd.too_many_closed(fd.import_diff(key("o_orderstatus = 'F'"), key("o_orderpriority = '1-URGENT'"), "k", "v"))


@query("with m as (select l_partkey, l_orderkey, max(l_quantity) as q from lineitem group by 1, 2) select l_partkey, l_orderkey, lag(q) over (partition by l_partkey order by l_orderkey) as previous_q from m")
def previous_act_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = r.read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_quantity").alias("q"))
    return rp.previous_version(items, "l_partkey", "l_orderkey", "q").select("l_partkey", "l_orderkey", "previous_q")


@query(f"with {r.FOLDERS}, s as (select case when paid is not null then 'paid' when sent is not null then 'sent' else 'forming' end as stage, amount from folders) select stage, count(*) as packages, cast(sum(coalesce(amount, 0)) * 1.20 as decimal(28,2)) as with_tax, round(100.0 * count(*) / sum(count(*)) over (), 1)::double as percent from s group by 1")
def package_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("paid").isNotNull(), "paid").when(F.col("sent").isNotNull(), "sent").otherwise("forming")
    return rp.package_amounts(r.folders(spark, sf_dir).withColumn("stage", stage), "stage", "amount", F.lit("1.20").cast("decimal(3,2)"))


@query("select 'order' as source, o_orderkey as id, o_orderstatus as status, cast(o_totalprice as decimal(18,2)) as amount from orders where o_orderstatus not in ('F') and cast(o_totalprice as decimal(18,2)) > 0 union all select 'account', c_custkey, c_mktsegment, cast(c_acctbal as decimal(18,2)) from customer where c_mktsegment not in ('F') and cast(c_acctbal as decimal(18,2)) > 0")
def blocked_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t, name, key, status, amount: r.read(spark, sf_dir, t).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.col(status).alias("status"), F.col(amount).cast("decimal(18,2)").alias("amount"))
    return rp.blocked_amounts([part("orders", "order", "o_orderkey", "o_orderstatus", "o_totalprice"), part("customer", "account", "c_custkey", "c_mktsegment", "c_acctbal")], ("F",))


@query("select event_id, user_id, event_type from events where event_type = 'purchase' order by ts desc, event_id desc limit 200")
def action_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.journal(r.read(spark, sf_dir, "events"), F.col("event_type") == "purchase", "ts", "event_id").select("event_id", "user_id", "event_type")


@query("select p_brand, count(*) as total, count(*) filter (where p_size > 10) as ok, round(100.0 * count(*) filter (where p_size > 10) / count(*), 1)::double as percent from part group by 1")
def norm_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.coverage(r.read(spark, sf_dir, "part"), "p_brand", F.col("p_size") > 10)


@query("with f as (select p_brand, min(p_partkey) as first from part group by 1), n as (select p_brand, cast(dense_rank() over (order by first) as int) as site_no from f) select p_partkey, site_no, cast(row_number() over (partition by p_brand order by p_partkey) as int) as place from part join n using (p_brand)")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.display_order(r.read(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", "site_no", "place")


@query("with c as (select p_brand, case when length(p_name) > 8 then concat(substring(p_name, 1, 8), '…') else p_name end as t from part where p_name is not null) select p_brand, string_agg(distinct t, '; ' order by t) as remarks from c group by 1")
def group_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.remarks(r.read(spark, sf_dir, "part"), "p_brand", "p_name", 8)


@query(f"with {r.STATUS_LOG} select row_id, min(status_date) as first_signed from status_log where status = 'signed' group by 1")
def first_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.status_tier_first(r.status_log(spark, sf_dir))
