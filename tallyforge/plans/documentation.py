"""Queries on documentation status, folders, money, changes and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.expressions import folder_cost, overdue_days, status_tier
from ..functions import expressions as ex
from ..operators import findings as fd
from ..operators import progress as pg
from ..operators.forecast import day
from ..sources import roles as r
from .registry import query

TE, TO = r.TODAY_EVENTS, r.TODAY_ORDERS
CURRENT = f"{r.STATUS_LOG}, current as (select * from status_log qualify row_number() over (partition by row_id order by created_at desc, id desc) = 1)"
WEEKS = """weeks as (select cast(date_diff('day', date '2024-01-01', x) / 7 as int) as week_no, cast(greatest(x, date '2024-01-03') as date) as week_start, cast(least(x + 6, date '2024-01-28') as date) as week_end
 from (select cast(x as date) as x from range(date '2024-01-01', date '2024-01-29', interval 7 day) d(x)))"""


def week_grid(spark: SparkSession) -> DataFrame:
    return cal.weeks(spark, "2024-01-03", "2024-01-28")


@query(f"with {CURRENT} select row_id, status, status_date from current")
def latest_status_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.current_status(r.status_log(spark, sf_dir)).select("row_id", "status", "status_date")


BY_TYPE = "select row_id, work_type, status from status_log {where} qualify row_number() over (partition by row_id, work_type order by created_at desc, id desc) = 1"


@query(f"with {r.STATUS_LOG} {BY_TYPE.format(where='where work_type is not null')}")
def latest_status_by_row_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.current_by_type(r.status_log(spark, sf_dir)).select("row_id", "work_type", "status")


@query(f"with {r.STATUS_LOG} {BY_TYPE.format(where='')}")
def latest_status_with_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.current_by_type(r.status_log(spark, sf_dir), with_untyped=True).select("row_id", "work_type", "status")


TIER = "case when status like 'signed in pencil%' then 1 when status like 'signed%' then 2 when status is null or status = '' then 0 else 1 end"


@query(f"""with {CURRENT} select count(*) as total, count(*) filter (where {TIER} = 2) as signed, count(*) filter (where status = 'in progress') as under_way, count(*) filter (where status = 'returned') as returned,
 count(*) - count(*) filter (where {TIER} = 2) - count(*) filter (where status in ('in progress', 'returned')) as rest from current""")
def progress_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.tiles(pg.current_status(r.status_log(spark, sf_dir)))


@query(f"""with {CURRENT} select t.tab_id, count(*) filter (where {TIER} = 2) as green, count(*) filter (where {TIER} = 1 and status <> 'returned') as yellow, count(*) filter (where status = 'returned') as red
 from (select cast(x as int) as tab_id from range(7) r(x)) t left join current c on c.tab_id = t.tab_id group by 1""")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.stream(pg.current_status(r.status_log(spark, sf_dir)), spark.range(7).select(F.col("id").cast("int").alias("tab_id")))


@query(f"""with {r.STATUS_LOG}, {WEEKS} select k.row_id, week_no, week_end, (select status from status_log s where s.row_id = k.row_id and s.status_date <= week_end order by status_date desc, created_at desc, id desc limit 1) as status
 from (select distinct row_id from status_log) k, weeks""")
def state_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.state_matrix(r.status_log(spark, sf_dir), week_grid(spark)).select("row_id", "week_no", "week_end", "status")


@query(f"""with {r.STATUS_LOG}, {WEEKS}, cells as (select k.row_id, k.work_type, week_no, (select status from status_log s where s.row_id = k.row_id and s.work_type = k.work_type and s.status_date <= week_end order by status_date desc, created_at desc, id desc limit 1) as status
 from (select distinct row_id, work_type from status_log where work_type is not null) k, weeks) select row_id, week_no, count(*) filter (where {TIER} = 2) as signed, count(*) as types from cells group by 1, 2""")
def signed_count_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.signed_as_of(r.status_log(spark, sf_dir), week_grid(spark))


@query(f"with {WEEKS} select * from weeks")
def week_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return week_grid(spark)


@query(f"""with {r.STATUS_LOG}, latest as ({BY_TYPE.format(where='where work_type is not null')}) select t.work_type, l.status from (select distinct work_type from status_log where work_type is not null) t left join latest l on l.work_type = t.work_type and l.row_id = 7""")
def drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = r.status_log(spark, sf_dir).where("work_type is not null")
    types = log.select("work_type").distinct()
    return types.join(pg.current_by_type(log.where("row_id = 7")).select("work_type", "status"), "work_type", "left")


@query(f"""with {CURRENT}, f as (select row_id, min(status_date) as first_signed from status_log where status = 'signed' group by 1), m as (select tab_id, status, count(*) as n from current where status <> 'signed' group by 1, 2)
 select c.tab_id, count(*) as members, count(*) filter (where {TIER} = 2) as signed, max(first_signed) as last_first_signed,
 (select status from m where m.tab_id = c.tab_id order by n desc, status limit 1) as usual from current c left join f using (row_id) group by c.tab_id""")
def group_rollup_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.group_rollup(r.status_log(spark, sf_dir))


@query(f"""with {CURRENT}, u as (select distinct user_id as row_id from events where event_type = 'error' and value > 200) select row_id, tab_id from current c where {TIER} = 2 and not exists (select 1 from u where u.row_id = c.row_id)""")
def available_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = r.read(spark, sf_dir, "events").where("event_type = 'error' and value > 200").select(F.col("user_id").alias("row_id"))
    return pg.current_status(r.status_log(spark, sf_dir)).where(status_tier(F.col("status")) == 2).join(used, "row_id", "left_anti").select("row_id", "tab_id")


STAGE = "case when paid is not null then 'paid' when signed is not null then 'ks2_signed' when checked is not null then 'checked' when sent is not null then 'sent' else 'forming' end"
COST = "coalesce(estimate, amount)"


@query(f"""with {r.FOLDERS}, s as (select {STAGE} as stage, count(*) as folders, sum({COST}) as cost, count({COST}) as with_cost from folders group by 1)
 select t.stage, coalesce(folders, 0) as folders, cast(coalesce(cost, 0) as decimal(28,2)) as cost, coalesce(with_cost, 0) as with_cost from (values ('forming'), ('sent'), ('checked'), ('ks2_signed'), ('paid')) t(stage) left join s using (stage)""")
def folder_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = r.folders(spark, sf_dir)
    return pg.funnel(folders, pg.stage_table(folders))


@query(f"""with {r.FOLDERS}, c as (select *, cast(coalesce({COST}, 0) as decimal(18,2)) as cost from folders) select contract_id, cast(sum(cost) as decimal(28,2)) as contract, cast(sum(case when signed is not null then cost else 0 end) as decimal(28,2)) as ks2,
 cast(sum(case when paid is not null then cost else 0 end) as decimal(28,2)) as ks3, count(signed) as ks2_count, cast(sum(cost) - sum(case when paid is not null then cost else 0 end) as decimal(28,2)) as remaining from c group by 1""")
def folder_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.balance(r.folders(spark, sf_dir))


@query(f"""with {r.FOLDERS}, l as (select folder_id, 1 as stage_no, 'sent' as stage, sent as date from folders union all select folder_id, 2, 'checked', checked from folders union all select folder_id, 3, 'ks2_signed', signed from folders union all select folder_id, 4, 'paid', paid from folders)
 select folder_id, stage, date from l where date is not null order by date desc, folder_id, stage_no limit 10""")
def folder_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.transitions(r.folders(spark, sf_dir))


@query(f"with {r.FOLDERS} select folder_id from folders where not exists (select 1 from lineitem where l_orderkey = folder_id)")
def folder_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.folders(spark, sf_dir).join(r.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("folder_id")), "folder_id", "left_anti").select("folder_id")


@query(f"with {r.FOLDERS}, n as (select l_orderkey as folder_id, count(*) as sections from lineitem group by 1) select folder_id, coalesce(sections, 0) as sections, cast({COST} as decimal(18,2)) as cost from folders left join n using (folder_id)")
def folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = r.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("folder_id")).agg(F.count("*").alias("sections"))
    return r.folders(spark, sf_dir).join(sections, "folder_id", "left").select("folder_id", F.coalesce("sections", F.lit(0)).alias("sections"), folder_cost(F.col("estimate"), F.col("amount")).alias("cost"))


@query(f"with {r.FOLDERS} select contract_id, string_agg(distinct rejection, ', ' order by rejection) as reasons, count(distinct rejection) as kinds from folders where rejection is not null group by 1")
def folder_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_sort(F.collect_set("rejection"))  # few kinds
    return r.folders(spark, sf_dir).where("rejection is not null").groupBy("contract_id").agg(F.array_join(reasons, ", ").alias("reasons"), F.size(reasons).cast("long").alias("kinds"))


@query(f"""with {r.CHANGES} select change_id, due, case when answered is null and not coalesce(status in ('approved','rejected','cancelled','closed'), false) and due < date '{TO}' then cast(date_diff('day', due, date '{TO}') as int) end as overdue from changes""")
def changes_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.changes(spark, sf_dir).select("change_id", "due", overdue_days(F.col("due"), F.col("answered"), F.col("status"), day(TO)).alias("overdue"))


LATEST_ITEM = f"""{r.FINDINGS}, latest as (select *, (not is_active or coalesce(resolved, false)) as removed from findings qualify row_number() over (partition by finding_id order by act_id desc, item_no desc, act_date desc, responsible_id desc nulls last) = 1),
 stated as (select *, case when removed then 'closed' when rejected then 'rejected' when fixed and not needs_design then 'ready' when needs_design then 'needs_design' else 'open' end as state from latest)"""


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.with_status(fd.latest_items(r.findings(spark, sf_dir)))


@query(f"with {LATEST_ITEM} select finding_id, act_id, item_no, responsible_id from latest")
def violation_latest_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.latest_items(r.findings(spark, sf_dir)).select("finding_id", "act_id", "item_no", "responsible_id")


TRACKS = ("done", "not_required", "not_done", "fact", "unknown")


@query(f"""with t as (select l_orderkey, l_linenumber, l_returnflag = 'R' and l_linestatus = 'F' as gone, l_quantity > 45 as rejected, {list(TRACKS)}[l_suppkey % 5 + 1] as phys, {list(TRACKS)}[l_partkey % 3 + 1] as design, {list(TRACKS)}[l_orderkey % 2 + 1] as docs from lineitem),
 s as (select case when gone then 'closed' when rejected then 'rejected' when phys in ('done', 'not_required') and design in ('done', 'not_required') and docs in ('done', 'not_required') then 'ready' when design = 'not_done' or phys = 'fact' then 'needs_rd' else 'open' end as state, phys, design from t)
 select state, phys, design, count(*) as findings from s group by all""")
def finding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by their state, as three tracks give it, and by two of the tracks."""
    track = lambda c, n: F.element_at(F.array(*map(F.lit, TRACKS)), (F.col(c) % n + 1).cast("int"))
    rows = r.read(spark, sf_dir, "lineitem").select(((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("gone"), (F.col("l_quantity") > 45).alias("rejected"), track("l_suppkey", 5).alias("phys"), track("l_partkey", 3).alias("design"), track("l_orderkey", 2).alias("docs"))
    state = ex.finding_state(F.col("gone"), F.col("rejected"), F.col("phys"), F.col("design"), F.col("docs"))
    return rows.groupBy(state.alias("state"), "phys", "design").agg(F.count("*").alias("findings"))


@query(f"""with {r.FOLDERS} select case when paid is not null then 'ks2_current' when signed is not null and estimate is not null then 'ks2_next' when signed is not null then 'signed' when sent is not null or checked is not null then 'checking' else 'formed' end as stage,
 count(*) as folders, cast(coalesce(sum(amount), 0) as decimal(28,2)) as amount from folders group by 1""")
def folder_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by the stages of the pipe of execution."""
    stage = ex.pipe_stage(F.col("paid"), F.col("signed"), F.col("estimate"), F.col("sent"), F.col("checked"))
    return r.folders(spark, sf_dir).groupBy(stage.alias("stage")).agg(F.count("*").alias("folders"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("amount"))


@query(f"with {LATEST_ITEM} select state, count(*) as findings from stated group by 1")
def violation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, sf_dir).groupBy("state").agg(F.count("*").alias("findings"))


@query(f"""with {LATEST_ITEM} select count(*) as total, count(*) filter (where removed) as removed, count(*) filter (where not removed) as active, count(*) filter (where not removed and fixed and not needs_design) as ready,
 count(*) filter (where not removed and needs_design and not rejected) as needs_design, count(*) filter (where not removed and responsible_id is null) as no_responsible from stated""")
def violation_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.dashboard(stated(spark, sf_dir))


@query(f"with {LATEST_ITEM} select responsible_id, s_name as name, count(*) as open, count(*) filter (where state = 'ready') as ready from stated join supplier on s_suppkey = responsible_id where not removed group by 1, 2")
def violation_by_responsible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.by_responsible(stated(spark, sf_dir), r.read(spark, sf_dir, "supplier"))


@query("select p_partkey, p_name from part where p_name ilike '%widget%' and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49 and l_linenumber = 1) order by p_partkey limit 100")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = r.read(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return fd.link_candidates(r.read(spark, sf_dir, "part"), linked, "p_partkey", "widget", "p_name").select("p_partkey", "p_name")


REGISTRY = "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')"


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: r.read(spark, sf_dir, t)
    rows = read("orders").where(F.col("o_orderstatus") == "O").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rows.join(read("customer"), rows.o_custkey == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"select o_orderkey, c_name, n_name, cast(o_totalprice as decimal(18,2)) as amount {REGISTRY} order by o_orderdate desc nulls last, o_orderkey limit 50 offset 100")
def registry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry_rows(spark, sf_dir).orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(100).limit(50)
    return rows.select("o_orderkey", "c_name", "n_name", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


@query(f"select count(*) as total {REGISTRY}")
def registry_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_rows(spark, sf_dir).agg(F.count("*").alias("total"))


@query("with a as (select l_partkey as k, max(l_tax) as v from lineitem where l_shipdate < timestamp '1998-01-01' group by 1), b as (select l_partkey as k, max(l_tax) as v from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1) select coalesce(a.k, b.k) as k, case when a.k is null then 'new' when b.k is null then 'removed' when a.v is not distinct from b.v then 'carried' else 'changed' end as change from a full join b on a.k = b.k")
def import_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_tax").alias("v"), "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    side = lambda c: rows.where(c).groupBy("k").agg(F.max("v").alias("v"))
    return fd.import_diff(side(F.col("l_shipdate") < cut), side(F.col("l_shipdate") >= cut), "k", "v")
