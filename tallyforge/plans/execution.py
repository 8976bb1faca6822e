"""Queries on works, plans and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import evm, forecast, versioned
from ..sources import roles as r
from .registry import query

TE, TO, DIRECTIVE = r.TODAY_EVENTS, r.TODAY_ORDERS, "1999-12-31"
LATEST = "order by updated_at desc, id desc"
MERGED = f"""{r.PROGRESS}, last as (select * from progress qualify row_number() over (partition by date, work_id {LATEST}) = 1),
 plan as (select * from progress where planned is not null qualify row_number() over (partition by date, work_id {LATEST}) = 1),
 merged as (select l.date, l.work_id, l.actual, l.pct, coalesce(l.planned, p.planned) as planned from last l left join plan p using (date, work_id))"""
DAILY = "daily as (select date, cast(sum(planned) as bigint) as planned, cast(sum(actual) as bigint) as actual, count(actual) as with_actual from merged group by 1)"
WORKDAYS = "(select count(*) from range({a}::date + 1, {b}::date + 1, interval 1 day) d(x) where isodow(x) < 6)"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.latest_with_plan(r.progress(spark, sf_dir), ["date", "work_id"], ["updated_at", "id"], ["planned"])


@query(f"""with {MERGED}, {DAILY} select * from (select date, planned, actual, cast(sum(coalesce(planned, 0)) over (order by date) as bigint) as planned_total,
 case when with_actual > 0 then cast(sum(coalesce(actual, 0)) over (order by date) as bigint) end as actual_total from daily) where date between date '2024-01-05' and date '2024-01-25'""")
def scurve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.s_curve(evm.daily_totals(merged(spark, sf_dir)), "2024-01-05", "2024-01-25")


@query(f"with {r.PROGRESS} select id, date, work_id, planned, actual from progress qualify row_number() over (partition by date, work_id {LATEST}) = 1")
def latest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.latest(r.progress(spark, sf_dir), ["date", "work_id"], ["updated_at", "id"]).select("id", "date", "work_id", "planned", "actual")


@query(f"with {MERGED} select date, work_id, planned, actual from merged")
def latest_fact_plan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("date", "work_id", "planned", "actual")


@query(f"with {r.PROGRESS} select work_id, date, actual from progress where actual is not null qualify row_number() over (partition by work_id order by date desc, updated_at desc, id desc) = 1")
def latest_actual_per_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.latest_actual(r.progress(spark, sf_dir))


@query(f"with {r.CREWS} select date, cast(sum(planned) as bigint) as planned, cast(sum(actual) as bigint) as actual, count(actual) as with_actual from crews group by 1")
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.daily_totals(r.crews(spark, sf_dir))


@query(f"with {r.CREWS} select work_id, cast(sum(planned) as bigint) as effort from crews where source = 'excel' group by 1")
def effort_per_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.crews(spark, sf_dir).where("source = 'excel'").groupBy("work_id").agg(F.sum("planned").alias("effort"))


@query(f"""with {r.CREWS}, {r.WORKS}, e as (select work_id, sum(planned) as effort from crews where source = 'excel' group by 1)
 select cast(sum(effort * (100 - coalesce(pct, 0))) as double) / 100 as remaining, count(effort) as known, count(*) - count(effort) as unknown
 from works left join e using (work_id) where pct is null or pct < 100""")
def remaining_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.remaining_effort(r.crews(spark, sf_dir), r.works(spark, sf_dir)).withColumn("remaining", F.col("remaining").cast("double"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    effort = r.crews(spark, sf_dir).groupBy("work_id").agg(F.sum(F.when(F.col("source") == "excel", F.col("planned"))).alias("effort"), F.max("planned").alias("crew"))
    return evm.weights(r.works(spark, sf_dir), effort)


WEIGHTED = f"""{r.CREWS}, {r.WORKS}, e as (select work_id, sum(planned) filter (where source = 'excel') as effort, max(planned) as crew from crews group by 1),
 weighted as (select works.*, case when effort > 0 then effort when crew > 0 then crew else 1 end as weight,
 case when effort > 0 then 'effort' when crew > 0 then 'crew' else 'one' end as weight_source from works left join e using (work_id))"""


@query(f"with {WEIGHTED} select work_id, cast(weight as bigint) as weight, weight_source from weighted")
def work_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir).select("work_id", F.col("weight").cast("long").alias("weight"), "weight_source")


@query(f"with {WEIGHTED} select round(cast(sum(weight * coalesce(pct, 0)) as double) / cast(sum(weight) as double), 6) as progress, count(*) filter (where pct is null) as unknown, count(*) as works from weighted")
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.weighted_progress(weighted(spark, sf_dir)).withColumn("progress", F.round("progress", 6))


EVM_WEIGHTED = f"""{r.WORKS}, e as (select work_id, sum(planned) as effort from progress where source = 'excel' and planned is not null group by 1),
 weighted as (select works.*, case when effort is not null and effort > 0 then effort when p_size > 0 then p_size else 1 end as weight from works left join e using (work_id) join part on p_partkey = work_id)"""


@query(f"""with {MERGED}, {EVM_WEIGHTED}, l as (select max(date) as last_date from progress where actual is not null),
 d as (select sum(weight) as total_weight, round_even(cast(sum(weight * coalesce(pct, 0)) as double) / cast(sum(weight) as double), 1) as progress, count(*) filter (where pct is null) as unknown from weighted),
 s as (select last_date, coalesce(sum(planned), 0) as pv, coalesce(sum(actual), 0) as ac, count(*) filter (where date >= last_date - 13 and planned > 0) as promised, count(*) filter (where date >= last_date - 13 and planned > 0 and actual >= planned) as met from merged, l where date <= last_date group by 1)
 select last_date, progress, cast(total_weight as bigint) as total_weight, unknown, cast(pv as bigint) as planned_value, cast(ac as bigint) as actual_cost, round_even(progress / 100 * cast(total_weight as double), 1) as earned_value,
 round_even(progress / 100 * cast(total_weight as double) / nullif(cast(pv as double), 0), 2) as spi, round_even(progress / 100 * cast(total_weight as double) / nullif(cast(ac as double), 0), 2) as cpi, promised, met, round_even(met * 100.0::double / nullif(promised, 0), 1) as ppc from s, d""")
def evm_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.progress(spark, sf_dir)
    effort = rows.where("source = 'excel' and planned is not null").groupBy("work_id").agg(F.sum("planned").alias("effort"))
    crew = r.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_size").alias("crew"))
    return evm.earned_value(rows, merged(spark, sf_dir), evm.weights(r.works(spark, sf_dir), crew.join(effort, "work_id", "left")))


PPC = "count(*) filter (where planned > 0) as promised, count(*) filter (where planned > 0 and actual >= planned) as met, round(100.0 * count(*) filter (where planned > 0 and actual >= planned) / nullif(count(*) filter (where planned > 0), 0), 6)::double as ppc"


@query(f"with {MERGED} select {PPC} from merged where date > date '{TE}' - 14 and date <= date '{TE}'")
def ppc_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = forecast.day(TE)
    return evm.promises(merged(spark, sf_dir).where((F.col("date") > F.date_sub(today, 14)) & (F.col("date") <= today)))


@query(f"with {MERGED} select cast(date_trunc('week', date) as date) as week, {PPC} from merged group by 1 having count(*) filter (where planned > 0) > 0")
def ppc_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.promises_by_week(merged(spark, sf_dir))


@query(f"""with {r.CREWS}, d as (select date, cast(sum(planned) as bigint) as required, cast(sum(coalesce(actual, 0)) as bigint) as present from crews group by 1)
 select date, required, present, case when present < required then required - present end as deficit, case when present > required then present - required end as surplus, round(100.0 * present / nullif(required, 0), 6)::double as coverage from d""")
def resource_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = r.crews(spark, sf_dir).groupBy("date").agg(F.sum("planned").alias("required"), F.sum(F.coalesce("actual", F.lit(0))).alias("present"))
    return days.withColumns(evm.deficit(F.col("required"), F.col("present")))


@query(f"with {r.CREWS}, {r.WORKS} select works.source, cast(sum(planned) as bigint) as planned, cast(sum(actual) as bigint) as actual, count(actual) as with_actual from crews join works using (work_id) where crews.source = 'excel' group by 1")
def plan_fact_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.crews(spark, sf_dir).where("source = 'excel'").drop("source").join(r.works(spark, sf_dir).select("work_id", "source"), "work_id")
    return evm.daily_totals(rows, "source")


DONE = "coalesce(status in ('done_physically','submitted','accepted','closed','cancelled'), false)"
FINE = "coalesce(confidence in ('high','medium'), false)"
RESOLVED = f"""{r.TERMS}, resolved as (select *, coalesce(current_finish, case when {FINE} then plan_finish end) as finish from terms where coalesce(current_finish, case when {FINE} then plan_finish end) is not null)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.resolved_terms(r.terms(spark, sf_dir))


@query(f"with {RESOLVED} select work_id, finish, date_diff('day', finish, date '{TO}') as lag_days from resolved where finish < date '{TO}' and not {DONE}")
def overdue_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.overdue(resolved(spark, sf_dir), TO, "finish").select("work_id", "finish", F.col("lag_days").cast("long").alias("lag_days"))


@query(f"""with {RESOLVED}, a as (select max(finish) as last_finish, count(*) filter (where finish < date '{TO}') as late_works,
 cast(coalesce(round_even(avg(date_diff('day', finish, date '{TO}')) filter (where finish < date '{TO}'), 0), 0) as int) as mean_lag from resolved where not {DONE})
 select last_finish, late_works, mean_lag, last_finish + mean_lag as forecast from a""")
def baseline_lag_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.baseline_lag(resolved(spark, sf_dir), TO)


@query(f"with {r.SCHEDULE} select work_id, case when date_diff('day', start_date, plan_finish) > 0 then round(cast(date_diff('day', start_date, date '{TO}') * 100.0 as double) / date_diff('day', start_date, plan_finish), 1) end as position from schedule")
def schedule_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.schedule(spark, sf_dir).select("work_id", forecast.position(F.col("start_date"), F.col("plan_finish"), forecast.day(TO)).cast("double").alias("position"))


@query(f"with {r.SCHEDULE} select work_id, cast({WORKDAYS.format(a='start_date', b='plan_finish')} as int) as days from schedule where plan_finish is not null")
def working_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.schedule(spark, sf_dir).where("plan_finish is not null").select("work_id", cal.working_days(F.col("start_date"), F.col("plan_finish")).alias("days"))


@query(f"""with {r.SCHEDULE}, n as (select work_id, start_date, work_id % 50 as k from schedule) select work_id, start_date as finish from n where k = 0
 union all select work_id, finish from (select work_id, cast(x as date) as finish, k, row_number() over (partition by work_id order by x) as nth from (select work_id, k, unnest(range(start_date + 1, start_date + 90, interval 1 day)) as x from n where k > 0) where isodow(x) < 6) where nth = k""")
def date_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.schedule(spark, sf_dir).select("work_id", cal.add_working_days(F.col("start_date"), (F.col("work_id") % 50).cast("int")).alias("finish"))


@query(f"""with {r.SCHEDULE}, w as (select work_id, amount, {WORKDAYS.format(a='start_date', b='plan_finish')} as days from schedule) select work_id, case when days > 0 then cast(ceil(cast(amount as double) / 1000 / days) as bigint) end as people from w""")
def people_for_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.schedule(spark, sf_dir).select("work_id", forecast.people_for_date(F.col("amount").cast("double") / 1000, F.col("start_date"), F.col("plan_finish")).alias("people"))


REMAINING = f"""{r.WORKS}, x as (select work_id, sum(planned) as effort from progress where source = 'excel' group by 1),
 todo as (select cast(sum(effort * (100 - coalesce(pct, 0))) as double) / 100 as remaining, count(effort) as known, count(*) - count(effort) as unknown from works left join x using (work_id) where pct is null or pct < 100)"""


@query(f"""with {MERGED}, {DAILY}, {REMAINING}, l as (select * from daily where actual is not null order by date desc limit 14), p as (select round(cast(sum(actual) as double) / count(*), 2) as pace from l),
 n as (select pace, remaining, cast(ceil(remaining / pace) as int) as days_needed from p, todo), c as (select cast(x as date) as x, row_number() over (order by x) as k from range(date '{TE}' + 1, date '{TE}' + 4000, interval 1 day) d(x) where isodow(x) < 6)
 select pace, remaining, days_needed, (select x from c where k = days_needed) as forecast from n""")
def pace_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = evm.remaining_effort(r.progress(spark, sf_dir), r.works(spark, sf_dir)).select(F.col("remaining").cast("double").alias("remaining"))
    return forecast.pace_forecast(evm.daily_totals(merged(spark, sf_dir)), left, TE)


@query("""select cast(isoyear(ts) as int) as iso_year, cast(weekofyear(ts) as int) as iso_week, user_id, event_id, value from events qualify row_number() over (partition by isoyear(ts), weekofyear(ts), user_id order by ts, event_id) = 1""")
def week_snapshot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.first_of_week(r.read(spark, sf_dir, "events"))


@query(f"""with {r.TERMS} select work_id, coalesce(current_start, plan_start) as start, case when executor_type = 'subcontract' and subcontractor_id is null then 'no subcontractor' else '' end as obstacles from terms
 where (current_start is not null or {FINE}) and status = 'not_started' and coalesce(current_start, plan_start) between date '{TO}' and date '{TO}' + 14""")
def lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.lookahead(r.terms(spark, sf_dir), TO)


@query(f"""with {RESOLVED}, {r.BLOCKERS}, {r.CREWS}, o as (select work_id, count(*) as open from blockers where resolved is null group by 1), e as (select order_id as work_id, sum(planned) filter (where source = 'excel') as effort from crews group by 1),
 la as (select order_id as work_id, actual from crews where actual is not null qualify row_number() over (partition by order_id order by date desc, line_no desc) = 1),
 s as (select s.*, open, effort, actual, (select count(*) from range(date '{TO}' + 1, least(finish, date '{DIRECTIVE}') + 1, interval 1 day) d(x) where isodow(x) < 6) as days from resolved s left join o using (work_id) left join e using (work_id) left join la using (work_id) where not {DONE})
 select work_id, concat_ws(', ', case when finish < date '{TO}' then 'overdue' end, case when finish > date '{DIRECTIVE}' then 'after directive' end, case when open > 0 then 'blocked ' || open end) as reasons,
 case when days > 0 and effort is not null then cast(greatest(ceil(cast(effort * (100 - coalesce(pct, 0)) as double) / 100 / days) - coalesce(actual, 0), 0) as bigint) end as extra_people from s where finish < date '{TO}' or finish > date '{DIRECTIVE}' or open > 0""")
def critical_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    crews = r.crews(spark, sf_dir).withColumn("work_id", F.col("order_id"))
    effort = crews.groupBy("work_id").agg(F.sum(F.when(F.col("source") == "excel", F.col("planned"))).alias("effort"))
    last = versioned.latest(crews.where("actual is not null"), ["work_id"], ["date", "line_no"])
    return forecast.critical(resolved(spark, sf_dir), r.blockers(spark, sf_dir), effort, last, TO, DIRECTIVE)


def facts(rows: DataFrame, **values) -> DataFrame:
    """Rows (metric, value as text) of a table with one row."""
    pairs = [F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in values.items()]
    return rows.select(F.explode(F.array(*pairs)).alias("f")).select("f.*")


@query(f"""with {MERGED}, {DAILY}, {REMAINING}, {RESOLVED}, late as (select max(finish) as last_finish, count(*) as active, count(*) filter (where finish < date '{TO}') as late_works, cast(coalesce(round_even(avg(date_diff('day', finish, date '{TO}')) filter (where finish < date '{TO}'), 0), 0) as int) as mean_lag from resolved where not {DONE}),
 lastday as (select planned, actual from daily where date = (select max(date) from progress where actual is not null)), l as (select * from daily where actual is not null order by date desc limit 14), p as (select round(cast(sum(actual) as double) / count(*), 2) as pace from l)
 select 'overdue_count' as metric, late_works::varchar as value from late union all select 'baseline_date', last_finish::varchar from late union all select 'avg_lag', mean_lag::varchar from late union all select 'baseline_lag_forecast', (last_finish + mean_lag)::varchar from late
 union all select 'works_with_baseline', count(*)::varchar from resolved union all select 'known_works', known::varchar from todo union all select 'excluded_works', unknown::varchar from todo
 union all select 'required_crew', planned::varchar from lastday union all select 'actual_crew', actual::varchar from lastday union all select 'deficit', (case when actual < planned then planned - actual end)::varchar from lastday
 union all select 'days_needed', cast(ceil(remaining / pace) as int)::varchar from p, todo""")
def criticality_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overdue works, the baseline's lag, remaining effort at the recent pace, and the crew of the last day with an actual."""
    c, terms = F.col, resolved(spark, sf_dir)
    lag = forecast.baseline_lag(terms, TO)
    left = evm.remaining_effort(r.progress(spark, sf_dir), r.works(spark, sf_dir)).withColumn("remaining", c("remaining").cast("double"))
    totals = evm.daily_totals(merged(spark, sf_dir))
    last = totals.where("actual is not null").orderBy(F.desc("date")).limit(1)
    pace = forecast.pace_forecast(totals, left, TE)
    parts = [
        facts(lag, overdue_count=c("late_works"), baseline_date=c("last_finish"), avg_lag=c("mean_lag"), baseline_lag_forecast=c("forecast")), facts(terms.agg(F.count("*").alias("n")), works_with_baseline=c("n")), facts(left, known_works=c("known"), excluded_works=c("unknown")),
        facts(last.withColumns(evm.deficit(c("planned"), c("actual"))), required_crew=c("planned"), actual_crew=c("actual"), deficit=c("deficit")), facts(pace, days_needed=c("days_needed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""with {r.CREWS}, {r.WORKS} select coalesce(location, 'none') as place, cast(sum(planned) as bigint) as planned, cast(sum(actual) as bigint) as actual, count(distinct work_id) as works from crews join works using (work_id) where date = date '{TO}' group by 1""")
def report_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.crews(spark, sf_dir).where(F.col("date") == forecast.day(TO)).join(r.works(spark, sf_dir), "work_id")
    return rows.groupBy(F.coalesce("location", F.lit("none")).alias("place")).agg(F.sum("planned").alias("planned"), F.sum("actual").alias("actual"), F.count_distinct("work_id").alias("works"))


@query(f"with {r.CREWS} select order_id, line_no, work_id, planned - coalesce(actual, 0) as missing from crews where date = date '{TO}' and planned > coalesce(actual, 0)")
def report_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.crews(spark, sf_dir).where((F.col("date") == forecast.day(TO)) & (F.col("planned") > F.coalesce("actual", F.lit(0))))
    return rows.select("order_id", "line_no", "work_id", (F.col("planned") - F.coalesce("actual", F.lit(0))).alias("missing"))


@query(f"""with {r.BLOCKERS} select kind, count(*) filter (where raised = date '{TO}') as arisen, count(*) filter (where resolved = date '{TO}') as closed from blockers group by 1""")
def report_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = forecast.day(TO)
    return r.blockers(spark, sf_dir).groupBy("kind").agg(F.count_if(F.col("raised") == today).alias("arisen"), F.count_if(F.coalesce(F.col("resolved") == today, F.lit(False))).alias("closed"))


@query(f"""with {r.CREWS}, {r.BLOCKERS}, l as (select date, greatest(coalesce(sum(planned), 0) - coalesce(sum(actual), 0), 0) as lost from crews where date between date '{TO}' - 365 and date '{TO}' group by 1)
 select kind, cast(sum(coalesce(lost, 0)) as bigint) as lost, count(*) as blockers from blockers left join l on date = raised where raised between date '{TO}' - 365 and date '{TO}' group by 1""")
def loss_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.losses(r.crews(spark, sf_dir), r.blockers(spark, sf_dir), TO, 365)


@query(f"""with {r.BLOCKERS} select count(*) as blockers, count(distinct raised) as days, count(*) - count(distinct raised) as overlap_days from blockers where raised between date '{TO}' - 365 and date '{TO}'""")
def loss_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.loss_overlap(r.blockers(spark, sf_dir), TO, 365)


@query(f"""with {r.BLOCKERS} select kind, round(cast(sum(date_diff('day', raised, resolved)) as double) / count(resolved), 6) as mean_days, count(resolved) as resolved, count(*) - count(resolved) as open, cast(max(case when resolved is null then date_diff('day', raised, date '{TO}') end) as int) as oldest_open from blockers group by 1""")
def resolution_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.resolution_time(r.blockers(spark, sf_dir), TO)


@query(f"""with {r.CREWS} select work_id, date, cast(sum(planned) as bigint) as planned, cast(sum(actual) as bigint) as actual, count(actual) as with_actual from crews where date between date '{TO}' and date '{TO}' + 29 group by 1, 2""")
def gantt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = forecast.day(TO)
    return evm.daily_totals(r.crews(spark, sf_dir).where(F.col("date").between(first, F.date_add(first, 29))), "work_id", "date")


SHIFT = """{progress}, {works}, p as (select work_id, planned from progress where date = date '{day}' and source = 'excel' and planned is not null qualify row_number() over (partition by work_id {latest}) = 1),
 f as (select work_id, pct as fact_pct, actual as fact from progress where date = date '{day}' and source = 'web' qualify row_number() over (partition by work_id {latest}) = 1)
 select work_id, planned, fact_pct, fact, f.work_id is not null as filled from (select work_id from works where case when (select count(*) from p) > 0 then work_id in (select work_id from p) else coalesce(pct, 0) < 100 end) w left join p using (work_id) left join f using (work_id)"""


def shift(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    return evm.shift_sheet(r.progress(spark, sf_dir), r.works(spark, sf_dir), day)


@query("with " + SHIFT.format(progress=r.PROGRESS, works=r.WORKS, day=TE, latest=LATEST))
def shift_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift(spark, sf_dir, TE)


@query("with " + SHIFT.format(progress=r.PROGRESS, works=r.WORKS, day="2030-01-01", latest=LATEST))
def shift_sheet_without_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day for which nothing is planned shows all works that are not done."""
    return shift(spark, sf_dir, "2030-01-01")


@query(f"""with {r.CREWS} select team_id, cast(sum(planned) as bigint) as planned, round(cast(sum(actual) as double) / count(actual), 1) as mean_actual, count(distinct date) as days from crews group by 1""")
def executor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.crews(spark, sf_dir).groupBy("team_id").agg(F.sum("planned").alias("planned"), F.round(F.sum("actual").cast("double") / F.count("actual"), 1).alias("mean_actual"), F.count_distinct("date").alias("days"))


@query(f"""with {r.WORKS} select work_id, case when pct is null or pct = 0 then 'not_started' when pct >= 100 then 'done_physically' else 'in_progress' end as status from works""")
def derived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.expressions import work_status

    return r.works(spark, sf_dir).select("work_id", work_status(F.col("pct")).alias("status"))


@query(f"""with {r.CREWS}, d as (select distinct work_id, date from crews where planned > 0), m as (select *, lag(date) over (partition by work_id order by date) as before from d),
 g as (select work_id, date, case when before is null or (select count(*) from range(before + 1, date, interval 1 day) x(y) where isodow(y) < 6) > 0 then 1 else 0 end as fresh from m),
 i as (select *, sum(fresh) over (partition by work_id order by date) as island from g) select work_id, cast(island as int) as island, min(date) as first_day, max(date) as last_day, count(*) as days from i group by 1, 2""")
def plan_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.islands(r.crews(spark, sf_dir), "work_id", "date")


@query(f"""with {r.CREWS}, {r.WORKS}, e as (select work_id, sum(planned) as effort from crews group by 1) select round(corr(cast(effort as double), cast(volume as double)), 6) as correlation, count(*) as works from works join e using (work_id)""")
def effort_volume_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    effort = r.crews(spark, sf_dir).groupBy("work_id").agg(F.sum("planned").alias("effort"))
    return r.works(spark, sf_dir).join(effort, "work_id").agg(F.round(F.corr(F.col("effort").cast("double"), F.col("volume").cast("double")), 6).alias("correlation"), F.count("*").alias("works"))
