"""Queries of the data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as dq
from ..sources import roles as r
from .registry import query

PERIOD = ("2024-01-03", "2024-01-28")


def select(contour: str, rule: str, key: str, detail: str, rest: str) -> str:
    return f"select '{contour}' as contour, '{rule}' as rule, cast({key} as bigint) as key, cast({detail} as varchar) as detail {rest}"


SQL = {
    "dq_fact_outside_period": (r.PROGRESS, select("works", "fact_outside_period", "id", "date", f"from progress where actual is not null and date not between date '{PERIOD[0]}' and date '{PERIOD[1]}'")),
    "dq_over_plan": (r.CREWS, select("works", "over_plan", "order_id", "actual - planned", "from crews where actual - planned >= 3")),
    "dq_percent_decreased": (r.PROGRESS, select("works", "percent_decreased", "a.work_id", "concat(a.date, ':', a.pct, '>', b.date, ':', b.pct)", "from progress a join progress b on a.work_id = b.work_id and b.date > a.date and b.pct < a.pct where not exists (select 1 from progress c where c.work_id = a.work_id and c.pct is not null and c.date > a.date and c.date < b.date)")),
    "dq_fact_after_done": (r.PROGRESS, select("works", "fact_after_done", "id", "done", "from progress join (select work_id, min(date) as done from progress where pct >= 100 group by 1) using (work_id) where actual > 0 and date > done")),
    "dq_no_schedule": (r.WORKS, select("works", "no_schedule", "work_id", "name", "from works where work_id not in (select o_orderkey from orders where o_orderstatus = 'F') and not exists (select 1 from lineitem where l_partkey = work_id and l_quantity > 48)")),
    "dq_untyped_entry": (r.STATUS_LOG, select("documents", "untyped_entry", "id", "tab_id", "from status_log where work_type is null and tab_id in (select tab_id from status_log where work_type is not null)")),
    "dq_future_status": (r.STATUS_LOG, select("documents", "future_status", "row_id", "status_date", "from (select * from status_log qualify row_number() over (partition by row_id order by created_at desc, id desc) = 1) where status_date > date '2024-01-29'")),
    "dq_impossible_dates": (r.FOLDERS, select("documents", "impossible_dates", "folder_id", "formed", "from (select * replace (case when folder_id % 13 = 0 then formed else checked end as checked) from folders) where coalesce(checked < sent or signed < checked or paid < signed or sent < formed, false)")),
    "dq_signed_without_cost": (r.FOLDERS, select("documents", "signed_without_cost", "folder_id", "signed", "from folders where signed is not null and coalesce(estimate, amount) is null")),
    "dq_empty_folder": (r.FOLDERS, select("documents", "empty_folder", "folder_id", "formed", "from folders where not exists (select 1 from lineitem where l_orderkey = folder_id)")),
    "dq_resolved_in_last_act": (r.FINDINGS, select("findings", "resolved_in_last_act", "finding_id", "act_id", "from (select * replace (year(act_date) * 12 + month(act_date) as act_id) from findings where act_date < date '1998-06-01') where act_id = (select act_id from (select * replace (year(act_date) * 12 + month(act_date) as act_id) from findings where act_date < date '1998-06-01') order by act_date desc, act_id desc limit 1) and coalesce(resolved, false)")),
    "dq_orphan_processing": (r.FINDINGS, select("findings", "orphan_processing", "p_partkey", "null", "from part where not exists (select 1 from findings where finding_id = p_partkey and item_no > 6 and act_id % 50 = 0)")),
}


def rule_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    progress, log, folders, items = (f(spark, sf_dir) for f in (r.progress, r.status_log, r.folders, r.findings))
    lines, orders = r.read(spark, sf_dir, "lineitem"), r.read(spark, sf_dir, "orders")
    late = folders.withColumn("checked", F.when(F.col("folder_id") % 13 == 0, F.col("formed")).otherwise(F.col("checked")))
    key = lambda df, c, name: df.select(F.col(c).alias(name))
    return {
        "dq_fact_outside_period": dq.fact_outside_period(progress, *PERIOD),
        "dq_over_plan": dq.over_plan(r.crews(spark, sf_dir).withColumnRenamed("order_id", "id")),
        "dq_percent_decreased": dq.percent_decreased(progress),
        "dq_fact_after_done": dq.fact_after_done(progress),
        "dq_no_schedule": dq.no_schedule(r.works(spark, sf_dir), key(orders.where("o_orderstatus = 'F'"), "o_orderkey", "work_id"), key(lines.where("l_quantity > 48"), "l_partkey", "work_id")),
        "dq_untyped_entry": dq.untyped_entries(log),
        "dq_future_status": dq.future_status(log, "2024-01-29"),
        "dq_impossible_dates": dq.impossible_dates(late),
        "dq_signed_without_cost": dq.signed_without_cost(folders),
        "dq_empty_folder": dq.empty_folders(folders, key(lines, "l_orderkey", "folder_id")),
        "dq_resolved_in_last_act": dq.resolved_in_last_act(items.where("act_date < '1998-06-01'").withColumn("act_id", F.year("act_date") * 12 + F.month("act_date"))),
        "dq_orphan_processing": dq.orphan_processing(key(r.read(spark, sf_dir, "part"), "p_partkey", "finding_id"), items.where("item_no > 6 and act_id % 50 = 0")),
    }


def register(name: str) -> None:
    cte, body = SQL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule_tables(spark, sf_dir)[name]

    run.__name__, run.__doc__ = name, f"Rows that break the rule {name[3:]}."
    query(f"with {cte} {body}")(run)


for _name in SQL:
    register(_name)


@query("with " + ", ".join(dict.fromkeys(c for c, _ in SQL.values())) + " select contour, rule, count(*) as total from (" + " union all ".join(b for _, b in SQL.values()) + ") group by 1, 2")
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq.summary(list(rule_tables(spark, sf_dir).values()))
