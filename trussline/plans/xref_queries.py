"""Cross references, comparisons, summaries and calendar functions over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions import calendars, exprs
from trussline.operators import xref as X
from trussline.operators.common import load
from trussline.plans.lens import CTES, lens

Query = Callable[[SparkSession, str], DataFrame]
_ACTV = "select * from (values ('1', 'URGENT', 'T1'), ('2', 'HIGH', 'T1'), ('3', 'MEDIUM', 'T1'), ('4', 'NOT SPECIFIED', 'T2')) t(actv_code_id, actv_code_name, actv_code_type_id)"
_TYPES = "select * from (values ('T1', 'Priority')) t(actv_code_type_id, actv_code_type)"
_UDFTYPE = "select * from (values ('1', 'TASK', 'Area', 'FT_TEXT', ''), ('2', 'TASK', 'Weight', '', 'FT_FLOAT'), ('3', 'PROJECT', 'Review', '', '')) t(udf_type_id, table_name, udf_type_label, logical_data_type, udf_data_type)"
_UDFVALUE = """select cast(1 + o_orderkey % 4 as string) as udf_type_id, cast(o_orderkey as string) as fk_id, case when o_orderkey % 5 = 0 then o_orderpriority else '' end as udf_text,
  case when o_orderkey % 3 = 0 then cast(o_custkey as string) end as udf_number, substr(cast(o_orderdate as string), 1, 10) as udf_date from {orders}"""
_BASELINE = """select case when n_nationkey % 4 = 0 then cast(n_nationkey as string) else '' end as base_proj_id, cast(n_nationkey + 5 as string) as proj_id, n_name as bl_name, case when n_nationkey % 3 = 0 then 'BL_Project' else 'BL_Other' end as bl_type,
  case when n_nationkey % 2 = 0 then '1998-01-01 00:00' else '' end as fin_dt, '1998-02-01 00:00' as last_recalc_date from {nation} where n_nationkey < 8"""
_UPDATE = """select task_id, task_code, case when cast(task_id as bigint) % 3 = 0 then 'TK_Complete' else status_code end as status_code,
  case when cast(task_id as bigint) % 3 = 0 then '0' else remain_drtn_hr_cnt end as remain_drtn_hr_cnt, act_start_date, case when cast(task_id as bigint) % 3 = 0 then target_end_date else '' end as act_end_date,
  early_start_date, target_end_date as early_end_date from {task} where cast(task_id as bigint) % 7 <> 0"""


def _lens(make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    return make(spark, lens(spark, d))


def _half(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    return X.half_step(t["task"], spark.sql(_UPDATE.format(task="_lens_task"))).select("task_id", "status_code", "remain_drtn_hr_cnt", "act_start_date", "act_end_date", "early_start_date", "early_end_date", "matched", "progressed")


def _hours(t: dict[str, DataFrame]) -> DataFrame:
    return t["task"].join(t["calendar"].select("clndr_id", exprs.number("day_hr_cnt").alias("hpd")), "clndr_id", "left")


_PHYSICAL = "case when cast(task_id as bigint) % 7 = 0 then cast(cast(task_id as bigint) % 130 as string) else '' end"
_SERIALS = """select o_orderkey as k, case o_orderkey % 4 when 0 then cast(30000 + o_orderkey % 30000 as string) when 1 then substr(cast(o_orderdate as string), 1, 10) when 2 then cast(o_orderkey as string) || 'x' else '' end as raw from {orders}"""


def _counts(t: dict[str, DataFrame], task: str, taskpred: str) -> DataFrame:
    n = lambda name, of: t[of].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
    return n("TASK", task).unionByName(n("TASKPRED", taskpred))


def _fields(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(name, c) for c in df.columns], "table string, field string")


_MAKE: dict[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]] = {
    "b02_serial_dates": lambda s, t: s.sql(_SERIALS.format(orders="_lens_orders")).select("k", exprs.serial_date("raw").alias("day")),
    "b08_durations": lambda s, t: _hours(t).select("task_id", exprs.days_or_zero("target_drtn_hr_cnt", F.col("hpd")).alias("days"), exprs.days_or_zero("remain_drtn_hr_cnt", F.col("hpd"), 1).alias("rounded")),
    "b11_percent_complete": lambda s, t: t["task"].select("task_id", exprs.percent_complete(F.expr(_PHYSICAL), F.lit(""), F.col("target_drtn_hr_cnt"), F.col("remain_drtn_hr_cnt")).alias("pct")),
    "f14_tiers": lambda s, t: t["task"].select(F.explode(F.array("cstr_type", "cstr_type2")).alias("code")).groupBy(exprs.tier(F.col("code")).alias("tier")).agg(F.count(F.lit(1)).alias("n")),
    "c01_wbs_paths": lambda s, t: X.wbs_paths(t["projwbs"]),
    "c02_task_resources": lambda s, t: X.task_resources(t["taskrsrc"], t["rsrc"]),
    "c03_adjacency": lambda s, t: X.adjacency(t["taskpred"]).select("task_id", F.array_join("predecessors", ",").alias("predecessors"), F.array_join("successors", ",").alias("successors")),
    "c04_activity_codes": lambda s, t: X.activity_codes(t["taskactv"], s.sql(_ACTV), s.sql(_TYPES)),
    "c05_udf_values": lambda s, t: X.udf_values(s.sql(_UDFVALUE.format(orders="_lens_orders")), s.sql(_UDFTYPE)),
    "c06_udf_types": lambda s, t: X.udf_types(s.sql(_UDFTYPE)),
    "c07_baselines": lambda s, t: X.baselines(None, t["project"].withColumn("bl_type", F.when(F.col("proj_id").try_cast("int") % 5 == 0, "BL_Primary").otherwise(""))),
    "c07_baseline_rows": lambda s, t: X.baselines(s.sql(_BASELINE.format(nation="_lens_nation")), t["project"].withColumn("bl_type", F.when(F.col("proj_id").try_cast("int") % 5 == 0, "BL_Primary").otherwise(""))),
    "c08_contract_baseline": lambda s, t: X.contract_baseline(X.baselines(None, t["project"].withColumn("bl_type", F.when(F.col("proj_id").try_cast("int") % 5 == 0, "BL_Primary").otherwise("")))),
    "c09_schema_difference": lambda s, t: X.schema_difference(_fields(t["task"], "TASK"), _fields(t["baseline_task"], "TASK")),
    "c11_findings": lambda s, t: X.structure_findings(t["project"], t["projwbs"], t["task"], t["taskpred"], t["calendar"]),
    "c12_compliance": lambda s, t: X.compliance(X.structure_findings(t["project"], t["projwbs"], t["task"], t["taskpred"], t["calendar"])),
    "c13_half_step": _half,
    "c13_unmatched": lambda s, t: X.unmatched_codes(t["task"], s.sql(_UPDATE.format(task="_lens_task"))),
    "c09_count_difference": lambda s, t: X.count_difference(_counts(t, "task", "taskpred"), _counts(t, "baseline_task", "taskpred")),
    "d02_project_header": lambda s, t: X.project_header(t["project"]),
    "d08_lags": lambda s, t: X.lagged_relationships(t["taskpred"]),
    "d03_metrics": lambda s, t: X.schedule_metrics(t["task"]),
    "d04_breakdown": lambda s, t: X.breakdown(t["task"]),
    "d05_critical_counts": lambda s, t: X.critical_counts(t["task"]),
    "d06_critical_list": lambda s, t: X.critical_list(t["task"]),
    "d07_float_distribution": lambda s, t: X.float_distribution(t["task"], t["calendar"]),
    "d08_relationship_types": lambda s, t: X.relationship_types(t["taskpred"]),
    "d09_open_ends": lambda s, t: X.summary_open_ends(t["task"], t["taskpred"]),
    "d11_wbs_rollup": lambda s, t: X.wbs_rollup(t["projwbs"], t["task"]),
    "d12_resources": lambda s, t: X.resource_use(t["taskrsrc"]),
    "d13_constraints": lambda s, t: X.constraint_counts(t["task"]),
}


def b03_calendar_map(spark: SparkSession, d: str) -> DataFrame:
    """Every calendar decoded; of repeated deliveries the last by loaded_at counts."""
    return calendars.calendar_map(load(spark, d, "calendar"), "loaded_at").select(
        "clndr_id", F.array_join("work_days", ",").alias("work_days"), F.array_join("holidays", ",").alias("holidays"), F.array_join("special_workdays", ",").alias("special_workdays"), "hours_per_day", "hours_per_week"
    )


def c10_field_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the raw export files with another number of fields than their version has."""
    return X.field_count_issues(X.raw_field_counts(load(spark, d, "xer_line")))


def d10_calendars(spark: SparkSession, d: str) -> DataFrame:
    """Every calendar; of repeated deliveries the last by loaded_at counts."""
    return X.calendar_list(load(spark, d, "calendar"), "loaded_at")


_DATES = ("early_start_date", "early_end_date")


def b04_work_days(spark: SparkSession, d: str) -> DataFrame:
    """Working days of every activity's early dates, and the day five working days after its start."""
    week, off = F.array(*[F.lit(i) for i in range(1, 6)]), F.array(F.lit("2025-01-01"), F.lit("2025-12-25"))
    a, b = (exprs.moment(c).cast("date") for c in _DATES)
    return load(spark, d, "task").groupBy("task_id").agg(*[F.min(c).alias(c) for c in _DATES]).select(
        "task_id", exprs.work_days_between(a, b, week, off).cast("long").alias("n_days"),
        F.date_format(exprs.add_work_days(a, F.lit(5), week, off), "yyyy-MM-dd").alias("plus_5"), F.date_format(exprs.add_work_days(a, F.lit(-3), week, off), "yyyy-MM-dd").alias("minus_3"),
    )


def b10_dates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "task").select("task_id", F.date_format(exprs.moment("target_end_date"), "yyyy-MM-dd HH:mm").alias("target_end"), exprs.number("total_float_hr_cnt").alias("float_hours"), exprs.days("target_drtn_hr_cnt", F.lit(10.0)).alias("days")).distinct()


QUERIES: dict[str, Query] = {name: partial(_lens, make) for name, make in _MAKE.items()} | {f.__name__: f for f in (b03_calendar_map, b04_work_days, b10_dates, c10_field_counts, d10_calendars)}

_WORK = "task_type not in ('TT_WBS', 'TT_LOE')"
_TAGGED = "bl as (select proj_id as baseline_id, proj_short_name as bl_name, 'BL_Primary' as bl_type, last_recalc_date as data_date from project where cast(proj_id as int) % 5 = 0)"
_FOUND = """, deep as (select wbs_id, 1 as d from projwbs where parent_wbs_id = '' union all select p.wbs_id, d + 1 from projwbs p join deep on p.parent_wbs_id = deep.wbs_id),
v as (select (select count(*) from project) as np, (select count(*) from calendar) as nc, (select max(d) from deep)::bigint as nd, (select count(*) from task where task_type not in ('TT_WBS', 'TT_LOE')) as na,
  (select count(*) from task where task_type not in ('TT_WBS', 'TT_LOE', 'TT_Mile', 'TT_FinMile')) as nw,
  (select count(*) from (select task_id from taskpred union all select pred_task_id from taskpred) x where task_id in (select task_id from task where task_type not in ('TT_WBS', 'TT_LOE', 'TT_Mile', 'TT_FinMile'))) as nt),
fi as (select 'XER-PROJECT-MISSING' as check_id, 'BLOCK' as severity, np as n from v where np = 0 union all select 'XER-MULTI-PROJECT', 'INFO', np from v where np > 1 union all select 'XER-CALENDAR-MISSING', 'BLOCK', nc from v where nc = 0
  union all select 'XER-WBS-DEPTH-LOW', 'BLOCK', nd from v where nd < 3 union all select 'XER-WBS-DEPTH-HIGH', 'WARN', nd from v where nd > 6 union all select 'XER-ACTIVITY-COUNT-LOW', 'WARN', na from v where na < 50
  union all select 'XER-ACTIVITY-COUNT-HIGH', 'WARN', na from v where na > 10000 union all select 'XER-NO-TASKPRED', 'BLOCK', nw from v where nw > 0 and nt = 0)
"""
_WORKED = """with x as (select task_id, min(early_start_date) as a, min(early_end_date) as b from task group by 1),
y as (select task_id, try_strptime(nullif(a, ''), '%Y-%m-%d %H:%M')::date as a, try_strptime(nullif(b, ''), '%Y-%m-%d %H:%M')::date as b from x)"""
_OK = "dayofweek({0}) between 1 and 5 and {0} not in (date '2025-01-01', date '2025-12-25')"

SQL: dict[str, str] = {
    "c01_wbs_paths": CTES + ", w as (select wbs_id, 0::bigint as depth, wbs_name as full_path from projwbs where parent_wbs_id = '' union all select p.wbs_id, w.depth + 1, w.full_path || ' > ' || p.wbs_name from projwbs p join w on p.parent_wbs_id = w.wbs_id) select * from w",
    "c02_task_resources": CTES + " select task_id, rsrc_id, rsrc_name from taskrsrc left join rsrc using (rsrc_id)",
    "c03_adjacency": CTES + " select coalesce(a.task_id, b.task_id) as task_id, coalesce(a.l, '') as predecessors, coalesce(b.l, '') as successors from (select task_id, string_agg(pred_task_id, ',' order by pred_task_id) as l from taskpred group by 1) a full join (select pred_task_id as task_id, string_agg(task_id, ',' order by task_id) as l from taskpred group by 1) b on a.task_id = b.task_id",
    "c04_activity_codes": CTES + f", c as ({_ACTV}), y as ({_TYPES}) select t.task_id, t.actv_code_id, actv_code_name, actv_code_type from taskactv t left join c using (actv_code_id) left join y using (actv_code_type_id)",
    "c05_udf_values": lambda s, t: X.udf_values(s.sql(_UDFVALUE.format(orders="_lens_orders")), s.sql(_UDFTYPE)),
    "c06_udf_types": lambda s, t: X.udf_types(s.sql(_UDFTYPE)),
    "c07_baselines": CTES + f", {_TAGGED} select * from bl",
    "c08_contract_baseline": CTES + f", {_TAGGED} select * from bl order by data_date, baseline_id limit 1",
    "c09_schema_difference": "select 'TASK' as \"table\", unnest(['task_name', 'wbs_id', 'clndr_id', 'total_float_hr_cnt', 'target_drtn_hr_cnt', 'remain_drtn_hr_cnt', 'cstr_type', 'cstr_type2', 'crt_path_num', 'target_start_date', 'early_start_date', 'early_end_date', 'act_start_date', 'act_end_date']) as field, 'removed' as kind",
    "c11_findings": CTES + _FOUND + " select check_id, severity, n, null::varchar as subject from fi",
    "c12_compliance": CTES + _FOUND + ", s as (select greatest(0, least(100, 100 - 20 * count(*) filter (severity = 'BLOCK') - 5 * count(*) filter (severity = 'WARN')))::bigint as score from fi) select score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade from s",
    "c13_half_step": CTES + ", u as (" + _UPDATE.format(task="task") + """), m as (select t.*, u.task_code is not null as matched, u.status_code as us, u.remain_drtn_hr_cnt as ur, u.act_start_date as ua, u.act_end_date as ue, u.early_start_date as xs, u.early_end_date as xe from task t left join u using (task_code))
 select task_id, case when coalesce(us, '') <> '' then us else status_code end as status_code, case when coalesce(ur, '') <> '' then ur else remain_drtn_hr_cnt end as remain_drtn_hr_cnt, case when coalesce(ua, '') <> '' then ua else act_start_date end as act_start_date, case when coalesce(ue, '') <> '' then ue else act_end_date end as act_end_date,
 case when us = 'TK_Complete' and status_code <> 'TK_Complete' and xs <> '' then xs else early_start_date end as early_start_date, case when us = 'TK_Complete' and status_code <> 'TK_Complete' and xe <> '' then xe else early_end_date end as early_end_date, matched,
 coalesce((us <> '' and us <> status_code) or (ur <> '' and ur <> remain_drtn_hr_cnt) or (ua <> '' and ua <> act_start_date) or (ue <> '' and ue <> act_end_date), false) as progressed from m""",
    "d03_metrics": CTES + f" select proj_id, count(*) as n_total, count(*) filter (status_code = 'TK_Complete') as n_complete, count(*) filter (status_code = 'TK_Active') as n_in_progress, count(*) filter (status_code = 'TK_NotStart') as n_not_started, count(*) filter (status_code = 'TK_Complete') * 100.0::double / count(*) as pct_complete from task where {_WORK} group by 1",
    "d04_breakdown": CTES + f" select 'type' as \"of\", case task_type when 'TT_Task' then 'Task Dependent' when 'TT_Rsrc' then 'Resource Dependent' when 'TT_Mile' then 'Start Milestone' when 'TT_FinMile' then 'Finish Milestone' when 'TT_LOE' then 'Level of Effort' else 'WBS Summary' end as value, count(*) as n from task group by all union all select 'status', case status_code when 'TK_NotStart' then 'Not Started' when 'TK_Active' then 'In Progress' else 'Complete' end, count(*) from task where {_WORK} group by all",
    "d05_critical_counts": CTES + f" select proj_id, count(*) filter (try_cast(total_float_hr_cnt as double) <= 0) as by_float, 0::bigint as by_flag, count(*) filter (try_cast(crt_path_num as bigint) > 0) as by_path from task where {_WORK} group by 1",
    "c05_udf_values": CTES + f", u as ({_UDFTYPE}), v as (" + _UDFVALUE.format(orders="orders") + ") select u.table_name, v.fk_id, u.udf_type_label, coalesce(nullif(udf_text, ''), nullif(udf_number, ''), nullif(udf_date, ''), '') as value from v left join u using (udf_type_id)",
    "c06_udf_types": f"select udf_type_id, table_name, udf_type_label, coalesce(nullif(logical_data_type, ''), nullif(udf_data_type, ''), '') as logical_type from ({_UDFTYPE})",
    "c07_baseline_rows": CTES + f", {_TAGGED}, r as (select coalesce(nullif(base_proj_id, ''), proj_id) as baseline_id, bl_name, bl_type, coalesce(nullif(fin_dt, ''), last_recalc_date) as data_date from (" + _BASELINE.format(nation="nation") + ")) select * from r union all select * from bl where baseline_id not in (select baseline_id from r)",
    "c09_count_difference": CTES + " select 'TASK' as \"table\", (select count(*) from baseline_task) - (select count(*) from task) as delta",
    "c10_field_counts": r"""with l as (select file_id, line_no, string_split(regexp_replace(regexp_replace(line, '\r$', ''), '^\x{FEFF}', ''), chr(9)) as p from xer_line),
 h as (select *, lag(p) over (partition by file_id order by line_no) as before from l where p[1] in ('ERMHDR', '%T', '%F')),
 v as (select file_id, min_by(p[2], line_no) as version from h where p[1] = 'ERMHDR' group by 1),
 c as (select h.file_id, trim(before[2]) as tab, max_by(len(p), line_no) - 1 as n from h where p[1] = '%F' and before[1] = '%T' group by 1, 2),
 k as (select * from (values ('24', 'TASK', 61), ('24', 'TASKPRED', 11), ('23', 'TASK', 61), ('23', 'TASKPRED', 11), ('22', 'TASK', 61), ('22', 'TASKPRED', 11), ('20', 'TASK', 66), ('20', 'TASKPRED', 10), ('19', 'TASK', 66), ('19', 'TASKPRED', 10)) t(major, tab, expected))
 select c.file_id, c.tab as "table", k.expected::integer as expected, c.n::integer as actual from c left join v using (file_id) join k on k.tab = c.tab and k.major = split_part(version, '.', 1) where c.n <> k.expected
 union all select distinct c.file_id, null, null, null from c left join v using (file_id) where coalesce(split_part(version, '.', 1), '') not in (select major from k)""",
    "c13_unmatched": CTES + ", u as (" + _UPDATE.format(task="task") + ") select distinct task_code, 'base' as only_in from task where task_code not in (select task_code from u) union all select distinct task_code, 'update' from u where task_code not in (select task_code from task)",
    "d02_project_header": CTES + " select proj_id, proj_short_name as project_name, proj_short_name as project_long_name, last_recalc_date as data_date, '' as plan_start, plan_end_date as plan_finish, scd_end_date as scheduled_finish, plan_end_date as must_finish_by, (select count(*) from project) as project_count from project order by cast(proj_id as bigint) limit 1",
    "d08_lags": CTES + " select task_id, pred_task_id, pred_type, cast(lag_hr_cnt as double) as lag from taskpred where cast(lag_hr_cnt as double) <> 0",
    "d06_critical_list": CTES + f" select task_id, task_code, task_name, total_float_hr_cnt from task where {_WORK} and try_cast(total_float_hr_cnt as double) <= 0 order by cast(task_id as bigint) limit 50",
    "d07_float_distribution": CTES + f", x as (select total_float_hr_cnt as f, try_cast(total_float_hr_cnt as double) / coalesce(cast(day_hr_cnt as double), 8) as d from task left join calendar using (clndr_id) where {_WORK}) select case when f = '' then 'none' when d < 0 then 'negative' when d = 0 then 'zero' when d <= 5 then '1-5' when d <= 10 then '6-10' when d <= 20 then '11-20' when d <= 44 then '21-44' else 'over 44' end as bucket, count(*) as n from x group by 1",
    "d08_relationship_types": CTES + " select pred_type, count(*) as n, count(*) filter (cast(lag_hr_cnt as double) <> 0) as n_lagged from taskpred group by 1",
    "d09_open_ends": CTES + f" select task_id, 'predecessor' as lacks from task where {_WORK} and task_type <> 'TT_Mile' and task_id not in (select task_id from taskpred) union all select task_id, 'successor' from task where {_WORK} and task_type <> 'TT_FinMile' and task_id not in (select pred_task_id from taskpred)",
    "d11_wbs_rollup": CTES + " select p.wbs_id, wbs_name, count(task_id) as n from projwbs p left join task t on t.wbs_id = p.wbs_id group by all",
    "d12_resources": CTES + " select rsrc_id, count(*) as n_assignments, count(distinct task_id) as n_tasks from taskrsrc group by 1",
    "d13_constraints": CTES + f" select cstr_type, count(*) as n from task where {_WORK} and cstr_type <> '' group by 1",
    "b02_serial_dates": "with s as (" + _SERIALS.format(orders="orders") + """), y as (select k, coalesce(case when regexp_full_match(raw, '[0-9]{5,6}') then date '1899-12-30' + cast(raw as integer) end, try_cast(case when regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then raw end as date)) as d from s)
 select k, case when year(d) between 1990 and 2050 then strftime(d, '%Y-%m-%d') else '' end as day from y""",
    "b08_durations": CTES + " select task_id, coalesce(case when h > 0 then coalesce(try_cast(target_drtn_hr_cnt as double), 0) / h end, 0) as days, coalesce(case when h > 0 then round_even(coalesce(try_cast(remain_drtn_hr_cnt as double), 0) / h, 1) end, 0) as rounded from (select t.*, cast(c.day_hr_cnt as double) as h from task t left join calendar c using (clndr_id))",
    "b11_percent_complete": CTES + f", x as (select task_id, try_cast({_PHYSICAL} as double) as p, try_cast(target_drtn_hr_cnt as double) as t, try_cast(remain_drtn_hr_cnt as double) as r from task) select task_id, case when p between 0 and 100 then p when t > 0 then greatest(0, least(100, 100 * (t - r) / t)) else 0 end::double as pct from x",
    "f14_tiers": CTES + " select case when code in ('CS_MANDSTART', 'CS_MANDFIN') then 'ABSOLUTE' when code in ('CS_MSO', 'CS_MEO') then 'DATE' when code in ('CS_MSOA', 'CS_MSOB', 'CS_MEOA', 'CS_MEOB') then 'SOFT' when code = 'CS_ALAP' then 'PREFERENCE' end as tier, count(*) as n from (select unnest([cstr_type, cstr_type2]) as code from task) group by 1",
    "b04_work_days": _WORKED + f""" select task_id, case when b < a then 0 when a is not null and b is not null then len([x for x in range(a, b + interval 1 day, interval 1 day) if {_OK.format('x::date')}]) end::bigint as n_days,
 strftime([x for x in range(a + interval 1 day, a + interval 40 day, interval 1 day) if {_OK.format('x::date')}][5], '%Y-%m-%d') as plus_5, strftime([x for x in range((a - interval 1 day)::timestamp, (a - interval 40 day)::timestamp, interval '-1' day) if {_OK.format('x::date')}][3], '%Y-%m-%d') as minus_3 from y""",
    "b10_dates": "select distinct task_id, strftime(try_strptime(target_end_date, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') as target_end, try_cast(nullif(trim(total_float_hr_cnt), '') as double) as float_hours, coalesce(try_cast(nullif(trim(target_drtn_hr_cnt), '') as double), 0) / 10 as days from task",
}
