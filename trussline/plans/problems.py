"""Queries over the whole test tables for the data-quality operators of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.operators import drift, hierarchy, orphans, reject_rows, snapshots
from trussline.operators.common import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.rejected(load(spark, d, "xer_line"))


def p1_task(spark: SparkSession, d: str) -> DataFrame:
    cols = ("task_id", "task_code", "task_name", "wbs_id", "status_code", "total_float_hr_cnt", "target_end_date")
    return reject_rows.loaded(load(spark, d, "xer_line"), "TASK", cols)


def p1_taskpred(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.loaded(load(spark, d, "xer_line"), "TASKPRED", ("task_pred_id", "task_id", "pred_task_id", "pred_type", "lag_hr_cnt"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = reject_rows.parse_records(reject_rows.record_lines(load(spark, d, "xer_line"), ("TASK", "TASKPRED")))
    return rows.groupBy("tab", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.schedule_orphans(*[load(spark, d, t) for t in ("task", "taskpred", "projwbs", "calendar")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "rec_id", "kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(load(spark, d, "task_snap")).select("proj_id", "task_code", "snap_no", "kind")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(load(spark, d, "task_snap"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(load(spark, d, "task_feed"))


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """One wide table: the fields of every row under the names they had first, in their united types."""
    return drift.wide(load(spark, d, "task_feed"), ("task_code", "status_code", "target_end_date", "total_float_hr_cnt", "remain_drtn_hr_cnt", "driving_path_flag", "crt_path_num", "cstr_type2"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, d, "projwbs"), "wbs_id", "parent_wbs_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where(F.col("cycle_id").isNotNull()).select(F.col("id").alias("wbs_id"), F.col("cycle_id").alias("cycle_wbs_id"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d).where(F.col("cycle_id").isNull())
    return tree.select(F.col("id").alias("wbs_id"), F.col("root").alias("root_wbs_id"), F.col("depth").cast("long"), F.concat_ws(" > ", "path").alias("path"))


def p5_below(spark: SparkSession, d: str) -> DataFrame:
    pairs = hierarchy.all_below(_tree(spark, d))
    return pairs.select(F.col("id").alias("wbs_id"), F.col("below_id").alias("below_wbs_id"), F.col("levels").cast("long"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_task, p1_taskpred, p1_counts, p2_found, p2_report, p3_found, p3_changes, p4_found, p4_rows, p5_found, p5_paths, p5_below)}

_TRIM = "trim({}, ' ' || chr(9))"

_RECORDS = r"""
with l as (select line_id, file_id, line_no, regexp_replace(line, '\r$', '') as t from xer_line),
h as (select *, split_part(t, chr(9), 1) as k from l),
g as (select *, last_value(case when k = '%T' then trim(split_part(t, chr(9), 2)) when k = '%E' then '' end ignore nulls) over w as tab,
        last_value(case when k = '%F' then t when k in ('%T', '%E') then '' end ignore nulls) over w as head
      from h window w as (partition by file_id order by line_no rows unbounded preceding)),
r as (select *, regexp_full_match(t, '%R(\t("([^"]|"")*"|[^"\t]*))*') as quoted,
        regexp_extract_all(substr(t, 3), '\t("([^"]|"")*"|[^"\t]*)', 1) as raw,
        [trim(x) for x in string_split(head, chr(9))[2:]] as fields
      from g where k = '%R' and tab in ('TASK', 'TASKPRED')),
v as (select *, [case when x[1] = '"' then replace(x[2:length(x) - 1], '""', '"') else x end for x in raw] as vals from r),
c as (select *, case when not quoted then 'quoting' when len(vals) <> len(fields) then 'columns'
        when tab = 'TASK' and list_contains(fields, 'task_id') and not regexp_full_match(vals[list_position(fields, 'task_id')], '[0-9]{1,18}') then 'value'
        when tab = 'TASK' and list_contains(fields, 'total_float_hr_cnt') and not regexp_full_match(vals[list_position(fields, 'total_float_hr_cnt')], '( *[+-]?[0-9]+(\.[0-9]+)? *)?') then 'value'
        when tab = 'TASKPRED' and list_contains(fields, 'lag_hr_cnt') and not regexp_full_match(vals[list_position(fields, 'lag_hr_cnt')], '( *[+-]?[0-9]+(\.[0-9]+)? *)?') then 'value' end as reason from v)
"""


def _loaded_sql(table: str, cols: tuple[str, ...]) -> str:
    pick = ", ".join(f"coalesce(vals[list_position(fields, '{c}')], '') as {c}" for c in cols)
    return f"{_RECORDS} select line_id, file_id, line_no, {pick} from c where reason is null and tab = '{table}'"


_ORPHANS = f"""
with t as (select {_TRIM.format('task_id')} as rec, min(loaded_at) as fl, bool_or(delete_date is not null) as del, any_value({_TRIM.format('wbs_id')}) as w, any_value({_TRIM.format('clndr_id')}) as c from task group by 1),
p as (select {_TRIM.format('task_pred_id')} as rec, min(loaded_at) as fl, bool_or(delete_date is not null) as del, any_value({_TRIM.format('task_id')}) as s, any_value({_TRIM.format('pred_task_id')}) as q from taskpred group by 1),
w as (select {_TRIM.format('wbs_id')} as rec, min(loaded_at) as fl, bool_or(delete_date is not null) as del from projwbs group by 1),
c as (select {_TRIM.format('clndr_id')} as rec, min(loaded_at) as fl, bool_or(delete_date is not null) as del from calendar group by 1),
k as (select 'task' as tab, rec, fl, del from t union all select 'projwbs', * from w union all select 'calendar', * from c),
r as (select 'taskpred.task_id' as ref_field, rec, fl, 'task' as tab, s as ref from p where not del union all select 'taskpred.pred_task_id', rec, fl, 'task', q from p where not del
  union all select 'task.wbs_id', rec, fl, 'projwbs', w from t where not del union all select 'task.clndr_id', rec, fl, 'calendar', c from t where not del),
o as (select r.ref_field, r.rec as rec_id, case when k.rec is null then 'missing' when k.del then 'deleted' when k.fl > r.fl then 'late' end as kind, r.fl as first_load
  from r left join k on r.tab = k.tab and r.ref = k.rec where r.ref <> '' and r.rec <> '')
"""

_SNAPS = f"""
with m as (select upper({_TRIM.format('proj_id')}) as proj_id, upper({_TRIM.format('task_code')}) as task_code, snap_no, loaded_at,
  nullif(lower({_TRIM.format('status_code')}), '') as st, nullif(lower({_TRIM.format('target_end_date')}), '') as e from task_snap),
n as (select *, case st when 'not started' then 'tk_notstart' when 'in progress' then 'tk_active' when 'complete' then 'tk_complete' else st end as status,
  coalesce(strftime(coalesce(try_strptime(replace(replace(e, '/', '-'), 't', ' '), ['%Y-%m-%d %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']), try_strptime(e, ['%d-%b-%Y %H:%M', '%d-%b-%Y'])), '%Y-%m-%d %H:%M'), e) as fin
  from m where proj_id <> '' and task_code <> ''),
u as (select * from n qualify row_number() over (partition by proj_id, task_code, snap_no order by loaded_at desc, status desc, fin desc) = 1),
s as (select proj_id, snap_no, lag(snap_no) over (partition by proj_id order by snap_no) as before from (select distinct proj_id, snap_no from n)),
a as (select s.proj_id, s.snap_no, s.before, u.task_code, u.status, u.fin from s join u on u.proj_id = s.proj_id and u.snap_no = s.snap_no where s.before is not null),
b as (select s.proj_id, s.snap_no, s.before, u.task_code, u.status, u.fin from s join u on u.proj_id = s.proj_id and u.snap_no = s.before),
d as (select coalesce(a.proj_id, b.proj_id) as proj_id, coalesce(a.task_code, b.task_code) as task_code, coalesce(a.snap_no, b.snap_no) as snap_no,
  case when b.task_code is null then 'added' when a.task_code is null then 'removed' when a.status is distinct from b.status or a.fin is distinct from b.fin then 'changed' end as kind,
  b.status as old_status, a.status as new_status, b.fin as old_end, a.fin as new_end
  from a full join b on a.proj_id = b.proj_id and a.snap_no = b.snap_no and a.task_code = b.task_code)
"""

_DRIFT = """
with f as (select feed_code, file_no, row_no, trim(json_extract_string(payload, '$.task_id'), ' ' || chr(9)) as task_id, unnest(json_keys(payload)) as name, payload from task_feed),
x as (select *, json_extract(payload, '$."' || name || '"') as v from f),
c as (select feed_code, file_no, row_no, task_id, name, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'DOUBLE' then 'decimal' when 'NULL' then null else 'integer' end as type, json_extract_string(v, '$') as val from x),
s as (select feed_code, file_no, name, list_sort(list(distinct type) filter (type is not null)) as types from c group by all),
o as (select feed_code, file_no, lag(file_no) over (partition by feed_code order by file_no) as old_no from (select distinct feed_code, file_no from task_feed)),
n as (select o.*, s.name, s.types from o join s using (feed_code, file_no) where old_no is not null),
b as (select o.feed_code, o.file_no, s.name, s.types from o join s on s.feed_code = o.feed_code and s.file_no = o.old_no),
come as (select n.feed_code, n.file_no, n.old_no, n.name from n anti join b using (feed_code, file_no, name)),
gone as (select b.feed_code, b.file_no, b.name from b anti join n using (feed_code, file_no, name)),
cells as (select feed_code, file_no, task_id, name, min_by(type || ':' || val, row_no) as v from c where type is not null group by all),
tasks as (select distinct feed_code, file_no, task_id from c where task_id is not null),
pair as (select g.feed_code, g.file_no, m.old_no, g.name as gone, m.name as come from gone g join come m using (feed_code, file_no)),
both_ as (select p.*, t.task_id from pair p join tasks t on t.feed_code = p.feed_code and t.file_no = p.file_no join tasks u on u.feed_code = p.feed_code and u.file_no = p.old_no and u.task_id = t.task_id),
ag as (select q.feed_code, q.file_no, q.gone, q.come, count(*) filter (a.v is not null or e.v is not null) as n, count(*) filter (a.v = e.v) as same from both_ q
  left join cells a on a.feed_code = q.feed_code and a.file_no = q.old_no and a.task_id = q.task_id and a.name = q.gone
  left join cells e on e.feed_code = q.feed_code and e.file_no = q.file_no and e.task_id = q.task_id and e.name = q.come group by all),
ren as (select * from ag where n > 0 and same >= 0.9 * n)
select feed_code, file_no, come as field_name, 'renamed' as kind from ren
union all select feed_code, file_no, name, 'removed' from gone g where not exists (select 1 from ren r where r.feed_code = g.feed_code and r.file_no = g.file_no and r.gone = g.name)
union all select feed_code, file_no, name, 'added' from come g where not exists (select 1 from ren r where r.feed_code = g.feed_code and r.file_no = g.file_no and r.come = g.name)
union all select n.feed_code, n.file_no, n.name, 'retyped' from n join b using (feed_code, file_no, name) where len(n.types) > 0 and len(b.types) > 0 and n.types <> b.types
"""

_WBS = f"""
with recursive m as (select {_TRIM.format('wbs_id')} as id, max({_TRIM.format('parent_wbs_id')}) as up from projwbs group by 1),
n as (select m.id, p.id as parent from m left join m p on p.id = m.up and m.up <> ''),
t as (select id, id as root, 0 as depth, [id] as path from n where parent is null union all select n.id, t.root, t.depth + 1, list_append(t.path, n.id) from n join t on n.parent = t.id)
"""

_CYCLES = f"""
with recursive m as (select {_TRIM.format('wbs_id')} as id, max({_TRIM.format('parent_wbs_id')}) as up from projwbs group by 1),
n as (select m.id, p.id as parent from m left join m p on p.id = m.up and m.up <> ''),
t as (select id from n where parent is null union all select n.id from n join t on n.parent = t.id),
x as (select n.id, n.parent from n where n.id not in (select id from t)),
w as (select id, id as pos, 0 as step from x union all select w.id, x.parent, step + 1 from w join x on x.id = w.pos where step < (select count(*) from x)),
far as (select id, pos from w where step = (select count(*) from x)),
lows as (select f.id, min(v.pos) as cycle_wbs_id from far f join w v on v.id = f.pos group by 1)
select id as wbs_id, cycle_wbs_id from lows
"""

SQL: dict[str, str] = {
    "p1_found": f"{_RECORDS} select line_id, reason from c where reason is not null",
    "p1_task": _loaded_sql("TASK", ("task_id", "task_code", "task_name", "wbs_id", "status_code", "total_float_hr_cnt", "target_end_date")),
    "p1_taskpred": _loaded_sql("TASKPRED", ("task_pred_id", "task_id", "pred_task_id", "pred_type", "lag_hr_cnt")),
    "p1_counts": f"{_RECORDS} select tab, coalesce(reason, 'valid') as reason, count(*) as n from c group by all",
    "p2_found": f"{_ORPHANS} select ref_field, rec_id, kind from o where kind is not null",
    "p2_report": f"{_ORPHANS} select ref_field, kind, strftime(first_load, '%Y-%m') as month, count(*) as n from o where kind is not null group by all",
    "p3_found": f"{_SNAPS} select proj_id, task_code, snap_no, kind from d where kind is not null",
    "p3_changes": f"{_SNAPS} select * from d where kind is not null",
    "p4_found": _DRIFT,
    "p5_found": _CYCLES,
    "p5_paths": f"{_WBS} select id as wbs_id, root as root_wbs_id, depth::bigint as depth, array_to_string(path, ' > ') as path from t",
    "p5_below": f"""{_WBS}, x as (select id, parent from n where id not in (select id from t)),
w as (select id, parent as pos, 1 as step from x union all select w.id, x.parent, step + 1 from w join x on x.id = w.pos where step < (select count(*) from x))
select a as wbs_id, id as below_wbs_id, (len(path) - i)::bigint as levels from (select id, path, unnest(path) as a, generate_subscripts(path, 1) as i from t) where a <> id
union all select pos, id, min(step)::bigint from w where pos <> id group by pos, id""",
}
