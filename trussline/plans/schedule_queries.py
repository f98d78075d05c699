"""Schedule analytics over the derived tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.operators import findings
from trussline.operators import schedule as S
from trussline.operators.common import cut
from trussline.plans.lens import CTES, lens

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Derived and enriched tables of one input; :meth:`kept` writes the enriched ones once, for
    operators that read them several times."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        t = lens(spark, d)
        self.project, self.task, self.taskpred, self.taskrsrc, self.baseline = (t[n] for n in ("project", "task", "taskpred", "taskrsrc", "baseline_task"))
        self.tasks = S.enrich_tasks(self.task, t["calendar"], self.project)
        self.edges = S.enrich_edges(self.taskpred, self.tasks)

    def kept(self) -> Tables:
        self.tasks = cut(self.tasks)
        self.edges = cut(S.enrich_edges(self.taskpred, self.tasks))
        return self


def _of(make: Callable[[Tables], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    return make(Tables(spark, d))


def _report(t: Tables) -> DataFrame:
    checks = S.health_checks(t.project, t.tasks, t.edges, t.taskrsrc)
    return findings.health_report(t.project, checks, S.execution_index(t.baseline, t.tasks), S.path_groups(t.tasks, t.edges), S.continuity_gaps(t.edges))


_MAKE: dict[str, Callable[[Tables], DataFrame]] = {
    "f00_project_pick": lambda t: S.pick_projects(t.project, t.task),
    "f01_critical_path": lambda t: S.critical_path(t.project, t.tasks),
    "f01_activities": lambda t: S.critical_activities(t.tasks, t.edges),
    "f02_constraint_driven": lambda t: S.constraint_driven(t.project, t.tasks),
    "f02_breakdown": lambda t: S.constraint_breakdown(t.tasks),
    "f02_off_longest_path": lambda t: S.off_longest_path(t.kept().tasks, t.edges),
    "f03_open_ends": lambda t: S.open_ends(t.kept().tasks, t.edges),
    "f03_score": lambda t: S.open_end_score(t.project, t.kept().tasks, S.open_ends(t.tasks, t.edges)),
    "f04_relationships": lambda t: S.relationship_quality(t.project, t.edges),
    "f05_lags": lambda t: S.lags(t.edges),
    "f05_score": lambda t: S.lag_score(t.project, S.lags(t.edges)),
    "f06_out_of_sequence": lambda t: S.out_of_sequence(t.edges),
    "f06_score": lambda t: S.oos_score(t.project, t.tasks, S.out_of_sequence(t.edges)),
    "f07_near_critical": lambda t: S.near_critical(t.tasks),
    "f07_score": lambda t: S.near_critical_score(t.project, t.tasks, S.near_critical(t.tasks)),
    "f08_disconnected": lambda t: S.disconnected(t.kept().tasks, t.edges),
    "f09_saturation": lambda t: S.constraint_saturation(t.project, t.tasks),
    "f10_confidence": lambda t: S.confidence(t.project, S.all_scores(t.project, t.tasks, t.edges)),
    "f11_recommendations": lambda t: S.recommendations(t.tasks, t.edges),
    "f15_counters": lambda t: S.counters(t.project, t.tasks),
    "g01_g14_checks": lambda t: S.health_checks(t.project, t.kept().tasks, t.edges, t.taskrsrc),
    "g15_execution_index": lambda t: S.execution_index(t.baseline, t.tasks),
    "g16_score": lambda t: S.health_score(S.health_checks(t.project, t.kept().tasks, t.edges, t.taskrsrc)),
    "g17_path_groups": lambda t: S.path_groups(t.kept().tasks, t.edges),
    "g17_components": lambda t: S.path_groups(t.kept().tasks.withColumn("crt_path_num", F.lit("")), t.edges),
    "g18_continuity_gaps": lambda t: S.continuity_gaps(t.edges),
    "g19_drivers": lambda t: S.drivers(t.kept().tasks, t.edges),
    "g19_flagged_drivers": lambda t: S.drivers(t.kept().tasks, t.edges.withColumn("flagged", F.col("lag") > 50)),
    "g19_driving_path": lambda t: S.driving_path(t.kept().tasks, t.edges),
    "g20_findings": lambda t: _report(t.kept()),
    "g22_counts": lambda t: findings.counts(_report(t.kept())),
    "g21_profiles": lambda t: t.project.sparkSession.createDataFrame([(p, k, float(v)) for p, x in S.PROFILES.items() for k, v in x.items()], "profile string, threshold string, value double"),
}
QUERIES: dict[str, Query] = {name: partial(_of, make) for name, make in _MAKE.items()}

_E = CTES + """,
te as (select t.*, try_cast(c.day_hr_cnt as double) as hpd, coalesce(try_cast(total_float_hr_cnt as double), 999) as tf999, coalesce(try_cast(total_float_hr_cnt as double), 0) as tf0,
  task_type not in ('TT_WBS', 'TT_LOE') as work_, task_type not in ('TT_WBS', 'TT_LOE') and status_code <> 'TK_Complete' as open_,
  task_type not in ('TT_WBS', 'TT_LOE') and status_code <> 'TK_Complete' and coalesce(try_cast(total_float_hr_cnt as double), 999) <= 0 as cp,
  cstr_type in ('CS_MANDSTART', 'CS_MANDFIN', 'CS_MSO', 'CS_MEO') or cstr_type2 in ('CS_MANDSTART', 'CS_MANDFIN', 'CS_MSO', 'CS_MEO') as hard,
  p.last_recalc_date as dd, p.scd_end_date as finish from task t left join calendar c using (clndr_id) join project p using (proj_id)),
ee as (select e.task_id, e.pred_task_id, e.pred_type, cast(e.lag_hr_cnt as double) as lag_, s.proj_id as sp, q.proj_id as pp, s.status_code as ss, q.status_code as ps, s.cp as scp, q.cp as pcp, s.work_ as sw, s.hpd as sh, q.hpd as ph
  from taskpred e join te s on s.task_id = e.task_id join te q on q.task_id = e.pred_task_id),
base as (select p.proj_id, count(t.task_id) as n_tasks, count(*) filter (work_) as n_work, count(*) filter (open_) as n_open, count(*) filter (cp) as cp_count, count(*) filter (cp and hard) as cp_constrained,
  count(*) filter (open_ and hard) as n_hard, count(*) filter (work_ and status_code = 'TK_Active') as n_active from project p left join te t using (proj_id) group by 1),
lacks as (select t.proj_id, t.task_id, t.cp, t.task_id not in (select task_id from ee) as no_pred, t.task_id not in (select pred_task_id from ee) as bare, t.task_type, substr(t.early_end_date, 1, 10) as fin, substr(t.finish, 1, 10) as goal from te t where open_),
sure as (select *, cp and bare and (task_type in ('TT_Mile', 'TT_FinMile') or (fin <> '' and fin = goal)) as is_sure, cp and bare as cand from lacks),
term as (select *, case when max(is_sure::int) over (partition by proj_id) = 1 then is_sure when max(case when cand and fin <> '' then fin end) over (partition by proj_id) is not null then cand and fin <> '' and fin = max(case when cand and fin <> '' then fin end) over (partition by proj_id) else cand and count(*) filter (cand) over (partition by proj_id) = 1 end as terminal from sure),
ends as (select proj_id, task_id, cp, no_pred, bare and not terminal as no_succ, terminal from term where no_pred or bare),
lagged as (select sp as proj_id, task_id, pred_task_id, pred_type, lag_ as lag, lag_ / coalesce(sh, 8) as lag_days, scp or pcp as on_cp from ee where lag_ <> 0),
oos as (select sp as proj_id, task_id, pred_task_id, min(pred_type) as pred_type, bool_or(scp) as on_cp from ee where sw and ss = 'TK_Active' and ((pred_type = 'PR_FS' and ps <> 'TK_Complete') or (pred_type = 'PR_SS' and ps = 'TK_NotStart')) group by 1, 2, 3),
near as (select proj_id, task_id, tf999, tf999 / coalesce(hpd, 8) as tf_days, case when tf999 / coalesce(hpd, 8) <= 2 then 1 when tf999 / coalesce(hpd, 8) <= 5 then 2 else 3 end::bigint as band from te where open_ and tf999 > 0 and tf999 <= 80),
anchors as (select proj_id, task_id from (select *, max((task_type = 'TT_FinMile' and cp)::int) over (partition by proj_id) as n_some from te) where task_type = 'TT_FinMile' and (n_some = 0 or cp)),
reach as (select proj_id, task_id from anchors union select e.pp, e.pred_task_id from ee e join reach r on e.task_id = r.task_id and e.pp = e.sp),
loose as (select proj_id, task_id, cp from te where open_ and task_id not in (select task_id from reach)),
sc_cp as (select *, case when n_open > 0 then cp_count * 100.0::double / n_open else 0 end as cp_pct from base),
s1 as (select proj_id, n_open, cp_count, cp_pct, case when cp_count = 0 then 0 when cp_pct < 3 or cp_pct > 40 then 55 else 100 end::bigint as score from sc_cp),
s2 as (select *, case when pct > 50 then 30 when pct > 25 then 60 when pct > 0 then 75 else 100 end::bigint as score from (select proj_id, cp_count, cp_constrained, case when cp_count > 0 then cp_constrained * 100.0::double / cp_count else 0 end as pct from base)),
s3 as (select proj_id, n_open, cp_open_ends, open_ends, terminals, case when cp_open_ends > 0 then greatest(0, 40 - 10 * cp_open_ends) when open_ends > 0.15 * n_open then 60 when open_ends > 0 then 80 else 100 end::bigint as score
  from (select b.proj_id, b.n_open, count(*) filter (e.cp and (e.no_pred or e.no_succ)) as cp_open_ends, count(*) filter (e.no_pred or e.no_succ) as open_ends, count(*) filter (e.terminal) as terminals from base b left join ends e using (proj_id) group by all)),
s4 as (select *, case when n_cp_not_fs * 2 > n_cp_rels then 30 when n_cp_not_fs > 0 then 70 else 95 end::bigint as score from (select b.proj_id, count(e.task_id) as n_rels, count(*) filter (pred_type = 'PR_FS') as n_fs, count(*) filter (scp and pcp) as n_cp_rels, count(*) filter (scp and pcp and pred_type <> 'PR_FS') as n_cp_not_fs from base b left join ee e on e.sp = b.proj_id group by 1)),
s5 as (select *, case when n_cp_leads > 0 then greatest(0, 40 - 15 * n_cp_leads) when n_leads > 0.3 * n_lags and n_leads > 5 then 60 when n_leads > 0 then 80 else 95 end::bigint as score from (select b.proj_id, count(l.task_id) as n_lags, count(*) filter (lag < 0) as n_leads, count(*) filter (lag < 0 and on_cp) as n_cp_leads, count(*) filter (abs(lag_days) > 10) as n_excessive from base b left join lagged l using (proj_id) group by 1)),
s6 as (select *, case when n_oos_cp > 0 then 30 when n_oos > 0.2 * n_active and n_oos > 3 then 60 when n_oos > 0 then 80 else 100 end::bigint as score from (select b.proj_id, b.n_active, count(o.task_id) as n_oos, count(*) filter (o.on_cp) as n_oos_cp from base b left join oos o using (proj_id) group by 1, 2)),
s7 as (select *, case when band_1 > 10 then 40 when n_near > 0.3 * n_open then 55 when n_near > 0 and band_1 > 3 then 80 when n_near > 0 then 90 else 100 end::bigint as score from (select b.proj_id, b.n_open, count(*) filter (band = 1) as band_1, count(*) filter (band = 2) as band_2, count(*) filter (band = 3) as band_3, count(n.task_id) as n_near from base b left join near n using (proj_id) group by 1, 2)),
s8 as (select *, case when n_loose_cp > 0 then 20 when n_loose > 0.1 * n_open then 60 when n_loose > 0 then 80 else 100 end::bigint as score from (select b.proj_id, b.n_open, count(l.task_id) as n_loose, count(*) filter (l.cp) as n_loose_cp from base b left join loose l using (proj_id) group by 1, 2)),
s9 as (select *, case when pct > 20 then 30 when pct > 5 then 60 else 100 end::bigint as score from (select proj_id, n_open, n_hard, case when n_open > 0 then n_hard * 100.0::double / n_open else 0 end as pct from base)),
drive as (select e.task_id, e.pred_task_id from ee e join te p on p.task_id = e.pred_task_id qualify row_number() over (partition by e.task_id order by coalesce(nullif(p.early_end_date, ''), nullif(p.act_end_date, ''), p.target_end_date) desc, cast(e.pred_task_id as bigint)) = 1),
both_ends as (select sp as proj_id, lag_, pred_type from ee union all select pp, lag_, pred_type from ee where pp <> sp),
be as (select proj_id, count(*) as n_e, count(*) filter (lag_ < 0) as n_lead, count(*) filter (lag_ > 0) as n_lag, count(*) filter (pred_type = 'PR_FS') as n_fs from both_ends group by 1),
wt as (select *, coalesce(hpd, 8) as h, cast(remain_drtn_hr_cnt as double) as rem, cast(target_drtn_hr_cnt as double) as tgt, dd::timestamp as d0, target_end_date::timestamp as te_, nullif(act_start_date, '')::timestamp as as_, nullif(act_end_date, '')::timestamp as ae_ from te where work_),
wd as (select *, case when tgt > 0 then greatest(0, least(100, 100 * (tgt - rem) / tgt)) else 0 end as done from wt),
gg as (select proj_id, count(*) as n, count(*) filter ((task_id not in (select task_id from taskpred) and task_type not in ('TT_Mile', 'TT_FinMile')) or (task_id not in (select pred_task_id from taskpred) and task_type <> 'TT_FinMile')) as n_logic,
  count(*) filter (hard) as n_hard, count(*) filter (open_) as n_open, count(*) filter (open_ and tf0 / h > 44) as n_hf, count(*) filter (open_ and tf0 < 0) as n_neg,
  count(*) filter (open_ and task_type not in ('TT_Mile', 'TT_FinMile')) as n_body, count(*) filter (open_ and task_type not in ('TT_Mile', 'TT_FinMile') and rem / h > 44) as n_hd,
  count(*) filter (as_ > d0) + count(*) filter (ae_ > d0) + count(*) filter (te_ < d0 and done < 100 and status_code <> 'TK_Complete' and ae_ is null) as n_inv,
  count(*) filter (task_id in (select task_id from taskrsrc)) as n_res, count(*) filter (te_ <= d0) as n_due, count(*) filter (te_ <= d0 and status_code <> 'TK_Complete') as n_missed,
  max(d0) as d0, max(case when cp then early_end_date::timestamp end) as cp_end, min(case when cp then tf999 / h end) as cp_tf from wd group by 1),
gp as (select *, epoch(cp_end - d0) / 3600 / 8 as len_ from gg join be using (proj_id)),
chk as (select proj_id, unnest([{i: 1, v: n_logic * 100.0::double / n}, {i: 2, v: n_lead::double}, {i: 3, v: n_lag * 100.0::double / n_e}, {i: 4, v: n_fs * 100.0::double / n_e}, {i: 5, v: n_hard * 100.0::double / n}, {i: 6, v: case when n_open > 0 then n_hf * 100.0::double / n_open else 0 end},
  {i: 7, v: n_neg::double}, {i: 8, v: n_hd * 100.0::double / greatest(n_body, 1)}, {i: 9, v: n_inv::double}, {i: 10, v: n_res * 100.0::double / n}, {i: 11, v: n_inv::double}, {i: 12, v: n_res * 100.0::double / n},
  {i: 13, v: case when n_due > 0 then n_missed * 100.0::double / n_due else 0 end}, {i: 14, v: case when len_ > 0 then (len_ + cp_tf) / len_ end}]) as x from gp),
checks as (select proj_id, x.i::bigint as check_id, x.v as value, [5, 0, 5, 90, 5, 5, 0, 5, 0, 80, 0, 80, 5, 0.95][x.i]::double as threshold, case when x.v is null then 'INFO' when x.i in (4, 10, 12, 14) and x.v >= [0, 0, 0, 90, 0, 0, 0, 0, 0, 80, 0, 80, 0, 0.95][x.i] then 'PASS'
  when x.i not in (4, 10, 12, 14) and x.v <= [5, 0, 5, 0, 5, 5, 0, 5, 0, 0, 0, 0, 5, 0][x.i] then 'PASS' when x.i in (2, 7, 9, 11, 14) then 'BLOCK' else 'WARN' end as severity from chk)
"""

_TAIL: dict[str, str] = {
    "f00_project_pick": "select proj_id, n_tasks, row_number() over (order by n_tasks desc, cast(proj_id as bigint)) - 1 as pick from base",
    "f01_critical_path": "select * from s1",
    "f01_activities": "select t.proj_id, t.task_id, task_code, wbs_id, tf999 / coalesce(hpd, 8) as tf_days, cstr_type, cstr_type2, crt_path_num, (select count(*) from ee where ee.task_id = t.task_id) as n_pred, (select count(*) from ee where ee.pred_task_id = t.task_id) as n_succ from te t where cp",
    "f02_constraint_driven": "select * from s2",
    "f02_breakdown": "select proj_id, cstr, count(*) as n from (select proj_id, unnest([cstr_type, cstr_type2]) as cstr from te where open_) where cstr <> '' group by all",
    "f03_open_ends": "select * from ends",
    "f03_score": "select * from s3",
    "f04_relationships": "select * from s4",
    "f05_lags": "select * from lagged",
    "f05_score": "select * from s5",
    "f06_out_of_sequence": "select * from oos",
    "f06_score": "select * from s6",
    "f07_near_critical": "select * from near",
    "f07_score": "select * from s7",
    "f08_disconnected": "select * from loose",
    "f09_saturation": "select * from s9",
    "f10_confidence": "select *, case when overall >= 80 then 'GREEN' when overall >= 40 then 'AMBER' else 'RED' end as band, case when overall >= 80 then 'High Confidence' when overall >= 60 then 'Moderate Confidence' when overall >= 40 then 'Low Confidence' else 'Unreliable' end as confidence from (select s1.proj_id, s1.score as s_cp, s2.score as s_constraints, s3.score as s_open_ends, s4.score as s_relationships, s5.score as s_lags, s8.score as s_continuity, s7.score as s_near, s6.score as s_oos, s9.score as s_saturation, s1.score * 0.05::double + s2.score * 0.17::double + s3.score * 0.20::double + s4.score * 0.13::double + s5.score * 0.15::double + s8.score * 0.10::double + s7.score * 0.10::double + s6.score * 0.05::double + s9.score * 0.05::double as overall from s1 join s2 using (proj_id) join s3 using (proj_id) join s4 using (proj_id) join s5 using (proj_id) join s6 using (proj_id) join s7 using (proj_id) join s8 using (proj_id) join s9 using (proj_id))",
    "f11_recommendations": "select proj_id, 1::bigint as priority, 'constraint on the critical path' as kind, task_id from te where cp and hard union all select proj_id, case when cp then 1 else 3 end, 'no predecessor', task_id from ends where no_pred union all select proj_id, case when cp then 1 else 2 end, 'no successor', task_id from ends where no_succ union all select proj_id, 1, 'lead on the critical path', task_id from lagged where lag < 0 and on_cp union all select proj_id, case when cp then 1 else 2 end, 'leads to no finish', task_id from loose union all select proj_id, 3, 'few FS relationships', null from s4 where n_rels > 0 and n_fs * 100 < 80 * n_rels union all select proj_id, 2, 'leads off the critical path', null from s5 where n_leads > 10 and n_cp_leads = 0 union all select proj_id, 2, 'hard constraints on many activities', null from s9 where n_hard * 100 > 5 * n_open",
    "f15_counters": "select p.proj_id, count(*) filter (work_) as n_work, count(*) filter (work_ and status_code = 'TK_Complete') as n_complete, count(*) filter (work_ and status_code = 'TK_Active') as n_active, count(*) filter (work_ and status_code = 'TK_NotStart') as n_not_started from project p left join te using (proj_id) group by 1",
    "g01_g14_checks": "select * from checks",
    "g15_execution_index": "select n_due, n_done, bei, severity from bei",
    "g16_score": "select proj_id, count(*) filter (severity = 'PASS') as passed from checks group by 1",
    "g17_path_groups": "select proj_id, path, task_code, place from flag_paths",
    "g17_components": "select proj_id, path, task_code, row_number() over (partition by proj_id, path order by begin_, task_code) as place from (select t.proj_id, min(r.b) as path, t.task_code, coalesce(nullif(t.early_start_date, ''), t.target_start_date) as begin_ from near_cp r join te t on t.task_id = r.a group by t.task_id, t.proj_id, t.task_code, begin_)",
    "g18_continuity_gaps": "select sp as proj_id, task_id, pred_task_id from ee where scp and not pcp and sp = pp and ps <> 'TK_Complete'",
    "g19_drivers": "select * from drive",
    "g19_flagged_drivers": "select e.task_id, e.pred_task_id from ee e join te p on p.task_id = e.pred_task_id qualify row_number() over (partition by e.task_id order by (lag_ > 50)::int desc, case when lag_ > 50 then null else coalesce(nullif(p.early_end_date, ''), nullif(p.act_end_date, ''), p.target_end_date) end desc, cast(e.pred_task_id as bigint)) = 1",
    "g19_driving_path": "select code, step, task_code from walk",
    "g20_findings": "select * from report",
    "g22_counts": "select proj_id, count(*) filter (severity = 'BLOCK') as n_block, count(*) filter (severity = 'WARN') as n_warn, count(*) filter (severity = 'INFO') as n_info, count(*) filter (severity = 'PASS') as n_pass, bool_or(severity = 'BLOCK') as has_blocking from report group by 1",
}
_WALK = """, walk as (select task_code as code, 0::bigint as step, task_code, task_id, false as halt from te
  union all select w.code, w.step + 1, t.task_code, t.task_id, t.status_code = 'TK_Complete' or coalesce(nullif(t.early_end_date, ''), t.act_end_date)::timestamp < t.dd::timestamp from walk w join drive d on d.task_id = w.task_id join te t on t.task_id = d.pred_task_id where not w.halt and w.step < 200)
"""
_BEI = """, bei as (select *, case when bei is null then 'INFO' when bei >= 0.95 then 'PASS' else 'WARN' end as severity from (select count(*) as n_due, count(*) filter (now = 'TK_Complete') as n_done, count(*) filter (now = 'TK_Complete') / nullif(count(*), 0)::double as bei
  from (select distinct b.task_code from baseline_task b where task_type not in ('TT_WBS', 'TT_LOE') and target_end_date::timestamp <= (select dd::timestamp from te group by proj_id, dd order by count(*) desc, cast(proj_id as bigint) limit 1)) d
  left join (select task_code, min_by(status_code, cast(task_id as bigint)) as now from te where work_ group by 1) c using (task_code)))
"""
_PATHS = """, cpt as (select *, nullif(nullif(crt_path_num, ''), '0') as flag from te where cp),
  several as (select proj_id from cpt group by 1 having count(distinct flag) > 1),
  near_cp as (select task_id as a, task_id as b from te where cp union select n.a, case when e.task_id = n.b then e.pred_task_id else e.task_id end from near_cp n join ee e on e.scp and e.pcp and e.sp = e.pp and (e.task_id = n.b or e.pred_task_id = n.b)),
  flag_paths as (select proj_id, flag as path, task_code, row_number() over (partition by proj_id, flag order by coalesce(nullif(early_start_date, ''), target_start_date), task_code) as place from cpt where flag is not null and proj_id in (select proj_id from several)
    union all select proj_id, path, task_code, row_number() over (partition by proj_id, path order by begin_, task_code) from (select t.proj_id, min(r.b) as path, t.task_code, coalesce(nullif(t.early_start_date, ''), t.target_start_date) as begin_ from near_cp r join te t on t.task_id = r.a where t.proj_id not in (select proj_id from several) group by t.task_id, t.proj_id, t.task_code, begin_))
"""
_REPORT = """, report as (select proj_id, ['DCMA-01-Logic', 'DCMA-02-Leads', 'DCMA-03-Lags', 'DCMA-04-Relationship', 'DCMA-05-Hard', 'DCMA-06-HighFloat', 'DCMA-07-NegFloat', 'DCMA-08-HighDuration', 'DCMA-09-InvalidDates', 'DCMA-10-Resources', 'DCMA-11-InvalidDatesFuture', 'DCMA-12-ResourceCoverage', 'DCMA-13-MissedTasks', 'DCMA-14-CPLI'][check_id] as check_id, severity, value, threshold from checks
  union all select proj_id, 'BEI', severity, bei, 0.95 from bei, project
  union all select proj_id, 'DCMA-Ext-MultipleCP', 'INFO', count(distinct path)::double, null from flag_paths group by 1 having count(distinct path) > 1
  union all select p.proj_id, 'DCMA-Ext-CPContinuity', case when count(g.task_id) > 0 then 'WARN' else 'PASS' end, count(g.task_id)::double, null from project p left join (select sp as proj_id, task_id from ee where scp and not pcp and sp = pp and ps <> 'TK_Complete') g using (proj_id) group by 1)
"""
_NEEDS = {"g19_driving_path": _WALK, "g15_execution_index": _BEI, "g17_path_groups": _PATHS, "g17_components": _PATHS, "g20_findings": _BEI + _PATHS + _REPORT, "g22_counts": _BEI + _PATHS + _REPORT}

SQL: dict[str, str] = {name: _E + _NEEDS.get(name, "") + tail for name, tail in _TAIL.items()}
SQL["g21_profiles"] = "select * from (values " + ", ".join(f"('{p}', '{k}', {float(v)}::double)" for p, x in S.PROFILES.items() for k, v in x.items()) + ") t(profile, threshold, value)"
