"""Schedule tables derived from the order tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from trussline.operators.common import load

BASE = ("region", "nation", "customer", "supplier", "orders", "lineitem")

# The given definitions of the derived tables, in order of use.
TABLES: dict[str, str] = {
    "calendar": "select * from (values ('C1','5-Day 8h','8','40'),('C2','4-10s','10','40'),('C3','24x7','24','168')) t(clndr_id,clndr_name,day_hr_cnt,week_hr_cnt)",
    "project": "select cast(n_nationkey as string) proj_id, n_name proj_short_name, '1998-06-01 00:00' last_recalc_date, '2001-08-01 00:00' scd_end_date, '2001-08-01 00:00' plan_end_date from nation",
    "projwbs": """select 'R' || cast(r_regionkey as string) wbs_id, 'P0' parent_wbs_id, r_name wbs_name from region
 union all select 'N' || cast(n_nationkey as string), 'R' || cast(n_regionkey as string), n_name from nation
 union all select 'P0','','Portfolio'""",
    "task": """select cast(o_orderkey as string) task_id, 'A' || lpad(cast(o_orderkey as string),8,'0') task_code, 'Order ' || cast(o_orderkey as string) task_name,
 cast(c_nationkey as string) proj_id, 'N' || cast(c_nationkey as string) wbs_id, 'C' || cast(1 + o_orderkey % 4 as string) clndr_id,
 case o_orderstatus when 'F' then 'TK_Complete' when 'P' then 'TK_Active' else 'TK_NotStart' end status_code,
 case o_orderkey % 20 when 0 then 'TT_Mile' when 1 then 'TT_FinMile' when 2 then 'TT_LOE' when 3 then 'TT_WBS' when 4 then 'TT_Rsrc' else 'TT_Task' end task_type,
 case when o_orderkey % 53 = 7 then '' else cast((o_orderkey * 37) % 641 - 40 as string) end total_float_hr_cnt,
 cast((o_orderkey % 90) * 8 as string) target_drtn_hr_cnt, cast((o_orderkey % 73) * 8 as string) remain_drtn_hr_cnt,
 case o_orderkey % 31 when 3 then 'CS_MANDSTART' when 5 then 'CS_MSO' when 8 then 'CS_MEOB' when 11 then 'CS_ALAP' when 13 then 'CS_MEO' else '' end cstr_type,
 case o_orderkey % 41 when 2 then 'CS_MANDFIN' when 4 then 'CS_MSOA' else '' end cstr_type2,
 cast(case when o_orderkey % 13 < 2 then o_orderkey % 13 + 1 else 0 end as string) crt_path_num,
 substr(cast(o_orderdate as string),1,16) target_start_date,
 substr(cast(o_orderdate + (o_orderkey % 60) * INTERVAL '1' DAY as string),1,16) target_end_date,
 substr(cast(o_orderdate as string),1,16) early_start_date,
 substr(cast(o_orderdate + (o_orderkey % 45) * INTERVAL '1' DAY as string),1,16) early_end_date,
 case when o_orderstatus in ('F','P') then substr(cast(o_orderdate as string),1,16) else '' end act_start_date,
 case when o_orderstatus = 'F' then substr(cast(o_orderdate + (o_orderkey % 50) * INTERVAL '1' DAY as string),1,16) else '' end act_end_date
 from orders join customer on o_custkey = c_custkey""",
    "taskpred": """select cast(a.k as string) task_id, cast(b.k as string) pred_task_id,
 case a.k % 12 when 0 then 'PR_FF' when 1 then 'PR_SS' when 2 then 'PR_SF' else 'PR_FS' end pred_type,
 cast(case a.k % 11 when 0 then -16 when 1 then 40 when 2 then 120 else 0 end as string) lag_hr_cnt
 from (select o_orderkey k, c_nationkey p, row_number() over (partition by c_nationkey order by o_orderdate, o_orderkey) rn from orders join customer on o_custkey=c_custkey) a
 join (select o_orderkey k, c_nationkey p, row_number() over (partition by c_nationkey order by o_orderdate, o_orderkey) rn from orders join customer on o_custkey=c_custkey) b
 on a.p=b.p and (b.rn = a.rn - 1 or b.rn = a.rn - 7) where a.k % 17 <> 0 and b.k % 19 <> 0""",
    "taskrsrc": "select distinct cast(l_orderkey as string) task_id, cast(l_suppkey as string) rsrc_id from lineitem",
    "baseline_task": """select task_id, task_code, proj_id, task_type, status_code,
 substr(cast(o_orderdate + ((o_orderkey % 60) - (o_orderkey % 21)) * INTERVAL '1' DAY as string),1,16) target_end_date
 from task join orders on task_id = cast(o_orderkey as string) where o_orderkey % 29 <> 0""",
    "rsrc": "select cast(s_suppkey as string) rsrc_id, s_name rsrc_name from supplier",
    "taskactv": "select cast(o_orderkey as string) task_id, substr(o_orderpriority,1,1) actv_code_id from orders",
}
#: CTE prefix for the SQL of a query over these tables.
CTES = "with recursive " + ",\n".join(f"{n} as ({q})" for n, q in TABLES.items())


#: The relationships again, as an equi-join on the place in the project's order.
_TASKPRED = """with o as (select o_orderkey k, c_nationkey p, row_number() over (partition by c_nationkey order by o_orderdate, o_orderkey) rn from orders join customer on o_custkey = c_custkey),
 a as (select k, p, rn - off as prn from o lateral view explode(array(1, 7)) x as off where k % 17 <> 0)
 select cast(a.k as string) task_id, cast(o.k as string) pred_task_id,
 case a.k % 12 when 0 then 'PR_FF' when 1 then 'PR_SS' when 2 then 'PR_SF' else 'PR_FS' end pred_type,
 cast(case a.k % 11 when 0 then -16 when 1 then 40 when 2 then 120 else 0 end as string) lag_hr_cnt
 from a join o on a.p = o.p and a.prn = o.rn where o.k % 19 <> 0"""


def _named(query: str) -> str:
    """Table names after FROM and JOIN as views of our own, to keep the session's names free."""
    return re.sub(r"\b(from|join) (region|nation|customer|supplier|orders|lineitem|task)\b", r"\1 _lens_\2", query)


def lens(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The derived tables by name."""
    for name in BASE:
        load(spark, d, name).createOrReplaceTempView(f"_lens_{name}")
    out = {}
    for name, query in TABLES.items():
        out[name] = spark.sql(_named(_TASKPRED if name == "taskpred" else query))
        if name == "task":
            out[name].createOrReplaceTempView("_lens_task")
    return out
