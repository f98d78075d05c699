"""Schedule analytics for every project at once: the critical path, logic quality and health checks.

Two enriched tables feed all checks. Projects without activities or relationships still have
a row in every per-project result. Percentages and scores are left unrounded.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.exprs import days, has_hard, is_work, moment, number, number_or, percent_complete
from trussline.operators.common import cut, hot_values, salted_join
from trussline.operators.graph import connected_components

#: Projects with up to this many activities and relationships are walked in one task; larger ones by joins.
MAX_EDGES = 500_000


def enrich_tasks(task: DataFrame, calendar: DataFrame, project: DataFrame) -> DataFrame:
    """Activities with hours per day, float, flags, parsed dates and the project's data date.

    An absent column reads as ``''``. Blank float is 999 for criticality and 0 elsewhere. The
    project's day length is that of its own calendar, or its default one, else 8.
    """
    for c in ("phys_complete_pct", "act_pct_complete", "driving_path_flag", "cstr_type", "cstr_type2", "crt_path_num", "early_start_date", "early_end_date", "act_start_date", "act_end_date", "target_start_date", "target_end_date", "total_float_hr_cnt", "remain_drtn_hr_cnt", "target_drtn_hr_cnt"):
        if c not in task.columns:
            task = task.withColumn(c, F.lit(""))
    per_day = calendar.groupBy("clndr_id").agg(F.max(number("day_hr_cnt")).alias("hpd"))
    own = [F.nullif(F.col(c), F.lit("")) for c in ("clndr_id", "dflt_clndr_id") if c in project.columns]
    dates = project.groupBy("proj_id").agg(F.first("last_recalc_date").alias("data_date_raw"), F.first(F.coalesce(F.nullif("scd_end_date", F.lit("")), "plan_end_date")).alias("finish_raw"), F.first(F.coalesce(*own) if own else F.lit(None).cast("string")).alias("_cal"))
    dates = dates.join(per_day.select(F.col("clndr_id").alias("_cal"), F.col("hpd").alias("_per")), "_cal", "left").select("proj_id", "data_date_raw", "finish_raw", F.when(F.col("_per") > 0, F.col("_per")).otherwise(8.0).alias("proj_hpd"))
    t = task.join(per_day, "clndr_id", "left").join(dates, "proj_id", "left")
    work = is_work()
    open_ = work & (F.col("status_code") != "TK_Complete")
    tf999 = number_or("total_float_hr_cnt", 999.0)
    return t.select(
        *task.columns, "hpd", "proj_hpd", "finish_raw", work.alias("work"), open_.alias("open"), tf999.alias("tf999"), number_or("total_float_hr_cnt", 0.0).alias("tf0"),
        (open_ & (tf999 <= 0)).alias("cp"), has_hard(F.col("cstr_type"), F.col("cstr_type2")).alias("hard"), moment("data_date_raw").alias("data_date"),
        *[moment(f"{c}_date").alias(f"{c}_ts") for c in ("early_start", "early_end", "act_start", "act_end", "target_start", "target_end")],
    )


def enrich_edges(taskpred: DataFrame, tasks: DataFrame) -> DataFrame:
    """Relationships with both ends: project, status, type, criticality, calendar; lag in hours, and
    whether the relationship itself is flagged as driving."""
    flags = [F.col(c) == "Y" for c in ("driving", "driving_path_flag") if c in taskpred.columns]
    taskpred = taskpred.withColumn("flagged", F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags]), F.lit(False)) if flags else F.lit(False))
    end = lambda p: tasks.select(*[F.col(c).alias(f"{p}_{c}") for c in ("task_id", "proj_id", "status_code", "work", "cp", "clndr_id", "hpd")])
    pred = end("pred").withColumnRenamed("pred_task_id", "_pid")
    e = taskpred.join(end("succ"), taskpred["task_id"] == F.col("succ_task_id"), "left").join(pred, taskpred["pred_task_id"] == F.col("_pid"), "left")
    return e.select("task_id", "pred_task_id", "pred_type", "flagged", F.coalesce(number("lag_hr_cnt"), F.lit(0.0)).alias("lag"), *[f"{p}_{c}" for p in ("succ", "pred") for c in ("proj_id", "status_code", "clndr_id", "hpd")], *[F.coalesce(f"{p}_{c}", F.lit(False)).alias(f"{p}_{c}") for p in ("succ", "pred") for c in ("work", "cp")])


def _per_project(project: DataFrame, part: DataFrame, **fill: float) -> DataFrame:
    return project.select("proj_id").distinct().join(part, "proj_id", "left").fillna({c: 0 for c in part.columns if c != "proj_id"})


def _pct(a: Column, b: Column) -> Column:
    return F.when(b > 0, a * 100.0 / b).otherwise(F.lit(0.0))


def _cases(*rules: tuple[Column, int], other: int) -> Column:
    return reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0])).otherwise(other)


def pick_projects(project: DataFrame, task: DataFrame) -> DataFrame:
    """proj_id, n_tasks and pick: projects by falling number of activities, ties by order of id."""
    n = task.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    per = _per_project(project, n)
    return per.withColumn("pick", F.row_number().over(Window.orderBy(F.desc("n_tasks"), F.col("proj_id").try_cast("long"), "proj_id")).cast("long") - 1)


def counters(project: DataFrame, tasks: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("work") & c)
    s = F.col("status_code")
    return _per_project(project, tasks.groupBy("proj_id").agg(n(F.lit(True)).alias("n_work"), n(s == "TK_Complete").alias("n_complete"), n(s == "TK_Active").alias("n_active"), n(s == "TK_NotStart").alias("n_not_started")))


def critical_path(project: DataFrame, tasks: DataFrame) -> DataFrame:
    p = _per_project(project, tasks.groupBy("proj_id").agg(F.count_if("open").alias("n_open"), F.count_if("cp").alias("cp_count")))
    pct = _pct(F.col("cp_count"), F.col("n_open"))
    return p.withColumn("cp_pct", pct).withColumn("score", _cases((F.col("cp_count") == 0, 0), (F.col("cp_pct") < 3, 55), (F.col("cp_pct") > 40, 55), other=100).cast("long"))


def critical_activities(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Critical activities with float in days and the number of predecessors and successors."""
    own = edges.where(F.col("succ_proj_id").isNotNull())
    preds, succs = own.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_pred")), own.groupBy(F.col("pred_task_id").alias("task_id")).agg(F.count(F.lit(1)).alias("n_succ"))
    cp = tasks.where("cp").join(preds, "task_id", "left").join(succs, "task_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cp.select("proj_id", "task_id", "task_code", "wbs_id", (F.col("tf999") / F.when(F.col("hpd") > 0, F.col("hpd")).otherwise(8.0)).alias("tf_days"), "cstr_type", "cstr_type2", "crt_path_num", zero("n_pred"), zero("n_succ"))


def constraint_driven(project: DataFrame, tasks: DataFrame) -> DataFrame:
    p = _per_project(project, tasks.groupBy("proj_id").agg(F.count_if("cp").alias("cp_count"), F.count_if(F.col("cp") & F.col("hard")).alias("cp_constrained")))
    pct = _pct(F.col("cp_constrained"), F.col("cp_count"))
    return p.withColumn("pct", pct).withColumn("score", _cases((F.col("pct") > 50, 30), (F.col("pct") > 25, 60), (F.col("pct") > 0, 75), other=100).cast("long"))


def constraint_breakdown(tasks: DataFrame) -> DataFrame:
    """Constraint codes of open activities over both slots."""
    each = tasks.where("open").select("proj_id", F.explode(F.array("cstr_type", "cstr_type2")).alias("cstr")).where("cstr <> ''")
    return each.groupBy("proj_id", "cstr").agg(F.count(F.lit(1)).alias("n"))


def constraint_saturation(project: DataFrame, tasks: DataFrame) -> DataFrame:
    p = _per_project(project, tasks.groupBy("proj_id").agg(F.count_if("open").alias("n_open"), F.count_if(F.col("open") & F.col("hard")).alias("n_hard")))
    return p.withColumn("pct", _pct(F.col("n_hard"), F.col("n_open"))).withColumn("score", _cases((F.col("pct") > 20, 30), (F.col("pct") > 5, 60), other=100).cast("long"))


def open_ends(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Open activities that lack a predecessor or a successor; terminals of the critical path excluded.

    Terminal: a critical activity without successor that is a milestone or ends on the
    project's finish; where a project has none, those with its latest early end, or the only
    such activity if it has no early end.
    """
    own = edges.where(F.col("succ_proj_id").isNotNull())
    has_pred, has_succ = own.select("task_id").distinct().withColumn("p", F.lit(True)), own.select(F.col("pred_task_id").alias("task_id")).distinct().withColumn("s", F.lit(True))
    t = tasks.where("open").join(has_pred, "task_id", "left").join(has_succ, "task_id", "left")
    no_pred, no_succ = F.col("p").isNull(), F.col("s").isNull()
    end = F.substring("early_end_date", 1, 10)
    candidate = F.col("cp") & no_succ
    sure = F.col("task_type").isin("TT_Mile", "TT_FinMile") | ((end != "") & (end == F.substring("finish_raw", 1, 10)))
    bare = t.where(no_pred | no_succ).select("proj_id", "task_id", "cp", no_pred.alias("no_pred"), no_succ.alias("no_succ"), candidate.alias("cand"), F.coalesce(candidate & sure, F.lit(False)).alias("sure"), F.nullif(end, F.lit("")).alias("end"))
    per = bare.where("cand").groupBy("proj_id").agg(F.max("sure").alias("_some"), F.max("end").alias("_latest"), F.count(F.lit(1)).alias("_n"))
    last = F.when(F.col("_some"), F.col("sure")).when(F.col("_latest").isNotNull(), F.col("end") == F.col("_latest")).otherwise(F.col("_n") == 1)
    return bare.join(per, "proj_id", "left").select("proj_id", "task_id", "cp", "no_pred", "no_succ", F.coalesce(F.col("cand") & last, F.lit(False)).alias("terminal")).withColumn("no_succ", F.col("no_succ") & ~F.col("terminal"))


def open_end_score(project: DataFrame, tasks: DataFrame, ends: DataFrame) -> DataFrame:
    bad = F.col("no_pred") | F.col("no_succ")
    n = ends.groupBy("proj_id").agg(F.count_if(bad & F.col("cp")).alias("cp_open_ends"), F.count_if(bad).alias("open_ends"), F.count_if("terminal").alias("terminals"))
    p = _per_project(project, tasks.groupBy("proj_id").agg(F.count_if("open").alias("n_open")).join(n, "proj_id", "left"))
    return p.withColumn("score", F.when(F.col("cp_open_ends") > 0, F.greatest(F.lit(0), 40 - 10 * F.col("cp_open_ends"))).when(F.col("open_ends") > 0.15 * F.col("n_open"), 60).when(F.col("open_ends") > 0, 80).otherwise(100).cast("long"))


def relationship_quality(project: DataFrame, edges: DataFrame) -> DataFrame:
    own = edges.where(F.col("succ_proj_id").isNotNull()).withColumn("proj_id", F.col("succ_proj_id"))
    on_cp = F.col("succ_cp") & F.col("pred_cp")
    agg = own.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n_rels"), F.count_if(F.col("pred_type") == "PR_FS").alias("n_fs"), F.count_if(on_cp).alias("n_cp_rels"), F.count_if(on_cp & (F.col("pred_type") != "PR_FS")).alias("n_cp_not_fs"))
    p = _per_project(project, agg)
    return p.withColumn("score", F.when(F.col("n_cp_not_fs") * 2 > F.col("n_cp_rels"), 30).when(F.col("n_cp_not_fs") > 0, 70).otherwise(95).cast("long"))


def lags(edges: DataFrame) -> DataFrame:
    """Relationships with a lag, in days of the successor's calendar (the predecessor's if it names none)."""
    hpd = F.when(F.coalesce("succ_clndr_id", F.lit("")) != "", F.col("succ_hpd")).otherwise(F.col("pred_hpd"))
    own = edges.where(F.col("succ_proj_id").isNotNull() & (F.col("lag") != 0))
    return own.select(F.col("succ_proj_id").alias("proj_id"), "task_id", "pred_task_id", "pred_type", "lag", (F.col("lag") / F.when(hpd > 0, hpd).otherwise(8.0)).alias("lag_days"), (F.col("succ_cp") | F.col("pred_cp")).alias("on_cp"))


def lag_score(project: DataFrame, lagged: DataFrame) -> DataFrame:
    lead = F.col("lag") < 0
    agg = lagged.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n_lags"), F.count_if(lead).alias("n_leads"), F.count_if(lead & F.col("on_cp")).alias("n_cp_leads"), F.count_if(F.abs("lag_days") > 10).alias("n_excessive"))
    p = _per_project(project, agg)
    score = F.when(F.col("n_cp_leads") > 0, F.greatest(F.lit(0), 40 - 15 * F.col("n_cp_leads"))).when((F.col("n_leads") > 0.3 * F.col("n_lags")) & (F.col("n_leads") > 5), 60).when(F.col("n_leads") > 0, 80).otherwise(95)
    return p.withColumn("score", score.cast("long"))


def out_of_sequence(edges: DataFrame) -> DataFrame:
    """Pairs whose successor has begun before its predecessor allows it; each pair once."""
    begun = (F.col("succ_status_code") == "TK_Active") & F.col("pred_proj_id").isNotNull()
    broken = ((F.col("pred_type") == "PR_FS") & (F.col("pred_status_code") != "TK_Complete")) | ((F.col("pred_type") == "PR_SS") & (F.col("pred_status_code") == "TK_NotStart"))
    return edges.where(begun & broken & F.col("succ_work")).groupBy(F.col("succ_proj_id").alias("proj_id"), "task_id", "pred_task_id").agg(F.min("pred_type").alias("pred_type"), F.max("succ_cp").alias("on_cp"))


def oos_score(project: DataFrame, tasks: DataFrame, oos: DataFrame) -> DataFrame:
    n = oos.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n_oos"), F.count_if("on_cp").alias("n_oos_cp"))
    act = tasks.groupBy("proj_id").agg(F.count_if(F.col("work") & (F.col("status_code") == "TK_Active")).alias("n_active"))
    p = _per_project(project, act.join(n, "proj_id", "left"))
    return p.withColumn("score", F.when(F.col("n_oos_cp") > 0, 30).when((F.col("n_oos") > 0.2 * F.col("n_active")) & (F.col("n_oos") > 3), 60).when(F.col("n_oos") > 0, 80).otherwise(100).cast("long"))


def near_critical(tasks: DataFrame) -> DataFrame:
    """Open activities with a float above 0 and up to 80 hours, with the band of their days."""
    d = days("total_float_hr_cnt", "hpd")
    return tasks.where(F.col("open") & (F.col("tf999") > 0) & (F.col("tf999") <= 80)).select("proj_id", "task_id", "tf999", d.alias("tf_days"), F.when(d <= 2, 1).when(d <= 5, 2).otherwise(3).cast("long").alias("band"))


def near_critical_score(project: DataFrame, tasks: DataFrame, near: DataFrame) -> DataFrame:
    n = near.groupBy("proj_id").agg(*[F.count_if(F.col("band") == b).alias(f"band_{b}") for b in (1, 2, 3)], F.count(F.lit(1)).alias("n_near"))
    p = _per_project(project, tasks.groupBy("proj_id").agg(F.count_if("open").alias("n_open")).join(n, "proj_id", "left"))
    return p.withColumn("score", F.when(F.col("band_1") > 10, 40).when(F.col("n_near") > 0.3 * F.col("n_open"), 55).when((F.col("n_near") > 0) & (F.col("band_1") > 3), 80).when(F.col("n_near") > 0, 90).otherwise(100).cast("long"))


def _reach(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Tasks of one project from which an anchor can be reached, by a walk against the links."""
    back: dict[str, list[str]] = {}
    for s, p in zip(links["task_id"], links["pred_task_id"], strict=True):
        back.setdefault(s, []).append(p)
    seen = set(nodes.loc[nodes["anchor"], "task_id"])
    todo = deque(seen)
    while todo:
        for p in back.get(todo.popleft(), ()):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return nodes.loc[nodes["task_id"].isin(seen), ["task_id"]].assign(proj_id=key[0])


def reaching(tasks: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """proj_id, task_id of every activity that leads to an anchor of its project.

    Anchors are critical finish milestones, or all finish milestones where none is critical.
    Cyclic logic ends in either way of walking. Projects of more than ``max_edges`` activities
    and relationships are not put into one task: their frontier moves by joins, one step a
    round, and each round writes its new activities only.
    """
    fin = F.col("task_type") == "TT_FinMile"
    some = tasks.groupBy("proj_id").agg(F.max(fin & F.col("cp")).alias("_some"), F.count(F.lit(1)).alias("_n"))
    links = edges.where(F.col("succ_proj_id") == F.col("pred_proj_id")).select(F.col("succ_proj_id").alias("pid"), "task_id", "pred_task_id")
    sizes = some.join(links.groupBy(F.col("pid").alias("proj_id")).agg(F.count(F.lit(1)).alias("_m")), "proj_id", "left")
    sizes = cut(sizes.select("proj_id", "_some", (F.col("_n") + F.coalesce("_m", F.lit(0)) > max_edges).alias("large")))
    nodes = tasks.join(sizes, "proj_id").select("proj_id", "task_id", "large", F.when(F.col("_some"), fin & F.col("cp")).otherwise(fin).alias("anchor"))
    links = links.join(sizes.select(F.col("proj_id").alias("pid"), "large"), "pid")
    out = nodes.where("not large").drop("large").groupBy("proj_id").cogroup(links.where("not large").groupBy("pid")).applyInPandas(_reach, "task_id string, proj_id string").select("proj_id", "task_id")
    if sizes.where("large").isEmpty():
        return out
    far = cut(links.where("large").drop("large"))
    fronts = [cut(nodes.where("large and anchor").select("proj_id", "task_id"))]
    while not fronts[-1].isEmpty():
        step = fronts[-1].join(far, "task_id").select("proj_id", F.col("pred_task_id").alias("task_id")).distinct()
        fronts.append(cut(step.join(reduce(DataFrame.unionByName, fronts), ["proj_id", "task_id"], "left_anti")))
    return reduce(DataFrame.unionByName, [out, *fronts])


def disconnected(tasks: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Open activities that lead to no anchor."""
    return tasks.where("open").join(reaching(tasks, edges, max_edges), ["proj_id", "task_id"], "left_anti").select("proj_id", "task_id", "cp")


def continuity_score(project: DataFrame, tasks: DataFrame, loose: DataFrame) -> DataFrame:
    n = loose.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n_loose"), F.count_if("cp").alias("n_loose_cp"))
    p = _per_project(project, tasks.groupBy("proj_id").agg(F.count_if("open").alias("n_open")).join(n, "proj_id", "left"))
    return p.withColumn("score", F.when(F.col("n_loose_cp") > 0, 20).when(F.col("n_loose") > 0.1 * F.col("n_open"), 60).when(F.col("n_loose") > 0, 80).otherwise(100).cast("long"))


# Weights of the nine checks, in their order.
WEIGHTS = {"cp": 0.05, "constraints": 0.17, "open_ends": 0.20, "relationships": 0.13, "lags": 0.15, "continuity": 0.10, "near": 0.10, "oos": 0.05, "saturation": 0.05}


def confidence(project: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """Weighted score of each project, unrounded, its band and how far it is to be trusted."""
    out = project.select("proj_id").distinct()
    for name in WEIGHTS:
        out = out.join(scores[name].select("proj_id", F.col("score").alias(f"s_{name}")), "proj_id")
    total = reduce(lambda a, b: a + b, [F.col(f"s_{n}") * F.lit(w) for n, w in WEIGHTS.items()])
    return out.select("proj_id", *[f"s_{n}" for n in WEIGHTS], total.alias("overall")).withColumns({
        "band": F.when(F.col("overall") >= 80, "GREEN").when(F.col("overall") >= 40, "AMBER").otherwise("RED"),
        "confidence": F.when(F.col("overall") >= 80, "High Confidence").when(F.col("overall") >= 60, "Moderate Confidence").when(F.col("overall") >= 40, "Low Confidence").otherwise("Unreliable"),
    })


def all_scores(project: DataFrame, tasks: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The nine score tables; tasks and relationships are built once and read by all of them."""
    tasks, edges = cut(tasks), cut(edges)
    return {
        "cp": critical_path(project, tasks), "constraints": constraint_driven(project, tasks), "open_ends": open_end_score(project, tasks, open_ends(tasks, edges)),
        "relationships": relationship_quality(project, edges), "lags": lag_score(project, lags(edges)), "oos": oos_score(project, tasks, out_of_sequence(edges)),
        "near": near_critical_score(project, tasks, near_critical(tasks)), "continuity": continuity_score(project, tasks, disconnected(tasks, edges)), "saturation": constraint_saturation(project, tasks),
    }


def recommendations(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per finding, by priority: 1 critical, 2 high, 3 medium.

    Findings on a project as a whole have a null task_id: less than 80 % FS relationships,
    more than 10 leads with none at a critical activity, and more than 5 % of the open
    activities with a hard constraint.
    """
    tasks, edges = cut(tasks), cut(edges)  # each is read many times
    ends, oos_, loose = open_ends(tasks, edges), lags(edges), disconnected(tasks, edges)
    own, lead = edges.where(F.col("succ_proj_id").isNotNull()), F.col("lag") < 0
    links = own.groupBy(F.col("succ_proj_id").alias("proj_id")).agg(F.count(F.lit(1)).alias("n_rels"), F.count_if(F.col("pred_type") == "PR_FS").alias("n_fs"), F.count_if(lead).alias("n_leads"), F.count_if(lead & (F.col("succ_cp") | F.col("pred_cp"))).alias("n_cp_leads"))
    bound = tasks.groupBy("proj_id").agg(F.count_if("open").alias("n_open"), F.count_if(F.col("open") & F.col("hard")).alias("n_hard"))
    wide = lambda df: df.withColumn("task_id", F.lit(None).cast("string"))
    row = lambda df, prio, kind: df.select("proj_id", prio.cast("long").alias("priority"), F.lit(kind).alias("kind"), "task_id")
    one = F.lit(1)
    return reduce(DataFrame.unionByName, [
        row(tasks.where("cp and hard"), one, "constraint on the critical path"),
        row(ends.where("no_pred"), F.when(F.col("cp"), 1).otherwise(3), "no predecessor"),
        row(ends.where("no_succ"), F.when(F.col("cp"), 1).otherwise(2), "no successor"),
        row(oos_.where("lag < 0 and on_cp"), one, "lead on the critical path"),
        row(loose, F.when(F.col("cp"), 1).otherwise(2), "leads to no finish"),
        row(wide(links.where("n_fs * 100 < 80 * n_rels")), F.lit(3), "few FS relationships"),
        row(wide(links.where("n_leads > 10 and n_cp_leads = 0")), F.lit(2), "leads off the critical path"),
        row(wide(bound.where("n_hard * 100 > 5 * n_open")), F.lit(2), "hard constraints on many activities"),
    ])


# How a relationship of each type bounds the successor's start (S) by the predecessor's: with the
# predecessor's and the successor's durations p and s, S >= P + p (FS), P (SS), P + p - s (FF), P - s (SF).
_BOUND = {"PR_FS": (1, 0), "PR_SS": (0, 0), "PR_FF": (1, -1), "PR_SF": (0, -1)}


def _off_longest(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Critical activities of one project with slack on its longest path; none if its logic is cyclic."""
    span = dict(zip(nodes["task_id"], nodes["span"], strict=True))
    ahead: dict[str, list[tuple[str, float]]] = {}
    waits = dict.fromkeys(span, 0)
    for s, p, k in zip(links["task_id"], links["pred_task_id"], links["pred_type"], strict=True):
        a, b = _BOUND.get(k, _BOUND["PR_FS"])
        ahead.setdefault(p, []).append((s, a * span[p] + b * span[s]))
        waits[s] += 1
    order, start = deque(t for t, n in waits.items() if n == 0), dict.fromkeys(span, 0.0)
    done: list[str] = []
    while order:
        t = order.popleft()
        done.append(t)
        for s, gap in ahead.get(t, ()):
            start[s] = max(start[s], start[t] + gap)
            waits[s] -= 1
            if waits[s] == 0:
                order.append(s)
    if len(done) < len(span):
        return nodes.loc[[], ["task_id"]].assign(proj_id=key[0])
    end = max((start[t] + span[t] for t in done), default=0.0)
    late = {t: end - span[t] for t in done}
    for t in reversed(done):
        late[t] = min([late[t], *(late[s] - gap for s, gap in ahead.get(t, ()))])
    off = {t for t in done if late[t] - start[t] > 1e-9}
    return nodes.loc[nodes["cp"] & nodes["task_id"].isin(off), ["task_id"]].assign(proj_id=key[0])


def _relaxed(state: DataFrame, links: DataFrame, most: int) -> DataFrame | None:
    """``state`` (id, at) raised along ``links`` (id, other, gap) until at[other] >= at[id] + gap
    holds for all, or None if that takes more than ``most`` rounds: then the links run in a circle."""
    state = cut(state)
    for _ in range(most + 1):
        pushed = state.join(links, "id").groupBy(F.col("other").alias("id")).agg(F.max(F.col("at") + F.col("gap")).alias("push"))
        raised = cut(state.join(pushed, "id", "left").select("id", F.greatest("at", "push").alias("at"), F.coalesce(F.col("push") > F.col("at") + 1e-9, F.lit(False)).alias("moved")))
        state = raised.select("id", "at")
        if raised.where("moved").isEmpty():
            return state
    return None


def off_longest_path(tasks: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """proj_id, task_id of critical activities that the network alone does not make critical.

    The network holds the project's work activities with their remaining durations in days, and
    the relationships between them without lags; an unknown type counts as finish to start.
    Off the longest path is what could start later without moving the network's end. A project
    whose logic is cyclic has no longest path and no rows. Projects of more than ``max_edges``
    activities and relationships are not put into one task: starts are raised by joins, one
    step of the network a round.
    """
    span = days("remain_drtn_hr_cnt", "hpd")
    nodes = tasks.where("work").select("proj_id", "task_id", "cp", F.greatest(span, F.lit(0.0)).alias("span"))
    inside = edges.where(F.col("succ_work") & F.col("pred_work") & (F.col("succ_proj_id") == F.col("pred_proj_id")))
    links = inside.select(F.col("succ_proj_id").alias("pid"), "task_id", "pred_task_id", "pred_type")
    n, m = nodes.groupBy("proj_id").agg(F.count(F.lit(1)).alias("_n")), links.groupBy(F.col("pid").alias("proj_id")).agg(F.count(F.lit(1)).alias("_m"))
    sizes = cut(n.join(m, "proj_id", "left").select("proj_id", "_n", (F.col("_n") + F.coalesce("_m", F.lit(0)) > max_edges).alias("large")))
    nodes, links = nodes.join(sizes.drop("_n"), "proj_id"), links.join(sizes.select(F.col("proj_id").alias("pid"), "large"), "pid")
    out = nodes.where("not large").drop("large").groupBy("proj_id").cogroup(links.where("not large").drop("large").groupBy("pid")).applyInPandas(_off_longest, "task_id string, proj_id string").select("proj_id", "task_id")
    for big in (r["proj_id"] for r in sizes.where("large").toLocalIterator()):  # one at a time, each larger than max_edges
        own, rel = nodes.where(F.col("proj_id") == big), links.where(F.col("pid") == big)
        spans = lambda p: own.select(F.col("task_id").alias(f"{p}_id"), F.col("span").alias(f"{p}_span"))  # noqa: E731, B023
        kind = lambda i: F.coalesce(*[F.when(F.col("pred_type") == k, F.lit(v[i])) for k, v in _BOUND.items()], F.lit(_BOUND["PR_FS"][i]))
        gaps = cut(rel.join(spans("s"), F.col("task_id") == F.col("s_id")).join(spans("p"), F.col("pred_task_id") == F.col("p_id")).select("p_id", "s_id", (kind(0) * F.col("p_span") + kind(1) * F.col("s_span")).alias("gap")))
        most = own.count()
        start = _relaxed(own.select(F.col("task_id").alias("id"), F.lit(0.0).alias("at")), gaps.select(F.col("p_id").alias("id"), F.col("s_id").alias("other"), "gap"), most)
        if start is None:
            continue
        known = own.select(F.col("task_id").alias("id"), "span", "cp")
        end = start.join(known, "id").agg(F.max(F.col("at") + F.col("span"))).first()[0]
        # The latest starts are found from the end: what is left after an activity's start.
        left = _relaxed(known.select("id", F.col("span").alias("at")), gaps.select(F.col("s_id").alias("id"), F.col("p_id").alias("other"), "gap"), most)
        off = start.join(left.withColumnRenamed("at", "left"), "id").join(known, "id").where(F.col("cp") & (F.lit(end) - F.col("left") - F.col("at") > 1e-9))
        out = out.unionByName(off.select(F.lit(big).alias("proj_id"), F.col("id").alias("task_id")))
    return out


# --- Health checks -------------------------------------------------------------------------

# Thresholds of the bundled profiles (commercial, nuclear, mining).
PROFILES: dict[str, dict[str, float]] = {
    "commercial": {"logic": 5, "leads": 0, "lags": 5, "fs": 90, "hard": 5, "high_float_days": 44, "high_float": 5, "neg_float": 0, "high_duration_days": 44, "high_duration": 5, "invalid": 0, "resources": 80, "missed": 5, "cpli": 0.95, "bei": 0.95},
    "nuclear": {"logic": 2, "leads": 0, "lags": 3, "fs": 95, "hard": 3, "high_float_days": 44, "high_float": 3, "neg_float": 0, "high_duration_days": 30, "high_duration": 3, "invalid": 0, "resources": 90, "missed": 3, "cpli": 0.98, "bei": 0.98},
    "mining": {"logic": 8, "leads": 0, "lags": 8, "fs": 85, "hard": 8, "high_float_days": 60, "high_float": 8, "neg_float": 0, "high_duration_days": 60, "high_duration": 8, "invalid": 0, "resources": 70, "missed": 8, "cpli": 0.90, "bei": 0.90},
}


def profile(of: str | dict[str, float] = "commercial") -> dict[str, float]:
    """A bundled profile, or the commercial one with the caller's own thresholds."""
    if isinstance(of, dict):
        return PROFILES["commercial"] | of
    if of not in PROFILES:
        raise ValueError(f"unknown profile {of!r}; known: {', '.join(PROFILES)}")
    return dict(PROFILES[of])


def health_checks(project: DataFrame, tasks: DataFrame, edges: DataFrame, taskrsrc: DataFrame, of: str | dict[str, float] = "commercial") -> DataFrame:
    """proj_id, check_id, value, threshold, severity: the fourteen checks of every project.

    Relationships count for a project if either end is in it. A check that cannot be computed
    has a null value and severity INFO, which does not count as passed.
    """
    th = profile(of)
    work = F.col("work")
    t = tasks.where("work")
    mark = lambda df, c, p, s, r: df.select(F.col(c).alias("task_id"), *[F.lit(v).alias(n) for n, v in (("_p", p), ("_s", s), ("_r", r))])
    marks = mark(edges, "task_id", 1, None, None).unionByName(mark(edges, "pred_task_id", None, 1, None)).unionByName(mark(taskrsrc, "task_id", None, None, 1))
    t = t.join(marks.groupBy("task_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in ("_p", "_s", "_r")]), "task_id", "left")
    kind, dd = F.col("task_type"), F.col("data_date")
    no_logic = (F.col("_p").isNull() & ~kind.isin("TT_Mile", "TT_FinMile")) | (F.col("_s").isNull() & (kind != "TT_FinMile"))
    open_, per = F.col("open"), F.when(F.col("hpd") > 0, F.col("hpd")).otherwise(8.0)
    body = open_ & ~kind.isin("TT_Mile", "TT_FinMile")
    late = lambda c: F.coalesce(c > dd, F.lit(False)).cast("int")
    remain = number_or("remain_drtn_hr_cnt", 0.0)
    done = percent_complete(F.col("phys_complete_pct"), F.col("act_pct_complete"), F.col("target_drtn_hr_cnt"), F.col("remain_drtn_hr_cnt"))
    stale = F.coalesce((F.col("target_end_ts") < dd) & (done < 100) & (F.col("status_code") != "TK_Complete") & F.col("act_end_ts").isNull(), F.lit(False)).cast("int")
    due = F.coalesce(F.col("target_end_ts") <= dd, F.lit(False))
    cp = F.col("cp")
    a = t.groupBy("proj_id").agg(
        F.count_if(work).alias("n"), F.count_if(no_logic).alias("n_logic"), F.count_if("hard").alias("n_hard"), F.count_if(open_).alias("n_open"),
        F.count_if(open_ & (F.col("tf0") / per > th["high_float_days"])).alias("n_hf"), F.count_if(open_ & (F.col("tf0") < 0)).alias("n_neg"),
        F.count_if(body).alias("n_body"), F.count_if(body & (remain / per > th["high_duration_days"])).alias("n_hd"),
        F.sum(late(F.col("act_start_ts")) + late(F.col("act_end_ts")) + stale).alias("n_inv"), F.count_if(F.col("_r").isNotNull()).alias("n_res"),
        F.count_if(due).alias("n_due"), F.count_if(due & (F.col("status_code") != "TK_Complete")).alias("n_missed"), F.max("data_date").alias("dd"),
        F.coalesce(F.max(F.when(cp, F.col("early_end_ts"))), F.max(F.when(cp, F.col("target_end_ts")))).alias("cp_end"), F.min(F.when(cp, F.col("tf999") / per)).alias("cp_tf"), F.max("proj_hpd").alias("proj_hpd"),
    )
    sides = edges.select(F.explode(F.array_distinct(F.array("succ_proj_id", "pred_proj_id"))).alias("proj_id"), "lag", "pred_type").where(F.col("proj_id").isNotNull())
    e = sides.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n_e"), F.count_if(F.col("lag") < 0).alias("n_lead"), F.count_if(F.col("lag") > 0).alias("n_lag"), F.count_if(F.col("pred_type") == "PR_FS").alias("n_fs"))
    p = _per_project(project, a.drop("dd", "cp_end", "cp_tf", "proj_hpd").join(e, "proj_id", "left")).join(a.select("proj_id", "dd", "cp_end", "cp_tf", "proj_hpd"), "proj_id", "left")
    c = F.col
    length = (F.unix_micros(c("cp_end").cast("timestamp")) - F.unix_micros(c("dd").cast("timestamp"))) / 3.6e9 / c("proj_hpd")
    cpli = F.when(length > 0, (length + c("cp_tf")) / length)
    resources = F.when(c("n") > 0, _pct(c("n_res"), c("n"))).otherwise(F.lit(100.0))
    dated = c("dd").isNotNull()
    up, down = (lambda v, lim: v <= lim), (lambda v, lim: v >= lim)
    rules: list[tuple[int, Column, float, object, str]] = [
        (1, _pct(c("n_logic"), c("n")), th["logic"], up, "WARN"), (2, c("n_lead").cast("double"), th["leads"], up, "BLOCK"), (3, _pct(c("n_lag"), c("n_e")), th["lags"], up, "WARN"),
        (4, F.when(c("n_e") > 0, c("n_fs") * 100.0 / c("n_e")).otherwise(100.0), th["fs"], down, "WARN"), (5, _pct(c("n_hard"), c("n")), th["hard"], up, "WARN"),
        (6, _pct(c("n_hf"), c("n_open")), th["high_float"], up, "WARN"), (7, c("n_neg").cast("double"), th["neg_float"], up, "BLOCK"),
        (8, c("n_hd") * 100.0 / F.greatest(c("n_body"), F.lit(1)), th["high_duration"], up, "WARN"), (9, F.when(dated, c("n_inv").cast("double")), th["invalid"], up, "BLOCK"),
        (10, resources, th["resources"], down, "WARN"), (11, F.when(dated, c("n_inv").cast("double")), th["invalid"], up, "BLOCK"), (12, resources, th["resources"], down, "WARN"),
        (13, F.when(dated, _pct(c("n_missed"), c("n_due"))), th["missed"], up, "WARN"), (14, cpli, th["cpli"], down, "BLOCK"),
    ]
    told = [F.struct(F.lit(i).cast("long").alias("check_id"), v.cast("double").alias("value"), F.lit(float(lim)).alias("threshold"), F.when(v.isNull(), "INFO").when(ok(v, lim), "PASS").otherwise(sev).alias("severity")) for i, v, lim, ok, sev in rules]
    return p.select("proj_id", F.inline(F.array(*told)))


def health_score(checks: DataFrame) -> DataFrame:
    return checks.groupBy("proj_id").agg(F.count_if(F.col("severity") == "PASS").alias("passed"))


def execution_index(baseline: DataFrame, tasks: DataFrame, of: str | dict[str, float] = "commercial") -> DataFrame:
    """Distinct baseline work activities due by the data date, those complete now, their ratio and severity.

    The data date is that of the project with the most activities, the first by id of equal
    ones. Of current work activities with one code, the first by id counts.
    """
    largest = tasks.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n"), F.max("data_date").alias("dd")).orderBy(F.desc("n"), F.col("proj_id").try_cast("long"), "proj_id").first()
    by = F.lit(largest["dd"] if largest else None).cast("timestamp_ntz")
    now = tasks.where("work").groupBy("task_code").agg(F.min_by("status_code", F.struct(F.col("task_id").try_cast("long"), "task_id")).alias("now"))
    due = baseline.where(is_work() & (moment("target_end_date") <= by)).select("task_code").distinct()
    out = due.join(now, "task_code", "left").agg(F.count(F.lit(1)).alias("n_due"), F.count_if(F.col("now") == "TK_Complete").alias("n_done")).withColumn("bei", F.col("n_done") / F.nullif(F.col("n_due"), F.lit(0)))
    return out.withColumn("severity", F.when(F.col("bei").isNull(), "INFO").when(F.col("bei") >= profile(of)["bei"], "PASS").otherwise("WARN"))


def path_groups(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """proj_id, path, task_code, place: the critical paths, each in order of start and code.

    A project whose critical activities bear two or more path numbers is grouped by them, and
    activities without one are left out. In any other project the paths are the connected
    components of the relationships between critical activities, each named by its least id.
    """
    cp = cut(tasks.where("cp").select("proj_id", "task_id", "task_code", F.nullif(F.nullif(F.trim("crt_path_num"), F.lit("")), F.lit("0")).alias("flag"), F.coalesce("early_start_ts", "target_start_ts").alias("start")))
    several = cp.groupBy("proj_id").agg((F.count_distinct("flag") > 1).alias("by_flag"))
    cp = cp.join(several, "proj_id")
    flagged = cp.where("by_flag and flag is not null").withColumn("path", F.col("flag"))
    rest = cp.where("not by_flag")
    inside = edges.where(F.col("succ_cp") & F.col("pred_cp") & (F.col("succ_proj_id") == F.col("pred_proj_id"))).select(F.col("task_id").alias("a"), F.col("pred_task_id").alias("b"))
    found = connected_components(rest.select(F.col("task_id").alias("id")), inside)
    paths = flagged.unionByName(rest.join(found.select(F.col("id").alias("task_id"), F.col("comp").alias("path")), "task_id").select(*flagged.columns))
    order = Window.partitionBy("proj_id", "path").orderBy(F.col("start").asc_nulls_last(), "task_code")
    return paths.select("proj_id", "path", "task_code", F.row_number().over(order).cast("long").alias("place"))


def continuity_gaps(edges: DataFrame) -> DataFrame:
    """Relationships into critical activities whose predecessor is neither critical nor complete."""
    gap = F.col("succ_cp") & ~F.col("pred_cp") & (F.col("pred_proj_id") == F.col("succ_proj_id")) & (F.col("pred_status_code") != "TK_Complete")
    return edges.where(gap).select(F.col("succ_proj_id").alias("proj_id"), "task_id", "pred_task_id")


def drivers(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """One driving predecessor per activity: the first on a relationship flagged as driving, else
    the one that ends last, the first of equal ones. Predecessors without any date drive by a flag
    only; an activity whose driver is no known activity has none."""
    end = tasks.select(F.col("task_id").alias("pred_task_id"), F.coalesce("early_end_ts", "act_end_ts", "target_end_ts").alias("pred_end"), F.lit(True).alias("known"))
    each = edges.select("task_id", "pred_task_id", "flagged").join(end, "pred_task_id", "left").where(F.col("flagged") | F.col("pred_end").isNotNull())
    rank = F.struct(~F.col("flagged"), F.when(~F.col("flagged"), -F.unix_micros(F.col("pred_end").cast("timestamp"))), F.col("pred_task_id").try_cast("long"), "pred_task_id")
    best = each.groupBy("task_id").agg(F.min_by(F.struct("pred_task_id", "known"), rank).alias("d"))
    return best.where("d.known").select("task_id", "d.pred_task_id")


def driving_path(tasks: DataFrame, edges: DataFrame, codes: list[str] | None = None, most: int = 200) -> DataFrame:
    """code, step, task_code: the driving chain back from each activity, step 0 being itself.

    All activities are traced, or those with the given codes. A chain stops at an activity
    without predecessor, one already met, one complete (included), one that ends before its
    data date (included), or after ``most`` steps. Chains double in length each round, so
    that log2(most) rounds of joins build all of them.
    """
    over = (F.col("status_code") == "TK_Complete") | F.coalesce(F.coalesce("early_end_ts", "act_end_ts") < F.col("data_date"), F.lit(False))
    t = cut(tasks.select("task_id", "task_code", over.alias("halt")).join(drivers(tasks, edges), "task_id", "left"))
    state = t.select("task_id", F.array(F.struct("task_id", "task_code")).alias("chain"), F.when(~F.col("halt"), F.col("pred_task_id")).alias("next"))
    going = F.col("next").isNotNull() & (F.size("chain") < most)
    while not (active := state.where(going)).isEmpty():
        state = cut(_chained(active, state).unionByName(state.where(~going)))
    first = t.where(F.col("task_code").isin(codes)) if codes is not None else t
    begun = first.select("task_id", F.array(F.struct("task_id", "task_code")).alias("chain"), F.col("pred_task_id").alias("next"))
    whole = _chained(begun.where("next is not null"), state).unionByName(begun.where("next is null"))
    # What follows the first activity met again has been met, too: the distinct ones come first.
    path = F.slice("chain", 1, F.least(F.size(F.array_distinct("chain.task_id")), F.lit(most + 1)))
    return whole.select(F.get("chain", F.lit(0))["task_code"].alias("code"), F.posexplode(path).alias("step", "at")).select("code", F.col("step").cast("long"), F.col("at.task_code").alias("task_code"))


def _chained(chains: DataFrame, state: DataFrame) -> DataFrame:
    """``chains`` continued by the chain of the activity each of them leads to."""
    ahead = state.select(F.col("task_id").alias("next"), F.col("chain").alias("_chain"), F.col("next").alias("_next"))
    hot = hot_values(chains, ["next"])["next"]
    met = salted_join(chains, ahead, ["next"], F.col("next").isin(hot) if hot else F.lit(False), F.col("task_id"), "inner")
    return met.select("task_id", F.concat("chain", "_chain").alias("chain"), F.col("_next").alias("next"))
