"""Cross references, baselines, comparisons and summaries of schedule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.calendars import calendar_map
from trussline.functions.exprs import MILESTONE_TYPES, STATUS_LABELS, TYPE_LABELS, is_work, labelled, number
from trussline.operators.common import cut, hot_values, one_of, salted_join
from trussline.operators.hierarchy import hierarchy
from trussline.operators.schedule import profile

# Known field counts of the main tables by major version.
FIELD_COUNTS = {
    "24": {"PROJECT": 71, "SCHEDOPTIONS": 25, "PROJWBS": 26, "TASK": 61, "TASKPRED": 11},
    "23": {"PROJECT": 71, "SCHEDOPTIONS": 25, "PROJWBS": 26, "TASK": 61, "TASKPRED": 11},
    "22": {"PROJECT": 71, "SCHEDOPTIONS": 25, "PROJWBS": 26, "TASK": 61, "TASKPRED": 11},
    "20": {"PROJECT": 82, "TASK": 66, "TASKPRED": 10},
    "19": {"PROJECT": 82, "TASK": 66, "TASKPRED": 10},
}


def wbs_paths(projwbs: DataFrame) -> DataFrame:
    """wbs_id, depth, full_path of names from the root; a node below a cycle has a null path."""
    tree = cut(hierarchy(projwbs, "wbs_id", "parent_wbs_id").select("id", "depth", "path"))
    names = projwbs.groupBy(F.col("wbs_id").alias("step")).agg(F.min("wbs_name").alias("wbs_name"))
    steps = tree.select("id", "depth", F.posexplode_outer("path").alias("at", "step"))
    # A root stands in the path of every node below it.
    hot = hot_values(steps, ["step"])["step"]
    steps = salted_join(steps, names, ["step"], one_of("step", hot), F.col("id"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("at", "wbs_name")))), lambda x: x["wbs_name"]), " > ")
    return steps.groupBy(F.col("id").alias("wbs_id"), F.col("depth").cast("long").alias("depth")).agg(F.nullif(path, F.lit("")).alias("full_path"))


def task_resources(taskrsrc: DataFrame, rsrc: DataFrame) -> DataFrame:
    """Assignments with the resource's name, null where the resource is unknown."""
    return taskrsrc.join(rsrc, "rsrc_id", "left").select("task_id", "rsrc_id", "rsrc_name")


def adjacency(taskpred: DataFrame) -> DataFrame:
    """Per activity the sorted predecessors and successors."""
    lists = lambda key, other, name: taskpred.groupBy(F.col(key).alias("task_id")).agg(F.array_sort(F.collect_list(F.col(other))).alias(name))
    both = lists("task_id", "pred_task_id", "predecessors").join(lists("pred_task_id", "task_id", "successors"), "task_id", "full")
    none = F.array().cast("array<string>")
    return both.select("task_id", F.coalesce("predecessors", none).alias("predecessors"), F.coalesce("successors", none).alias("successors"))


def activity_codes(taskactv: DataFrame, actvcode: DataFrame, actvtype: DataFrame) -> DataFrame:
    """Code values of activities with the names of the value and its type."""
    return taskactv.join(actvcode, "actv_code_id", "left").join(actvtype, "actv_code_type_id", "left").select("task_id", "actv_code_id", "actv_code_name", "actv_code_type")


def udf_values(udfvalue: DataFrame, udftype: DataFrame) -> DataFrame:
    """User-defined values: table_name, fk_id, label, and the first non-empty of text, number, date."""
    value = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("udf_text", "udf_number", "udf_date")], F.lit(""))
    return udfvalue.join(udftype, "udf_type_id", "left").select("table_name", "fk_id", "udf_type_label", value.alias("value"))


def udf_types(udftype: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("logical_data_type", "udf_data_type", "data_type") if c in udftype.columns], F.lit(""))
    return udftype.select("udf_type_id", "table_name", "udf_type_label", kind.alias("logical_type"))


def baselines(baseline: DataFrame | None, project: DataFrame) -> DataFrame:
    """Baseline rows, then tagged projects not among them; else the first project by id, as PROJECT_SINGLE."""
    rows = None
    if baseline is not None:
        rows = baseline.select(F.coalesce(F.nullif("base_proj_id", F.lit("")), "proj_id").alias("baseline_id"), "bl_name", "bl_type", F.coalesce(F.nullif("fin_dt", F.lit("")), "last_recalc_date").alias("data_date"))
    tagged = project.where(F.coalesce("bl_type", F.lit("")) != "").select(F.col("proj_id").alias("baseline_id"), F.col("proj_short_name").alias("bl_name"), "bl_type", F.col("last_recalc_date").alias("data_date"))
    every = tagged if rows is None else rows.unionByName(tagged.join(rows, "baseline_id", "left_anti"))
    single = project.orderBy("proj_id").limit(1).select(F.col("proj_id").alias("baseline_id"), F.col("proj_short_name").alias("bl_name"), F.lit("PROJECT_SINGLE").alias("bl_type"), F.col("last_recalc_date").alias("data_date"))
    return single if every.isEmpty() else every


def contract_baseline(found: DataFrame) -> DataFrame:
    """The one baseline that counts: BL_Project, then BL_Primary, then the earliest data date, blanks last."""
    rank = F.when(F.col("bl_type") == "BL_Project", 0).when(F.col("bl_type") == "BL_Primary", 1).otherwise(2)
    return found.orderBy(rank, F.coalesce("data_date", F.lit("")) == "", "data_date", "baseline_id").limit(1)


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """table, field, kind (added or removed) between two field lists (table, field)."""
    plain = lambda x: x.select("table", "field").distinct()
    tell = lambda x, kind: x.withColumn("kind", F.lit(kind))
    return tell(plain(b).exceptAll(plain(a)), "added").unionByName(tell(plain(a).exceptAll(plain(b)), "removed"))


def count_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """table and delta for tables whose number of rows differs; a and b: table, n."""
    both = a.select("table", F.col("n").alias("_a")).join(b.select("table", F.col("n").alias("_b")), "table", "full")
    return both.select("table", (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("delta")).where("delta <> 0")


def field_count_issues(counts: DataFrame) -> DataFrame:
    """file_id, table, expected, actual where the number of fields is not that of the file's major
    version; one row with null table and numbers for a file whose version is unknown.

    ``counts``: file_id, version, table, n_fields. Tables without a known number are not checked.
    """
    rows = [(v, t, n) for v, of in FIELD_COUNTS.items() for t, n in of.items()]
    want = counts.sparkSession.createDataFrame(rows, "major string, table string, expected int")
    known = F.coalesce(F.col("major").isin(*FIELD_COUNTS), F.lit(False))
    own = counts.withColumn("major", F.substring_index("version", ".", 1))
    none = lambda kind: F.lit(None).cast(kind)
    wrong = own.join(want, ["major", "table"]).where(F.col("n_fields") != F.col("expected")).select("file_id", "table", "expected", F.col("n_fields").cast("int").alias("actual"))
    skipped = own.where(~known).select("file_id").distinct().select("file_id", none("string").alias("table"), none("int").alias("expected"), none("int").alias("actual"))
    return wrong.unionByName(skipped)


def raw_field_counts(lines: DataFrame) -> DataFrame:
    """file_id, version, table, n_fields of raw export lines: the last ``%F`` line of each table."""
    text = F.regexp_replace(F.regexp_replace("line", r"\r$", ""), "^\ufeff", "")
    heads = lines.select("file_id", "line_no", F.split(text, "\t").alias("p")).where(F.col("p")[0].isin("ERMHDR", "%T", "%F"))
    rows = heads.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "p"))).alias("h"))
    version = F.get(F.filter("h", lambda x: x["p"][0] == "ERMHDR"), F.lit(0))["p"]
    fields = F.filter(F.transform("h", lambda x, i: F.struct(x["p"].alias("p"), F.get(F.col("h"), i - 1)["p"].alias("before"), x["line_no"].alias("line_no"))), lambda x: (x["p"][0] == "%F") & (x["before"][0] == "%T"))
    each = rows.select("file_id", F.get(version, F.lit(1)).alias("version"), F.inline(fields))
    return each.groupBy("file_id", "version", F.trim(F.get("before", F.lit(1))).alias("table")).agg((F.max_by(F.size("p"), "line_no") - 1).alias("n_fields"))


# The fields of progress that an update hands on.
PROGRESS = ["act_start_date", "act_end_date", "remain_drtn_hr_cnt", "phys_complete_pct", "status_code"]


def unmatched_codes(base: DataFrame, update: DataFrame) -> DataFrame:
    """task_code and the side (base or update) that alone has it."""
    codes = lambda df: df.select("task_code").distinct()
    only = lambda a, b, side: codes(a).join(codes(b), "task_code", "left_anti").withColumn("only_in", F.lit(side))
    return only(base, update, "base").unionByName(only(update, base, "update"))


def half_step(base: DataFrame, update: DataFrame) -> DataFrame:
    """The base's activities with the progress of an update, by task_code.

    A value of the update counts if it is not empty and differs. Early dates follow for
    activities that the update completes. Activities only in the update are never added; of
    repeated codes in the update the last by task_id counts. ``progressed`` tells what moved.
    """
    fields = [c for c in PROGRESS if c in base.columns and c in update.columns]
    dates = [c for c in ("early_start_date", "early_end_date") if c in base.columns and c in update.columns]
    new = update.groupBy("task_code").agg(*[F.max_by(c, F.struct(F.col("task_id").try_cast("long"), "task_id")).alias(f"_u_{c}") for c in [*fields, *dates]], F.lit(True).alias("_met"))
    j = base.join(new, "task_code", "left")
    moves = lambda c: (F.coalesce(F.col(f"_u_{c}"), F.lit("")) != "") & ~F.col(f"_u_{c}").eqNullSafe(F.col(c))
    completes = (F.col("_u_status_code") == "TK_Complete") & (F.col("status_code") != "TK_Complete") if "status_code" in fields else F.lit(False)
    out: list[Column] = []
    for c in base.columns:
        if c in fields:
            out.append(F.when(moves(c), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        elif c in dates:
            out.append(F.when(completes & (F.coalesce(F.col(f"_u_{c}"), F.lit("")) != ""), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    any_ = reduce(lambda a, b: a | b, [moves(c) for c in fields], F.lit(False))
    return j.select(*out, F.coalesce("_met", F.lit(False)).alias("matched"), F.coalesce(any_, F.lit(False)).alias("progressed"))


# --- Summary ---------------------------------------------------------------------------------


def schedule_metrics(task: DataFrame) -> DataFrame:
    """Counts per status over work activities, per project."""
    t = task.where(is_work())
    n = lambda s: F.count_if(F.col("status_code") == s)
    return t.groupBy("proj_id").agg(F.count(F.lit(1)).alias("n_total"), n("TK_Complete").alias("n_complete"), n("TK_Active").alias("n_in_progress"), n("TK_NotStart").alias("n_not_started"), (n("TK_Complete") * 100.0 / F.count(F.lit(1))).alias("pct_complete"))


def breakdown(task: DataFrame) -> DataFrame:
    """Activities by type, all of them, and by status label, work only."""
    count = F.count(F.lit(1)).alias("n")
    return task.groupBy(F.lit("type").alias("of"), labelled("task_type", TYPE_LABELS).alias("value")).agg(count).unionByName(task.where(is_work()).groupBy(F.lit("status").alias("of"), labelled("status_code", STATUS_LABELS).alias("value")).agg(count))


def critical_counts(task: DataFrame) -> DataFrame:
    """Critical by float, complete ones included, by driving flag, and by path number (a whole number above 0)."""
    if "driving_path_flag" not in task.columns:
        task = task.withColumn("driving_path_flag", F.lit(""))
    path = F.when(F.trim("crt_path_num").rlike(r"^[+-]?\d+$"), F.trim("crt_path_num").try_cast("long")) > 0
    return task.where(is_work()).groupBy("proj_id").agg(F.count_if(number("total_float_hr_cnt") <= 0).alias("by_float"), F.count_if(F.col("driving_path_flag") == "Y").alias("by_flag"), F.count_if(path).alias("by_path"))


def critical_list(task: DataFrame, most: int = 50) -> DataFrame:
    """The first critical activities of all, by id: a top-k report whose bound is its feature."""
    return task.where(is_work() & (number("total_float_hr_cnt") <= 0)).orderBy(F.col("task_id").try_cast("long")).limit(most).select("task_id", "task_code", "task_name", "total_float_hr_cnt")


def float_distribution(task: DataFrame, calendar: DataFrame) -> DataFrame:
    """Work activities by days of float; blank float is ``none``, an unreadable one ``zero``."""
    per = calendar.groupBy("clndr_id").agg(F.max(number("day_hr_cnt")).alias("hpd"))
    d = F.coalesce(number("total_float_hr_cnt"), F.lit(0.0)) / F.when(F.col("hpd") > 0, F.col("hpd")).otherwise(8.0)
    bucket = F.when(F.coalesce("total_float_hr_cnt", F.lit("")) == "", "none").when(d < 0, "negative").when(d == 0, "zero").when(d <= 5, "1-5").when(d <= 10, "6-10").when(d <= 20, "11-20").when(d <= 44, "21-44").otherwise("over 44")
    return task.where(is_work()).join(per, "clndr_id", "left").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def relationship_types(taskpred: DataFrame) -> DataFrame:
    return taskpred.groupBy("pred_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(number("lag_hr_cnt"), F.lit(0.0)) != 0).alias("n_lagged"))


def lagged_relationships(taskpred: DataFrame) -> DataFrame:
    """Relationships with a readable lag other than 0."""
    return taskpred.withColumn("lag", number("lag_hr_cnt")).where("lag <> 0").select("task_id", "pred_task_id", "pred_type", "lag")


def project_header(project: DataFrame) -> DataFrame:
    """The first project by id, with the number of projects. What a column lacks is ``''``."""
    text = lambda c: F.col(c) if c in project.columns else F.lit("")
    first = project.orderBy(F.col("proj_id").try_cast("long"), "proj_id").limit(1)
    n = project.count()
    return first.select(
        "proj_id", text("proj_short_name").alias("project_name"), F.coalesce(F.nullif(text("proj_long_name"), F.lit("")), text("proj_short_name")).alias("project_long_name"), text("last_recalc_date").alias("data_date"),
        text("plan_start_date").alias("plan_start"), text("plan_end_date").alias("plan_finish"), text("scd_end_date").alias("scheduled_finish"), text("plan_end_date").alias("must_finish_by"), F.lit(n).cast("long").alias("project_count"),
    )


def calendar_list(calendar: DataFrame, order: str | None = None) -> DataFrame:
    """Calendars with their hours, and the number of work days and holidays decoded."""
    return calendar_map(calendar, order).select("clndr_id", F.col("clndr_name").alias("name"), "hours_per_day", "hours_per_week", F.size("work_days").alias("n_work_days"), F.size("holidays").alias("n_holidays"))


def summary_open_ends(task: DataFrame, taskpred: DataFrame) -> DataFrame:
    """Work activities without predecessor (start milestones exempt) or successor (finish milestones exempt)."""
    t = task.where(is_work())
    no_pred = t.where("task_type <> 'TT_Mile'").join(taskpred.select("task_id"), "task_id", "left_anti").select("task_id", F.lit("predecessor").alias("lacks"))
    no_succ = t.where("task_type <> 'TT_FinMile'").join(taskpred.select(F.col("pred_task_id").alias("task_id")), "task_id", "left_anti").select("task_id", F.lit("successor").alias("lacks"))
    return no_pred.unionByName(no_succ)


def wbs_rollup(projwbs: DataFrame, task: DataFrame) -> DataFrame:
    """Activities directly in each node."""
    n = task.groupBy("wbs_id").agg(F.count(F.lit(1)).alias("n"))
    return projwbs.select("wbs_id", "wbs_name").join(n, "wbs_id", "left").fillna(0, ["n"])


def resource_use(taskrsrc: DataFrame) -> DataFrame:
    return taskrsrc.groupBy("rsrc_id").agg(F.count(F.lit(1)).alias("n_assignments"), F.count_distinct("task_id").alias("n_tasks"))


def constraint_counts(task: DataFrame) -> DataFrame:
    return task.where(is_work() & (F.col("cstr_type") != "")).groupBy("cstr_type").agg(F.count(F.lit(1)).alias("n"))


def structure_findings(
    project: DataFrame, projwbs: DataFrame, task: DataFrame, taskpred: DataFrame, calendar: DataFrame, field_issues: DataFrame | None = None, encoding: str | None = None, of: str | dict[str, float] = "commercial"
) -> DataFrame:
    """check_id, severity, n, subject: what the structural rules find in one set of tables.

    ``n`` is what the rule counts, ``subject`` the table or calendar it is about, if it is about
    one. ``field_issues`` come from :func:`field_count_issues`. A rule that holds has no row.
    """
    th = {"wbs_depth_min": 3, "wbs_depth_max": 6, "activity_count_min": 50, "activity_count_max": 10_000} | profile(of)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("of"), "n")
    work = task.where(is_work() & ~F.col("task_type").isin(MILESTONE_TYPES))
    tied = taskpred.select(F.explode(F.array("task_id", "pred_task_id")).alias("task_id")).join(work.select("task_id"), "task_id", "left_semi")
    segments = F.size(F.filter(F.split("full_path", " > "), lambda s: s != ""))
    depth = wbs_paths(projwbs).agg(F.max(F.coalesce(F.when(F.col("full_path").isNotNull(), segments), F.lit(0))).cast("long").alias("n")).select(F.lit("depth").alias("of"), "n")
    counts = reduce(DataFrame.unionByName, [one(project, "projects"), one(calendar, "calendars"), depth, one(task.where(is_work()), "activities"), one(work, "work"), one(tied, "tied")])
    wide = counts.groupBy().pivot("of", ["projects", "calendars", "depth", "activities", "work", "tied"]).agg(F.first("n"))
    c = F.col
    rules = [
        ("XER-PROJECT-MISSING", "BLOCK", c("projects") == 0, c("projects")), ("XER-MULTI-PROJECT", "INFO", c("projects") > 1, c("projects")), ("XER-CALENDAR-MISSING", "BLOCK", c("calendars") == 0, c("calendars")),
        ("XER-WBS-DEPTH-LOW", "BLOCK", c("depth") < th["wbs_depth_min"], c("depth")), ("XER-WBS-DEPTH-HIGH", "WARN", c("depth") > th["wbs_depth_max"], c("depth")),
        ("XER-ACTIVITY-COUNT-LOW", "WARN", c("activities") < th["activity_count_min"], c("activities")), ("XER-ACTIVITY-COUNT-HIGH", "WARN", c("activities") > th["activity_count_max"], c("activities")),
        ("XER-NO-TASKPRED", "BLOCK", (c("work") > 0) & (c("tied") == 0), c("work")),
        ("XER-ENCODING-UNUSUAL", "INFO", F.lit(bool(encoding) and encoding.lower() not in ("utf-8", "utf-8-sig", "cp1252")), F.lit(None).cast("long")),
    ]
    none = F.lit(None).cast("string")
    row = lambda i, s, n, about: F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), n.cast("long").alias("n"), about.alias("subject"))
    out = wide.select(F.inline(F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), row(i, s, n, none)) for i, s, holds, n in rules]))))
    named = calendar.where(F.lower("clndr_name").contains("holiday") & ~F.lower("clndr_name").contains("no holiday"))
    if "clndr_data" not in named.columns:
        named = named.withColumn("clndr_data", F.lit(""))
    empty = calendar_map(named).where(F.size("holidays") == 0).select(F.inline(F.array(row("XER-CALENDAR-HOLIDAYS-EMPTY", "WARN", F.lit(0), F.col("clndr_id")))))
    out = out.unionByName(empty)
    if field_issues is not None:
        told = F.when(F.col("table").isNull(), row("XER-FIELD-COUNT-SKIPPED", "INFO", F.lit(None), F.col("file_id"))).otherwise(row("XER-FIELD-COUNT", "WARN", F.col("actual"), F.col("table")))
        out = out.unionByName(field_issues.select(F.inline(F.array(told))))
    return out


def compliance(findings: DataFrame) -> DataFrame:
    """100 less 20 for each BLOCK and 5 for each WARN, within 0 to 100, and its letter."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 20 * F.count_if(F.col("severity") == "BLOCK") - 5 * F.count_if(F.col("severity") == "WARN")))
    s = F.col("score")
    return findings.agg(score.cast("long").alias("score")).withColumn("grade", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F"))
