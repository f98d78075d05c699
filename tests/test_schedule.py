"""Small schedules with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from trussline.operators import findings
from trussline.operators import schedule as S
from trussline.operators import xref as X
from trussline.operators.graph import connected_components

T = ["task_id", "task_code", "proj_id", "wbs_id", "clndr_id", "status_code", "task_type", "target_drtn_hr_cnt", "remain_drtn_hr_cnt", "total_float_hr_cnt", "target_start_date", "target_end_date", "cstr_type"]


def tables(spark, tasks, edges, hours="8"):
    project = spark.createDataFrame([("1", "TEST", "2026-01-01 00:00", "2026-02-15 16:00", "2026-02-15 16:00")], "proj_id string, proj_short_name string, last_recalc_date string, plan_end_date string, scd_end_date string")
    cal = spark.createDataFrame([("C1", hours)], "clndr_id string, day_hr_cnt string")
    task = spark.createDataFrame([tuple(t.get(c, d) for c, d in zip(T, ["", t["task_id"], "1", "W1", "C1", "TK_NotStart", "TT_Task", "40", "40", "0", "2026-01-05 08:00", "2026-01-09 16:00", ""])) for t in tasks], ", ".join(f"{c} string" for c in T))
    pred = spark.createDataFrame([(s, p, k, lag) for s, p, k, lag in edges] or [], "task_id string, pred_task_id string, pred_type string, lag_hr_cnt string")
    t = S.enrich_tasks(task, cal, project)
    return project, t, S.enrich_edges(pred, t)


CHAIN = [{"task_id": "A"}, {"task_id": "B"}, {"task_id": "C", "task_type": "TT_FinMile", "remain_drtn_hr_cnt": "0"}]
LINKS = [("B", "A", "PR_FS", "0"), ("C", "B", "PR_FS", "0")]


def overall(spark, tasks, edges):
    p, t, e = tables(spark, tasks, edges)
    return S.confidence(p, S.all_scores(p, t, e)).first()


def test_clean_chain_scores(spark):
    r = overall(spark, CHAIN, LINKS)
    assert (r.s_cp, r.s_open_ends, r.s_relationships, r.s_lags) == (55, 30, 95, 95)
    assert r.overall == pytest.approx(82.35)


def test_mandatory_pair_saturates(spark):
    tasks = [dict(CHAIN[0], cstr_type="CS_MANDSTART"), dict(CHAIN[1], cstr_type="CS_MANDFIN"), CHAIN[2]]
    r = overall(spark, tasks, LINKS)
    assert r.s_saturation == 30 and r.overall == pytest.approx(66.95)


def test_project_without_open_work_still_has_a_row(spark):
    r = overall(spark, [{"task_id": "A", "status_code": "TK_Complete"}], [])
    assert r.s_cp == 0 and r.overall == pytest.approx(93.6)


@pytest.mark.parametrize(("hours", "lag", "days"), [("8", "-40", -5.0), ("10", "-40", -4.0), ("24", "-48", -2.0), ("0", "-40", -5.0)])
def test_lag_days_follow_the_calendar(spark, hours, lag, days):
    _, _, e = tables(spark, CHAIN, [("B", "A", "PR_FS", lag)], hours)
    assert [r.lag_days for r in S.lags(e).collect()] == [days]


@pytest.mark.parametrize("limit", [10**6, 1])
def test_reachability_ends_on_cycles_either_way(spark, limit):
    tasks = [{"task_id": x, "total_float_hr_cnt": "160"} for x in "ABDE"] + [CHAIN[2]]
    _, t, e = tables(spark, tasks, [("B", "A", "PR_FS", "0"), ("A", "B", "PR_FS", "0"), ("C", "B", "PR_FS", "0"), ("D", "E", "PR_FS", "0"), ("E", "D", "PR_FS", "0")])
    assert {r.task_id for r in S.disconnected(t, e, limit).collect()} == {"D", "E"}


def test_out_of_sequence_keeps_every_pair(spark):
    tasks = [{"task_id": "X", "status_code": "TK_Active"}] + [{"task_id": f"P{i}"} for i in range(25)]
    _, _, e = tables(spark, tasks, [("X", f"P{i}", "PR_SS", "0") for i in range(25)])
    assert S.out_of_sequence(e).count() == 25


def test_health_of_a_clean_chain(spark):
    p, t, e = tables(spark, CHAIN, LINKS)
    rs = spark.createDataFrame([], "task_id string, rsrc_id string")
    got = {r.check_id: r for r in S.health_checks(p, t, e, rs).collect()}
    assert got[14].value == 1.0 and got[1].value == pytest.approx(100 / 3) and got[1].severity == "WARN"
    assert S.health_score(S.health_checks(p, t, e, rs)).first().passed == 11
    assert S.profile({"lags": 9})["lags"] == 9
    with pytest.raises(ValueError, match="mining"):
        S.profile("x")


def test_driving_path_and_half_step(spark):
    _, t, e = tables(spark, CHAIN, LINKS)
    assert [r.task_code for r in S.driving_path(t, e, ["C"]).orderBy("step").collect()] == ["C", "B", "A"]
    base = spark.createDataFrame([("1", "A", "TK_NotStart", "40"), ("2", "B", "TK_Active", "8")], "task_id string, task_code string, status_code string, remain_drtn_hr_cnt string")
    upd = spark.createDataFrame([("7", "A", "TK_Complete", ""), ("9", "Z", "TK_Active", "1")], "task_id string, task_code string, status_code string, remain_drtn_hr_cnt string")
    got = {r.task_code: r for r in X.half_step(base, upd).collect()}
    assert (got["A"].status_code, got["A"].remain_drtn_hr_cnt, got["A"].progressed, got["B"].matched) == ("TK_Complete", "40", True, False) and "Z" not in got
    assert X.half_step(base, base).where(F.col("progressed")).count() == 0


def test_udfs_baselines_and_codes(spark):
    types = spark.createDataFrame([("1", "TASK", "Area", "FT_TEXT")], "udf_type_id string, table_name string, udf_type_label string, logical_data_type string")
    vals = spark.createDataFrame([("1", "5", "", "3", ""), ("2", "6", None, None, "d")], "udf_type_id string, fk_id string, udf_text string, udf_number string, udf_date string")
    assert {(r.fk_id, r.value, r.udf_type_label) for r in X.udf_values(vals, types).collect()} == {("5", "3", "Area"), ("6", "d", None)}
    assert X.udf_types(types).first().logical_type == "FT_TEXT"
    pr = spark.createDataFrame([("1", "P", "", "2026")], "proj_id string, proj_short_name string, bl_type string, last_recalc_date string")
    assert X.contract_baseline(X.baselines(None, pr)).first().bl_type == "PROJECT_SINGLE"
    a, b = (spark.createDataFrame([("T", n)], "table string, n long") for n in (3, 5))
    assert X.count_difference(a, b).first().delta == 2
    n = spark.createDataFrame([("f", "24.12", "TASK", 60), ("f", "24.12", "TASKPRED", 11), ("g", "7", "TASK", 60), ("h", None, "TASK", 61), ("i", "19.12", "TASK", 66)], "file_id string, version string, table string, n_fields int")
    assert {tuple(r) for r in X.field_count_issues(n).collect()} == {("f", "TASK", 61, 60), ("g", None, None, None), ("h", None, None, None)}
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["\ufeffERMHDR\t24.12\t2025", "%T\tTASK\r", "%F\ta\tb\r", "%R\t1\t2", "%T\tTASK", "%F\ta\tb\tc", "%E"])], "file_id string, line_no int, line string")
    assert [tuple(r) for r in X.raw_field_counts(lines).collect()] == [("f", "24.12", "TASK", 3)]


def test_structure_findings(spark):
    project, t, e = tables(spark, [*CHAIN, {"task_id": "L", "task_type": "TT_LOE"}], LINKS)
    wbs = spark.createDataFrame([("W1", "", "a"), ("W2", "W1", "b"), ("W3", "W2", "")], "wbs_id string, parent_wbs_id string, wbs_name string")
    cal = spark.createDataFrame([("C1", "With Holidays", "8", "40", ""), ("C2", "No holidays", "8", "40", ""), ("C3", "Holiday", "8", "40", "(0||Exceptions()((0||0(d|45658)())))")], "clndr_id string, clndr_name string, day_hr_cnt string, week_hr_cnt string, clndr_data string")
    issues = spark.createDataFrame([("f", "TASK", 61, 60), ("g", None, None, None)], "file_id string, table string, expected int, actual int")
    found = lambda *a, **k: {(r.check_id, r.severity, r.n, r.subject) for r in X.structure_findings(*a, **k).collect()}
    got = found(project, wbs, t, e, cal, issues, "utf-16")
    assert got == {
        ("XER-WBS-DEPTH-LOW", "BLOCK", 2, None), ("XER-ACTIVITY-COUNT-LOW", "WARN", 3, None), ("XER-CALENDAR-HOLIDAYS-EMPTY", "WARN", 0, "C1"),
        ("XER-FIELD-COUNT", "WARN", 60, "TASK"), ("XER-FIELD-COUNT-SKIPPED", "INFO", None, "g"), ("XER-ENCODING-UNUSUAL", "INFO", None, None),
    }
    # No work activity, no need of logic; with one there is.
    bare = {"activity_count_min": 0, "wbs_depth_min": 1}
    assert found(project, wbs, t.where("task_id = 'C'"), e.limit(0), cal.limit(0), of=bare) == {("XER-CALENDAR-MISSING", "BLOCK", 0, None)}
    assert found(project.limit(0), wbs.limit(0), t, e.limit(0), cal.where("clndr_id = 'C2'"), of=bare) == {("XER-NO-TASKPRED", "BLOCK", 2, None), ("XER-PROJECT-MISSING", "BLOCK", 0, None)}
    assert X.compliance(X.structure_findings(project, wbs, t, e, cal, issues, "utf-16")).first().score == 65


@pytest.mark.parametrize("most", [200, 5])
def test_driving_paths_of_all_activities(spark, most):
    rng = random.Random(most)
    ids = range(1, 121)
    tasks = [{"task_id": str(i), "task_code": f"c{i}", "status_code": rng.choice(["TK_NotStart"] * 9 + ["TK_Complete"]), "target_end_date": f"2026-{rng.randint(1, 12):02d}-09 16:00"} for i in ids]
    links = {(i, j) for i in ids for j in rng.sample(range(max(1, i - 4), i), min(i - 1, 2))} | {(3, 9), (40, 40), (50, 60), (60, 50), (70, 90)}
    _, t, e = tables(spark, tasks, [(str(i), str(j), "PR_FS", "0") for i, j in links] + [("5", "gone", "PR_FS", "0")])
    past = {x["task_id"] for x in tasks if int(x["task_id"]) % 17 == 0}
    t = t.withColumn("early_end_ts", F.when(F.col("task_id").isin(past), F.lit("2025-12-01 00:00").cast("timestamp_ntz")))
    end = {int(x["task_id"]): "2025" if x["task_id"] in past else x["target_end_date"] for x in tasks}
    halt = {int(x["task_id"]) for x in tasks if x["task_id"] in past or x["status_code"] == "TK_Complete"}
    want = set()
    for i in ids:
        seen = [i]
        while len(seen) <= most and (seen[-1] == i or seen[-1] not in halt):
            before = sorted((j for k, j in links if k == seen[-1]), key=lambda j: (end[j], -j))
            if not before or before[-1] in seen:
                break
            seen.append(before[-1])
        want |= {(f"c{i}", n, f"c{j}") for n, j in enumerate(seen)}
    got = [tuple(r) for r in S.driving_path(t, e, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_recommendations_for_the_whole_project(spark):
    ids = [str(i) for i in range(1, 22)]
    kinds = lambda tasks, edges: {(r.proj_id, r.priority, r.kind) for r in S.recommendations(*tables(spark, tasks, edges)[1:]).where("task_id is null").collect()}
    free = [{"task_id": i, "total_float_hr_cnt": "160"} for i in ids]
    links = [(b, a, "PR_FS", "-8" if int(a) < 12 else "0") for a, b in zip(ids, ids[1:], strict=False)]
    few, leads, hard = ("1", 3, "few FS relationships"), ("1", 2, "leads off the critical path"), ("1", 2, "hard constraints on many activities")
    assert kinds(free, links) == {leads}
    assert kinds(free, [(b, a, k, "0" if a == "1" else lag) for b, a, k, lag in links]) == set()
    assert kinds([dict(free[0], total_float_hr_cnt="0"), *free[1:]], links) == set()
    assert kinds(free, [(b, a, "PR_SS" if int(a) < 5 else k, "0") for b, a, k, _ in links]) == set()
    assert kinds(free, [(b, a, "PR_SS" if int(a) < 6 else k, "0") for b, a, k, _ in links]) == {few}
    assert kinds([dict(free[0], cstr_type="CS_MSO"), *free[1:]], []) == set()
    assert kinds([dict(t, cstr_type="CS_MSO") for t in free[:2]] + free[2:], []) == {hard}


def test_lead_on_the_critical_path_of_a_pair(spark):
    """Two critical activities and a lead of five days. The second is the only one without a
    successor and has no early end, so it is terminal, and one open end is left."""
    r = overall(spark, CHAIN[:2], [("B", "A", "PR_FS", "-40")])
    assert (r.s_cp, r.s_constraints, r.s_open_ends, r.s_relationships, r.s_lags, r.s_continuity, r.s_near, r.s_oos, r.s_saturation) == (55, 100, 30, 95, 25, 20, 100, 100, 100)
    assert r.overall == pytest.approx(63.85) and (r.band, r.confidence) == ("AMBER", "Moderate Confidence")
    assert sum(S.WEIGHTS.values()) == pytest.approx(1.0) and S.WEIGHTS["continuity"] == 0.10 and S.WEIGHTS["oos"] == 0.05


def test_two_ends_without_dates_are_open(spark):
    p, t, e = tables(spark, CHAIN[:2], [])
    assert not any(r.terminal for r in S.open_ends(t, e).collect())


def test_paths_are_components_without_path_numbers(spark):
    tasks = [{"task_id": x} for x in "ABCDE"] + [{"task_id": "F", "total_float_hr_cnt": "80"}]
    _, t, e = tables(spark, tasks, [("B", "A", "PR_FS", "0"), ("D", "C", "PR_FS", "0"), ("E", "F", "PR_FS", "0"), ("F", "D", "PR_FS", "0"), ("A", "A", "PR_FS", "0")])
    assert {(r.path, r.task_code) for r in S.path_groups(t, e).collect()} == {("A", "A"), ("A", "B"), ("C", "C"), ("C", "D"), ("E", "E")}
    flagged = t.withColumn("crt_path_num", F.when(F.col("task_id") == "A", "1").when(F.col("task_id") == "C", "2").otherwise("0"))
    assert {(r.path, r.task_code) for r in S.path_groups(flagged, e).collect()} == {("1", "A"), ("2", "C")}


def test_components_equal_a_union_find(spark):
    rng = random.Random(9)
    n, links = 300, [(rng.randrange(300), rng.randrange(320)) for _ in range(230)] + [(i, i + 1) for i in range(40, 120)]
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        if a < n and b < n:
            top[max(find(a), find(b))] = min(find(a), find(b))
    key = lambda i: f"{i:04d}"
    got = connected_components(spark.createDataFrame([(key(i), "x") for i in [*range(n), 5, 5]] + [(None, "x")], "id string, comp string"), spark.createDataFrame([(key(a), key(b)) for a, b in links] + [(None, "0001")], "a string, b string"))
    assert {r.id: r.comp for r in got.collect()} == {key(i): key(find(i)) for i in range(n)}
    assert connected_components(spark.createDataFrame([], "id string"), spark.createDataFrame([], "a string, b string")).count() == 0


def test_driver_by_flag_and_without_dates(spark):
    tasks = [{"task_id": x, "target_end_date": d} for x, d in (("1", "2026-01-09 16:00"), ("2", "2026-03-09 16:00"), ("3", ""), ("4", "2026-01-01 08:00"), ("5", "2026-01-01 08:00"))]
    _, t, e = tables(spark, tasks, [("4", "1", "PR_FS", "0"), ("4", "2", "PR_FS", "0"), ("4", "9", "PR_FS", "0"), ("5", "3", "PR_FS", "0")])
    assert [(r.task_id, r.pred_task_id) for r in S.drivers(t, e).collect()] == [("4", "2")]
    by_flag = e.withColumn("flagged", F.col("pred_task_id") == "1")
    assert [(r.task_id, r.pred_task_id) for r in S.drivers(t, by_flag).collect()] == [("4", "1")]
    assert S.drivers(t, e.withColumn("flagged", F.col("pred_task_id") == "9")).count() == 0


def test_invalid_dates_follow_the_reported_percentage(spark):
    p, t, e = tables(spark, [{"task_id": "A", "target_end_date": "2025-12-01 08:00"}], [])
    rs = spark.createDataFrame([], "task_id string, rsrc_id string")
    of = lambda x: {r.check_id: r.value for r in S.health_checks(p, x, e, rs).collect()}[9]
    assert of(t) == 1.0 and of(t.withColumn("phys_complete_pct", F.lit("100"))) == 0.0 and of(t.withColumn("act_pct_complete", F.lit("101"))) == 1.0


def test_findings_are_counted_and_checked(spark):
    p, t, e = tables(spark, CHAIN, LINKS)
    checks = S.health_checks(p, t, e, spark.createDataFrame([], "task_id string, rsrc_id string"))
    index = S.execution_index(t.limit(0), t)
    report = findings.health_report(p, checks, index, S.path_groups(t, e), S.continuity_gaps(e))
    got = {r.check_id: r for r in report.collect()}
    assert len(got) == 16 and got["BEI"].severity == "INFO" and got["DCMA-Ext-CPContinuity"].severity == "PASS"
    n = findings.counts(report).first()
    assert (n.n_block, n.n_warn, n.n_info, n.n_pass, n.has_blocking) == (0, 3, 1, 12, False)
    with pytest.raises(Exception, match="no severity"):
        spark.range(1).select(findings.severity(F.lit("FATAL"))).collect()


@pytest.mark.parametrize("limit", [10**6, 1])
def test_critical_activities_off_the_longest_path(spark, limit):
    tasks = [{"task_id": "1", "remain_drtn_hr_cnt": "0"}, {"task_id": "2"}, {"task_id": "3"}, {"task_id": "4", "remain_drtn_hr_cnt": "0", "task_type": "TT_FinMile"}, {"task_id": "5", "total_float_hr_cnt": "80"}]
    links = [("4", "1", "PR_FS", "0"), ("3", "2", "PR_FS", "-400"), ("4", "3", "PR_FS", "0")]
    off = lambda rel: {r.task_id for r in S.off_longest_path(*tables(spark, tasks, rel)[1:], limit).collect()}
    assert off(links) == {"1"}
    # Started with its predecessor, or ended with it: five days in all.
    assert off([("4", "1", "PR_FS", "0"), ("3", "2", "PR_SS", "0"), ("4", "3", "PR_FS", "0")]) == {"1"}
    assert off([("4", "1", "PR_FS", "0"), ("3", "2", "PR_FF", "0"), ("4", "3", "PR_FF", "0"), ("2", "1", "PR_XX", "0")]) == set()
    assert off([*links, ("2", "3", "PR_FS", "0")]) == set()


def test_longest_paths_agree_either_way(spark):
    rng = random.Random(21)
    tasks = [{"task_id": f"{i:02d}", "remain_drtn_hr_cnt": str(8 * rng.randint(0, 9)), "total_float_hr_cnt": rng.choice(["0", "8"])} for i in range(40)]
    links = [(f"{i:02d}", f"{j:02d}", rng.choice(["PR_FS", "PR_SS", "PR_FF", "PR_SF"]), "0") for i in range(40) for j in rng.sample(range(i), min(i, 2))]
    _, t, e = tables(spark, tasks, links)
    one, other = ({r.task_id for r in S.off_longest_path(t, e, n).collect()} for n in (10**6, 1))
    assert one == other and one
