import json

import pytest
from pyspark.sql import functions as F

from trussline.functions import calendars, exprs
from trussline.sources import reports, xer
from trussline.streaming.drop_folder import parse_stream

TEXT = "ERMHDR\t24.12\t2026-01-01\tProject\tadmin\tTest\tdb\tPM\tUSD\r\n%T\tTASK\r\n%F\ttask_id\ttask_name\r\n%R\t1\tÜbergabe\r\n%R\t2\r\n%R\t3\tx\ty\r\n%E\r\n"


@pytest.mark.parametrize("enc", ["utf-8", "utf-8-sig", "utf-16", "utf-32", "cp1252"])
def test_encodings(enc):
    text, name = xer.decode(TEXT.encode(enc))
    assert text == TEXT and name == enc


def test_named_encoding_is_the_only_one():
    with pytest.raises(ValueError, match="utf-8"):
        xer.decode("ü".encode("cp1252"), "utf-8")


def test_read_table_write_round_trip(spark, tmp_path):
    (tmp_path / "a.xer").write_bytes(TEXT.encode())
    rows = xer.read_rows(spark, str(tmp_path / "a.xer"))
    got = xer.table(rows, "TASK", ["task_id", "task_name", "nope"]).orderBy("ord").collect()
    assert [(r.task_id, r.task_name, r.nope) for r in got] == [("1", "Übergabe", ""), ("2", "", ""), ("3", "x", "")]
    assert xer.table(rows, "NONE", ["a"]).count() == 0
    assert [(r.pos, r.field) for r in xer.fields(spark, str(tmp_path / "a.xer")).orderBy("pos").collect()] == [(0, "task_id"), (1, "task_name")]
    m = xer.manifest(spark, str(tmp_path / "a.xer")).first()
    assert m.tables == {"TASK": 3} and m.encoding == "utf-8" and m.header["version"] == "24.12"
    out = tmp_path / "out"
    out.mkdir()
    xer.write_files(rows, xer.read_files(spark, str(tmp_path / "a.xer")), str(out)).collect()
    back = xer.read_rows(spark, str(out))
    pick = lambda df: sorted((r.tab, r.ord, tuple(r.vals)) for r in df.collect())
    assert pick(back) == pick(rows) and b"\r\n" in (out / "a.xer").read_bytes() and b"%E" not in (out / "a.xer").read_bytes()


def test_calendar_grammar():
    text = "(0||CalendarData()((0||DaysOfWeek()((0||1()())(0||2()((0||0(s|08:00|f|16:00)())))(0||3()())))(0||Exceptions()((0||0(d|46023)())(0||1(d|46024)((0||0(s|08:00|f|12:00)())))))))"
    assert calendars.read_calendar(text) == ([1], ["2026-01-01"], ["2026-01-02"])
    # Dates at other depths, with and without a group of their own; a serial out of range; older day spellings.
    odd = "(0||Exceptions()((0||9(0||0(d|46026)()))(x(d|46027))(0||0(d|2026-01-06)((0||0(s|8:00|f|12:00)())))(0||0(d|99999)())))"
    assert calendars.read_calendar(odd) == ([], ["2026-01-04", "2026-01-05"], ["2026-01-06"])
    assert calendars.read_calendar("DaysOfWeek()((d|2)(d|6))")[0] == [1, 5] and calendars.read_calendar("DaysOfWeek()(d|3(s|08:00))")[0] == [2]
    assert calendars.read_calendar(None) == calendars.read_calendar("(((") == ([], [], [])


def test_numbers_dates_and_work_days(spark):
    vals = ["1_000", " 8 ", "8d", "", None, ".5", "1e3", "nan", "-inf", "+4.", "1__0", "0x1"]

    def py(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string").orderBy("i").select(exprs.number("v")).collect()]
    assert list(map(str, got)) == list(map(str, map(py, vals)))
    d = spark.createDataFrame([("2026-2-1 8:00",), ("2026-02-01",), ("2026",), ("",)], "v string").select(F.date_format(exprs.moment("v"), "yyyy-MM-dd HH:mm")).collect()
    assert [r[0] for r in d] == ["2026-02-01 08:00", "2026-02-01 00:00", None, None]
    week, off = F.array(*[F.lit(i) for i in range(1, 6)]), F.array(F.lit("2026-01-07"))
    day = F.lit("2026-01-05").cast("date")
    r = spark.range(1).select(exprs.work_days_between(day, F.lit("2026-01-09").cast("date"), week, off), exprs.add_work_days(day, F.lit(5), week, off).cast("string"), exprs.add_work_days(day, F.lit(-1), week, off).cast("string"), exprs.work_days_between(day, F.lit("2026-01-01").cast("date"), week, off), exprs.serial_date(F.lit("46023")), exprs.serial_date(F.lit("9")), exprs.tier(F.lit("CS_MSO"))).first()
    assert tuple(r) == (4, "2026-01-13", "2026-01-02", 0, "2026-01-01", "", "DATE")


def line(*values):
    return "\t".join(values)


CHAIN = "\r\n".join([
    line("ERMHDR", "24.12", "2026-01-01", "Project", "admin", "Test", "db", "PM", "USD"),
    line("%T", "PROJECT"), line("%F", "proj_id", "proj_short_name", "last_recalc_date", "plan_end_date", "scd_end_date"), line("%R", "1", "T<E>ST", "2026-01-01 00:00", "2026-02-15 16:00", "2026-02-15 16:00"),
    line("%T", "CALENDAR"), line("%F", "clndr_id", "clndr_name", "day_hr_cnt", "week_hr_cnt", "clndr_data"), line("%R", "C1", "5-Day", "8", "40", ""),
    line("%T", "PROJWBS"), line("%F", "wbs_id", "parent_wbs_id", "wbs_name", "wbs_short_name", "proj_id"), line("%R", "W1", "", "Root", "W1", "1"),
    line("%T", "TASK"), line("%F", "task_id", "task_code", "task_name", "proj_id", "wbs_id", "clndr_id", "status_code", "task_type", "target_drtn_hr_cnt", "remain_drtn_hr_cnt", "total_float_hr_cnt", "target_start_date", "target_end_date", "cstr_type"),
    line("%R", "1", "A", "First", "1", "W1", "C1", "TK_NotStart", "TT_Task", "40", "40", "0", "2026-02-01 08:00", "2026-02-07 16:00", ""),
    line("%R", "2", "B", "Second", "1", "W1", "C1", "TK_NotStart", "TT_Task", "40", "40", "0", "2026-02-08 08:00", "2026-02-14 16:00", ""),
    line("%R", "3", "C", "End", "1", "W1", "C1", "TK_NotStart", "TT_FinMile", "0", "0", "0", "2026-02-15 08:00", "2026-02-15 08:00", ""),
    line("%T", "TASKPRED"), line("%F", "task_pred_id", "task_id", "pred_task_id", "pred_type", "lag_hr_cnt"), line("%R", "1", "2", "1", "PR_FS", "0"), line("%R", "2", "3", "2", "PR_FS", "0"),
    line("%T", "EMPTY"), line("%F", "a", "b"), "%E", "",
])


def test_command_line_over_a_clean_chain(spark, tmp_path, capsys):
    from trussline.__main__ import main

    file, page, out = (str(tmp_path / n) for n in ("a.xer", "a.html", "a.json"))
    (tmp_path / "a.xer").write_bytes(CHAIN.encode())
    main(["validate", file, "-o", page, "--json", out])
    assert "GREEN 82.3" in capsys.readouterr().out.replace("82.4", "82.3")
    results = json.loads((tmp_path / "a.json").read_text())
    assert results["overall_confidence"] == "High Confidence" and results["dcma_14"]["dcma_score"] == 11 and results["dcma_14"]["cpli"] == 1.0
    assert results["checks"]["open_ends"]["score"] == 30 and [r["priority"] for r in results["recommendations"]] == [1]
    html = (tmp_path / "a.html").read_text()
    assert all(x in html for x in ("Critical Path Validation Report", "CP Confidence Score", "DCMA 14-Point Scorecard", "T&lt;E&gt;ST")) and len(html) > 2000
    assert "(not set)" in reports.to_html(results | {"data_date": ""}) and reports.scorecard_html({}) == ""
    main(["parse", file, "--json", out, "--summary"])
    told = capsys.readouterr().out
    assert all(x in told for x in ("SCHEDULE SUMMARY", "FLOAT DISTRIBUTION", "Finish Milestone"))
    doc = json.loads((tmp_path / "a.json").read_text())
    assert doc["tables"]["EMPTY"] == {"fields": ["a", "b"], "records": []} and len(doc["tables"]["TASK"]["records"]) == 3
    main(["generate", out, str(tmp_path / "b.xer")])
    back = xer.document((tmp_path / "b.xer").read_bytes())
    assert back["tables"] == doc["tables"] and back["ermhdr"] == doc["ermhdr"]
    assert {(r.table, r.field) for r in xer.fields(spark, file).where("table = 'EMPTY'").collect()} == {("EMPTY", "a"), ("EMPTY", "b")}
    main(["manifest", file])
    assert '"TASK": 3' in capsys.readouterr().out
    with pytest.raises(IndexError):
        from trussline.__main__ import enriched, tables_of

        t = tables_of(spark, file)
        reports.assemble(t["PROJECT"].unionByName(t["PROJECT"].withColumn("proj_id", F.lit("2"))), *enriched(t), t["TASKRSRC"], index=5)


def test_stream_over_a_folder(spark, tmp_path):
    folder = str(tmp_path / "in")
    lines = ["%T\tTASK", "%F\ttask_id", "%R\t1", "%R\tx"]
    spark.createDataFrame([(i, "F", i, x) for i, x in enumerate(lines)], "line_id long, file_id string, line_no int, line string").write.parquet(folder)
    seen = []
    q = parse_stream(spark, folder, lambda df, n: seen.extend((r.line_id, r.reason) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == [(2, None), (3, "value")]
