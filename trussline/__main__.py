"""Command line over one export file.

``python -m trussline validate FILE [-o PAGE] [--json OUT] [--project-index N] [--baseline FILE]``,
``parse FILE [--summary [OUT]] [--json OUT]``, ``generate JSON OUT``, ``manifest FILE``, ``checks FILE``.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.operators import schedule
from trussline.sources import reports, xer

# The columns that the operators read.
COLUMNS = {
    "PROJECT": ["proj_id", "proj_short_name", "proj_long_name", "last_recalc_date", "plan_start_date", "plan_end_date", "scd_end_date", "clndr_id", "dflt_clndr_id"],
    "TASK": [
        "task_id", "proj_id", "wbs_id", "clndr_id", "task_code", "task_name", "task_type", "status_code", "total_float_hr_cnt", "target_drtn_hr_cnt", "remain_drtn_hr_cnt", "cstr_type", "cstr_type2", "driving_path_flag", "crt_path_num",
        "early_start_date", "early_end_date", "target_start_date", "target_end_date", "act_start_date", "act_end_date", "phys_complete_pct", "act_pct_complete",
    ],
    "TASKPRED": ["task_id", "pred_task_id", "pred_type", "lag_hr_cnt", "driving", "driving_path_flag"],
    "CALENDAR": ["clndr_id", "clndr_name", "day_hr_cnt", "week_hr_cnt", "clndr_data"],
    "PROJWBS": ["wbs_id", "parent_wbs_id", "wbs_name", "wbs_short_name"],
    "TASKRSRC": ["task_id", "rsrc_id"],
}


def tables_of(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of one file with the columns of :data:`COLUMNS`."""
    rows = xer.read_rows(spark, path)
    return {name: xer.table(rows, name, cols) for name, cols in COLUMNS.items()}


def enriched(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    tasks = schedule.enrich_tasks(t["TASK"].drop("file_id", "ord"), t["CALENDAR"], t["PROJECT"])
    return tasks, schedule.enrich_edges(t["TASKPRED"], tasks)


def _validate(spark: SparkSession, a: argparse.Namespace) -> None:
    t = tables_of(spark, a.path)
    baseline = tables_of(spark, a.baseline)["TASK"] if a.baseline else None
    results = reports.assemble(t["PROJECT"], *enriched(t), t["TASKRSRC"], baseline, a.project_index, a.profile)
    if a.output:
        Path(a.output).write_text(reports.to_html(results), encoding="utf-8")
    if a.json:
        Path(a.json).write_text(reports.to_json(results), encoding="utf-8")
    print(f"{results['overall_rating']} {results['overall_score']} {results['overall_confidence']}; {results['dcma_14']['dcma_score']}/14")


def _parse(spark: SparkSession, a: argparse.Namespace) -> None:
    doc = xer.document(Path(a.path).read_bytes())
    if a.json:
        Path(a.json).write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    if a.summary is not None:
        t = tables_of(spark, a.path)
        file = {"name": Path(a.path).name, "encoding": doc["encoding_used"], "version": doc["ermhdr"].get("version", "")} | {n: len(x["records"]) for n, x in doc["tables"].items()}
        told = reports.to_text(reports.summary(t["PROJECT"], t["TASK"], t["TASKPRED"], t["CALENDAR"], t["PROJWBS"], t["TASKRSRC"], file))
        Path(a.summary).write_text(told, encoding="utf-8") if a.summary else print(told)
    if not a.json and a.summary is None:
        print(json.dumps({n: len(x["records"]) for n, x in doc["tables"].items()}))


def _checks(spark: SparkSession, a: argparse.Namespace) -> None:
    t = tables_of(spark, a.path)
    for r in schedule.health_checks(t["PROJECT"], *enriched(t), t["TASKRSRC"], a.profile).toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="trussline")
    sub = ap.add_subparsers(dest="what", required=True)
    for name in ("validate", "checks"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--profile", default="commercial")
        if name == "validate":
            p.add_argument("-o", "--output")
            p.add_argument("--json")
            p.add_argument("--project-index", type=int, default=0)
            p.add_argument("--baseline")
    p = sub.add_parser("parse")
    p.add_argument("path")
    p.add_argument("--summary", nargs="?", const="")
    p.add_argument("--json")
    p = sub.add_parser("generate")
    p.add_argument("path")
    p.add_argument("out")
    sub.add_parser("manifest").add_argument("path")
    a = ap.parse_args(argv)
    if a.what == "generate":
        Path(a.out).write_bytes(xer.document_text(json.loads(Path(a.path).read_text(encoding="utf-8"))).encode())
        return
    spark = SparkSession.builder.getOrCreate()
    if a.what == "validate":
        _validate(spark, a)
    elif a.what == "parse":
        _parse(spark, a)
    elif a.what == "checks":
        _checks(spark, a)
    else:
        for r in xer.manifest(spark, a.path).select("*", F.lit("manifest").alias("kind")).toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


if __name__ == "__main__":
    main(sys.argv[1:])
