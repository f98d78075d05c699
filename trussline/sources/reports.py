"""Reports of one project: the assembled results, and their JSON, text and HTML forms.

Everything here is about a single project or file, which bounds what comes to the driver.
"""

from __future__ import annotations

import html
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.operators import findings, schedule, xref

# Order and titles of the nine checks.
TITLES = {
    "cp": "CP Identification", "constraints": "Constraint-Driven CP", "open_ends": "Open Ends on CP", "relationships": "Relationship Quality", "lags": "Lag Analysis",
    "oos": "Out of Sequence", "near": "Near-Critical", "continuity": "Logic Continuity", "saturation": "Constraint Saturation",
}
COLOURS = {"PASS": "#22c55e", "GREEN": "#22c55e", "INFO": "#3b82f6", "WARN": "#f59e0b", "AMBER": "#f59e0b", "BLOCK": "#ef4444", "RED": "#ef4444"}
PRIORITIES = {1: "Critical", 2: "High", 3: "Medium"}


def rows_of(df: DataFrame, proj_id: str) -> list[dict]:
    """The rows of one project."""
    return [r.asDict(recursive=True) for r in df.where(df["proj_id"] == proj_id).toLocalIterator()]


def rating(score: float) -> str:
    return "GREEN" if score >= 80 else "AMBER" if score >= 40 else "RED"


def assemble(project: DataFrame, tasks: DataFrame, edges: DataFrame, taskrsrc: DataFrame, baseline: DataFrame | None = None, index: int = 0, profile: str | dict[str, float] = "commercial") -> dict:
    """All results of one project as one nested document: header, checks, lists, health report.

    ``index`` picks a project by falling number of activities; with a single project it is
    ignored. A number out of range is an error. Lists are whole, never cut short.
    """
    picks = {r["pick"]: r["proj_id"] for r in schedule.pick_projects(project, tasks).where(F.col("pick") <= index).collect()}
    at = index if len(picks) > 1 or index == 0 else (0 if project.select("proj_id").distinct().count() <= 1 else index)
    if at not in picks:
        raise IndexError(f"no project {index}")
    pid = picks[at]
    head = project.where(F.col("proj_id") == pid).first().asDict()
    scores = schedule.all_scores(project, tasks, edges)
    overall = rows_of(schedule.confidence(project, scores), pid)[0]
    lists = {
        "critical_activities": schedule.critical_activities(tasks, edges), "near_critical": schedule.near_critical(tasks), "open_ends": schedule.open_ends(tasks, edges),
        "out_of_sequence": schedule.out_of_sequence(edges), "lags": schedule.lags(edges), "disconnected": schedule.disconnected(tasks, edges), "recommendations": schedule.recommendations(tasks, edges),
        "critical_paths": schedule.path_groups(tasks, edges), "continuity_gaps": schedule.continuity_gaps(edges),
    }
    out = {name: rows_of(df, pid) for name, df in lists.items()}
    out["recommendations"].sort(key=lambda r: r["priority"])
    checks = schedule.health_checks(project, tasks, edges, taskrsrc, profile)
    bei = schedule.execution_index(baseline if baseline is not None else tasks.limit(0), tasks, profile)
    report = rows_of(findings.health_report(project, checks, bei, lists["critical_paths"], lists["continuity_gaps"]), pid)
    passed = sum(r["severity"] == "PASS" for r in report if r["check_id"] in findings.CHECKS)
    values = {r["check_id"]: r["value"] for r in report}
    return {
        "project": head, "data_date": head.get("last_recalc_date") or "", "counters": rows_of(schedule.counters(project, tasks), pid)[0],
        "checks": {n: rows_of(df, pid)[0] | {"title": TITLES[n], "rating": rating(overall[f"s_{n}"])} for n, df in scores.items()},
        "overall_score": round(overall["overall"], 1), "overall_rating": overall["band"], "overall_confidence": overall["confidence"], **out,
        "dcma_14": {"profile": profile if isinstance(profile, str) else "custom", "dcma_score": passed, "cpli": values.get("DCMA-14-CPLI"), "bei": values.get("BEI"), "n_paths": len({r["path"] for r in out["critical_paths"]}), "report": report,
                    "counts": {s: sum(r["severity"] == s for r in report) for s in findings.SEVERITIES}},
    }


def to_json(results: Mapping) -> str:
    return json.dumps(results, default=str, ensure_ascii=False, indent=1)


def summary(project: DataFrame, task: DataFrame, taskpred: DataFrame, calendar: DataFrame, projwbs: DataFrame, taskrsrc: DataFrame, file: Mapping | None = None, most: int = 50) -> dict:
    """The summary of one file, with a list for each part; ``most`` bounds the list of critical
    activities, and a note tells what it leaves out."""
    take = lambda df: [r.asDict(recursive=True) for r in df.toLocalIterator()]
    critical = take(xref.critical_list(task, most))
    n_critical = sum(r["by_float"] for r in take(xref.critical_counts(task)))
    return {
        "file": dict(file or {}), "project": take(xref.project_header(project)), "metrics": take(xref.schedule_metrics(task)), "breakdown": take(xref.breakdown(task)), "critical_counts": take(xref.critical_counts(task)),
        "critical_list": critical, "critical_note": f"{n_critical - len(critical)} more are not listed" if n_critical > len(critical) else "", "float_distribution": take(xref.float_distribution(task, calendar)),
        "relationships": take(xref.relationship_types(taskpred)), "lags": take(xref.lagged_relationships(taskpred)), "open_ends": take(xref.summary_open_ends(task, taskpred)), "calendars": take(xref.calendar_list(calendar)),
        "wbs": take(xref.wbs_rollup(projwbs, task)), "resources": take(xref.resource_use(taskrsrc)), "constraints": take(xref.constraint_counts(task)),
    }


def to_text(parts: Mapping, width: int = 78) -> str:
    """Fixed-width text: a heading for each part, its rows as aligned columns."""
    lines = ["=" * width, "SCHEDULE SUMMARY", "=" * width]
    for name, part in parts.items():
        if part in ("", [], {}):
            continue
        lines += ["", name.replace("_", " ").upper(), "-" * width]
        rows = part if isinstance(part, list) else [part] if isinstance(part, Mapping) else None
        if rows is None:
            lines.append(f"  {part}")
            continue
        cols = list(rows[0])
        cells = [cols, *[["" if r[c] is None else f"{r[c]:.2f}" if isinstance(r[c], float) else str(r[c]) for c in cols] for r in rows]]
        wide = [max(len(r[i]) for r in cells) for i in range(len(cols))]
        lines += ["  " + "  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in cells]
    return "\n".join(lines) + "\n"


def cell(value: object) -> str:
    """A value as escaped HTML."""
    return html.escape("–" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value))


def _table(rows: list[dict], skip: tuple[str, ...] = ("proj_id",)) -> str:
    if not rows:
        return "<p>None.</p>"
    cols = [c for c in rows[0] if c not in skip]
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in cols) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(f'<th>{cell(c)}</th>' for c in cols)}</tr>{body}</table>"


def _mark(word: str) -> str:
    return f'<b style="color:{COLOURS.get(word, "#6b7280")}">{cell(word)}</b>'


def scorecard_html(dcma: Mapping) -> str:
    """The health checks as a fragment: score, indices, and every finding by its id."""
    if not dcma:
        return ""
    score = dcma["dcma_score"]
    colour = COLOURS["PASS" if score >= 13 else "WARN" if score >= 10 else "BLOCK"]
    rows = "".join(f"<tr><td>{cell(r['check_id'])}</td><td>{_mark(r['severity'])}</td><td>{cell(r['value'])}</td><td>{cell(r['threshold'])}</td></tr>" for r in sorted(dcma["report"], key=lambda r: r["check_id"]))
    return (
        f'<section class="scorecard"><h2>DCMA 14-Point Scorecard</h2><p>Profile: {cell(dcma["profile"])}</p><p style="color:{colour};font-size:2em">{score}/14</p>'
        f'<p>CPLI: {cell(dcma["cpli"])} BEI: {cell(dcma["bei"])} Critical paths: {cell(dcma["n_paths"])}{" (multiple)" if dcma["n_paths"] > 1 else ""}</p>'
        f"<table><tr><th>Check</th><th>Severity</th><th>Value</th><th>Threshold</th></tr>{rows}</table></section>"
    )


def _gauge(score: float, colour: str) -> str:
    """A ring that is filled as far as the score goes."""
    return f'<svg viewBox="0 0 36 36" width="120"><circle cx="18" cy="18" r="15.9" fill="none" stroke="#ddd" stroke-width="3"/><circle cx="18" cy="18" r="15.9" fill="none" stroke="{colour}" stroke-width="3" stroke-dasharray="{score:.1f} 100" transform="rotate(-90 18 18)"/><text x="18" y="21" text-anchor="middle" font-size="8">{score:.1f}</text></svg>'


def to_html(results: Mapping) -> str:
    """A page that needs nothing else: score, counters, a card for each check, scorecard and lists."""
    pid = results["project"].get("proj_id", "")
    cards = "".join(
        f"<section><h3>{cell(c['title'])} {_mark(c['rating'])} {cell(c['score'])}</h3>{_table([{k: v for k, v in c.items() if k not in ('title', 'rating', 'proj_id')}])}</section>"
        for c in (results["checks"][n] for n in TITLES)
    )
    counters = " ".join(f"<span>{cell(k.removeprefix('n_').replace('_', ' '))}: <b>{cell(v)}</b></span>" for k, v in results["counters"].items() if k != "proj_id")
    told = [{"priority": PRIORITIES[r["priority"]], "finding": r["kind"], "activity": r["task_id"] or "whole schedule"} for r in results["recommendations"]]
    lists = {"Recommendations": told, "Critical activities": results["critical_activities"], "Near-critical": sorted(results["near_critical"], key=lambda r: r["tf999"]), "Open ends": results["open_ends"], "Out of sequence": results["out_of_sequence"], "Disconnected": results["disconnected"]}
    style = "body{font-family:sans-serif;margin:2em}section{border:1px solid #ccc;border-radius:6px;padding:1em;margin:1em 0}td,th{padding:.2em .8em;text-align:left}span{margin-right:1.5em}"
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>Critical Path Validation Report</title><style>{style}</style></head><body><h1>Critical Path Validation Report</h1>"
        f"<p>Project {cell(pid)} {cell(results['project'].get('proj_short_name', ''))}. Data date: {cell(results['data_date'] or '(not set)')}.</p>"
        f"<section><h2>CP Confidence Score</h2>{_gauge(results['overall_score'], COLOURS[results['overall_rating']])}<p>{_mark(results['overall_rating'])} {cell(results['overall_confidence'])}</p></section>"
        f"<p>{counters}</p>{cards}{scorecard_html(results['dcma_14'])}" + "".join(f"<section><h2>{cell(n)}</h2>{_table(rows)}</section>" for n, rows in lists.items()) + "</body></html>"
    )
