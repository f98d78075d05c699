"""Work-calendar text to work days, holidays and exceptions."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.exprs import number

SHAPE = "work_days array<int>, holidays array<string>, special_workdays array<string>"
# A time slot of the format, and two older spellings of a work day.
_SLOT = re.compile(r"\(s\|\d{1,2}:\d{2}\|f\|\d{1,2}:\d{2}\)")


_OLD_DAYS = [r"\(d\|([1-7])\)", r"d\|([1-7])\(s\|"]


def _inside(text: str, at: int) -> str:
    """The bracketed group that opens at or after ``at``, without its brackets."""
    start = text.find("(", at)
    level = 0
    for i in range(start, len(text)) if start >= 0 else ():
        level += (text[i] == "(") - (text[i] == ")")
        if level == 0:
            return text[start + 1 : i]
    return text[start + 1 :] if start >= 0 else ""


def _groups(text: str) -> list[str]:
    """Top-level bracketed groups of a text."""
    out, level, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch == "(":
            if level == 0:
                start = i
            level += 1
        elif ch == ")" and level:
            level -= 1
            if level == 0:
                out.append(text[start + 1 : i])
    return out


def _day(raw: str) -> str:
    if re.fullmatch(r"\d{5,6}", raw):
        day = date(1899, 12, 30) + timedelta(days=int(raw))
    else:
        try:
            day = date.fromisoformat(raw)
        except ValueError:
            return ""
    return day.isoformat() if 1990 <= day.year <= 2050 else ""


def read_calendar(text: str | None) -> tuple[list[int], list[str], list[str]]:
    """Work days (0 is Sunday), holidays and special work days, each sorted and distinct.

    A day of the week works if its group holds a time slot. Dates of exceptions are looked for at
    any depth: one followed by a group with a slot is a special work day, any other a holiday.
    Null, empty and unreadable text gives none.
    """
    text = text or ""
    work: set[int] = set()
    holidays: set[str] = set()
    special: set[str] = set()
    at = text.find("DaysOfWeek")
    if at >= 0:
        # DaysOfWeek()( ... ): the second group holds the days.
        rest = text[at + len("DaysOfWeek") :]
        body = _inside(rest, rest.find(")") + 1) if rest.startswith("()") else _inside(rest, 0)
        for group in _groups(body):
            m = re.match(r"\s*0\|\|([1-7])\(\)", group)
            if m and _SLOT.search(group):
                work.add(int(m[1]) - 1)
        if not work:
            work = next((found for found in ({int(n) - 1 for n in re.findall(p, body)} for p in _OLD_DAYS) if found), set())
    at = text.find("Exceptions")
    if at >= 0:
        rest = text[at + len("Exceptions") :]
        body = _inside(rest, rest.find(")") + 1) if rest.startswith("()") else _inside(rest, 0)
        bare: set[str] = set()
        for m in re.finditer(r"d\|(\d{4}-\d{2}-\d{2}|\d+)", body):
            day, rest = _day(m[1]), body[m.end() :].removeprefix(")").lstrip(" \t\r\n")
            if day and rest.startswith("("):
                (special if _SLOT.search(_inside(rest, 0)) else holidays).add(day)
            elif day:
                bare.add(day)
        holidays |= bare - special
    return sorted(work), sorted(holidays), sorted(special)


def calendar_days(texts: Column) -> Column:
    """:func:`read_calendar` batch by batch; calendars are few, and their grammar nests."""

    @F.pandas_udf(SHAPE)
    def read(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_calendar(t) for t in batch], columns=["work_days", "holidays", "special_workdays"])

    return read(texts)


def calendar_map(calendar: DataFrame, order: str | None = None) -> DataFrame:
    """One row per clndr_id: decoded days, hours_per_day (8 if unreadable), hours_per_week (40).

    Of repeated ids the last by ``order`` counts.
    """
    rows = calendar
    if order:
        rows = rows.groupBy("clndr_id").agg(F.max_by(F.struct(*[c for c in calendar.columns if c != "clndr_id"]), order).alias("r")).select("clndr_id", "r.*")
    hours = lambda c, d: F.coalesce(number(c), F.lit(float(d)))
    return rows.withColumn("days", calendar_days(F.col("clndr_data"))).select("clndr_id", "clndr_name", "days.*", hours("day_hr_cnt", 8).alias("hours_per_day"), hours("week_hr_cnt", 40).alias("hours_per_week"))
