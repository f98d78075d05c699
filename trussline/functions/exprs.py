"""Column expressions over schedule fields, all of them built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of activity types, statuses and constraints.
EXCLUDED_TYPES = ["TT_WBS", "TT_LOE"]
# Labels of statuses.
STATUS_LABELS = {"TK_NotStart": "Not Started", "TK_Active": "In Progress", "TK_Complete": "Complete"}
# Labels of activity types.
TYPE_LABELS = {"TT_Task": "Task Dependent", "TT_Rsrc": "Resource Dependent", "TT_Mile": "Start Milestone", "TT_FinMile": "Finish Milestone", "TT_LOE": "Level of Effort", "TT_WBS": "WBS Summary"}
MILESTONE_TYPES = ["TT_Mile", "TT_FinMile"]
MANDATORY = ["CS_MANDSTART", "CS_MANDFIN"]
PINNED = ["CS_MSO", "CS_MEO"]
SOFT = ["CS_MSOA", "CS_MSOB", "CS_MEOA", "CS_MEOB"]
HARD = MANDATORY + PINNED

_NUMBER = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\s*$"
_NAMED = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def number(c: Column | str) -> Column:
    """Double of a decimal, exponent, infinity or NaN spelling; null for anything else."""
    s = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.trim(F.regexp_replace(s, r"[\s_]", "")), "^\\+", "")
    word = F.lower(plain)
    named = F.when(word.endswith("nan"), F.lit(float("nan"))).when(word.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(s.rlike(_NUMBER), plain.try_cast("double")).when(s.rlike(_NAMED), named)


def number_or(c: Column | str, default: float) -> Column:
    return F.coalesce(number(c), F.lit(float(default)))


def moment(c: Column | str) -> Column:
    """Timestamp of ``Y-M-D H:M``, ``Y-M-D H:M:S`` or ``Y-M-D``, unpadded parts allowed."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    read = lambda n, f: F.try_to_timestamp(F.substring(s, 1, n), F.lit(f)).cast("timestamp_ntz")
    return F.coalesce(read(16, "y-M-d H:m"), read(19, "y-M-d H:m:s"), read(10, "y-M-d"))


def days(hours: Column | str, per_day: Column | str | None, default: float = 8.0) -> Column:
    """Hours as working days; an absent or non-positive day length counts as ``default``."""
    per = F.lit(None).cast("double") if per_day is None else (F.col(per_day) if isinstance(per_day, str) else per_day)
    return number_or(hours, 0.0) / F.when(per > 0, per).otherwise(F.lit(default))


def days_or_zero(hours: Column | str, per_day: Column, digits: int | None = None) -> Column:
    """Hours as working days; 0 for an unreadable duration or a non-positive day length."""
    out = F.when(per_day > 0, number_or(hours, 0.0) / per_day).otherwise(F.lit(0.0))
    return out if digits is None else F.bround(out, digits)


def percent_complete(physical: Column, actual: Column, target: Column, remain: Column) -> Column:
    """The first reported percentage within 0 to 100, else the share of the duration used up."""
    given = [F.when(number(c).between(0, 100), number(c)) for c in (physical, actual)]
    t = number_or(target, 0.0)
    r = F.coalesce(number(remain), t)
    return F.coalesce(*given, F.when(t > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (t - r) / t))), F.lit(0.0))


def labelled(c: Column | str, labels: dict[str, str]) -> Column:
    """The label of a code; an unknown code itself."""
    code = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[code], code)


def is_work(c: Column | str = "task_type") -> Column:
    return ~F.coalesce((F.col(c) if isinstance(c, str) else c).isin(EXCLUDED_TYPES), F.lit(False))


def tier(c: Column) -> Column:
    """How hard a constraint code binds."""
    return F.when(c.isin(MANDATORY), "ABSOLUTE").when(c.isin(PINNED), "DATE").when(c.isin(SOFT), "SOFT").when(c == "CS_ALAP", "PREFERENCE")


def has_hard(*slots: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c.isin(HARD), F.lit(False)) for c in slots])


def serial_date(c: Column | str) -> Column:
    """ISO date of a spreadsheet serial or an ISO date from 1990 to 2050; ``''`` for anything else."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    day = F.coalesce(F.when(s.rlike(r"^\d{5,6}$"), F.date_add(F.lit("1899-12-30").cast("date"), s.try_cast("int"))), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date")))
    return F.when(F.year(day).between(1990, 2050), F.date_format(day, "yyyy-MM-dd")).otherwise("")


def is_work_day(day: Column, work_days: Column, holidays: Column) -> Column:
    """Whether the calendar works that day; Sunday is day 0."""
    return F.array_contains(work_days, F.dayofweek(day) - 1) & ~F.array_contains(holidays, F.date_format(day, "yyyy-MM-dd"))


def work_days_between(start: Column, end: Column, work_days: Column, holidays: Column) -> Column:
    """Working days from start to end, both included; 0 if the end is earlier, null if either is."""
    each = F.sequence(start, end)
    return F.when(end < start, 0).when(start.isNotNull() & end.isNotNull(), F.size(F.filter(each, lambda d: is_work_day(d, work_days, holidays))))


def add_work_days(day: Column, n: Column, work_days: Column, holidays: Column) -> Column:
    """The n-th working day after ``day`` (before it for a negative n); 0 gives the day itself.

    A calendar without work days gives null.
    """
    steps = F.abs(n)
    reach = F.ceil((steps + F.size(holidays)) * 7 / F.nullif(F.size(work_days), F.lit(0))).cast("int") + 7
    ahead = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, reach)), lambda d: is_work_day(d, work_days, holidays))
    back = F.filter(F.sequence(F.date_sub(day, 1), F.date_sub(day, reach)), lambda d: is_work_day(d, work_days, holidays))
    return F.when(n == 0, day).when(n > 0, F.get(ahead, steps - 1)).otherwise(F.get(back, steps - 1))
