"""Findings of the health checks as rows, and their report per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities, and the names and sources of the checks in order of their numbers.
SEVERITIES = ["BLOCK", "WARN", "INFO", "PASS"]
CHECKS = [
    "DCMA-01-Logic", "DCMA-02-Leads", "DCMA-03-Lags", "DCMA-04-Relationship", "DCMA-05-Hard", "DCMA-06-HighFloat", "DCMA-07-NegFloat", "DCMA-08-HighDuration",
    "DCMA-09-InvalidDates", "DCMA-10-Resources", "DCMA-11-InvalidDatesFuture", "DCMA-12-ResourceCoverage", "DCMA-13-MissedTasks", "DCMA-14-CPLI",
]


def severity(c: Column) -> Column:
    """The severity itself; any other value is an error when the row is read."""
    return F.when(c.isin(SEVERITIES), c).otherwise(F.raise_error(F.concat(F.lit("no severity: "), F.coalesce(c, F.lit("null"))).cast("string")))


def health_report(project: DataFrame, checks: DataFrame, index: DataFrame, paths: DataFrame, gaps: DataFrame) -> DataFrame:
    """proj_id, check_id, severity, value, threshold: the fourteen checks of each project, the
    execution index of the whole, several critical paths, and gaps in the critical path.

    ``index`` is one row and holds for every project. A project with one critical path or none
    has no finding about several.
    """
    names = F.array(*[F.lit(c) for c in CHECKS])
    none = F.lit(None).cast("double")
    every = checks.select("proj_id", F.get(names, (F.col("check_id") - 1).cast("int")).alias("check_id"), severity(F.col("severity")).alias("severity"), "value", "threshold")
    ids = project.select("proj_id").distinct()
    one = index.first()
    bei = ids.select("proj_id", F.lit("BEI").alias("check_id"), severity(F.lit(one["severity"])).alias("severity"), F.lit(one["bei"]).cast("double").alias("value"), F.lit(0.95).alias("threshold"))
    n = paths.groupBy("proj_id").agg(F.count_distinct("path").cast("double").alias("value")).where("value > 1")
    several = n.select("proj_id", F.lit("DCMA-Ext-MultipleCP").alias("check_id"), F.lit("INFO").alias("severity"), "value", none.alias("threshold"))
    broken = ids.join(gaps.groupBy("proj_id").agg(F.count(F.lit(1)).cast("double").alias("value")), "proj_id", "left").fillna(0.0, ["value"])
    gap = broken.select("proj_id", F.lit("DCMA-Ext-CPContinuity").alias("check_id"), F.when(F.col("value") > 0, "WARN").otherwise("PASS").alias("severity"), "value", none.alias("threshold"))
    return every.unionByName(bei).unionByName(several).unionByName(gap)


def counts(findings: DataFrame) -> DataFrame:
    """Findings of each severity per project, and whether any of them blocks."""
    n = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES]
    return findings.groupBy("proj_id").agg(*n, F.max(F.col("severity") == "BLOCK").alias("has_blocking"))
